"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each place of a word. For each place
the best score of a path to it and that path's number of pieces are carried along; no path is kept.

The rules are those of the ``tokenizers`` library's Unigram model: scores add up in double precision;
a longer last piece wins a tie, as it starts earlier and later ones must be strictly better; a
character that is no piece costs the least score less 10; unknown characters count as their UTF-8
bytes where the vocabulary has byte pieces, else each run of them counts as one. Blanks become U+2581,
one is put in front of a text that has none there, and each begins a new word. Words are scored once
per worker and looked up afterwards.

Defined cases: null texts count as empty ones (no tokens); very long texts are read whole; repeated rows
each come back; a null doc_id is kept; other columns pass through, but one named like the new column is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.vocab import vocabulary_path
from quarry.session import small_batches, table

NAME = "op5_token_counts"
SQL = None

BLANK = "▁"
_CACHE_WORDS = 1_000_000
_TEXTS = 128
_counters: dict[str, Counter] = {}


def load_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces and scores of a sentencepiece model that may match text; has it all byte pieces?"""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return plain, sum(sp.is_byte(i) for i in range(n)) == 256


class Counter:
    """Counts the pieces of the best path of each word."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - 10.0
        self.bytes_known = bytes_known
        self.known: dict[str, int] = {}
        # no piece crosses a character that none contains, so words can be cut there
        inside = set().union(*(p for p, _ in pieces))
        self.breaks = [c for c in "\n\t\r" if c not in inside]
        self.cut = re.compile("([" + "".join(map(re.escape, self.breaks)) + "]+)") if self.breaks else None

    @classmethod
    def shared(cls, path: str) -> Counter:
        if path not in _counters:
            _counters[path] = cls(*load_vocabulary(path))
        return _counters[path]

    def count_word(self, word: str) -> int:
        n = len(word)
        best, count, last_unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(word):
            ends[end].append((length, score))
        for end in range(n):
            top = None
            for length, score in sorted(ends[end], reverse=True):  # the longest first: it wins ties
                start = end + 1 - length
                if best[start] is not None and (top is None or best[start] + score > top):
                    top, count[end + 1], last_unknown[end + 1] = best[start] + score, count[start] + 1, False
            if word[end] not in self.single and (top is None or best[end] + self.unknown > top):
                top = best[end] + self.unknown
                size = len(word[end].encode("utf-8", "surrogatepass")) if self.bytes_known else int(not last_unknown[end])
                count[end + 1], last_unknown[end + 1] = count[end] + size, True
            best[end + 1] = top
        return count[n]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text if text[0] in (" ", BLANK) else " " + text
        parts = text.replace(BLANK, " ").split(" ")[1:]
        if self.bytes_known and self.cut and self.cut.search(text):
            out = []
            for p in parts:
                first, *rest = self.cut.split(p)
                out.append(BLANK + first)
                out += [x for x in rest if x]
            return out
        return [BLANK + p for p in parts]

    def __call__(self, texts: list[str]) -> Iterator[int]:
        for at in range(0, len(texts), _TEXTS):
            cut_up = [self.words(t) for t in texts[at : at + _TEXTS]]
            words = set().union(*cut_up)
            new = list(filterfalse(self.known.__contains__, words))
            if len(self.known) + len(new) > _CACHE_WORDS:
                self.known.clear()
                new = list(words)
            for w in new:
                self.known[w] = self.count_word(w)
            for w in cut_up:
                yield sum(map(self.known.__getitem__, w))


def count_tokens(docs: DataFrame, path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text added as column ``to``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter.shared(path)
        for texts in batches:
            yield pd.Series(np.fromiter(counter(["" if t is None else t for t in texts]), np.int64, len(texts)))

    small_batches(docs.sparkSession)
    return docs.withColumn(to, count(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary_path("piece_bpe_32k.model")).select("doc_id", "n_tokens")
