"""Token-id files: every document its own zstandard frame under one shared dictionary.

A dictionary is trained on the serialised ids of a bounded sample of documents. Documents are dealt
to tasks by ranges of the wanted order; each task encodes its documents in that order and streams
them into one file. A file can be opened at any document: it ends with an index of offsets.

File: magic ``QIDS0001`` | width of an id in bytes (u8) | SHA-256 of the dictionary (32 bytes) |
frames | index, per document: frame offset u64, frame length u32, tokens u32, doc_id i64, doc_id is
set u8 | index offset u64, documents u64, magic. Integers are little-endian. A file is written under
a temporary name and then renamed, with the same bytes whichever executor writes it, so a lost
executor's task can simply run again.

Words between blanks are encoded once per worker and looked up afterwards. That is exact where the
tokenizer's pieces never hold white space and its normaliser works within words, as in
``word_bpe_49k.json``; ``by_word=False`` encodes whole texts.

Defined cases: a null text is an empty one and holds only the end id; a null doc_id comes first;
rows of one doc_id are ordered by a hash of their text; very long texts are encoded whole, a frame each;
other columns are ignored, whatever their names; an empty table has no files and no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.vocab import vocabulary_path
from quarry.session import cut, shared_dir, small_batches, table

NAME = "op6_token_files"
SQL = None

MAGIC = b"QIDS0001"
_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("tokens", "<u4"), ("doc_id", "<i8"), ("set", "u1")])
_TAIL = struct.Struct("<QQ8s")
_CACHE_WORDS = 250_000  # and as many of those met before them
_TEXTS = 128  # cut up at once
# Texts of Latin letters without apostrophes can be cut further, into runs of letters and of other
# signs, and lower-cased here: each run is then a piece, or some pieces, of its own.
_LETTERS = "a-zªµºß-öø-ɏ"
_RUNS = re.compile(f"[{_LETTERS}]+|[^ \t\n\r\x0b\x0c\x85\xa0{_LETTERS}]+")
_RUN = re.compile(f"[{_LETTERS}]+")
_WORD_END = "</w>"  # fixed value: the mark of a piece's last id in the vocabulary
_ODD = re.compile("['İɐ-\U0010ffff]|<\\|")
_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Texts to ids, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word, self.known, self.before = Tokenizer.from_file(path), by_word, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for w, i in vocabulary.items() if w.endswith(_WORD_END)]] = True
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    @classmethod
    def shared(cls, path: str, by_word: bool) -> Encoder:
        """One a worker, so that its words last from task to task."""
        if (path, by_word) not in _encoders:
            _encoders[path, by_word] = cls(path, by_word)
        return _encoders[path, by_word]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Runs of letters, one piece each: many at once, told apart by the ids that end a word."""
        out: list[bytes] = []
        for at in range(0, len(runs), 1_000):
            part = runs[at : at + 1_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.final[ids]) + 1
            if len(stops) != len(part):
                out += self._encode(part)
                continue
            raw, stops = ids.tobytes(), (4 * stops).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_word:
            for t in texts:
                yield self._encode([t])[0]
            return
        for at in range(0, len(texts), _TEXTS):
            cut_up = [t.replace("\n", " ").replace("\t", " ").split(" ") if _ODD.search(t) else _RUNS.findall(t.lower()) for t in texts[at : at + _TEXTS]]
            looked_up = [list(map(self.known.get, words)) for words in cut_up]
            missing = {w for words, got in zip(cut_up, looked_up, strict=True) if None in got for w, ids in zip(words, got, strict=True) if ids is None}
            fresh = self._learn(missing) if missing else {}
            for words, got in zip(cut_up, looked_up, strict=True):
                if None in got:
                    got = [fresh[w] if ids is None else ids for w, ids in zip(words, got, strict=True)]
                yield b"".join(got)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodings of new words, which are also kept. When they are too many, those kept so far step back,
        and what had stepped back before is forgotten; a word that is met again comes forward."""
        fresh = {w: ids for w in words if (ids := self.before.get(w)) is not None}
        runs, rest = [], []
        for w in words.difference(fresh):
            (runs if w[:1].isalpha() and _RUN.fullmatch(w) else rest).append(w)
        fresh.update(zip(runs, self._encode_runs(runs), strict=True))
        for at in range(0, len(rest), 1_000):
            fresh.update(zip(rest[at : at + 1_000], self._encode(rest[at : at + 1_000]), strict=True))
        if len(self.known) + len(fresh) > _CACHE_WORDS:
            self.before, self.known = self.known, {}
        if len(fresh) <= _CACHE_WORDS:
            self.known.update(fresh)
        return fresh


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


class ShardWriter:
    """One file of frames and their index."""

    def __init__(self, path: str, dictionary: bytes, width: int, level: int):
        self.path, self.width = path, width
        self.fs, self.at = _open(path)
        self.temporary = f"{self.at}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.out.write(MAGIC + bytes([width]) + hashlib.sha256(dictionary).digest())
        self.place, self.index, self.tokens = 41, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zip.compress(_narrow(ids, self.width))
        self.out.write(frame)
        self.index.append((self.place, len(frame), len(ids) // 4, doc_id or 0, doc_id is not None))
        self.place += len(frame)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        self.out.write(np.array(self.index, _ENTRY).tobytes() + _TAIL.pack(self.place, len(self.index), MAGIC))
        self.out.close()
        try:
            self.fs.move(self.temporary, self.at)
        except OSError:  # some stores do not rename over the file of an earlier attempt, which has the same bytes
            self.fs.delete_file(self.at)
            self.fs.move(self.temporary, self.at)


class ShardReader:
    """Random access to the documents of one file."""

    def __init__(self, path: str, dictionary: bytes):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        head, tail = self.file.read_at(41, 0), _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if head[:8] != MAGIC or tail[2] != MAGIC or head[9:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} is no token file of this dictionary")
        self.width = head[8]
        self.index = np.frombuffer(self.file.read_at(_ENTRY.itemsize * tail[1], tail[0]), _ENTRY)
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        return np.frombuffer(self.unzip.decompress(self.file.read_at(int(e["length"]), int(e["offset"])), max_output_size=int(e["tokens"]) * self.width), f"<u{self.width}").astype("<u4")


def pieces(ids: bytes, width: int, number: int = 8, size: int = 2048) -> list[bytes]:
    """A document's ids whole if they are short, otherwise pieces spread evenly from its start to its end."""
    if len(ids) <= number * size:
        return [ids]
    room = (len(ids) - size) // width
    return [ids[at : at + size] for at in (i * room // (number - 1) * width for i in range(number))]


def train_dictionary(docs: DataFrame, tokenizer: str, by_word: bool, width: int, samples: int, size: int) -> bytes:
    """From about ``samples`` documents, chosen by a hash of doc_id; b'' if they are too few.

    Of documents of more than 16 KB of ids, eight pieces spread over the whole of them are taken.
    """
    n = docs.count()
    share = int(min(1.0, samples / max(n, 1)) * (1 << 20))
    picked = docs.filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(6)), F.lit(1 << 20)) < share).select("text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Encoder.shared(tokenizer, by_word)
        for b in batches:
            yield pd.DataFrame({"ids": [p for x in code(["" if t is None else t for t in b["text"]]) for p in pieces(_narrow(x, width), width)]})

    parts = [bytes(r["ids"]) for r in picked.mapInPandas(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, [p for p in parts if len(p) > 8]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, order: list[Column | str] | None = None, by_word: bool = True, samples: int = 1000, dictionary_bytes: int = 65536, level: int = 3
) -> tuple[DataFrame, bytes]:
    """Write ``docs`` in the order of ``order`` (doc_id); a row per file: shard, path, docs, tokens."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs.select("doc_id", "text"), tokenizer, by_word, width, samples, dictionary_bytes)
    end = np.array([end_id], "<u4").tobytes()
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary.zstd") as out:
        out.write(dictionary)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, shard, writer = Encoder.shared(tokenizer, by_word), TaskContext.get().partitionId(), None
        for b in batches:
            writer = writer or ShardWriter(f"{folder}/part-{shard:06d}.qids", dictionary, width, level)
            known = b["known"].to_numpy()
            for doc_id, is_set, ids in zip(b["id"].to_numpy(), known, code(b["text"].tolist()), strict=True):
                writer.add(int(doc_id) if is_set else None, ids + end)
        if writer:
            writer.close()
            yield pd.DataFrame({"shard": [shard], "path": [writer.path], "docs": [len(writer.index)], "tokens": [writer.tokens]})

    keys = [F.col(c) if isinstance(c, str) else c for c in (order or ["doc_id"])]
    named = {f"_k{i}": k for i, k in enumerate([*keys, F.xxhash64("text")])}
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"), *(k.alias(n) for n, k in named.items()))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, *named).sortWithinPartitions(*named).select("id", "known", "text")
    files = cut(rows.mapInPandas(write, "shard long, path string, docs long, tokens long"))
    for f in fs.get_file_info(pafs.FileSelector(at)):
        if f.path.endswith(".tmp"):  # of attempts that were lost
            fs.delete_file(f.path)
    return files, dictionary


def read_token_files(files: DataFrame, dictionary: bytes) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32, shard, at.

    One number per file reaches the driver, for the starts.
    """
    spark, start, rows = files.sparkSession, 0, []
    for r in files.orderBy("shard").collect():
        rows.append((r["shard"], r["path"], start))
        start += r["tokens"]
    listed = spark.createDataFrame(rows, "shard long, path string, start long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, path, at in zip(b["shard"], b["path"], b["start"], strict=True):
                reader = ShardReader(path, dictionary)
                n = reader.index["tokens"].astype(np.int64)
                crc = [zlib.crc32(reader.ids(i).tobytes()) for i in range(len(n))]
                ids = pd.Series(reader.index["doc_id"].astype(np.int64)).astype("Int64").where(reader.index["set"] == 1)
                yield pd.DataFrame({"doc_id": ids, "start": at + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(crc, np.int64), "shard": shard, "at": np.arange(len(n))})

    return listed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, at long")


def token_files(docs: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """Write under the shared folder and read back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    files, dictionary = write_token_files(docs, folder, vocabulary_path("word_bpe_49k.json"), 2, order)
    return read_token_files(files, dictionary)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
