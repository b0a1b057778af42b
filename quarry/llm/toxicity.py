"""Toxicity by weak supervision.

1. A bounded sample of labelled rows yields lexicons: words and word stems that toxic texts have far
   more often. They are dealt to lexicon voters; pattern voters look at shouting, symbols, repeated
   words and density. One pass over all whole texts gives each document its votes (toxic, clean or
   no vote) and a short feature vector.
2. A generative label model over the vote patterns of all documents: expectation maximisation
   estimates each voter's accuracy given the class, and the correlations of voters as a tree of
   class-conditional pair tables (the tree of greatest conditional mutual information). Given labels
   take part as one more voter of a fixed, small error rate. Only pattern counts reach the driver; there are at most 3^voters.
3. A linear (logistic) classifier is trained on the posterior labels of the sampled rows, and of as
   many without a label, and scores every document. Labels, lang, source and doc_id never enter a score.

Rows with crc32(doc_id as text) mod 5 = 0 are held out: their labels are read by no step.

Defined cases: null and empty texts have no words and get the score of the classifier's constant alone
(below 0.5 unless most texts are toxic); very long texts are read whole, and extra columns pass through
the stored rows whatever their names; a doc_id that
is labelled twice has its mean label (a tie is toxic); null labels count as absent; repeated rows
each come back; a null doc_id counts as the text ''; without any usable label every score is the
prior 0.5 cut to "not toxic" by a score of 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import Scratch, cut, small_batches, table

NAME = "op4_toxicity"
SQL = None

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6, 7)
_LEXICONS = 4  # voters of each kind
_PATTERNS = 5
VOTERS = 2 * _LEXICONS + _PATTERNS
_LABEL_NOISE = 0.05
_SURE = 24.0  # least G2 of a term: beyond what chance gives among a million terms
_STATS = 2 * _LEXICONS + 8


@dataclass(frozen=True)
class Lexicon:
    """Words and stems with their place in the feature vector."""

    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return _STATS + len(self.words) + len(self.stems)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _terms(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: in how many toxic and other sampled texts does a word or (twice) a stem occur."""
    seen: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            terms, stems = _terms(text), Counter()
            for w, n in terms.items():
                for k in _STEMS:
                    if len(w) >= k:
                        stems[w[:k]] += n
            keys = ["=" + w for w in terms if len(w) > 2] + ["~" + s for s, n in stems.items() if n > 1]
            for key in keys:
                seen.setdefault(key, [0, 0])[toxic] += 1
        if len(seen) > 1_000_000:
            yield _term_frame(seen)
            seen = {}
    if seen:
        yield _term_frame(seen)


def _term_frame(seen: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"term": list(seen), "n0": [v[0] for v in seen.values()], "n1": [v[1] for v in seen.values()]})


def build_lexicon(sample: DataFrame, words: int = 80, stems: int = 80) -> Lexicon:
    """The terms whose log-odds of toxic against other texts exceed 1.5, by the likelihood ratio G2."""
    total = sample.agg(F.sum("toxic"), F.count("*")).first()
    toxic, rest = int(total[0] or 0), int(total[1] or 0) - int(total[0] or 0)
    if not toxic or not rest:
        return Lexicon()
    counts = sample.select("text", "toxic").mapInPandas(_count_terms, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    odds = F.log((n1 + 0.5) / (toxic - n1 + 0.5)) - F.log((n0 + 0.5) / (rest - n0 + 0.5))
    part = lambda n, size: F.when(n > 0, n * F.log(n * (toxic + rest) / ((n0 + n1) * size))).otherwise(0.0)
    g2 = 2 * (part(n1, toxic) + part(n0, rest))
    scored = cut(counts.filter("n1 >= 3").select("term", odds.alias("odds"), g2.alias("g2")).filter((F.col("odds") > 1.5) & (F.col("g2") > _SURE)))
    best = {}
    for mark, most in (("=", words), ("~", 6 * stems)):
        top = scored.filter(F.col("term").startswith(mark)).orderBy(F.desc("g2"), "term").limit(most).collect()
        best[mark] = [r["term"][1:] for r in top]
    kept: list[str] = []
    for s in best["~"]:  # one of nested stems is enough
        if len(kept) < stems and not any(s.startswith(t) or t.startswith(s) for t in kept):
            kept.append(s)
    at = _STATS
    chosen = {w: at + i for i, w in enumerate(best["="])}
    return Lexicon(chosen, {s: at + len(chosen) + i for i, s in enumerate(kept)})


def examine(text: str | None, lex: Lexicon) -> tuple[list[int], dict[int, float]]:
    """Votes (1 toxic, -1 clean, 0 none) and features of one whole text."""
    text = text or ""
    terms = _terms(text)
    n = sum(terms.values())
    hits: Counter = Counter()
    by_voter = [0] * (2 * _LEXICONS)
    for w, c in terms.items():
        at = lex.words.get(w)
        if at is not None:
            hits[at] += c
            by_voter[at % _LEXICONS] += c
        for k in _STEMS:
            if len(w) >= k and (at := lex.stems.get(w[:k])) is not None:
                hits[at] += c
                by_voter[_LEXICONS + at % _LEXICONS] += c
    words, stems = sum(by_voter[:_LEXICONS]), sum(by_voter[_LEXICONS:])
    density = 100 * (words + stems) / n if n else 0.0
    shout = text.count("!!") / (n + 1)
    symbols = sum(text.count(c) for c in "#$%&*|") / (n + 1)
    repeat = max(terms.values(), default=0) / (n + 1)
    votes = [int(x >= 1) for x in by_voter[:_LEXICONS]] + [int(x >= 2) for x in by_voter[_LEXICONS:]]
    votes += [int(words >= 2), int(stems >= 3), 1 if density > 1 else -1 if density < 0.1 else 0, int(shout > 0.3), int(symbols > 0.5 or repeat > 0.5)]
    stats = [float(np.log1p(x)) for x in by_voter] + [float(np.log1p(words)), float(np.log1p(stems)), min(density, 20.0) / 5, float(np.log1p(n)) / 5, shout, min(symbols, 3.0), repeat, 1.0]
    features = {i: x for i, x in enumerate(stats) if x}
    features.update((i, float(np.log1p(c))) for i, c in hits.items())
    return votes, features


def _examiner(lex: Lexicon):
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [examine(t, lex) for t in texts]
        return pd.DataFrame(
            {
                "pattern": ["".join("-0+"[v + 1] for v in votes) for votes, _ in found],
                "at": [sorted(f) for _, f in found],
                "value": [[f[i] for i in sorted(f)] for _, f in found],
            }
        )

    return F.pandas_udf(run, "pattern string, at array<int>, value array<double>")


@dataclass
class LabelModel:
    """P(class) and P(vote | class, vote of the parent voter), voters in the order of the tree."""

    prior: float
    order: list[tuple[int, int]]
    tables: list[np.ndarray]  # [class, parent's vote, vote]

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        out = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(votes), 0)
        for (v, parent), t in zip(self.order, self.tables, strict=True):
            up = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            out += np.log(t[:, up, votes[:, v]]).T
        return out

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) given the votes and a label (0 clean, 1 none, 2 toxic) that errs at _LABEL_NOISE."""
        j = self.log_joint(votes)
        right, wrong = np.log(1 - _LABEL_NOISE), np.log(_LABEL_NOISE)
        j[:, 0] += np.choose(label, (right, 0, wrong))
        j[:, 1] += np.choose(label, (wrong, 0, right))
        return 1 / (1 + np.exp(np.clip(j[:, 0] - j[:, 1], -50, 50)))


def fit_label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over vote patterns. votes: [pattern, voter] in 0, 1, 2; start: first guess of P(toxic)."""
    n, m = votes.shape
    onehot = np.eye(3)[votes]  # [pattern, voter, vote]
    post = start
    for _ in range(rounds):
        mass = np.stack([weight * (1 - post), weight * post])  # [class, pattern]
        prior = float(np.clip(mass[1].sum() / mass.sum(), 1e-4, 0.5))
        pair = np.einsum("cp,piv,pjw->cijvw", mass, onehot, onehot, optimize=True) + 0.1
        joint = pair / pair.sum((0, 3, 4), keepdims=True)
        one = joint.sum(4, keepdims=True)
        two = joint.sum(3, keepdims=True)
        info = (joint * np.log(joint * joint.sum((3, 4), keepdims=True) / (one * two))).sum((0, 3, 4))
        order, inside = [(0, -1)], {0}
        while len(inside) < m:
            a, b = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda e: (info[e], -e[1]))
            order.append((b, a))
            inside.add(b)
        tables = []
        for v, parent in order:
            t = pair[:, parent, v] if parent >= 0 else pair[:, v, v].sum(1)[:, None, :].repeat(3, 1)
            tables.append(t / t.sum(2, keepdims=True))
        model = LabelModel(prior, order, tables)
        post = model.posterior(votes, label)
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _decode(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) for c in p] for p in patterns], int).reshape(len(patterns), -1)


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon and weights; without any usable label there are none, and nothing is toxic."""

    lexicon: Lexicon
    weights: np.ndarray | None

    def score(self, at: list[int], value: list[float]) -> float:
        if self.weights is None:
            return 0.0
        z = float(np.dot(self.weights[np.asarray(at, int)], value))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score_text(self, text: str | None) -> float:
        f = examine(text, self.lexicon)[1]
        return self.score(sorted(f), [f[i] for i in sorted(f)])

    def column(self, at: Column, value: Column) -> Column:
        """Score of each feature vector."""

        @F.pandas_udf("double")
        def score(at: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([self.score(i, v) for i, v in zip(at, value, strict=True)], dtype=float)

        return score(at, value)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_unlabelled: int = 12_000, keep: list[str] | None = None) -> tuple[ToxicityModel, DataFrame]:
    """The model, and for every row of ``docs``: doc_id, row (its columns ``keep``, or all), pattern of
    votes, features (at, value).

    ``max_labelled``: rows of the labelled sample that lexicons and the classifier are fitted on
    (about; chosen by a hash of doc_id). ``max_unlabelled``: rows without a label that may be read whose
    posteriors the classifier learns from as well. Vote statistics are over all documents.
    """
    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = work.put(known.filter(~held_out(F.col("doc_id"))))
    n_known = known.count()
    chosen = lambda most, n: F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < int(min(1.0, most / max(1, n)) * (1 << 20))
    picked = known.withColumn("picked", chosen(max_labelled, n_known))
    given = picked.filter("picked").select(F.col("doc_id").alias("_id"), "toxic")
    sample = work.put(docs.select("doc_id", "text").join(given, F.col("doc_id") == F.col("_id")).select("text", "toxic"))
    lex = build_lexicon(sample)

    row = F.struct(*(F.col(f"`{c}`") for c in (keep or docs.columns))).alias("row")
    seen = work.put(docs.select("doc_id", row, _examiner(lex)("text").alias("found")).select("doc_id", "row", "found.*"))
    n_seen = seen.count()
    marked = seen.select("doc_id", "pattern", "at", "value").join(picked.select(F.col("doc_id").alias("_id"), "toxic", "picked"), F.col("doc_id") == F.col("_id"), "left")
    marked = marked.withColumn("vote", F.expr("case toxic when 1 then '+' when 0 then '-' else '0' end"))
    counts = marked.groupBy(F.concat("vote", "pattern").alias("p")).count().collect()
    without = F.col("picked").isNull() & chosen(max_unlabelled, n_seen - n_known)
    train = marked.filter(F.coalesce("picked", without, F.lit(False))).select(F.concat("vote", "pattern").alias("p"), "at", "value").collect()
    work.clear(seen)
    if not lex.words and not lex.stems or not train:
        return ToxicityModel(lex, None), seen
    votes, weight = _decode([r["p"] for r in counts]), np.array([r["count"] for r in counts], float)
    label, votes = votes[:, 0], votes[:, 1:]
    lexical = (votes[:, : 2 * _LEXICONS + 3] == 2).sum(1)
    start = np.choose(label, (0.02, 0.0, 0.9)) + (label == 1) * np.where(lexical > 1, 0.9, np.where(lexical > 0, 0.4, 0.01))
    model = fit_label_model(votes, label, weight, start)
    x = np.zeros((len(train), lex.width))
    for i, r in enumerate(train):
        x[i, r["at"]] = r["value"]
    known_votes = _decode([r["p"] for r in train])
    return ToxicityModel(lex, fit_linear(x, model.posterior(known_votes[:, 1:], known_votes[:, 0]))), seen


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model, seen = fit_toxicity(docs, labels, max_labelled, keep=["doc_id"])
    scored = seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column(F.col("at"), F.col("value")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
