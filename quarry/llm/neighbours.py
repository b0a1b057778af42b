"""Approximate nearest neighbours by multi-index hashing.

Learned on a bounded sample: a rotation (iterative quantisation) whose signs give 64-bit codes, and the
Hamming radius that holds nearly all true neighbours within the sample. Largest inner product is
turned into smallest angle by one more component that lifts all rows to the greatest norm.

Codes are cut into eight substrings, and each has a table of buckets. If two codes differ in at most
r = 8s + a bits, then one of the first a + 1 substrings differs in at most s bits or one of the others
in at most s - 1; so probing the buckets within these distances meets every code within the radius.
What lies within it is ranked by the inner product of the original vectors in double precision.

All rows are indexed, in blocks of bounded size; a block of queries meets each block of rows in one
task, which returns at most k rows a query. So each row is sent once for ``BLOCK_QUERIES`` queries, and
each query once for ``BLOCK_ROWS`` rows: where queries are a fixed share of the rows, this traffic, like
the work itself, grows with their product. Dealing rows by substring instead would not change that: with
a radius near half the bits a query probes a fixed share of all buckets. Queries that find fewer than k
rows (and than there are) search again with a larger radius.

Defined cases: a vector that is null, empty, zero, or holds a null, NaN or infinite component takes no
part, nor does one whose length differs from that of most rows (ties: the shorter) or whose vec_id is
null; queries are rows that take part; of rows that share a vec_id the one of the least vector takes
part; ties go to the smaller vec_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import Scratch, table

NAME = "op3_nearest"
SQL = None

PARTS = 8
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 8_192
#: Rows that are worth a task of their own.
LEAST_ROWS = 4_096
#: Components of the vectors in a block at most: fewer rows where vectors are long.
BLOCK_VALUES = 1 << 22
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass(frozen=True)
class Codes:
    """Binary codes of lifted vectors, and the radius to search."""

    top: float
    centre: np.ndarray
    turn: np.ndarray
    radius: int

    @classmethod
    def learn(cls, sample: np.ndarray, top: float, k: int, rounds: int = 30, share: float = 0.97) -> Codes:
        rng = np.random.default_rng(3)
        x = cls._lift(sample, top)
        centre = x.mean(0)
        wide = np.zeros((len(x), 64))
        _, _, axes = np.linalg.svd(x - centre, full_matrices=False)
        axes = axes[:64]
        wide[:, : len(axes)] = (x - centre) @ axes.T
        turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        for _ in range(rounds):  # signs of the rotated rows, then the rotation that fits them best
            u, _, v = np.linalg.svd(np.sign(wide @ turn).T @ wide)
            turn = (u @ v).T
        basis = np.zeros((x.shape[1], 64))
        basis[:, : len(axes)] = axes.T
        made = cls(top, centre, basis @ turn, 0)
        picks = rng.permutation(len(sample))[:256]
        codes, asked = made.rows(sample), made.queries(sample[picks])
        far = []
        for i, q in zip(picks, asked, strict=True):
            score = sample @ sample[i]
            score[i] = -np.inf
            best = np.argsort(-score)[: min(k, len(sample) - 1)]
            far.append(np.bitwise_count(codes[best] ^ q))
        far = np.concatenate(far) if far else np.zeros(0)
        return cls(top, centre, basis @ turn, int(np.quantile(far, share, method="higher")) if len(far) else 64)

    @staticmethod
    def _lift(x: np.ndarray, top: float) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]])

    def _sign(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.turn > 0, axis=1).view(np.uint64).ravel()

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._sign(self._lift(x, self.top))

    def queries(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return self._sign(np.hstack([x / norm * self.top, np.zeros((len(x), 1))]))


class MultiIndex:
    """Buckets of each substring over some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint8).reshape(-1, PARTS)
        self.order = [np.argsort(parts[:, j], kind="stable") for j in range(PARTS)]
        self.sizes = [np.bincount(parts[:, j], minlength=256) for j in range(PARTS)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all codes within the radius of ``code``."""
        s, a = divmod(radius, PARTS)
        seen = np.zeros(len(self.codes), bool)
        q = np.array([code]).view(np.uint8)
        for j in range(PARTS):
            reach = s if j <= a else s - 1
            if reach >= 0:
                probed = _NEAR[q[j]] <= reach
                seen[self.order[j][np.repeat(probed, self.sizes[j])]] = True
        at = np.flatnonzero(seen)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def _search(codes: Codes, k: int):
    def run(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(asked):
            x, ids = np.stack(rows["embedding"].to_list()).astype(np.float64), rows["vec_id"].to_numpy()
            y, own = np.stack(asked["embedding"].to_list()).astype(np.float64), asked["vec_id"].to_numpy()
            index = MultiIndex(codes.rows(x))
            for q, v, code, radius in zip(own, y, codes.queries(y), asked["radius"], strict=True):
                at = index.within(code, int(radius))
                at = at[ids[at] != q]
                score = np.einsum("ij,j->i", x[at], v)
                if len(at) > k:
                    keep = score >= np.partition(score, len(at) - k)[len(at) - k]
                    at, score = at[keep], score[keep]
                best = np.lexsort((ids[at], -score))[:k]
                out += [(q, ids[at[b]], score[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(sound, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return rows
    return rows.filter(F.size("embedding") == length["n"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, asks: Column, k: int = 20, sample: int = 20_000, min_radius: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that takes part and whose vec_id
    makes ``asks`` true.

    ``sample``: rows that the codes are learned on (about; chosen by a hash of vec_id).
    """
    spark = vectors.sparkSession
    work = Scratch(spark, "neighbours-found")
    base = Scratch(spark, "neighbours")
    rows = base.put(usable(vectors))
    asked = rows.filter(asks)
    n, m = rows.count(), asked.count()
    names = "query_id long, rank int, vec_id long, score double"
    if not n or not m:
        return spark.createDataFrame([], names)
    share = int(min(1.0, sample / n) * (1 << 20))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < share).select("embedding").collect()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x))
    top = float(rows.agg(F.max(norm)).first()[0])
    learned = np.array([r["embedding"] for r in picked] or [rows.first()["embedding"]])
    codes = Codes.learn(learned, top, k)

    most = max(1, BLOCK_VALUES // learned.shape[1])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, lots = max(-(-n // min(BLOCK_ROWS, most)), min(tasks, -(-n // LEAST_ROWS))), -(-m // min(BLOCK_QUERIES, most))
    spread = lambda df, own, parts, other, times: df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    indexed = spread(rows, "b", blocks, "q", lots).withColumn("q", F.col("q").cast("long"))
    found, radius, left = None, min_radius or codes.radius, asked
    while True:
        here = spread(left, "q", lots, "b", blocks).withColumn("b", F.col("b").cast("long")).withColumn("radius", F.lit(radius))
        got = indexed.groupBy("b", "q").cogroup(here.groupBy("b", "q")).applyInPandas(_search(codes, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        got = work.put(got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        full = got.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1)).select("query_id")
        if radius < 64:
            short = work.put(left.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"))
            more = not short.isEmpty()
        else:
            more = False
        done = got.join(full, "query_id", "left_semi").select(got.columns) if more else got
        found = done if found is None else found.union(done)
        if not more:
            base.clear()
            return found
        left, radius = short, min(64, radius + 8)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, F.col("vec_id") % 20 == 0)
