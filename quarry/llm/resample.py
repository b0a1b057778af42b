"""Quality by importance resampling.

Texts are bags of hashed n-grams: words and runs of punctuation, alone and in pairs, fall into
``BUCKETS`` buckets. Two generative models are bags of bucket probabilities: one of the target (texts
labelled good, a bounded sample of them), one of all raw text. A document's weight is the likelihood
ratio of the two; adding Gumbel noise to its logarithm and keeping the k greatest samples documents
without replacement in proportion to their weights. The noise hangs on doc_id alone, so a run can be
repeated.

The k-th greatest key is found by counting keys in ever finer bins; no task sorts the corpus.

Defined cases: null and empty texts have no n-grams and a log-weight of 0; rows that repeat a doc_id
have the same noise, and where the k-th place falls among equal rows as many of them are taken as are
left; a null doc_id counts as -1 for the noise; very long texts are read whole; other columns are ignored; without target texts all log-weights are 0; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.rolling import BASE, FOLD, mix, tables
from quarry.session import cut, small_batches, table

NAME = "op1_resample"
SQL = None

BUCKETS = 1 << 14
_BLANK = frozenset(b" \t\n\r\x0b\x0c")
_KIND = np.array([0 if c in _BLANK else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each token and of each pair of neighbouring tokens of a whole text."""
    if not text:
        return np.empty(0, np.int64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(FOLD), np.uint8)
    kind = _KIND[b]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge))
    stops = np.concatenate((edge, [len(b)]))
    real = kind[starts] > 0
    starts, stops = starts[real], stops[real]
    power, back = tables(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])))
    one = mix((sums[stops] - sums[starts]) * back[starts])
    two = mix(one[:-1] * np.uint64(BASE) + one[1:])
    return (np.concatenate((one, two)) >> np.uint64(50)).astype(np.int64)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text in b["text"]:
            total += np.bincount(buckets(text), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": some, "n": total[some]})


def bag_model(texts: DataFrame) -> np.ndarray:
    """Log-probability of each bucket, with one more count everywhere; a row per bucket is collected."""
    rows = texts.select("text").mapInPandas(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.ones(BUCKETS)
    for r in rows:
        total[r["bucket"]] += r["n"]
    return np.log(total / total.sum())


def take_greatest(rows: DataFrame, k: int, key: str, bins: int = 4096, few: int = 500) -> DataFrame:
    """The k rows of the greatest ``key`` (finite doubles; ties: smaller doc_id, then the other columns).

    Of equal rows only their number is gathered, however many there are.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if k >= n or k <= 0:
        return rows if k > 0 else rows.limit(0)
    sure, here, left = [], rows, k
    while n > few and low < high and low + (high - low) / bins > low:
        width = (high - low) / bins
        at = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"))
        found = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in here.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            n, lo, hi = found[b]
            if n > left:
                break
            left -= n
        sure.append(here.filter(at > b))
        here, low, high = here.filter(at == b), lo, hi
    equal = here.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    before = Window.orderBy(F.desc(key), "doc_id", *rows.columns).rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("taken", F.least("copies", F.lit(left) - F.coalesce(F.sum("copies").over(before), F.lit(0)))).filter("taken > 0")
    out = equal.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("taken").cast("int"))).alias("copy")).drop("copy")
    for part in sure:
        out = out.union(part)
    return out


def importance_resample(docs: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """doc_id, log_weight, sample_key, n_grams of the k documents sampled."""
    small_batches(docs.sparkSession)
    ratio = bag_model(target) - bag_model(docs) if not target.isEmpty() else np.zeros(BUCKETS)

    @F.pandas_udf("log_weight double, n_grams long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        found = [buckets(t) for t in texts]
        return pd.DataFrame({"log_weight": [float(ratio[f].sum()) for f in found], "n_grams": [len(f) for f in found]})

    rows = docs.select("doc_id", weigh("text").alias("w")).select("doc_id", "w.*")
    even = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(1)), 11) + 0.5) / float(1 << 53)
    rows = cut(rows.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(even))))
    return take_greatest(rows, k, "sample_key").select("doc_id", "log_weight", "sample_key", "n_grams")


def good_texts(docs: DataFrame, labels: DataFrame, max_target: int = 8_000) -> tuple[DataFrame, float]:
    """Texts labelled good, about ``max_target`` of them (by a hash of doc_id); the good share of all labels."""
    known = cut(labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good")))
    n, good = known.agg(F.count("*"), F.sum(F.col("good").cast("int"))).first()
    share = int(min(1.0, max_target / max(good or 0, 1)) * (1 << 20))
    picked = known.filter("good").filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < share).select(F.col("doc_id").alias("_id"))
    target = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"), "left_semi")
    return cut(target.select("text")), (good or 0) / n if n else 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the size that good documents have by the labels' share of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target, share = good_texts(docs, table(spark, sf_dir, "labels"))
    sample = importance_resample(docs, target, round(share * docs.count()))
    return sample.withColumn("selected", F.lit(True))
