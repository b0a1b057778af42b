"""Benchmark decontamination by winnowing (DataFrame functions only).

Both corpora are cut into lower-cased words. Every document keeps, of each sliding group of
``window - k + 1`` word k-grams, the one with the smallest hash (winnowing); so do the benchmark
items. Two texts that share ``window`` consecutive words then share a kept fingerprint, so an
equi-join on fingerprints misses no shared span. Documents that meet a fingerprint are verified:
their windows are compared word for word and hits are extended over all words of the span.

Defined cases: a null text has no words; an item of fewer than ``window`` words is one window of
all its words, and one without words matches nothing; an item whose text occurs twice counts under
each item_id; very long texts are read whole; repeated rows are returned as often as they come; a null
doc_id is an id like any other; an empty table gives no rows; other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import cut, table

NAME = "op10_decontaminate"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))

#: Bytes, as rows, up to which fingerprints or windows of the benchmark are broadcast; else the join shuffles.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-case A-Z and cut at everything below U+0080 that is no letter or digit."""
    plain = F.translate(text, _BREAKS + _UPPER, " " * len(_BREAKS) + _UPPER.lower())
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), "")


# explode_outer, here and below: for explode Spark puts a filter on the array's size under the
# projections that make it, and there writes every step of the array out within every other.


def _grams(source: str, n: int) -> Column:
    """Hashes of all n-grams of the array of word hashes in column ``source``."""
    at = F.col(source)
    return F.when(
        F.size(at) >= n,
        F.transform(F.sequence(F.lit(0), F.size(at) - n), lambda i: F.xxhash64(*(F.get(at, i + j) for j in range(n)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _pairwise_least(source: str, step: int) -> Column:
    return F.transform(source, lambda x, i: F.least(x, F.get(F.col(source), i + step)))


def _starts(n: int) -> Column:
    """Where a run of n words begins, for every such run in ``_words``."""
    return F.when(
        F.size("_words") >= n,
        F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"))),
    ).otherwise(F.array().cast("array<struct<at:int,n:int>>"))


def _with_fingerprints(df: DataFrame, window: int, k: int, whole: list[int]) -> DataFrame:
    """Add ``fps``: winnowed k-gram hashes, and all n-gram hashes for each n in ``whole``.

    The sliding minimum doubles its width from step to step, so it costs log(width) passes.
    """
    df = df.withColumn("_wh", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_m", _grams("_wh", k))
    width, goal = 1, window - k + 1
    while width < goal:
        step = min(width, goal - width)
        df = df.withColumn("_m", _pairwise_least("_m", step))
        width += step
    kept = F.slice("_m", F.lit(1), F.greatest(F.size("_m") - (goal - 1), F.lit(1)))
    parts = [F.array_distinct(kept)] + [F.array_distinct(_grams("_wh", n)) for n in whole]
    return df.withColumn("fps", reduce(lambda a, b: F.concat(a, b), parts)).drop("_wh", "_m")


def _windows(df: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each run of n words, n in ``sizes``: columns at, n, run."""
    spans = F.concat(*(_starts(n) for n in sizes))
    df = df.withColumn("_s", F.explode_outer(spans)).filter("_s is not null")
    return df.select(
        *(c for c in df.columns if c not in ("_s", "_words")),
        F.col("_s.at").alias("at"),
        F.col("_s.n").alias("n"),
        F.array_join(F.slice("_words", F.col("_s.at"), F.col("_s.n")), " ").alias("run"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 5, share: float = 0.05) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, longest, text_hash.

    ``longest``: words of the longest window that occurs (0: none); ``window`` where a passage of the
    benchmark does. ``text_hash`` is xxhash64 of the text: with doc_id it names the row where ids repeat.
    ``share``: a document is contaminated when at least this share of its words is hit.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    items = cut(items.withColumn("_n", F.least(F.size("_words"), F.lit(window))))
    short = sorted(r[0] for r in items.filter(F.col("_n") < window).select("_n").distinct().collect())

    long_fps = _with_fingerprints(items.filter(F.col("_n") == window), window, k, []).select(F.explode_outer("fps").alias("fp")).filter("fp is not null")
    whole_fps = [_with_fingerprints(items.filter(F.col("_n") == n), window, k, [n]).select(F.explode_outer(F.slice("fps", -1, 1)).alias("fp")).filter("fp is not null") for n in short]
    fps = cut(reduce(DataFrame.unionByName, whole_fps, long_fps).distinct().withColumn("hit", F.lit(True)))
    runs = reduce(
        DataFrame.unionByName,
        [_windows(items.filter(F.col("_n") == n).select("item_id", "_words"), [n]) for n in [*short, window]],
    )
    runs = cut(runs.groupBy("n", "run").agg(F.collect_set("item_id").alias("ids")))
    load = runs.agg(F.sum(F.octet_length("run") + 8 * F.size("ids") + 64)).first()[0] or 0
    near_runs = F.broadcast(runs) if load <= BROADCAST_BYTES else runs
    near_fps = F.broadcast(fps) if 40 * fps.count() <= BROADCAST_BYTES else fps

    base = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")).withColumn("_words", words(F.col("text")))
    seen = _with_fingerprints(base, window, k, short).select(
        "doc_id", "th", F.size("_words").cast("long").alias("n_words"), F.posexplode_outer("fps").alias("pos", "fp")
    )
    seen = seen.join(near_fps, "fp", "left").groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"), F.sum((F.coalesce("pos", F.lit(0)) == 0).cast("int")).alias("copies"), F.max("hit").alias("hit")
    )
    seen = cut(seen)

    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    again = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    suspects = seen.filter("hit").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    texts = again.join(suspects, same, "left_semi").dropDuplicates(["doc_id", "th"])
    found = _windows(texts.select("doc_id", "th", words(F.col("text")).alias("_words")), [*short, window])
    found = found.join(near_runs, ["n", "run"]).groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
        F.max("n").alias("longest"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hits"), F.lit(1).alias("next")),
        lambda acc, s: F.struct(
            (acc["hits"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(acc["next"], s["at"]))).alias("hits"),
            F.greatest(acc["next"], s["at"] + s["n"]).alias("next"),
        ),
        lambda acc: acc["hits"].cast("long"),
    )
    found = found.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), covered.alias("n_hit"), "items", "longest")
    out = seen.join(found, same, "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast(found.schema["items"].dataType)), lambda x: x.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words"))).alias("contaminated"),
        ids.alias("items"),
        F.coalesce("longest", F.lit(0)).alias("longest"),
        F.col("th").alias("text_hash"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    exact = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.withColumn("contaminated", exact).drop("items", "longest", "text_hash")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS run FROM b),
sizes AS (SELECT DISTINCT n FROM b),
dw AS (SELECT doc_id, n, r.i AS i, r.run AS run FROM (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'run': array_to_string(w[i:i + n - 1], ' ')}})) AS r FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.run = bw.run),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
