"""Ranking: BM25, cosine top-k, reciprocal rank fusion, title and link-graph boosts.

Scores are rounded to six places, as they are shown, and ranked by the rounded score and then doc_id:
sums differ in their last bits from plan to plan, and a cut must not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B, RRF_K, DEPTH, MAX_HITS = 1.2, 0.75, 60, 200, 1000
#: Rows of query terms (term, query) that are broadcast; above, the join shuffles.
BROADCAST_TERMS = 100_000
#: Postings, each counted once for every query that asks for it, that one task of a batch adds up.
PAIRS_PER_TASK = 2_000_000


def check_parameters(k1: float, b: float) -> None:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be 0 or more, b between 0 and 1")


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float, b: float) -> Column:
    return idf(df, n) * saturation(tf, dl, avgdl, k1, b)


def bm25(hits: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id and score. hits: term, doc_id, dl, tf of the distinct query terms only; stats: one row."""
    check_parameters(k1, b)
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(frequency), "term").join(F.broadcast(stats.select("n_docs", "avgdl")))
    w = weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl"), k1, b)
    return rows.groupBy("doc_id").agg(F.round(F.sum(w), 6).alias("score"))


def bm25_batch(post: DataFrame, stats: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, limit: int = 10, terms: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank for many queries in one job.

    post: term, doc_id, tf, dl; stats: one row; queries: query_id, term (distinct); terms: term, df of all
    terms, where they are stored. Postings of the terms are dealt out by document before each meets the
    queries that ask for it, so what a document gets from a query is added up where it is made.
    """
    check_parameters(k1, b)
    small = queries.count() <= BROADCAST_TERMS
    near = F.broadcast if small else (lambda df: df)
    some = post.join(near(queries.select("term").distinct()), "term", "left_semi")
    stats = F.broadcast(stats.select("n_docs", "avgdl"))
    frequency = some.groupBy("term").agg(F.count("*").alias("df")) if terms is None else terms.select("term", "df")
    known = queries.join(frequency, "term")
    asked = known.join(stats).select("query_id", "term", idf(F.col("df"), F.col("n_docs")).alias("idf"))
    part = saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    # as many partitions as keep the sums of each one few
    pairs = known.agg(F.sum("df")).first()[0] or 0
    parts = max(1, -(-pairs // PAIRS_PER_TASK), min(post.sparkSession.sparkContext.defaultParallelism, -(-pairs // 50_000)))
    by_doc = some.join(stats).select("term", "doc_id", part.alias("part")).repartition(parts, "doc_id")
    scored = by_doc.join(near(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * F.col("part")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    # the bare row number lets Spark cut each partition at the limit before rows are dealt out by query
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return best.withColumn("rank", F.col("rank") - 1)


def top(rows: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """A bounded top-k (no global sort); limits beyond the cap are cut to it, 0 gives none."""
    return rows.orderBy(F.desc(score), "doc_id").limit(max(0, min(limit, MAX_HITS)))


def with_rank(rows: DataFrame, score: str, rank: str) -> DataFrame:
    """Ranks from 0. One partition is enough: a lane is at most MAX_HITS rows."""
    return rows.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), "doc_id")) - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_lane(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """doc_id and score of the nearest rows of ``vectors`` (doc_id, embedding)."""
    if not query:
        raise ValueError("the query vector has no dimension")
    q = F.array(*(F.lit(float(x)) for x in query))
    fits = vectors.filter(F.size("embedding") == len(query))
    scored = fits.select("doc_id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).filter("score is not null")
    return top(scored, limit if 0 < limit <= MAX_HITS else MAX_HITS)


def fuse(keyword: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """Full outer join of two lanes; each adds 1 / (k + rank), a missing one nothing."""
    k = k if k > 0 else RRF_K
    left = with_rank(keyword, "score", "keyword_rank").select("doc_id", F.col("score").alias("keyword_score"), "keyword_rank")
    right = with_rank(vector, "score", "vector_rank").select("doc_id", F.col("score").alias("vector_score"), "vector_rank")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return left.join(right, "doc_id", "full_outer").withColumn("score", part("keyword_rank") + part("vector_rank"))


def title_words(query: str) -> list[str]:
    """Words of three bytes or more; bytes beyond ASCII belong to words; stop words stay."""
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), query.encode())
    return sorted({w.decode("utf-8", "ignore") for w in re.findall(rb"[a-z0-9\x80-\xff]+", raw) if len(w) >= 3})


def title_boost(score: Column, title: Column, query: str, factor: float = 1.5) -> Column:
    """Once, if any word of the query is part of the title."""
    low = F.translate(title, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.lit(False)
    for w in title_words(query):
        hit = hit | low.contains(w)
    return score * F.when(F.coalesce(hit, F.lit(False)), factor).otherwise(1.0)


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("corpus", "dst_path").agg(F.count("*").alias("in_degree"))


def graph_boost(score: Column, in_degree: Column, greatest: Column, share: float, k: int = RRF_K) -> Column:
    """``share`` in (0, 4]: up to share/k more, by the root of the in-degree."""
    if not 0 < share <= 4:
        raise ValueError("the graph weight lies above 0 and at most at 4")
    part = F.try_divide(F.sqrt(F.coalesce(in_degree, F.lit(0)).cast("double")), F.sqrt(greatest.cast("double")))
    return score + share / k * F.coalesce(part, F.lit(0.0))


def percentile_nearest(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Nearest-rank percentiles, the value at place ceil(share * n): share and value.

    Tasks count equal values before the one row is made; for figures such as latencies.
    """
    found = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)") for p in shares]
    one = values.agg(F.array(*(F.struct(F.lit(p).cast("double").alias("share"), v.alias("value")) for p, v in zip(shares, found, strict=True))).alias("x"))
    return one.select(F.explode_outer("x").alias("x")).select("x.*")
