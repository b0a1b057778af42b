"""Tables of the document store as set operations.

Every function takes DataFrames and returns the new state of a table; nothing is updated in place.
``publish`` writes a generation and moves a pointer last, so readers never see half a state.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.index import by_term

KEY = ["corpus", "path"]
MAX_PAGE = 1000
BY_TERM = ("postings", "terms")  # tables that queries look up by term


class StoreError(ValueError):
    """kind: conflict or notfound."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


# -- artifacts


def upsert(stored: DataFrame, incoming: DataFrame, order: str = "mtime_ns") -> DataFrame:
    """The latest row of each (corpus, path); incoming rows win ties with stored ones."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*KEY).orderBy(F.desc("_new"), F.desc(order), F.desc("id"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose (corpus, path) is stored under another id."""
    known = stored.select(*KEY, F.col("id").alias("_id"))
    return incoming.join(known, KEY).filter("id <> _id").drop("_id")


def upsert_checked(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    if not conflicts(stored, incoming).isEmpty():
        raise StoreError("conflict", "a path is stored under another id")
    return upsert(stored, incoming)


def change_detect(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """The manifest with ``changed``: no stored row, or another time or size."""
    old = stored.select(*KEY, F.col("mtime_ns").alias("_m"), F.col("size_bytes").alias("_s"))
    same = F.col("mtime_ns").eqNullSafe(F.col("_m")) & F.col("size_bytes").eqNullSafe(F.col("_s")) & F.col("_m").isNotNull()
    return manifest.join(old, KEY, "left").withColumn("changed", ~same).drop("_m", "_s")


def orphans(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    return stored.join(manifest.select(*KEY), KEY, "left_anti")


def sweep(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    return stored.join(manifest.select(*KEY), KEY, "left_semi")


def delete_artifacts(ids: DataFrame, artifacts: DataFrame, chunks: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents go with their chunks and comments. ids: column id."""
    if not ids.join(artifacts, "id", "left_anti").isEmpty():
        raise StoreError("notfound", "no such artifact")
    gone = ids.select(F.col("id").alias("doc_id"))
    return artifacts.join(ids, "id", "left_anti"), chunks.join(gone, "doc_id", "left_anti"), comments.join(gone, "doc_id", "left_anti")


def get(artifacts: DataFrame, artifact_id: str, source: bool = False) -> DataFrame:
    rows = artifacts.filter(F.col("id") == artifact_id)
    return rows if source else rows.drop("source")


def get_by_path(artifacts: DataFrame, corpus: str, path: str) -> DataFrame:
    return artifacts.filter((F.col("corpus") == corpus) & (F.col("path") == path)).drop("source")


def get_many(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: slot, corpus, path -> slot and the row; what does not resolve is null."""
    return wanted.join(artifacts.drop("source"), KEY, "left")


def list_page(artifacts: DataFrame, corpus: str | None = None, kind: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """In order of corpus, path, id. The cut is a bounded top-k over limit + offset rows."""
    rows = artifacts
    if corpus is not None:
        rows = rows.filter(F.col("corpus") == corpus)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    return rows.drop("source").orderBy(*KEY, "id").offset(max(offset, 0)).limit(max(0, min(limit, MAX_PAGE)))


def counts_by_corpus(artifacts: DataFrame) -> DataFrame:
    """Count per corpus, clamped for display, and whether it was."""
    n = artifacts.groupBy("corpus").agg(F.count("*").alias("n"))
    return n.select("corpus", F.least("n", F.lit(MAX_PAGE).cast("long")).alias("n_docs"), (F.col("n") > MAX_PAGE).alias("truncated"))


def totals(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.count("*").alias("n_artifacts"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))


# -- chunks, comments, metas


def replace_by_document(rows: DataFrame, incoming: DataFrame, documents: DataFrame, key: list[str]) -> DataFrame:
    """Whole replacement: all rows of the named documents go, then the incoming ones come.

    Naming the documents apart from the rows lets a document be left with none.
    """
    return rows.join(documents.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def replace_chunks(chunks: DataFrame, incoming: DataFrame, documents: DataFrame) -> DataFrame:
    twice = incoming.groupBy("doc_id", "ord").count().filter("count > 1")
    if not twice.isEmpty():
        raise StoreError("conflict", "a document has an ordinal twice")
    return replace_by_document(chunks, incoming, documents, ["doc_id"])


def replace_metas(metas: DataFrame, incoming: DataFrame, documents: DataFrame) -> DataFrame:
    return replace_by_document(metas, incoming.distinct(), documents, KEY)


def list_chunks(chunks: DataFrame, doc_id) -> DataFrame:
    return chunks.filter(F.col("doc_id") == doc_id).select(F.concat(F.lit("b"), F.col("ord")).alias("id"), "ord", "text").orderBy("ord")


def list_comments(comments: DataFrame, doc_id, limit: int = 50) -> DataFrame:
    return comments.filter(F.col("doc_id") == doc_id).orderBy("created_at", "id").limit(limit)


def add_comments(comments: DataFrame, incoming: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Random ids are minted where there is none; every comment needs its document."""
    if not incoming.join(artifacts.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").isEmpty():
        raise StoreError("notfound", "a comment names no stored document")
    minted = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
    return comments.unionByName(incoming.withColumn("id", F.coalesce("id", minted)))


def set_resolved(comments: DataFrame, comment_id: str, resolved: bool) -> DataFrame:
    if comments.filter(F.col("id") == comment_id).isEmpty():
        raise StoreError("notfound", "no such comment")
    return comments.withColumn("resolved", F.when(F.col("id") == comment_id, F.lit(resolved)).otherwise(F.col("resolved")))


# -- links


def resolve_links(links: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to stored documents, and links that wait for theirs."""
    targets = artifacts.select("corpus", F.col("path").alias("dst_path")).distinct()
    links = links.select("corpus", "src_path", "dst_path").distinct()
    on = ["corpus", "dst_path"]
    return links.join(targets, on, "left_semi"), links.join(targets, on, "left_anti")


def replace_edges(edges: DataFrame, incoming: DataFrame, sources: DataFrame) -> DataFrame:
    gone = sources.select("corpus", F.col("path").alias("src_path")).distinct()
    return edges.join(gone, ["corpus", "src_path"], "left_anti").unionByName(incoming).distinct()


def add_pending(pending: DataFrame, incoming: DataFrame) -> DataFrame:
    return pending.unionByName(incoming).distinct()


def drain_pending(edges: DataFrame, pending: DataFrame, arrived: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that wait for a document that has come become edges if their source still exists."""
    here = arrived.select("corpus", F.col("path").alias("dst_path")).distinct()
    alive = artifacts.select("corpus", F.col("path").alias("src_path")).distinct()
    due = pending.join(here, ["corpus", "dst_path"], "left_semi")
    fresh = due.join(alive, ["corpus", "src_path"], "left_semi").select(edges.columns)
    return edges.unionByName(fresh).distinct(), pending.join(here, ["corpus", "dst_path"], "left_anti")


def forget(edges: DataFrame, pending: DataFrame, metas: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to a document that goes wait again; its own links, pending links and metas go."""
    src = gone.select("corpus", F.col("path").alias("src_path")).distinct()
    dst = gone.select("corpus", F.col("path").alias("dst_path")).distinct()
    kept = edges.join(src, ["corpus", "src_path"], "left_anti")
    waiting = kept.join(dst, ["corpus", "dst_path"], "left_semi").select(pending.columns)
    pending = pending.join(src, ["corpus", "src_path"], "left_anti").unionByName(waiting).distinct()
    return kept.join(dst, ["corpus", "dst_path"], "left_anti"), pending, metas.join(gone.select(*KEY).distinct(), KEY, "left_anti")


# -- generations


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables under a new folder of their own, then the pointer that names it.

    Two writers at once never share a folder; the later pointer, or of two with one number the greater
    folder name, is the state.
    """
    spark = next(iter(tables.values())).sparkSession
    latest = _pointer(spark, root)
    generation = latest[0] + 1 if latest else 1
    folder = f"gen={generation}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        if name in BY_TERM:
            df = by_term(df)
        df.write.parquet(f"{root}/{folder}/{name}")
    spark.createDataFrame([(generation, folder)], "generation long, folder string").coalesce(1).write.mode("append").parquet(f"{root}/published")
    return f"{root}/{folder}"


def _pointer(spark: SparkSession, root: str) -> tuple[int, str] | None:
    try:
        found = spark.read.parquet(f"{root}/published").agg(F.max(F.struct("generation", "folder")).alias("m")).first()["m"]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return tuple(found) if found else None


def open_latest(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    latest = _pointer(spark, root)
    if latest is None:
        raise StoreError("notfound", f"nothing is published under {root}")
    return {name: spark.read.parquet(f"{root}/{latest[1]}/{name}") for name in names}
