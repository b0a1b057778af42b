"""Corpora from folders of Markdown and HTML files, and full and incremental reindexing."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import artifact_id, content_hash
from quarry.functions.text import glob_regex
from quarry.operators import parse as P
from quarry.operators import store as S
from quarry.operators.index import Index, corpus_stats, document_frequency
from quarry.session import Scratch
from quarry.sources.embed import Embedder, embed_table

log = logging.getLogger(__name__)

# File endings, sizes and kinds.
EXTENSIONS = ("md", "markdown", "html", "htm")
MAX_BYTES, MAX_DEPTH = 16 << 20, 64
MANY_PATHS = 65_536  # of single documents to look at, broadcast up to here
KINDS = {"artifact": 0, "note": 1, "memory": 2, "session": 3}


def ignored(path: Column, patterns: list[str]) -> Column:
    """A pattern is a part of the path, or a glob over the path or its last segment."""
    out, name = F.lit(False), F.regexp_extract(path, "([^/]*)$", 1)
    for p in patterns:
        glob = "(?s)" + glob_regex(p)
        out = out | path.contains(p) | (path.rlike(glob) | name.rlike(glob) if re.search(r"[*?]", p) else F.lit(False))
    return out


def walk(spark: SparkSession, root: str, corpus: str, ignore: list[str] | None = None) -> DataFrame:
    """Manifest of a folder: corpus, path, mtime_ns, size_bytes, skipped, source.

    Names that begin with a dot are left out; files with another ending are no documents; oversized
    ones are listed as skipped, with no source; empty files, which hold no document, are not listed. Only filters touch the listing, so the
    contents of other files are never read.
    """
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", f"^[a-z]*:?/*{re.escape(base)}/+", "")
    rows = files.select(F.lit(corpus).alias("corpus"), rel.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size_bytes"), "content")
    rows = rows.filter(~F.col("path").rlike(r"(^|/)\.") & F.col("path").rlike(rf"(?i)\.({'|'.join(EXTENSIONS)})$"))
    rows = rows.filter(F.size(F.split("path", "/")) <= MAX_DEPTH + 1).filter(~ignored(F.col("path"), ignore or []))
    rows = rows.withColumn("skipped", ~F.col("size_bytes").between(1, MAX_BYTES))
    return rows.withColumn("source", F.when(~F.col("skipped"), F.decode("content", "UTF-8"))).drop("content")


def ingest(manifest: DataFrame, work: Scratch, kind: str = "artifact") -> dict[str, DataFrame]:
    """Parse each document once, into a table; artifacts, chunks, links and metas are read from that."""
    docs = P.parse_table(manifest.filter("source is not null")).withColumn("id", artifact_id("corpus", "path"))
    docs = work.put(docs.withColumns({"content_hash": content_hash("source"), "text": P.searchable_text(F.col("title"), F.col("blocks"))}))
    cut = docs.filter(F.size("at_limit") > 0).count()
    if cut:
        log.warning("%d documents have more links or metas than are kept (%d, %d), or longer values (%d)", cut, P.MAX_LINKS, P.MAX_METAS, P.MAX_META_VALUE)
    artifacts = docs.select("id", *S.KEY, "title", F.lit(KINDS[kind]).alias("kind"), "mtime_ns", "size_bytes", "content_hash", "heading_count", "summary", "source", "text")
    return {"artifacts": numbered(artifacts), "chunks": P.chunks(docs), "links": P.links(docs), "metas": P.metas(docs)}


def numbered(artifacts: DataFrame) -> DataFrame:
    """doc_id: 48 bits of the artifact's id; keyed by (corpus, path), so removals renumber nothing."""
    return artifacts.withColumn("doc_id", F.conv("id", 16, 10).cast("long"))


@dataclass(frozen=True)
class Embedding:
    """``make`` is called once a task and gives an embedder of ``dim`` dimensions."""

    make: Callable[[], Embedder]
    dim: int


def _indexed(artifacts: DataFrame, work: Scratch) -> Index:
    return Index.build(artifacts.select("doc_id", *S.KEY, "title", "kind", "text")).staged(work)


def _vectors(artifacts: DataFrame, embedding: Embedding | None) -> DataFrame:
    if embedding is None:
        return artifacts.sparkSession.createDataFrame([], "doc_id long, embedding array<float>")
    return embed_table(artifacts.select("doc_id", "text"), embedding.make, embedding.dim)


def _walk_all(spark: SparkSession, folders: dict[str, str], ignore: list[str] | None) -> DataFrame:
    if not folders:
        raise ValueError("no corpus to index")
    return reduce(DataFrame.unionByName, (walk(spark, root, corpus, ignore) for corpus, root in folders.items()))


def reindex(spark: SparkSession, folders: dict[str, str], store: str, ignore: list[str] | None = None, only: list[str] | None = None, embedding: Embedding | None = None) -> dict[str, DataFrame]:
    """Walk, parse, resolve links, build the index, embed, publish."""
    work = Scratch(spark, "ingest", f"{store}/staging")
    made = ingest(_walk_all(spark, {c: root for c, root in folders.items() if only is None or c in only}, ignore), work)
    edges, pending = S.resolve_links(made["links"], made["artifacts"])
    index = _indexed(made["artifacts"], work)
    postings = work.put(index.postings)
    tables = {"artifacts": made["artifacts"].drop("text"), "chunks": made["chunks"], "metas": made["metas"], "edges": edges, "pending_links": pending, "postings": postings, "documents": index.documents, "terms": document_frequency(postings), "stats": index.stats, "vectors": _vectors(made["artifacts"], embedding)}
    S.publish(tables, store)
    work.clear()
    return S.open_latest(spark, store, *TABLES)


TABLES = ("artifacts", "chunks", "metas", "edges", "pending_links", "postings", "documents", "terms", "stats", "vectors")


def _publish_changes(spark: SparkSession, state: dict[str, DataFrame], fresh: DataFrame, gone: DataFrame, store: str, embedding: Embedding | None) -> dict[str, DataFrame]:
    work = Scratch(spark, "changes", f"{store}/staging")
    fresh, gone = work.put(fresh), work.put(gone)
    S.publish(apply_changes(state, fresh, gone, work, embedding), store)
    work.clear()
    return S.open_latest(spark, store, *TABLES)


def rescan(spark: SparkSession, folders: dict[str, str], store: str, ignore: list[str] | None = None, embedding: Embedding | None = None) -> dict[str, DataFrame]:
    """Incremental reindex: parse what is new or differs in time or size, drop what has gone, publish."""
    state = S.open_latest(spark, store, *TABLES)
    here = _walk_all(spark, folders, ignore).filter("not skipped")
    listed = here.drop("source")  # the comparison needs no file contents
    changed = S.change_detect(listed, state["artifacts"]).filter("changed").select(*S.KEY)
    fresh = here.join(changed, S.KEY, "left_semi")
    return _publish_changes(spark, state, fresh, S.orphans(state["artifacts"], listed).select(*S.KEY), store, embedding)


def reindex_paths(spark: SparkSession, folders: dict[str, str], store: str, paths: DataFrame, ignore: list[str] | None = None, embedding: Embedding | None = None) -> dict[str, DataFrame]:
    """Look at single documents (corpus, path) again: what is in the folder now decides.

    A file that is there, can be listed and has changed is parsed; one that is not there any more goes.
    Paths that neither the folder nor the store knows change nothing. Where there is no store yet, all is
    indexed.
    """
    paths = paths.select(*S.KEY).distinct()
    try:
        state = S.open_latest(spark, store, *TABLES)
    except S.StoreError:
        return reindex(spark, folders, store, ignore, embedding=embedding)
    here = _walk_all(spark, folders, ignore).filter("not skipped").join(F.broadcast(paths) if paths.count() <= MANY_PATHS else paths, S.KEY, "left_semi")
    changed = S.change_detect(here.drop("source"), state["artifacts"]).filter("changed").select(*S.KEY)
    gone = state["artifacts"].select(*S.KEY).join(paths, S.KEY, "left_semi").join(here.select(*S.KEY), S.KEY, "left_anti")
    return _publish_changes(spark, state, here.join(changed, S.KEY, "left_semi"), gone, store, embedding)


def apply_changes(state: dict[str, DataFrame], changed: DataFrame, removed: DataFrame, work: Scratch, embedding: Embedding | None = None) -> dict[str, DataFrame]:
    """Incremental update: ``changed`` manifest rows replace theirs, ``removed`` (corpus, path) go.

    Only changed documents are parsed, tokenized and embedded; df, N and mean length are aggregates of
    what is left, so the result equals a rebuild.
    """
    made = ingest(changed, work)
    touched = changed.select(*S.KEY).unionByName(removed.select(*S.KEY)).distinct()
    fresh = made["artifacts"]
    artifacts = state["artifacts"].join(touched, S.KEY, "left_anti").unionByName(fresh.drop("text"))
    old_ids = state["artifacts"].join(touched, S.KEY, "left_semi").select("id", "doc_id")
    edges, pending, metas = S.forget(state["edges"], state["pending_links"], state["metas"], removed)
    edges, pending = (df.join(touched.withColumnRenamed("path", "src_path"), ["corpus", "src_path"], "left_anti") for df in (edges, pending))
    now, later = S.resolve_links(made["links"], artifacts)
    edges, pending = S.drain_pending(edges.unionByName(now), pending.unionByName(later), changed, artifacts)
    index, gone = _indexed(fresh, work), old_ids.select("doc_id")
    without = lambda name: state[name].join(gone, "doc_id", "left_anti")
    postings = work.put(without("postings").unionByName(index.postings))
    documents = work.put(without("documents").unionByName(index.documents))
    return {
        "artifacts": artifacts,
        "chunks": S.replace_by_document(state["chunks"], made["chunks"], old_ids.select(F.col("id").alias("doc_id")), ["doc_id"]),
        "metas": S.replace_metas(metas, made["metas"], changed),
        "edges": edges,
        "pending_links": pending,
        "postings": postings,
        "documents": documents,
        "terms": document_frequency(postings),
        "stats": corpus_stats(documents),
        "vectors": without("vectors").unionByName(_vectors(fresh, embedding)),
    }
