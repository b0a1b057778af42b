"""Python API over a published store: search, list, get, add, reindex, events, stats."""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import __version__
from quarry.functions.hashing import valid_artifact_id
from quarry.operators import store as S
from quarry.operators.facets import facet_table
from quarry.operators.index import Index
from quarry.plans.search import SearchPlan, SearchRequest, search
from quarry.sources.config import Config
from quarry.sources.corpus import TABLES, Embedding, reindex, reindex_paths, rescan
from quarry.sources.embed import EmbedderError, check_reply, load_embedder
from quarry.streaming.events import EventBus, apply_stream, debounce_stream

log = logging.getLogger(__name__)


@dataclass
class Counters:
    """What an engine has done since it began."""

    indexed: int = 0
    runs: int = 0
    searches: int = 0
    degraded: int = 0
    last_reindex_ns: int = 0


class Engine:
    """State is the latest published generation; ``refresh`` moves to a newer one."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.tables = spark, config, {}
        self.counters, self.bus = Counters(), EventBus()
        self.folders = {c.name: c.path for c in config.corpora}
        self.ignore = sorted({p for c in config.corpora for p in c.ignore})
        e = config.embedder
        self.embedding = Embedding(partial(load_embedder, e.factory), e.dim) if e.factory else None

    def refresh(self) -> Engine:
        self.tables = S.open_latest(self.spark, self.config.store, *TABLES)
        return self

    def _indexed(self, tables: dict[str, DataFrame]) -> Engine:
        self.tables = tables
        self.counters.runs += 1
        self.counters.indexed = tables["artifacts"].count()
        self.counters.last_reindex_ns = time.time_ns()
        return self

    def reindex(self, corpora: list[str] | None = None) -> Engine:
        return self._indexed(reindex(self.spark, self.folders, self.config.store, self.ignore, corpora, self.embedding))

    def rescan(self) -> Engine:
        """Take over what has not changed since the latest generation."""
        return self._indexed(rescan(self.spark, self.folders, self.config.store, self.ignore, self.embedding))

    def reindex_paths(self, paths: DataFrame) -> Engine:
        """Look at single documents (corpus, path) in their folders again; if that fails, at all."""
        try:
            return self._indexed(reindex_paths(self.spark, self.folders, self.config.store, paths, self.ignore, self.embedding))
        except S.StoreError:
            log.warning("single documents could not be reindexed; scanning everything", exc_info=True)
            return self.rescan()

    def apply_events(self, events: DataFrame, checkpoint: str, debounce: bool = True):
        """A stream of (corpus, path, action) to this store; the events are handed on to ``bus`` too."""

        def each(_: int, changed: DataFrame, removed: DataFrame) -> None:
            self.reindex_paths(changed.unionByName(removed))
            for action, rows in (("changed", changed), ("removed", removed)):
                for r in rows.toLocalIterator():
                    self.bus.publish({"type": f"file.{action}", "corpus": r["corpus"], "path": r["path"], "action": action})

        return apply_stream(debounce_stream(events, self.config.debounce_ms) if debounce else events, each, checkpoint)

    def search(self, q: str, vectors: DataFrame | None = None, **options) -> SearchPlan:
        """Without a vector, the configured embedder makes one; if it fails, the lane is left out."""
        t, d = self.tables, self.config.search
        base = SearchRequest(q, limit=d.limit, candidates=d.candidates, rrf_k=d.rrf_k, k1=d.k1, b=d.b, graph_weight=d.graph_weight)
        request = replace(base, **options)
        if request.limit < 1 or request.offset < 0:
            raise ValueError("limit is 1 or more, offset 0 or more")
        if request.vector is None and self.embedding and request.mode not in ("keyword", "keyword_only"):
            try:
                request = replace(request, vector=tuple(check_reply([q], self.embedding.make()([q]), self.embedding.dim)[0]))
            except EmbedderError:
                log.warning("the embedder failed; searching by keywords")
        stored = t["vectors"] if request.vector is not None and vectors is None else vectors
        index = Index(t["postings"], t["documents"], t["terms"], t["stats"])
        plan = search(request, index, t["artifacts"], stored, facet_table(t["metas"]), t["edges"])
        self.counters.searches += 1
        self.counters.degraded += plan.degraded
        return plan

    def set_vectors(self, vectors: DataFrame) -> Engine:
        """Publish a state with these rows (doc_id, embedding) in place of those of the same documents."""
        kept = self.tables["vectors"].join(vectors.select("doc_id"), "doc_id", "left_anti")
        rows = kept.unionByName(vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")))
        S.publish(self.tables | {"vectors": rows}, self.config.store)
        return self.refresh()

    def get_vectors(self, ids: list[int]) -> DataFrame:
        return self.tables["vectors"].filter(F.col("doc_id").isin(*ids))

    def artifacts(self, corpus: str | None = None, kind: int | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
        """A page, and how many there are in all."""
        rows = self.tables["artifacts"]
        every = rows if corpus is None else rows.filter(F.col("corpus") == corpus)
        every = every if kind is None else every.filter(F.col("kind") == kind)
        return S.list_page(rows, corpus, kind, limit, offset), every.count()

    def get(self, artifact_id: str, source: bool = False) -> DataFrame:
        if not valid_artifact_id(artifact_id):
            raise ValueError("an id has 12 hexadecimal digits")
        return S.get(self.tables["artifacts"], artifact_id, source)

    def corpora(self) -> DataFrame:
        return S.counts_by_corpus(self.tables["artifacts"])

    def stats(self) -> dict[str, int]:
        t = self.tables
        one, index = S.totals(t["artifacts"]).first(), t["stats"].first()
        return {
            "artifacts": one["n_artifacts"], "bytes": one["total_bytes"], "documents": index["n_docs"], "terms": t["terms"].count(), "edges": t["edges"].count(), "pending": t["pending_links"].count(), "vectors": t["vectors"].count(),
            **asdict(self.counters),
        }

    def identity(self) -> dict[str, str]:
        """Who answers: version, and a name for this store and its corpora."""
        about = "\n".join([self.config.store, *(f"{n}={p}" for n, p in sorted(self.folders.items()))])
        return {"name": "quarry", "version": __version__, "store": hashlib.sha256(about.encode()).hexdigest()[:16]}

    def bench(self, queries: list[str], rounds: int = 5, clock: Callable[[], float] = time.perf_counter, **options) -> dict[str, float]:
        """Milliseconds a search takes: least, nearest-rank p50, p95 and p99, and greatest."""
        took = []
        for q in queries * rounds:
            began = clock()
            self.search(q, **options).rows.collect()
            took.append(1000 * (clock() - began))
        took.sort()
        rank = lambda p: took[max(0, -(-p * len(took) // 100) - 1)]
        return {"samples": len(took), "min": took[0], "p50": rank(50), "p95": rank(95), "p99": rank(99), "max": took[-1]}
