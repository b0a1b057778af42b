"""Search as one lazy plan.

Order of steps: filter, keyword and vector lanes cut at ``depth``, fusion, title boost, graph boost,
facets, sort, limit, resolve, time cutoff, offset. Filters stand before the lanes' cut; with ``compat``
they follow it, so that a small corpus can be crowded out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import TOKENS_PER_DOC, tokenize
from quarry.operators import rank as R
from quarry.operators.facets import facet_predicate
from quarry.operators.index import Index, expand_prefix
from quarry.plans.grammar import ParsedQuery, QueryError, parse_query

MODES = {"hybrid": "hybrid", "keyword": "keyword", "keyword_only": "keyword", "semantic": "semantic", "vector": "semantic"}


@dataclass(frozen=True)
class SearchRequest:
    q: str
    corpus: str | None = None
    path_prefix: str | None = None
    kind: int | None = None
    mode: str = "hybrid"
    limit: int = 50
    offset: int = 0
    candidates: int | None = None
    rrf_k: int = R.RRF_K
    k1: float = R.K1
    b: float = R.B
    graph_weight: float = 0.0
    vector: tuple[float, ...] | None = None
    since_ns: int | None = None
    now_ns: int | None = None
    since_before_limit: bool = False
    compat: bool = False


@dataclass(frozen=True)
class SearchPlan:
    """``rows`` is lazy. degraded: a lane that was asked for could not run."""

    rows: DataFrame
    query: ParsedQuery
    terms: tuple[str, ...]
    vector_ran: bool
    degraded: bool
    graph_ran: bool


def query_terms(index: Index, text: str) -> list[str]:
    found = tokenize(text)
    if len(found) > TOKENS_PER_DOC:
        raise QueryError("invalid", f"the query has more than {TOKENS_PER_DOC} tokens")
    terms = list(dict.fromkeys(found))
    last = text.rstrip().rsplit(None, 1)[-1:] if text.strip() else []
    if last and last[0].endswith("*"):
        own = tokenize(last[0])
        if own:
            terms += [r["term"] for r in expand_prefix(index.terms, own[-1]).collect() if r["term"] not in terms]
    return terms


def search(request: SearchRequest, index: Index, artifacts: DataFrame, vectors: DataFrame | None = None, facets: DataFrame | None = None, edges: DataFrame | None = None) -> SearchPlan:
    """index.documents and artifacts carry doc_id, corpus, path, title, kind; artifacts more."""
    mode = MODES.get(request.mode.lower())
    if mode is None:
        raise QueryError("invalid", f"unknown mode {request.mode!r}")
    parsed = parse_query(request.q, request.now_ns)
    prefix = parsed.folder or request.path_prefix
    docs = index.documents
    if request.corpus is not None:
        docs = docs.filter(F.col("corpus") == request.corpus)
    if request.kind is not None:
        docs = docs.filter(F.col("kind") == request.kind)
    if prefix:
        docs = docs.filter(F.col("path").startswith(prefix))
    filtered = docs is not index.documents
    admitted = docs
    if parsed.has_facets:
        none = [c for c in ("tags", "caps") if facets is None]
        if facets is None:
            admitted = docs.withColumns({c: F.array().cast("array<string>") for c in none} | {"is_index": F.lit(False)})
        else:
            admitted = docs.join(facets, ["corpus", "path"], "left")
        admitted = admitted.filter(facet_predicate(parsed.conjuncts)).select(docs.columns)
    lanes_from = index.documents if request.compat else admitted
    ids = lambda df: df.select("doc_id")
    limited = filtered or parsed.has_facets

    terms = query_terms(index, parsed.text)
    wanted = max(request.limit + request.offset, request.candidates or R.DEPTH)
    depth = min(R.MAX_HITS, wanted)
    if terms:
        keyword = R.bm25(index.postings.filter(F.col("term").isin(*terms)), index.stats, request.k1, request.b)
        if limited and not request.compat:
            keyword = keyword.join(ids(lanes_from), "doc_id", "left_semi")
        keyword = R.top(keyword, depth)
    elif limited:
        keyword = R.top(admitted.select("doc_id", F.lit(0.0).alias("score")), depth)
    else:
        keyword = index.documents.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    wants_vector = mode != "keyword"
    can_vector = wants_vector and vectors is not None and bool(request.vector) and (bool(terms) or limited)
    empty = keyword.limit(0)
    if can_vector:
        pool = vectors.join(F.broadcast(ids(keyword)), "doc_id", "left_semi") if mode == "hybrid" else vectors
        if mode == "semantic" and limited:
            pool = pool.join(ids(docs if request.compat else admitted), "doc_id", "left_semi")
        vector = R.cosine_lane(pool, list(request.vector), depth)
    else:
        vector = empty
    if request.compat and limited:
        keyword = keyword.join(ids(docs), "doc_id", "left_semi")
    fused = R.fuse(empty if mode == "semantic" else keyword, vector, request.rrf_k)
    # both lanes together have 2 * MAX_HITS rows at most, so documents stay where they lie
    fused = F.broadcast(fused).join(index.documents.select("doc_id", "corpus", "path", "title"), "doc_id")
    score = R.title_boost(F.col("score"), F.col("title"), parsed.text)
    graph = request.graph_weight > 0 and request.corpus is not None and edges is not None
    if graph:
        degrees = R.in_degrees(edges.filter(F.col("corpus") == request.corpus))
        greatest = degrees.agg(F.max("in_degree").alias("greatest"))
        fused = fused.join(degrees.select(F.col("dst_path").alias("path"), "in_degree"), "path", "left").join(F.broadcast(greatest))
        score = R.graph_boost(score, F.col("in_degree"), F.col("greatest"), request.graph_weight, request.rrf_k)
    fused = fused.withColumn("score", F.round(score, 6)).drop("in_degree", "greatest")
    if request.compat and parsed.has_facets:
        fused = fused.join(ids(admitted), "doc_id", "left_semi")

    keep = artifacts.select("corpus", "path", F.col("id").alias("artifact_id"), "summary", "mtime_ns")
    cutoff = max((c for c in (parsed.since_ns, request.since_ns) if c is not None), default=None)
    first = min(request.limit + request.offset, R.MAX_HITS)
    if request.since_before_limit and cutoff is not None:
        fused = fused.join(keep.filter(F.col("mtime_ns") >= cutoff).select("corpus", "path"), ["corpus", "path"], "left_semi")
    rows = F.broadcast(R.top(fused, first)).join(keep, ["corpus", "path"])
    if cutoff is not None:
        rows = rows.filter(F.col("mtime_ns") >= cutoff)
    rows = rows.orderBy(F.desc("score"), "doc_id").offset(request.offset).limit(request.limit)
    columns = ["doc_id", "score", "keyword_score", "keyword_rank", "vector_score", "vector_rank", "artifact_id", "corpus", "path", "title", "summary"]
    return SearchPlan(rows.select(*columns), parsed, tuple(terms), can_vector, wants_vector and not can_vector, graph)
