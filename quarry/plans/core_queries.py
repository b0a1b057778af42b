"""Core queries, each with the SQL that gives the same rows; importing this module registers them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.codecs import utf8_length
from quarry.functions.hashing import FNV, artifact_id, content_hash
from quarry.functions.links import normalize
from quarry.operators import facets as FA
from quarry.operators import index as I
from quarry.operators import parse as P
from quarry.operators import rank as R
from quarry.operators import store as S
from quarry.plans.grammar import parse_query
from quarry.plans.registry import query
from quarry.plans.search import SearchRequest, search
from quarry.session import shared_dir, spread, table
from quarry.sources import testtables as TT
from quarry.sources.testtables import ARTIFACTS, EDGES, LINKS, METAS, PENDING, fold_sql, tokens_sql
from quarry.streaming import events as E

Q = "apache license reed version"
TERMS = T.tokenize(Q)
VEC = 7
LIST = ", ".join


def _words(terms: list[str]) -> str:
    return LIST(f"'{t}'" for t in terms)


TOKENED = f"SELECT *, {tokens_sql('text')} AS toks FROM ({ARTIFACTS})"


def _bm25_sql(terms: str, k1: float = 1.2, b: float = 0.75, name: str = "s") -> str:
    """CTEs that end in ``name`` (doc_id, score). ``terms``: a list or subselect for IN."""
    return f"""d AS MATERIALIZED ({TOKENED}),
st AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM d),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN ({terms}) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
{name} AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM p JOIN f USING (term) CROSS JOIN st GROUP BY doc_id)"""


def _tokened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_tokens(TT.artifacts(spark, sf_dir))


_indexes: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index over a folder's documents: built and saved once a session, opened by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        I.Index.build(TT.artifacts(spark, sf_dir).select("doc_id", "corpus", "path", "title", "kind", "text")).save(path)
        _indexes[key] = path
    return I.Index.open(spark, _indexes[key])


def _bm25(index: I.Index, terms: list[str]) -> DataFrame:
    return R.bm25(index.postings.filter(F.col("term").isin(*terms)), index.stats)


# -- tokens and index


@query("tokenize_terms", f"SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM ({TOKENED})")
def tokenize_terms(spark, sf_dir):
    return _tokened(spark, sf_dir).select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("term_freq", f"SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM ({TOKENED})) GROUP BY term, doc_id")
def term_freq(spark, sf_dir):
    return I.postings(_tokened(spark, sf_dir))


@query("doc_freq", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS term FROM ({TOKENED})) GROUP BY term")
def doc_freq(spark, sf_dir):
    return I.document_frequency(I.postings(_tokened(spark, sf_dir)))


@query("doc_length", f"SELECT doc_id, CAST(len(toks) AS INTEGER) AS token_count FROM ({TOKENED})")
def doc_length(spark, sf_dir):
    return I.document_lengths(_tokened(spark, sf_dir))


@query("corpus_stats", f"SELECT count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS total_tokens, round(sum(len(toks)) / count(*), 6) AS avgdl FROM ({TOKENED})")
def corpus_stats(spark, sf_dir):
    return I.corpus_stats(I.document_lengths(_tokened(spark, sf_dir))).withColumn("avgdl", F.round("avgdl", 6))


@query("index_counts", f"SELECT count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM (SELECT DISTINCT doc_id, unnest(toks) AS term FROM ({TOKENED}))")
def index_counts(spark, sf_dir):
    post = I.postings(_tokened(spark, sf_dir))
    return post.groupBy("term").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_postings"))


@query("prefix_expand", f"SELECT term FROM (SELECT DISTINCT unnest(toks) AS term FROM ({TOKENED})) WHERE starts_with(term, 'thin') ORDER BY term LIMIT 64")
def prefix_expand(spark, sf_dir):
    terms = _tokened(spark, sf_dir).select(F.explode(F.filter("tokens", lambda t: t.startswith("thin"))).alias("term"))
    return I.expand_prefix(terms, "thin")


# -- ranking


@query("bm25_topk", f"WITH {_bm25_sql(_words(TERMS))} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return R.top(_bm25(_index(spark, sf_dir), TERMS), 20)


@query("bm25_corpus_filter", f"WITH {_bm25_sql(_words(TERMS))} SELECT s.doc_id, score, path FROM s JOIN d USING (doc_id) WHERE corpus = 'fr' ORDER BY score DESC, s.doc_id LIMIT 20")
def bm25_corpus_filter(spark, sf_dir):
    index = _index(spark, sf_dir)
    names = index.documents.filter("corpus = 'fr'").select("doc_id", "path")
    return R.top(_bm25(index, TERMS).join(names, "doc_id"), 20)


@query("bm25_path_prefix", f"WITH {_bm25_sql(_words(TERMS))} SELECT s.doc_id, score, path FROM s JOIN d USING (doc_id) WHERE starts_with(path, 'src1') ORDER BY score DESC, s.doc_id LIMIT 20")
def bm25_path_prefix(spark, sf_dir):
    index = _index(spark, sf_dir)
    names = index.documents.filter(F.col("path").startswith("src1")).select("doc_id", "path")
    return R.top(_bm25(index, TERMS).join(names, "doc_id"), 20)


@query(
    "bm25_compat_depth_then_filter",
    f"WITH {_bm25_sql(_words(TERMS))}, l AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 50) SELECT l.doc_id, score FROM l JOIN d USING (doc_id) WHERE corpus = 'es'",
)
def bm25_compat(spark, sf_dir):
    lane = R.top(_bm25(_index(spark, sf_dir), TERMS), 50)
    return lane.join(TT.artifacts(spark, sf_dir, text=False).filter("corpus = 'es'").select("doc_id"), "doc_id", "left_semi")


@query(
    "bm25_prefix",
    f"""WITH x AS (SELECT term FROM (SELECT DISTINCT unnest(toks) AS term FROM ({TOKENED})) WHERE starts_with(term, 'thin') ORDER BY term LIMIT 64),
{_bm25_sql("SELECT term FROM x UNION SELECT 'thin'")} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20""",
)
def bm25_prefix(spark, sf_dir):
    terms = [r["term"] for r in I.expand_prefix(_index(spark, sf_dir).terms, "thin").collect()]  # 64 at most
    return R.top(_bm25(_index(spark, sf_dir), sorted({*terms, "thin"})), 20)


_COS = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {VEC})), 6)"


@query("cosine_topk", f"SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 25")
def cosine_topk(spark, sf_dir):
    return R.cosine_lane(TT.vectors(spark, sf_dir), TT.vector_of(spark, sf_dir, VEC), 25)


@query("semantic_filtered", f"SELECT v.vec_id AS doc_id, {_COS} AS score FROM embeddings v JOIN ({ARTIFACTS}) a ON a.doc_id = v.vec_id WHERE corpus = 'en' AND kind = 1 ORDER BY score DESC, doc_id LIMIT 25")
def semantic_filtered(spark, sf_dir):
    docs = TT.artifacts(spark, sf_dir, text=False).filter("corpus = 'en' and kind = 1").select("doc_id")
    return R.cosine_lane(TT.vectors(spark, sf_dir).join(docs, "doc_id", "left_semi"), TT.vector_of(spark, sf_dir, VEC), 25)


_LANES = f"""{_bm25_sql(_words(TERMS), name="s0")},
k AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM s0 ORDER BY score DESC, doc_id LIMIT 200)),
v AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM k) ORDER BY score DESC, doc_id LIMIT 200)),
fu AS (SELECT doc_id, k.score AS keyword_score, CAST(k.r AS INTEGER) AS keyword_rank, v.score AS vector_score, CAST(v.r AS INTEGER) AS vector_rank, coalesce(1.0 / (60 + k.r), 0.0) + coalesce(1.0 / (60 + v.r), 0.0) AS score
  FROM k FULL JOIN v USING (doc_id))"""


def _fused(spark, sf_dir) -> DataFrame:
    keyword = R.top(_bm25(_index(spark, sf_dir), TERMS), 200)
    near = TT.vectors(spark, sf_dir).join(keyword.select("doc_id"), "doc_id", "left_semi")
    return R.fuse(keyword, R.cosine_lane(near, TT.vector_of(spark, sf_dir, VEC), 200))


@query("hybrid_rrf", f"WITH {_LANES} SELECT doc_id, keyword_score, keyword_rank, vector_score, vector_rank, round(score, 6) AS score FROM fu ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def hybrid_rrf(spark, sf_dir):
    return R.top(_fused(spark, sf_dir).withColumn("score", F.round("score", 6)), 50)


_TITLE_Q = "The reed Apache éa"
_HIT = " OR ".join(f"contains(translate(title, '{T.UPPER}', '{T.LOWER}'), '{w}')" for w in R.title_words(_TITLE_Q))


@query("title_boost", f"WITH {_LANES} SELECT doc_id, round(score * CASE WHEN {_HIT} THEN 1.5 ELSE 1.0 END, 6) AS score FROM fu JOIN d USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 50")
def title_boost(spark, sf_dir):
    rows = F.broadcast(_fused(spark, sf_dir)).join(_index(spark, sf_dir).documents.select("doc_id", "title"), "doc_id")
    return R.top(rows.select("doc_id", F.round(R.title_boost(F.col("score"), F.col("title"), _TITLE_Q), 6).alias("score")), 50)


@query("graph_in_degree", f"SELECT corpus, dst_path, count(*) AS in_degree FROM ({EDGES}) GROUP BY corpus, dst_path")
def graph_in_degree(spark, sf_dir):
    return R.in_degrees(S.resolve_links(TT.links(spark, sf_dir), TT.artifacts(spark, sf_dir, text=False))[0])


@query(
    "graph_boost",
    f"""WITH {_LANES}, g AS (SELECT dst_path, count(*) AS n FROM ({EDGES}) WHERE corpus = 'en' GROUP BY dst_path)
SELECT doc_id, round(score + 2.0 / 60 * coalesce(sqrt(coalesce(g.n, 0)) / sqrt((SELECT max(n) FROM g)), 0), 6) AS score FROM fu JOIN d USING (doc_id) LEFT JOIN g ON d.path = g.dst_path WHERE corpus = 'en'
ORDER BY 2 DESC, 1 LIMIT 50""",
)
def graph_boost(spark, sf_dir):
    names = _index(spark, sf_dir).documents.filter("corpus = 'en'").select("doc_id", "path")
    degrees = graph_in_degree(spark, sf_dir).filter("corpus = 'en'")
    most = degrees.agg(F.max("in_degree").alias("most"))
    rows = F.broadcast(_fused(spark, sf_dir)).join(names, "doc_id").join(degrees.select(F.col("dst_path").alias("path"), "in_degree"), "path", "left").join(F.broadcast(most))
    return R.top(rows.select("doc_id", F.round(R.graph_boost(F.col("score"), F.col("in_degree"), F.col("most"), 2.0), 6).alias("score")), 50)


@query(
    "batch_bm25",
    f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
d AS MATERIALIZED ({TOKENED}), st AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM d),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS r FROM s) WHERE r < 10""",
)
def batch_bm25(spark, sf_dir):
    index = _index(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return R.bm25_batch(index.postings, index.stats, asked, limit=10, terms=index.terms)


# -- facets, filters


def _facet_rows(spark, sf_dir, conjuncts) -> DataFrame:
    docs = TT.artifacts(spark, sf_dir, text=False).select("doc_id", "corpus", "path")
    joined = docs.join(FA.facet_table(TT.metas(spark, sf_dir)), ["corpus", "path"], "left")
    return joined.filter(FA.facet_predicate(conjuncts)).select("doc_id", "path")


def _facet_sql(where: str) -> str:
    return f"""WITH m AS ({METAS}), a AS (SELECT doc_id, corpus, path FROM ({ARTIFACTS})),
x AS (SELECT a.doc_id, a.path, coalesce(list(value) FILTER (key = 'tags'), []) AS tags, coalesce(list(value) FILTER (key = 'caps'), []) AS caps, coalesce(bool_or(key = 'index' AND value IN ('true', '1', 'yes', '')), false) AS idx
  FROM a LEFT JOIN m ON a.corpus = m.corpus AND a.path = m.path GROUP BY ALL)
SELECT doc_id, path FROM x WHERE {where}"""


def _has(kind: str, value: str) -> str:
    return f"list_contains({kind}, '{value}')"


for _name, _text, _where in (
    ("facet_tag_any", "tag:toxic AND tag:src3", f"{_has('tags', 'toxic')} OR {_has('tags', 'src3')}"),
    ("facet_cap_all", "cap:even caps:third tag:good", f"{_has('caps', 'even')} AND {_has('caps', 'third')} AND {_has('tags', 'good')}"),
    ("facet_not", "tag:src1 NOT tag:toxic AND NOT cap:even", f"{_has('tags', 'src1')} AND NOT {_has('tags', 'toxic')} AND NOT {_has('caps', 'even')}"),
    ("facet_or", "tag:src1 cap:even OR NOT (cap:even OR cap:third)", f"({_has('tags', 'src1')} AND {_has('caps', 'even')}) OR (NOT {_has('caps', 'even')} AND NOT {_has('caps', 'third')})"),
    ("facet_index", "index:true tag:src0", f"idx AND {_has('tags', 'src0')}"),
    ("facet_not_index", "NOT index:true cap:third", f"NOT idx AND {_has('caps', 'third')}"),
):
    query(_name, _facet_sql(_where))(lambda spark, sf_dir, text=_text: _facet_rows(spark, sf_dir, parse_query(text).conjuncts))


@query("docs_with_meta", f"SELECT DISTINCT path FROM ({METAS}) WHERE corpus = 'en' AND key = 'caps'")
def docs_with_meta(spark, sf_dir):
    return FA.documents_with(TT.metas(spark, sf_dir), "en", "caps")


@query("filter_only_list", f"SELECT doc_id, path, 0.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER) AS keyword_rank FROM ({ARTIFACTS}) WHERE starts_with(path, 'src2/') ORDER BY doc_id LIMIT 200")
def filter_only_list(spark, sf_dir):
    docs = TT.artifacts(spark, sf_dir, text=False).filter(F.col("path").startswith("src2/")).select("doc_id", "path", F.lit(0.0).alias("score"))
    return R.with_rank(R.top(docs, 200), "score", "keyword_rank")


_CUT = TT.EPOCH_NS + 300 * TT.HOUR_NS


@query(
    "since_filter",
    f"WITH {_bm25_sql(_words(TERMS))} SELECT doc_id, score FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 50) JOIN d USING (doc_id) WHERE mtime_ns >= {_CUT}",
)
def since_filter(spark, sf_dir):
    names = TT.artifacts(spark, sf_dir, text=False).filter(F.col("mtime_ns") >= _CUT).select("doc_id")
    return R.top(_bm25(_index(spark, sf_dir), TERMS), 50).join(names, "doc_id", "left_semi")


# -- store

_SLIM = "doc_id AS id, corpus, path, kind, mtime_ns, size_bytes"


def _slim(spark, sf_dir) -> DataFrame:
    return TT.artifacts(spark, sf_dir, text=False).selectExpr(*_SLIM.split(", "))


@query("list_page", f"SELECT {_SLIM} FROM ({ARTIFACTS}) WHERE kind = 2 ORDER BY corpus, path, id LIMIT 40 OFFSET 30")
def list_page(spark, sf_dir):
    return S.list_page(_slim(spark, sf_dir).withColumn("source", F.lit("")), kind=2, limit=40, offset=30)


@query("count_by_corpus", f"SELECT corpus, least(count(*), 1000) AS n_docs, count(*) > 1000 AS truncated FROM ({ARTIFACTS}) GROUP BY corpus")
def count_by_corpus(spark, sf_dir):
    return S.counts_by_corpus(_slim(spark, sf_dir))


@query("total_bytes", f"SELECT count(*) AS n_artifacts, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM ({ARTIFACTS})")
def total_bytes(spark, sf_dir):
    return S.totals(_slim(spark, sf_dir))


@query("distinct_corpora", f"SELECT DISTINCT corpus FROM ({ARTIFACTS}) ORDER BY corpus LIMIT 256")
def distinct_corpora(spark, sf_dir):
    return _slim(spark, sf_dir).select("corpus").distinct().orderBy("corpus").limit(256)


@query("batch_lookup", f"SELECT w.slot, w.path, a.id FROM (SELECT CAST(range AS BIGINT) AS slot, 'en' AS corpus, 'src' || (range % 20) || '/' || range || '.md' AS path FROM range(0, 500)) w LEFT JOIN (SELECT {_SLIM} FROM ({ARTIFACTS})) a ON a.corpus = w.corpus AND a.path = w.path")
def batch_lookup(spark, sf_dir):
    wanted = spark.range(500).selectExpr("id AS slot", "'en' AS corpus", "concat('src', id % 20, '/', id, '.md') AS path")
    return S.get_many(_slim(spark, sf_dir).withColumn("source", F.lit("")), wanted).select("slot", "path", "id")


_STORED = f"SELECT id, corpus, path, kind, CASE WHEN id % 7 = 0 THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns, size_bytes FROM (SELECT {_SLIM} FROM ({ARTIFACTS})) WHERE id % 11 <> 0"
_MANIFEST = f"SELECT * FROM (SELECT {_SLIM} FROM ({ARTIFACTS})) WHERE id % 5 <> 0"


def _stored(spark, sf_dir) -> DataFrame:
    rows = _slim(spark, sf_dir).filter("id % 11 <> 0")
    return rows.withColumn("mtime_ns", F.when(F.col("id") % 7 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")))


def _manifest(spark, sf_dir) -> DataFrame:
    return _slim(spark, sf_dir).filter("id % 5 <> 0")


@query("change_detect", f"SELECT m.corpus, m.path, s.id IS NULL OR s.mtime_ns <> m.mtime_ns OR s.size_bytes <> m.size_bytes AS changed FROM ({_MANIFEST}) m LEFT JOIN ({_STORED}) s ON m.corpus = s.corpus AND m.path = s.path")
def change_detect(spark, sf_dir):
    return S.change_detect(_manifest(spark, sf_dir), _stored(spark, sf_dir)).select("corpus", "path", "changed")


@query("orphan_sweep", f"SELECT s.id, s.path FROM ({_STORED}) s ANTI JOIN ({_MANIFEST}) m ON m.corpus = s.corpus AND m.path = s.path")
def orphan_sweep(spark, sf_dir):
    return S.orphans(_stored(spark, sf_dir), _manifest(spark, sf_dir)).select("id", "path")


@query("upsert_latest", f"SELECT id, corpus, path, kind, mtime_ns, size_bytes FROM ({_MANIFEST}) UNION ALL SELECT s.* FROM ({_STORED}) s ANTI JOIN ({_MANIFEST}) m ON m.corpus = s.corpus AND m.path = s.path")
def upsert_latest(spark, sf_dir):
    return S.upsert(_stored(spark, sf_dir), _manifest(spark, sf_dir))


@query("path_set_operations", f"""SELECT 'union' AS op, count(*) AS n FROM (SELECT path FROM ({_STORED}) UNION SELECT path FROM ({_MANIFEST}))
UNION ALL SELECT 'intersect', count(*) FROM (SELECT path FROM ({_STORED}) INTERSECT SELECT path FROM ({_MANIFEST}))
UNION ALL SELECT 'except', count(*) FROM (SELECT path FROM ({_STORED}) EXCEPT SELECT path FROM ({_MANIFEST}))""")
def path_set_operations(spark, sf_dir):
    a, b = _stored(spark, sf_dir).select("path"), _manifest(spark, sf_dir).select("path")
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in named.items()])


# -- links


@query("edges_resolved", EDGES)
def edges_resolved(spark, sf_dir):
    return S.resolve_links(TT.links(spark, sf_dir), TT.artifacts(spark, sf_dir, text=False))[0].select("corpus", "src_path", "dst_path")


@query("pending_links", PENDING)
def pending_links(spark, sf_dir):
    return S.resolve_links(TT.links(spark, sf_dir), TT.artifacts(spark, sf_dir, text=False))[1].select("corpus", "src_path", "dst_path")


@query("edge_counts", f"SELECT (SELECT count(*) FROM ({EDGES})) AS n_edges, (SELECT count(*) FROM ({PENDING})) AS n_pending")
def edge_counts(spark, sf_dir):
    e, p = S.resolve_links(TT.links(spark, sf_dir), TT.artifacts(spark, sf_dir, text=False))
    return e.agg(F.count("*").alias("n_edges")).join(F.broadcast(p.agg(F.count("*").alias("n_pending"))))


_EARLY = "doc_id % 2 = 0"


@query(
    "drain_pending",
    f"""WITH l AS ({LINKS}), a AS ({ARTIFACTS}), old AS (SELECT * FROM a WHERE {_EARLY}), late AS (SELECT * FROM a WHERE NOT ({_EARLY})),
own AS (SELECT l.* FROM l SEMI JOIN old ON l.corpus = old.corpus AND l.src_path = old.path)
SELECT corpus, src_path, dst_path, 'edge' AS state FROM own SEMI JOIN a ON own.corpus = a.corpus AND own.dst_path = a.path
UNION ALL SELECT corpus, src_path, dst_path, 'pending' FROM own ANTI JOIN a ON own.corpus = a.corpus AND own.dst_path = a.path""",
)
def drain_pending(spark, sf_dir):
    """Links of the even documents wait for the odd ones, which then arrive."""
    every = TT.artifacts(spark, sf_dir, text=False)
    old, late = every.filter(_EARLY), every.filter(f"not ({_EARLY})")
    own = TT.links(spark, sf_dir).join(old.select("corpus", F.col("path").alias("src_path")), ["corpus", "src_path"], "left_semi")
    edges, pending = S.drain_pending(*S.resolve_links(own, old), late, every)
    tag = lambda df, s: df.select("corpus", "src_path", "dst_path", F.lit(s).alias("state"))
    return tag(edges, "edge").unionByName(tag(pending, "pending"))


@query(
    "forget_document",
    f"""WITH e AS ({EDGES}), p AS ({PENDING}), g AS (SELECT corpus, path FROM ({ARTIFACTS}) WHERE doc_id % 10 = 3),
k AS (SELECT e.* FROM e ANTI JOIN g ON e.corpus = g.corpus AND e.src_path = g.path)
SELECT corpus, src_path, dst_path, 'edge' AS state FROM k ANTI JOIN g ON k.corpus = g.corpus AND k.dst_path = g.path
UNION ALL SELECT corpus, src_path, dst_path, 'pending' FROM k SEMI JOIN g ON k.corpus = g.corpus AND k.dst_path = g.path
UNION ALL SELECT corpus, src_path, dst_path, 'pending' FROM p ANTI JOIN g ON p.corpus = g.corpus AND p.src_path = g.path""",
)
def forget_document(spark, sf_dir):
    every = TT.artifacts(spark, sf_dir, text=False)
    gone = every.filter("doc_id % 10 = 3").select("corpus", "path")
    edges, pending, _ = S.forget(*S.resolve_links(TT.links(spark, sf_dir), every), TT.metas(spark, sf_dir), gone)
    tag = lambda df, s: df.select("corpus", "src_path", "dst_path", F.lit(s).alias("state"))
    return tag(edges, "edge").unionByName(tag(pending, "pending"))


_TARGETS = ("./x.md", "../x/y.md", "../../z.md", "/root.md", "sub/", "https://x.test/", "#a", "y.md#part", "y.md?q=1", " a b.md ", "..\\w.md", "", "../../../out.md", "a/./b/../c.md")
_NORMAL = ("{p}/deep/x.md", "{p}/x/y.md", "z.md", "root.md", "{p}/deep/sub", None, None, "{p}/deep/y.md", None, "{p}/deep/a b.md", "{p}/w.md", None, None, "{p}/deep/a/c.md")


@query(
    "link_normalize",
    "WITH d AS (SELECT doc_id, source FROM documents) "
    + " UNION ALL ".join(
        "SELECT doc_id, '{}' AS target, {} AS path FROM d".format(t, "CAST(NULL AS VARCHAR)" if n is None else "replace('{}', '{{p}}', source)".format(n)) for t, n in zip(_TARGETS, _NORMAL, strict=True)
    ),
)
def link_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/deep/note.md")).alias("src"))
    rows = docs.withColumn("target", F.explode(F.array(*(F.lit(t) for t in _TARGETS))))
    return rows.select("doc_id", "target", normalize(F.col("src"), F.col("target")).alias("path"))


# -- text functions and extraction


@query("chunk_list", "SELECT CAST(conv_id AS BIGINT) AS doc_id, 'b' || CAST(turn AS VARCHAR) AS id, turn AS ord, text FROM conversations WHERE conv_id = 3 ORDER BY ord")
def chunk_list(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    return S.list_chunks(chunks, 3).select(F.lit(3).cast("long").alias("doc_id"), "id", "ord", "text")


@query("fold_ascii", f"SELECT doc_id, md5({fold_sql('text')}) AS folded_md5 FROM documents")
def fold_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"))


@query("slugify", f"SELECT doc_id, regexp_replace(regexp_replace({fold_sql('title')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM ({ARTIFACTS})")
def slugify(spark, sf_dir):
    return TT.artifacts(spark, sf_dir).select("doc_id", T.slugify(F.col("title")).alias("slug"))


_ODD_PATH = "CASE doc_id % 4 WHEN 0 THEN source || '/' || doc_id || '-x_y.html' WHEN 1 THEN source || '/v1.2/' || doc_id || '.a-b.md' WHEN 2 THEN doc_id || '_none' ELSE source || '-d/.hidden' || doc_id END"


@query("title_from_path", f"SELECT doc_id, translate(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '-_', '  ') AS title FROM (SELECT doc_id, {_ODD_PATH} AS p FROM ({ARTIFACTS.replace('lang AS corpus', 'source, lang AS corpus')}))")
def title_from_path(spark, sf_dir):
    path = F.expr(_ODD_PATH)
    return table(spark, sf_dir, "documents").select("doc_id", T.title_from_path(path).alias("title"))


@query("utf8_lengths_codecs", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(strlen(text) AS INTEGER) AS n_bytes, md5(to_base64(encode(text))) AS base64_md5, md5(hex(encode(text))) AS hex_md5 FROM documents")
def utf8_lengths_codecs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    plain = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    return d.select("doc_id", utf8_length(F.col("text")).alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.md5(plain).alias("base64_md5"), F.md5(F.hex(F.encode("text", "UTF-8"))).alias("hex_md5"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def _pages(spark, sf_dir) -> DataFrame:
    rest = F.regexp_extract("url", "://(.*)$", 1)
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.regexp_extract(rest, "^([^/]*)", 1).alias("corpus"), F.regexp_replace(F.regexp_extract(rest, "^[^/]*/([^?#]*)", 1), "/$", "").alias("path"), F.col("html").alias("source"))


@query("html_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    """The title element, of pages that have a heading too: the parser's title prefers the heading."""
    found = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(found, r"\s+", " ")).alias("title"))


@query(
    "html_links",
    r"""WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS t FROM pages)
SELECT DISTINCT page_id, regexp_replace(ltrim(t, '/'), '/+$', '') AS target FROM h WHERE starts_with(t, '/') AND NOT contains(t, ':') AND NOT contains(t, '?') AND NOT contains(t, '#') AND length(ltrim(t, '/')) > 0""",
)
def html_links(spark, sf_dir):
    rows = P.parse_table(_pages(spark, sf_dir))
    return rows.select("page_id", F.explode("links").alias("l")).select("page_id", F.col("l.target").alias("target")).distinct()


@query("parse_pages")
def parse_pages(spark, sf_dir):
    p = P.parse_table(_pages(spark, sf_dir))
    return p.select("page_id", "title", F.size("blocks").alias("n_blocks"), "heading_count", F.size("links").alias("n_links"), F.size("metas").alias("n_metas"), "summary")


def _fnv_sql(text: str, bits: int) -> str:
    """FNV-1a over a text's bytes; 128-bit integers hold every product."""
    basis, prime = FNV[bits]
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::HUGEINT)"
    return f"list_reduce(list_prepend({basis}::HUGEINT, {octets}), lambda h, b: (xor(h, b) * {prime}) % {1 << bits}::HUGEINT)"


@query("artifact_identity", f"SELECT doc_id, printf('%012x', CAST({_fnv_sql("corpus || chr(31) || path", 64)} // 65536 AS BIGINT)) AS id, CAST({_fnv_sql('text', 32)} AS BIGINT) AS content_hash FROM ({ARTIFACTS})")
def artifact_identity(spark, sf_dir):
    a = TT.artifacts(spark, sf_dir)
    return a.select("doc_id", artifact_id("corpus", "path").alias("id"), content_hash("text").alias("content_hash"))


# -- streams

_SPAN = 3_600_000_000


def _events(spark, sf_dir) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "removed").otherwise("changed")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), action.alias("action"))


_EVENTS = "SELECT event_id, user_id AS key, epoch_us(ts) AS tick, CASE WHEN event_type = 'purchase' THEN 'removed' ELSE 'changed' END AS action FROM events"
_WINDOWS = f"""e AS MATERIALIZED ({_EVENTS}), u AS MATERIALIZED (SELECT DISTINCT key, tick FROM e),
n AS MATERIALIZED (SELECT u.key, u.tick, v.tick AS nxt FROM u ASOF LEFT JOIN u v ON u.key = v.key AND u.tick + {_SPAN} <= v.tick),
w AS (SELECT key, min(tick) AS tick FROM u GROUP BY key UNION ALL SELECT w.key, n.nxt FROM w JOIN n ON w.key = n.key AND w.tick = n.tick WHERE n.nxt IS NOT NULL),
g AS (SELECT e.*, w.tick AS opened FROM e ASOF JOIN w ON e.key = w.key AND e.tick >= w.tick)"""


@query("debounce_first", f"WITH RECURSIVE {_WINDOWS} SELECT key, opened, opened + {_SPAN} AS published, count(*) AS events, bool_or(action = 'removed') AS removed FROM g GROUP BY key, opened")
def debounce_first(spark, sf_dir):
    return E.debounce(_events(spark, sf_dir), ["key"], "at", _SPAN).drop("window")


@query("rate_limit_windows", f"WITH RECURSIVE {_WINDOWS} SELECT key, opened, count(*) AS requests, least(count(*), 2) AS admitted, count(*) - least(count(*), 2) AS rejected FROM g GROUP BY key, opened")
def rate_limit_windows(spark, sf_dir):
    return E.rate_windows(_events(spark, sf_dir), ["key"], "at", _SPAN, 2).drop("window")


@query("event_ring_last256", f"SELECT id, event_id, action FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS id, count(*) OVER () AS n FROM ({_EVENTS})) WHERE id > n - 256 AND id > n - 100")
def event_ring_last256(spark, sf_dir):
    events = _events(spark, sf_dir)
    n = events.count()
    return E.event_ring(events, "event_id", after=n - 100).select("id", "event_id", "action")


@query("latency_percentile", "SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share, unnest([quantile_disc(value, 0.5), quantile_disc(value, 0.95), quantile_disc(value, 0.99)]) AS value FROM events")
def latency_percentile(spark, sf_dir):
    return R.percentile_nearest(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99])


# -- the whole plan


def _search(spark, sf_dir, **kw) -> DataFrame:
    docs = TT.artifacts(spark, sf_dir, text=False).withColumn("text", F.lit(""))
    index = _index(spark, sf_dir)
    names = docs.drop("text").withColumns({"id": F.col("doc_id").cast("string"), "summary": F.lit("")})
    edges = S.resolve_links(TT.links(spark, sf_dir), docs.drop("text"))[0]
    request = SearchRequest(vector=tuple(TT.vector_of(spark, sf_dir, VEC)), **kw)
    return search(request, index, names, TT.vectors(spark, sf_dir), FA.facet_table(TT.metas(spark, sf_dir)), edges).rows.select("doc_id", "score", "keyword_rank", "vector_rank", "path")


@query(
    "search_plan",
    f"""WITH RECURSIVE m AS ({METAS}), {_bm25_sql(_words(TERMS), name="s0")},
ok AS (SELECT DISTINCT d.doc_id FROM d JOIN m ON d.corpus = m.corpus AND d.path = m.path WHERE d.corpus = 'en' AND starts_with(d.path, 'src1') AND key = 'tags' AND value IN ('good', 'toxic')),
k AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT * FROM s0 WHERE doc_id IN (SELECT doc_id FROM ok) ORDER BY score DESC, doc_id LIMIT 200)),
v AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM k))),
g AS (SELECT dst_path, count(*) AS n FROM ({EDGES}) WHERE corpus = 'en' GROUP BY dst_path),
x AS (SELECT doc_id, CAST(k.r AS INTEGER) AS keyword_rank, CAST(v.r AS INTEGER) AS vector_rank, path, mtime_ns,
  round((coalesce(1.0 / (60 + k.r), 0.0) + coalesce(1.0 / (60 + v.r), 0.0)) * CASE WHEN {' OR '.join(f"contains(translate(title, '{T.UPPER}', '{T.LOWER}'), '{w}')" for w in R.title_words(Q))} THEN 1.5 ELSE 1.0 END
    + 1.0 / 60 * coalesce(sqrt(coalesce(g.n, 0)) / sqrt((SELECT max(n) FROM g)), 0), 6) AS score
  FROM k LEFT JOIN v USING (doc_id) JOIN d USING (doc_id) LEFT JOIN g ON d.path = g.dst_path)
SELECT doc_id, score, keyword_rank, vector_rank, path FROM (SELECT * FROM x ORDER BY score DESC, doc_id LIMIT 30) WHERE mtime_ns >= {_CUT} ORDER BY score DESC, doc_id""",
)
def search_plan(spark, sf_dir):
    """Hybrid search with folder, tags, time cutoff, title and graph boosts: every step of the plan."""
    text = f"{Q} folder:src1 (tag:good OR tag:toxic) since:{_CUT // 10**9}"
    return _search(spark, sf_dir, q=text, corpus="en", graph_weight=1.0, limit=30)


@query("search_filter_only", f"SELECT doc_id, round(1.0 / (60 + r), 6) AS score, CAST(r AS INTEGER) AS keyword_rank, path FROM (SELECT doc_id, path, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM ({ARTIFACTS}) WHERE starts_with(path, 'src3/')) WHERE r < 200 ORDER BY 2 DESC, 1 LIMIT 25")
def search_filter_only(spark, sf_dir):
    return _search(spark, sf_dir, q="folder:src3/", mode="keyword", limit=25).drop("vector_rank")


