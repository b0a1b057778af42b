"""Queries over documents that are made to measure, so that SQL can say what the parser must find, and
over the store's writes. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import parse as P
from quarry.operators import store as S
from quarry.plans.registry import query
from quarry.session import table
from quarry.sources import testtables as TT
from quarry.sources.testtables import ARTIFACTS, EDGES, METAS, PENDING

# One expression for both engines: a Markdown document of every block form for even ids, a web page else.
_NOTE = """'---\\nkb-tags: [t' || (doc_id % 7) || ', ' || lang || ']\\nkb-note: n' || doc_id || '\\n---\\n# Head ' || doc_id || ' One\\n\\nPlain words ' || doc_id || ' &amp; more &lt;b&gt;\\nsecond line\\n\\n## Sub '
|| doc_id || ' ##\\n\\nSetext ' || doc_id || '\\n-----\\n\\n```py\\ncode ' || doc_id || ' [x](no.md)\\n```\\n\\nSee [link ' || doc_id || '](../t' || doc_id || '.md#part) and [[wiki' || doc_id || '|Shown]] and [ext](https://e.test/).\\n'"""
_PAGE = """'<html><head><title>Page ' || doc_id || '</title><meta name="kb-caps" content="c' || doc_id || ', svg"><style>p {}</style></head><body><h1>Top ' || doc_id || '</h1><p id="p' || doc_id
|| '">One &#65;&amp;<b>two</b></p><script>leak</script><div>Go <a href="x' || doc_id || '.md#f">there ' || doc_id || '</a></div></body></html>'"""


def _made_sql(text: str) -> str:
    return text.replace("\\n", "' || chr(10) || '")


_SOURCE = f"CASE WHEN doc_id % 2 = 0 THEN {_made_sql(_NOTE)} ELSE {_made_sql(_PAGE)} END"
_PATH = "CASE WHEN doc_id % 2 = 0 THEN 'dir/' || doc_id || '.md' ELSE 'web/' || doc_id || '.html' END"
_EVEN, _ODD = "FROM documents WHERE doc_id % 2 = 0", "FROM documents WHERE doc_id % 2 = 1"


def _made(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("corpus"), F.expr(_PATH).alias("path"), F.expr(_SOURCE).alias("source"))
    return P.parse_table(docs).withColumn("id", F.col("doc_id").cast("string"))


def _rows(*rows: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {columns} {where}" for columns, where in rows)


_BLOCKS = _rows(
    ("doc_id, 0 AS ord, 'head-' || doc_id || '-one' AS id, 'Head ' || doc_id || ' One' AS text, 1 AS level", _EVEN),
    ("doc_id, 1, 'b1', 'Plain words ' || doc_id || ' & more <b> second line', 0", _EVEN),
    ("doc_id, 2, 'sub-' || doc_id, 'Sub ' || doc_id, 2", _EVEN),
    ("doc_id, 3, 'setext-' || doc_id, 'Setext ' || doc_id, 2", _EVEN),
    ("doc_id, 4, 'code-py-1', 'code ' || doc_id || ' [x](no.md)', 0", _EVEN),
    ("doc_id, 5, 'b5', 'See link ' || doc_id || ' and Shown and ext.', 0", _EVEN),
    ("doc_id, 0, 'b0', 'Page ' || doc_id, 0", _ODD),
    ("doc_id, 1, 'top-' || doc_id, 'Top ' || doc_id, 1", _ODD),
    ("doc_id, 2, 'b2', 'One A&two', 0", _ODD),
    ("doc_id, 3, 'b3', 'Go there ' || doc_id, 0", _ODD),
)


@query("parse_blocks", _BLOCKS)
def parse_blocks(spark, sf_dir):
    rows = _made(spark, sf_dir).select("doc_id", F.posexplode("blocks").alias("ord", "b"))
    return rows.select("doc_id", "ord", "b.id", "b.text", F.col("b.heading_level").alias("level"))


@query(
    "parse_outline",
    _rows(
        ("doc_id, 'Head ' || doc_id || ' One' AS title, 'Plain words ' || doc_id || ' & more <b> second line' AS summary, 3 AS heading_count, 'head-' || doc_id || '-one,sub-' || doc_id || ',setext-' || doc_id || ',code-py-1' AS anchors", _EVEN),
        ("doc_id, 'Top ' || doc_id, 'Page ' || doc_id, 1, 'top-' || doc_id || ',p' || doc_id", _ODD),
    ),
)
def parse_outline(spark, sf_dir):
    return _made(spark, sf_dir).select("doc_id", "title", "summary", "heading_count", F.array_join("anchors", ",").alias("anchors"))


@query(
    "parse_links",
    _rows(
        ("doc_id, 't' || doc_id || '.md' AS target, 'link ' || doc_id AS text", _EVEN),
        ("doc_id, 'dir/wiki' || doc_id, 'Shown'", _EVEN),
        ("doc_id, 'web/x' || doc_id || '.md', 'there ' || doc_id", _ODD),
    ),
)
def parse_links(spark, sf_dir):
    return _made(spark, sf_dir).select("doc_id", F.explode("links").alias("l")).select("doc_id", "l.*")


@query(
    "parse_metas",
    f"SELECT DISTINCT corpus, path, key, value FROM (SELECT lang AS corpus, {_PATH} AS path, unnest(CASE WHEN doc_id % 2 = 0 THEN ['tags', 'tags', 'note'] ELSE ['caps', 'caps'] END) AS key, unnest(CASE WHEN doc_id % 2 = 0 THEN ['t' || (doc_id % 7), lang, 'n' || doc_id] ELSE ['c' || doc_id, 'svg'] END) AS value FROM documents)",
)
def parse_metas(spark, sf_dir):
    return P.metas(_made(spark, sf_dir))


@query("chunks_made", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, ord, text FROM ({_BLOCKS})")
def chunks_made(spark, sf_dir):
    return P.chunks(_made(spark, sf_dir))


@query("searchable_text", f"SELECT doc_id, md5(t.text || ' ' || t.text || ' ' || string_agg(b.text, ' ' ORDER BY b.ord)) AS text_md5 FROM ({_BLOCKS}) b JOIN (SELECT doc_id, text FROM ({_BLOCKS}) WHERE level = 1) t USING (doc_id) GROUP BY doc_id, t.text")
def searchable_text(spark, sf_dir):
    return _made(spark, sf_dir).select("doc_id", F.md5(P.searchable_text(F.col("title"), F.col("blocks"))).alias("text_md5"))


# -- writes of the store

_CHUNKS = "SELECT conv_id AS doc_id, turn AS ord, text FROM conversations"


def _chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")


@query("replace_chunks", f"SELECT * FROM ({_CHUNKS}) WHERE doc_id % 4 > 1 UNION ALL SELECT DISTINCT doc_id, 0::BIGINT, 'new ' || doc_id FROM ({_CHUNKS}) WHERE doc_id % 4 = 0")
def replace_chunks(spark, sf_dir):
    """Documents 0 of 4 get one chunk, 1 of 4 none."""
    chunks = _chunks(spark, sf_dir)
    named = chunks.filter("doc_id % 4 < 2").select("doc_id").distinct()
    incoming = named.filter("doc_id % 4 = 0").select("doc_id", F.lit(0).cast("long").alias("ord"), F.concat(F.lit("new "), "doc_id").alias("text"))
    return S.replace_chunks(chunks, incoming, named)


@query("delete_artifacts", f"SELECT 'artifact' AS what, doc_id AS id, 0::BIGINT AS ord FROM ({ARTIFACTS}) WHERE doc_id % 9 > 0 UNION ALL SELECT 'chunk', doc_id, ord FROM ({_CHUNKS}) WHERE doc_id % 9 > 0")
def delete_artifacts(spark, sf_dir):
    a = TT.artifacts(spark, sf_dir, text=False).withColumnRenamed("doc_id", "id")
    none = spark.createDataFrame([], "doc_id long, id string")
    left, chunks, _ = S.delete_artifacts(a.filter("id % 9 = 0").select("id"), a, _chunks(spark, sf_dir), none)
    return left.select(F.lit("artifact").alias("what"), "id", F.lit(0).cast("long").alias("ord")).unionByName(chunks.select(F.lit("chunk").alias("what"), F.col("doc_id").alias("id"), "ord"))


_SOURCES = f"SELECT corpus, path, doc_id FROM ({ARTIFACTS}) WHERE doc_id % 6 < 2"


@query(
    "replace_edges",
    f"SELECT e.* FROM ({EDGES}) e ANTI JOIN ({_SOURCES}) s ON e.corpus = s.corpus AND e.src_path = s.path UNION SELECT corpus, path, path FROM ({_SOURCES}) WHERE doc_id % 6 = 0",
)
def replace_edges(spark, sf_dir):
    """Documents 0 of 6 link to themselves alone, 1 of 6 to none."""
    every = TT.artifacts(spark, sf_dir, text=False)
    edges, _ = S.resolve_links(TT.links(spark, sf_dir), every)
    sources = every.filter("doc_id % 6 < 2")
    incoming = sources.filter("doc_id % 6 = 0").select("corpus", F.col("path").alias("src_path"), F.col("path").alias("dst_path"))
    return S.replace_edges(edges, incoming, sources.select("corpus", "path"))


@query("add_pending", f"SELECT * FROM ({PENDING}) UNION SELECT corpus, path, 'later/' || (doc_id % 3) || '.md' FROM ({ARTIFACTS}) WHERE doc_id % 5 = 0")
def add_pending(spark, sf_dir):
    every = TT.artifacts(spark, sf_dir, text=False)
    _, pending = S.resolve_links(TT.links(spark, sf_dir), every)
    more = every.filter("doc_id % 5 = 0").select("corpus", F.col("path").alias("src_path"), F.concat(F.lit("later/"), F.col("doc_id") % 3, F.lit(".md")).alias("dst_path"))
    return S.add_pending(pending, more.unionByName(more))


@query(
    "replace_metas",
    f"SELECT m.* FROM ({METAS}) m ANTI JOIN (SELECT corpus, path FROM ({ARTIFACTS}) WHERE doc_id % 8 = 2) g ON m.corpus = g.corpus AND m.path = g.path UNION ALL SELECT corpus, path, 'tags', 'fresh' FROM ({ARTIFACTS}) WHERE doc_id % 16 = 2",
)
def replace_metas(spark, sf_dir):
    a = TT.artifacts(spark, sf_dir, text=False)
    incoming = a.filter("doc_id % 16 = 2").select("corpus", "path", F.lit("tags").alias("key"), F.lit("fresh").alias("value"))
    return S.replace_metas(TT.metas(spark, sf_dir), incoming.unionByName(incoming), a.filter("doc_id % 8 = 2").select("corpus", "path"))


@query(
    "comments_resolved",
    "SELECT id, doc_id, created_at, id = 'c3-1' AS resolved FROM (SELECT 'c' || conv_id || '-' || turn AS id, conv_id AS doc_id, CAST(turn AS VARCHAR) AS created_at FROM conversations WHERE role = 'user' OR conv_id % 2 = 1) WHERE doc_id = 3 ORDER BY created_at, id LIMIT 50",
)
def comments_resolved(spark, sf_dir):
    """Comments of users are stored, those on odd documents are added, one is resolved; a document's list."""
    turns = table(spark, sf_dir, "conversations")
    row = turns.select(F.expr("'c' || conv_id || '-' || turn").alias("id"), F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("created_at"), F.lit(False).alias("resolved"), "role")
    stored = row.filter("role = 'user'").drop("role")
    known = turns.select(F.col("conv_id").alias("id")).distinct()
    every = S.add_comments(stored, row.filter("role <> 'user' and doc_id % 2 = 1").drop("role"), known)
    return S.list_comments(S.set_resolved(every, "c3-1", True), 3)


@query("point_lookup", f"SELECT doc_id AS id, path, title FROM ({ARTIFACTS}) WHERE doc_id = 17 UNION ALL SELECT doc_id, path, title FROM ({ARTIFACTS}) WHERE corpus = 'en' AND path = (SELECT min(path) FROM ({ARTIFACTS}) WHERE corpus = 'en')")
def point_lookup(spark, sf_dir):
    a = TT.artifacts(spark, sf_dir).withColumn("source", F.lit("")).withColumnRenamed("doc_id", "id")
    first = a.filter("corpus = 'en'").agg(F.min("path")).first()[0]
    return S.get(a, 17).select("id", "path", "title").unionByName(S.get_by_path(a, "en", first).select("id", "path", "title"))


@query("glob_paths", f"SELECT doc_id, regexp_full_match(path, 'src[^/]/.*5[.]md') AND length(path) > 0 AS narrow, path LIKE 'src1%.md' AS wide FROM ({ARTIFACTS})")
def glob_paths(spark, sf_dir):
    a = TT.artifacts(spark, sf_dir, text=False)
    return a.select("doc_id", F.col("path").rlike("(?s)" + T.glob_regex("src?/*5.md")).alias("narrow"), F.col("path").rlike("(?s)" + T.glob_regex("src1*.md")).alias("wide"))
