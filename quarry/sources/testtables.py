"""The engine's tables made from the driver's: documents become artifacts, labels facets, and so on.

Each comes as a DataFrame and as the SQL that makes the same rows (names in capitals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import FOLD_FROM, FOLD_TO, STOPWORDS, TWO
from quarry.session import spread, table

HOUR_NS = 3_600_000_000_000
EPOCH_NS = 1_704_067_200_000_000_000


def artifacts(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    d = spread(d) if text else d
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = d.select(
        "doc_id",
        F.col("lang").alias("corpus"),
        path.alias("path"),
        F.substring_index("text", "\n", 1).alias("title"),
        (F.col("doc_id") % 4).cast("int").alias("kind"),
        (F.lit(EPOCH_NS) + F.col("doc_id") * HOUR_NS).alias("mtime_ns"),
        F.col("n_chars").alias("size_bytes"),
        "text",
    )
    return rows if text else rows.drop("text")


ARTIFACTS = f"""SELECT doc_id, lang AS corpus, source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, split_part(text, chr(10), 1) AS title,
  CAST(doc_id % 4 AS INTEGER) AS kind, {EPOCH_NS} + doc_id * {HOUR_NS} AS mtime_ns, n_chars AS size_bytes, text FROM documents"""


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tags: source and, where labelled, good and toxic; caps: even, third; index: every fiftieth."""
    a = artifacts(spark, sf_dir, text=False).select("doc_id", "corpus", "path")
    labels = table(spark, sf_dir, "labels")
    row = lambda df, key, value: df.select("corpus", "path", F.lit(key).alias("key"), value.alias("value"))
    parts = [
        row(a, "tags", F.substring_index("path", "/", 1)),
        row(a.join(labels.filter("quality = 1"), "doc_id", "left_semi"), "tags", F.lit("good")),
        row(a.join(labels.filter("toxic = 1"), "doc_id", "left_semi"), "tags", F.lit("toxic")),
        row(a.filter("doc_id % 2 = 0"), "caps", F.lit("even")),
        row(a.filter("doc_id % 3 = 0"), "caps", F.lit("third")),
        row(a.filter("doc_id % 50 = 0"), "index", F.lit("true")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


METAS = f"""SELECT corpus, path, key, value FROM (
  SELECT doc_id, corpus, path, 'tags' AS key, split_part(path, '/', 1) AS value FROM ({ARTIFACTS})
  UNION ALL SELECT doc_id, corpus, path, 'tags', 'good' FROM ({ARTIFACTS}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  UNION ALL SELECT doc_id, corpus, path, 'tags', 'toxic' FROM ({ARTIFACTS}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT doc_id, corpus, path, 'caps', 'even' FROM ({ARTIFACTS}) WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, corpus, path, 'caps', 'third' FROM ({ARTIFACTS}) WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, corpus, path, 'index', 'true' FROM ({ARTIFACTS}) WHERE doc_id % 50 = 0)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document links to a third of its number and to twice its number and one."""
    a = artifacts(spark, sf_dir, text=False).select("doc_id", "corpus", F.col("path").alias("src_path"))
    to = a.withColumn("to", F.explode(F.array(F.floor(F.col("doc_id") / 3), F.col("doc_id") * 2 + 1)))
    names = a.select(F.col("doc_id").alias("to"), F.col("src_path").alias("named"))
    dst = F.coalesce("named", F.concat(F.lit("missing/"), F.col("to").cast("string"), F.lit(".md")))
    return to.join(names, "to", "left").select("corpus", "src_path", dst.alias("dst_path")).distinct()


LINKS = f"""SELECT DISTINCT s.corpus, s.path AS src_path, coalesce(t.path, 'missing/' || CAST(s.goal AS VARCHAR) || '.md') AS dst_path
  FROM (SELECT *, unnest([doc_id // 3, doc_id * 2 + 1]) AS goal FROM ({ARTIFACTS})) s LEFT JOIN ({ARTIFACTS}) t ON t.doc_id = s.goal"""
EDGES = f"SELECT l.* FROM ({LINKS}) l SEMI JOIN ({ARTIFACTS}) a ON l.corpus = a.corpus AND l.dst_path = a.path"
PENDING = f"SELECT l.* FROM ({LINKS}) l ANTI JOIN ({ARTIFACTS}) a ON l.corpus = a.corpus AND l.dst_path = a.path"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def fold_sql(text: str, gone: str = "") -> str:
    out = f"translate({text}, '{FOLD_FROM}', '{FOLD_TO}')"
    for c, f in [*TWO.items(), ("×", gone), ("÷", gone)]:
        out = f"replace({out}, '{c}', '{f}')"
    return out


def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(string_split_regex({fold_sql(text, ' ')}, '[^a-z0-9]+'), lambda t: length(t) BETWEEN 2 AND 128 AND t NOT IN ({stop}))"
