"""A corpus from raw documents to token files, in five stages.

Every stage gets all that the one before it kept, as a table reread from Parquet, and returns the
columns of documents; the last returns what its files hold. Each stage's module states how it treats
nulls, empty and very long texts, repeated rows and empty tables; here a document whose text is null
passes the filters as an empty one does.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.decontaminate import decontaminate
from quarry.llm.mixing import mix_sources
from quarry.llm.nearcopies import one_of_each
from quarry.llm.tokenbin import token_files
from quarry.llm.toxicity import fit_toxicity
from quarry.session import shared_dir, table

#: Near copies, an EM fit and a tokenizer have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Features lie beside the rows: no join, one look at a text."""
    model, seen = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return seen.filter(model.column(F.col("at"), F.col("value")) < 0.5).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8) stays: the one
    of the smallest doc_id; where rows of a group share it, or none has one, one row.

    Candidates are groups of near SimHash fingerprints, found by the Gray-order trees of the SimHash
    operator (``nearcopies`` says how wide they must be); exact similarities decide within them.
    """
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, window: int = 13) -> DataFrame:
    """Documents that hold a whole window of a benchmark item go, however long they are.

    Of items shorter than a window, a twentieth or more of a document's words must lie in them.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), window)
    bad = found.filter((F.col("longest") >= window) | F.col("contaminated"))
    bad = bad.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("th"))
    return rows.join(bad, same, "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: by file and by row within it."""
    placed = mix_sources(docs)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(tasks, "position").sortWithinPartitions("position").select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the rows lie in their files (elsewhere: of doc_id)."""
    columns = ["doc_id", "text"]
    try:
        placed = docs.select(*columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files
        return token_files(docs.select(*columns))
    return token_files(placed, ["_file", "_row"])


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
