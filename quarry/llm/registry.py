"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import decontaminate, mixing, neighbours, resample, simhash, substrings, tokenbin, tokencount, toxicity, urlfilter

MODULES = (resample, urlfilter, neighbours, toxicity, tokencount, tokenbin, simhash, mixing, substrings, decontaminate)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {m.NAME: m.SQL for m in MODULES if m.SQL} | pipeline
