"""Facets: documents admitted by what they declare about themselves.

Within one alternative, tags mean any of them, caps all of them, and negated values none. An
alternative without positive facets admits every document that it does not exclude.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.grammar import FALSE_VALUES, Atom

INDEX_VALUES = ("true", "1", "yes", "")


def facet_table(metas: DataFrame) -> DataFrame:
    """corpus, path, tags, caps, is_index of documents that declare any (key, value)."""
    values = lambda key: F.collect_set(F.when(F.col("key") == key, F.col("value")))
    flag = F.max((F.col("key") == "index") & F.col("value").isin(*INDEX_VALUES))
    return metas.groupBy("corpus", "path").agg(values("tags").alias("tags"), values("caps").alias("caps"), flag.alias("is_index"))


def index_page(path: Column, declared: Column) -> Column:
    return F.coalesce(declared, F.lit(False)) | F.regexp_extract(F.lower(path), "([^/]*)$", 1).isin("index.html", "index.md")


def _held(array: str, value: str) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def conjunct_predicate(atoms: tuple[Atom, ...]) -> Column:
    parts: list[Column] = []
    tags = [_held("tags", a.value) for a in atoms if a.key == "tag" and not a.negated]
    if tags:
        parts.append(reduce(lambda x, y: x | y, tags))
    parts += [_held("caps", a.value) for a in atoms if a.key == "cap" and not a.negated]
    parts += [~_held("tags" if a.key == "tag" else "caps", a.value) for a in atoms if a.key in ("tag", "cap") and a.negated]
    for a in atoms:
        if a.key == "index":
            no = a.value.lower() in FALSE_VALUES
            if not (no and a.negated):
                page = index_page(F.col("path"), F.col("is_index"))
                parts.append(~page if no or a.negated else page)
    return reduce(lambda x, y: x & y, parts, F.lit(True))


def facet_predicate(conjuncts: tuple[tuple[Atom, ...], ...]) -> Column:
    """One boolean column over path, tags, caps, is_index."""
    if not conjuncts:
        return F.lit(True)
    return reduce(lambda x, y: x | y, (conjunct_predicate(c) for c in conjuncts))


def documents_with(metas: DataFrame, corpus: str, key: str, value: str | None = None) -> DataFrame:
    rows = metas.filter((F.col("corpus") == corpus) & (F.col("key") == key))
    return (rows if value is None else rows.filter(F.col("value") == value)).select("path").distinct()
