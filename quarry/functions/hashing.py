"""FNV-1a hashes and document identity (Arrow UDFs: wrapping multiplication has no SQL form)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Offset basis and prime of FNV-1a, by bits.
FNV = {32: (0x811C9DC5, 0x01000193), 64: (0xCBF29CE484222325, 0x100000001B3)}


def _fnv(data: bytes, basis: int, prime: int, mask: int) -> int:
    h = basis
    for byte in data:
        h = ((h ^ byte) * prime) & mask
    return h


def fnv1a32(data: bytes) -> int:
    return _fnv(data, *FNV[32], 0xFFFFFFFF)


def fnv1a64(data: bytes) -> int:
    return _fnv(data, *FNV[64], 0xFFFFFFFFFFFFFFFF)


def make_artifact_id(corpus: str, path: str) -> str:
    """The upper 48 bits of the hash of corpus, a unit separator and path, as 12 hex digits."""
    return f"{fnv1a64(corpus.encode() + bytes([0x1F]) + path.encode()) >> 16:012x}"


@F.pandas_udf(StringType())
def artifact_id(corpus: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or p is None else make_artifact_id(c, p) for c, p in zip(corpus, path, strict=True)], dtype=object)


@F.pandas_udf(LongType())
def content_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a-32 of a text's or binary's bytes."""
    for b in batches:
        yield pd.Series([None if x is None else fnv1a32(x if isinstance(x, bytes) else x.encode()) for x in b], dtype="Int64")


def is_artifact_id(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{12}$")


def valid_artifact_id(value: str) -> bool:
    return re.fullmatch("[0-9a-f]{12}", value) is not None
