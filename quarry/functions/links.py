"""Link targets as corpus-relative paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_SEGMENTS = 64


def normalize_link(source: str, target: str) -> str | None:
    """The path that ``target`` names from document ``source``; None if it names none of the corpus."""
    target = target.strip(" \t\r\n\f\v")
    name = target.partition("#")[0]
    if not name or ":" in name or "?" in name:
        return None
    folder = "" if name.startswith("/") else source.rpartition("/")[0]
    out: list[str] = []
    for part in f"{folder}/{name}".replace("\\", "/").split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
            if len(out) > MAX_SEGMENTS:
                return None
    return "/".join(out) or None


@F.pandas_udf(StringType())
def normalized_link(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or t is None else normalize_link(s, t) for s, t in zip(source, target, strict=True)], dtype=object)


def normalize(source: Column, target: Column) -> Column:
    """``normalize_link`` in the JVM: a fold over the segments, null once a path leaves the root."""
    name = F.regexp_replace(F.trim(F.translate(target, "\t\r\n\f\x0b", "     ")), "#.*$", "")
    folder = F.when(name.startswith("/"), "").otherwise(F.regexp_extract(source, r"^(.*)/[^/]*$", 1))
    parts = F.filter(F.split(F.translate(F.concat(folder, F.lit("/"), name), "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))

    def step(acc, part):
        up = part == ".."
        path = F.when(up, F.slice(acc["path"], 1, F.greatest(F.size(acc["path"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["path"], part))
        ok = acc["ok"] & ~(up & (F.size(acc["path"]) == 0)) & (up | (F.size(acc["path"]) < MAX_SEGMENTS))
        return F.struct(path.alias("path"), ok.alias("ok"))

    walked = F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"] & (F.size(acc["path"]) > 0), F.array_join(acc["path"], "/")))
    return F.when((name != "") & ~name.contains(":") & ~name.contains("?"), walked)
