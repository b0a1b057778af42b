"""URL filtering with a Bloom filter cascade.

A list entry is a host followed by the beginning of a path (``com/en/``, ``example.com``). A url
holds an entry if the host is the entry's or one of its subdomains and the path begins with the
entry's. So each url has a few candidate keys: the suffixes of its host of a number of labels that
occurs in the list, each with the prefixes of its path of a length that occurs there.

Level 1 of the cascade is a Bloom filter of the listed keys. Over the complete key universe of the
corpus, level 2 encodes the keys that level 1 takes wrongly, level 3 those listed keys that level 2
takes wrongly, and so on until none is left. For keys of that universe the level at which a key first
falls out tells exactly whether it is listed, so urls are judged by bit tests alone, with no join.
The universe is joined to the list once, to build the levels. A list whose filters would exceed
``MAX_BYTES`` is dealt by a hash into parts, each with a cascade of its own; urls then pass one part
after another, so no task holds more than one part's filters, and there is still no join.

Defined cases: a null url or one without ``://`` has an empty host and path, holds no entry and is
allowed; very long urls have no more candidate keys than short ones; repeated rows each come back; an
empty list allows everything; null entries are ignored; extra columns pass through, but host, path, rule,
verdict and listed replace columns of these names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import Scratch, table

NAME = "op2_url_filter"

# The rules, and names of unwanted sites.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
UNWANTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCK_LIST = tuple(f"{name}.example.{top}" for name in UNWANTED for top in ("com", "net", "org"))

#: Bytes of all levels that may be sent to every executor.
MAX_BYTES = 64 << 20
_STRETCH = 1 << 19  # bits of a filter that one task sets


def host_of(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    parts = F.split(host, r"\.")
    fitting = lambda numbers, most: F.filter(F.array(*map(F.lit, numbers)), lambda n: n <= most)
    suffixes = F.transform(fitting(labels, F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    heads = F.transform(fitting(lengths, F.char_length(path)), lambda n: F.substr(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h)))))


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key", F.lit(1)).alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"))


def _set_bits(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(_STRETCH, np.uint8)
    bits[rows["bit"].to_numpy()] = 1
    return pd.DataFrame({"c": rows["c"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` words of 64, ``n`` probes."""

    words: np.ndarray
    size: int
    n: int
    depth: int

    @classmethod
    def of(cls, keys: DataFrame, count: int, rate: float, depth: int) -> Level:
        """The filter of ``keys`` (key, h1, h2): tasks set the bits of a stretch each, whose bytes are collected."""
        size = max(64, math.ceil(count * math.log(1 / rate) / math.log(2) ** 2))
        n = max(1, round(math.log2(1 / rate)))
        spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(_spot(depth, i), F.lit(size).cast("long")))
        rows = keys.select(F.explode(spots).alias("s")).select(F.floor(F.col("s") / _STRETCH).cast("long").alias("c"), (F.col("s") % _STRETCH).cast("int").alias("bit"))
        words = np.zeros(-(-size // _STRETCH) * _STRETCH // 64, np.uint64)
        for r in rows.groupBy("c").applyInPandas(_set_bits, "c long, bits binary").collect():
            words.view(np.uint8)[r["c"] * (_STRETCH // 8) :][: _STRETCH // 8] = np.frombuffer(r["bits"], np.uint8)
        return cls(words, size, n, depth)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok, (up, down) = np.ones(len(h1), bool), _shifts(self.depth)
        first, step = (h1 ^ (h2 >> up)) >> 2, (h2 ^ (h1 >> down)) >> 8
        for i in range(self.n):
            s = (first + i * step) % self.size
            ok &= (self.words[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


def _shifts(depth: int) -> tuple[int, int]:
    """Every level hashes anew, else keys that meet at one level would meet at all."""
    return depth % 40 + 1, depth % 37 + 3


def _spot(depth: int, i: Column) -> Column:
    """A start of 62 bits and steps of 56, so that the sum stays within a long."""
    up, down = _shifts(depth)
    h1, h2 = F.col("h1"), F.col("h2")
    return F.shiftright(h1.bitwiseXOR(F.shiftright(h2, up)), 2) + i.cast("long") * F.shiftright(h2.bitwiseXOR(F.shiftright(h1, down)), 8)


def _first_rate(n: int, m: int) -> float:
    return min(0.5, max(1e-6, n * math.sqrt(0.5) / max(m, 1)))


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]

    @property
    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    @classmethod
    def build(cls, listed: DataFrame, outside: DataFrame, n: int, m: int, deepest: int = 60) -> Cascade:
        """listed: n keys; outside: m keys of the universe that are not listed; both distinct and hashed."""
        work = Scratch(listed.sparkSession, "cascade")
        inside, levels = listed, []
        rate = _first_rate(n, m)
        while n:
            if len(levels) == deepest:
                raise RuntimeError("keys of the universe share both hashes")
            level = Level.of(inside, n, rate, len(levels))
            levels.append(level)
            wrong = work.put(outside.filter(_bit_test([level])("h1", "h2")))
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
        work.clear()
        return cls(levels)

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, here = np.zeros(len(h1), bool), np.arange(len(h1))
        for depth, level in enumerate(self.levels):
            here = here[level.holds(h1[here], h2[here])]
            out[here] = depth % 2 == 0
        return out


def _bit_test(levels: list[Level]):
    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(levels[0].holds(h1.to_numpy(), h2.to_numpy()))

    return test


def _members(cascade: Cascade):
    @F.pandas_udf("array<boolean>")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        ends = np.cumsum([len(x) for x in h1])
        if not len(ends) or not ends[-1]:
            return pd.Series([[] for _ in h1])
        flat = cascade.member(np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64))
        return pd.Series(np.split(flat, ends[:-1]))

    return test


def filter_urls(pages: DataFrame, rules: dict[str, str], block_list: DataFrame | list[str], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed (the entries of rules and list it holds).

    The longest rule decides; without one, a url is blocked if it holds an entry of the list.
    """
    spark = pages.sparkSession
    if not isinstance(block_list, DataFrame):
        block_list = spark.createDataFrame([(x,) for x in block_list], "key string")
    listed = block_list.select("key").union(spark.createDataFrame([(k,) for k in rules], "key string")).filter("key is not null").distinct()
    work = Scratch(spark, "urls")
    listed = work.put(_hashed(listed))
    slash = F.instr("key", "/")
    head = F.when(slash > 0, F.substr("key", F.lit(1), slash - 1)).otherwise(F.col("key"))
    about = listed.select(F.when(slash > 0, F.char_length("key") - slash + 1).otherwise(0).alias("length"), F.size(F.split(head, r"\.")).alias("labels"))
    lengths, labels = (sorted(r[0] for r in about.select(c).distinct().collect()) for c in ("length", "labels"))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    keys = candidate_keys(F.col("host"), F.col("path"), labels or [0], lengths or [0])
    universe = rows.select("host", "path").distinct().select(F.explode_outer(keys).alias("key")).filter("key is not null").distinct()
    outside = work.put(_hashed(universe.join(listed, "key", "left_anti")))
    n, m = listed.count(), outside.count()
    # the first level, and as much again for all others
    parts = -(-int(2 * n * math.log(1 / _first_rate(n, m)) / math.log(2) ** 2 / 8) // MAX_BYTES) or 1
    rows = rows.withColumn("keys", keys).withColumn("listed", F.array().cast("array<string>"))
    own = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(parts))
    for part in range(parts):
        mine, others = (df if parts == 1 else work.put(df.filter(own == part)) for df in (listed, outside))
        cascade = Cascade.build(mine, others, mine.count(), others.count())
        here = F.col("keys") if parts == 1 else F.filter("keys", lambda k: F.pmod(F.xxhash64(k, F.lit(3)), F.lit(parts)) == part)  # noqa: B023
        rows = rows.withColumn("here", here)
        flags = _members(cascade)(F.transform("here", lambda k: F.xxhash64(k, F.lit(1))), F.transform("here", lambda k: F.xxhash64(k, F.lit(2))))
        rows = rows.withColumn("found", flags).withColumn("listed", F.concat("listed", F.filter("here", lambda k, i: F.get(F.col("found"), i))))
        rows = rows.drop("found", "here") if parts == 1 else work.put(rows.drop("found", "here"))
    work.clear(*([rows] if parts > 1 else []))
    if rules:
        known = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
        fits = F.filter("listed", lambda k: F.map_contains_key(known, k))
        longest = F.array_max(F.transform(fits, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))))
        rows = rows.withColumn("rule", longest["k"]).withColumn("said", F.try_element_at(known, F.col("rule")))
    else:
        rows = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("said", F.lit(None).cast("string"))
    without = F.when(F.size("listed") > 0, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("said", without)).select("row.*", "host", "path", "rule", "verdict", "listed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES, list(BLOCK_LIST)).select("page_id", "host", "path", "rule", "verdict")


_CASES = ", ".join(f"('{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{k}', '{v}')" for k, v in RULES.items())
_LISTED = ", ".join(f"('{x}')" for x in BLOCK_LIST)

SQL = f"""
WITH r AS (SELECT * FROM (VALUES {_CASES}) t(rh, rp, rule, act)),
b AS (SELECT * FROM (VALUES {_LISTED}) t(bh)),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n),
l AS (SELECT DISTINCT n FROM u JOIN b ON host = bh OR ends_with(host, '.' || bh))
SELECT page_id, host, path, m.rule, coalesce(m.act, CASE WHEN l.n IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN m ON u.n = m.n LEFT JOIN l ON u.n = l.n
"""
