"""Removal of repeated substrings by a sparse suffix array, merged from front-coded runs.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.

1. Every such string has an anchor: the ``grain`` bytes in it with the least hash. Equal strings have
   theirs at the same place, so only suffixes that start at anchors are sorted. An anchor whose hash
   occurs once in the corpus belongs to no repeated string and is left out (the duplicate detection of
   distributed prefix-doubling string sorting, which exchanges nothing that is known to be unique).
2. Each task sorts the suffixes at its other anchors and front-codes them: of each only what it does
   not share with the one before. Contexts that occur twice within a task are answered there, and one
   of them goes on. Runs are exchanged by the anchor's hash.
3. A loser tree merges the runs. It knows how many bytes each candidate shares with the last winner, so
   it compares these numbers and, where they are equal, bytes only from there on.
4. Along the merged order, common prefixes tell which suffixes agree to the right of the anchor, and an
   order of what stands to its left tells the same for that side; a string that agrees on both sides
   with another is repeated. This is exact; hashes only choose anchors.

An anchor of over ``HOT`` occurrences is not gathered in one task. Of a string with l bytes before the
anchor, l from lo to hi, at least lo bytes on the left and a number on the right are known to agree with
its copies, so suffixes are dealt out by these bytes; equal contexts, cut to what such strings can reach,
are answered by a grouped count and one of them goes on. What is still too much is halved: lo to the
middle, and the rest. For a single l the bytes are the whole string, of which one is left. Everything is
compared byte by byte, and what is small enough takes the way above.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than ``length`` lose
none; strings never cross documents; rows with equal doc_id and text are documents of their own, so
their strings occur twice; rows are returned as often as they come; very long texts are read whole;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.rolling import mix, tables
from quarry.session import Scratch, small_batches, table

NAME = "op9_repeated_substrings"
SQL = None

LENGTH, GRAIN = 400, 200
#: Contexts of an anchor that one task may gather.
HOT = 200_000
#: Suffixes for one task to merge.
TASK_SUFFIXES = 40_000
_FLUSH = 48 << 20  # bytes of contexts that a task holds before it writes runs


def rolling(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place."""
    power, back = tables(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])))
    return mix((sums[size:] - sums[:-size]) * back[: len(b) - size + 1])


def _sliding(x: np.ndarray, width: int, best: np.ufunc, none: int) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, in time that does not grow with the width."""
    n = len(x)
    full = np.full(-(-n // width) * width, none, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    left = best.accumulate(rows, axis=1).ravel()
    right = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - width + 1], left[width - 1 : n])


def anchors(b: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least grain of any ``length`` bytes (ties: all of them)."""
    if len(b) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, width = rolling(b, grain), length - grain + 1
    least = _sliding(h, width, np.minimum, (1 << 64) - 1)
    wide = np.zeros(len(h) + width - 1, np.uint64)
    wide[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_sliding(wide, width, np.maximum, 0) == h)
    return at, h[at]


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; ``known`` bytes of it are given."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (diff.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Of sorted strings: what each shares with the one before, and all the rest."""
    shared, rest, last = np.zeros(len(strings), np.uint16), [], b""
    for i, s in enumerate(strings):
        shared[i] = common(last, s, 0)
        rest.append(s[shared[i] :])
        last = s
    return shared, b"".join(rest)


def front_decode(shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> Iterator[tuple[int, bytes]]:
    at, last = 0, b""
    for h, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        last = last[:h] + rest[at : at + n - h]
        at += n - h
        yield h, last


class LoserTree:
    """Merges sorted runs of (bytes shared with the one before, string)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs, self.n = runs, len(runs)
        self.head: list[tuple[int, bytes] | None] = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.n)
        self.shared = [0] * self.n
        self.top = self._start(1) if self.n > 1 else 0

    def _start(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        winner, loser = self._play(self._start(2 * node), self._start(2 * node + 1))
        self.tree[node] = loser
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps what it shares with the winner."""
        if self.head[a] is None or self.head[b] is None:
            return (b, a) if self.head[a] is None else (a, b)
        ha, hb = self.shared[a], self.shared[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        x, y = self.head[a][1], self.head[b][1]
        h = common(x, y, ha)
        first = h == len(x) if h == len(x) or h == len(y) else x[h] < y[h]
        if h == len(x) == len(y):
            first = a < b
        self.shared[b if first else a] = h
        return (a, b) if first else (b, a)

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """Run, bytes shared with the string before in the merged order, string."""
        if not self.n:
            return
        while self.head[self.top] is not None:
            win = self.top
            yield win, self.shared[win], self.head[win][1]
            self.head[win] = item = next(self.runs[win], None)
            self.shared[win] = item[0] if item else 0
            node = (win + self.n) >> 1
            while node:
                win, self.tree[node] = self._play(win, self.tree[node])
                node >>= 1
            self.top = win


def repeated_at(right: np.ndarray, left: np.ndarray, before: np.ndarray, after: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order, the least and greatest shift l so that the ``length`` bytes from l before
    the anchor occur at another of these suffixes (greatest -1: none).

    right: bytes shared with the suffix before; left: what stands before each anchor, backwards, one
    row each; before and after: how many bytes there are on either side.
    """
    m, reach = len(right), length - grain
    low, high = np.full(m, length), np.full(m, -1)
    wide = np.zeros((m, -(-reach // 8) * 8), np.uint8)
    wide[:, :reach] = left
    order = np.lexsort(wide.view(">u8").T[::-1])
    turned = left[order]
    differ = turned[1:] != turned[:-1]
    same = np.where(differ.any(1), differ.argmax(1), reach)
    for shift in range(reach + 1):
        ok = (before >= shift) & (after >= length - shift)
        if ok.sum() < 2:
            continue
        side = np.empty(m, np.int64)
        side[order] = np.concatenate(([0], np.cumsum(same < shift)))
        key = np.cumsum(right < length - shift) * np.int64(m + 1) + side
        at = np.flatnonzero(ok)
        at = at[np.argsort(key[at], kind="stable")]
        twin = key[at][1:] == key[at][:-1]
        hit = at[np.concatenate((twin, [False])) | np.concatenate(([False], twin))]
        low[hit], high[hit] = np.minimum(low[hit], shift), shift
    return low, high


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _find_anchors(length: int, grain: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [anchors(np.frombuffer(_bytes(x), np.uint8), length, grain) for x in b["text"]]
            n = [len(at) for at, _ in found]
            if sum(n):
                yield pd.DataFrame({"h": np.concatenate([h for _, h in found]).view(np.int64), "d": np.repeat(b["d"].to_numpy(), n), "t": np.repeat(b["t"].to_numpy(), n), "at": np.concatenate([at for at, _ in found]).astype(np.int32)})

    return run


_RUN = "bucket long, shared binary, rest binary, before binary, after binary, lead binary, owner binary"
_SPAN = "d long, t long, start long, stop long"


def _flush(held: dict, length: int) -> Iterator[pd.DataFrame]:
    """Contexts (lead, suffix, bucket) with their owners as spans that are answered and runs for the rest."""
    spans, sent, zip_ = [], {}, zstandard.ZstdCompressor(level=1)
    for (lead, suffix, bucket), owners in held.items():
        if len(owners) > 1 and len(lead) + len(suffix) >= length:
            spans += [(d, t, at - len(lead), at + len(suffix)) for d, t, at in owners if at >= 0]
            owners = [(0, 0, -1)]  # answered, but others may equal parts of it
        sent.setdefault(bucket, []).extend((suffix, lead, o) for o in owners)
    rows = []
    for bucket, items in sent.items():
        items.sort(key=lambda x: x[0])
        shared, rest = front_code([s for s, _, _ in items])
        rows.append((bucket, shared.tobytes(), zip_.compress(rest), np.array([len(x[1]) for x in items], np.uint16).tobytes(), np.array([len(x[0]) for x in items], np.uint16).tobytes(), zip_.compress(b"".join(x[1] for x in items)), np.array([x[2] for x in items], np.int64).tobytes()))
    if spans:
        rows.append((-1, b"", b"", b"", b"", b"", np.array(spans, np.int64).tobytes()))
    if rows:
        yield pd.DataFrame(rows, columns=["bucket", "shared", "rest", "before", "after", "lead", "owner"])


def _make_runs(length: int, contexts):
    """Contexts of a task: spans that are answered here (bucket -1) and sorted, front-coded runs.

    contexts: yields (lead, suffix, bucket), owner for a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for b in batches:
            for context, owner in contexts(b):
                owners = held.setdefault(context, [])
                size += 64 if owners else len(context[0]) + len(context[1]) + 300
                owners.append(owner)
                if size > _FLUSH:
                    yield from _flush(held, length)
                    held, size = {}, 0
        yield from _flush(held, length)

    return run


def _in_texts(length: int, reach: int, buckets: int):
    def contexts(b: pd.DataFrame) -> Iterator[tuple]:
        for d, t, text, places, hashes in zip(b["d"], b["t"], b["text"], b["places"], b["hashes"], strict=True):
            raw = _bytes(text)
            for at, h in zip(np.asarray(places).tolist(), np.asarray(hashes).tolist(), strict=True):
                yield (raw[max(0, at - reach) : at], raw[at : at + length], h % buckets), (d, t, at)

    return contexts


def _in_rows(buckets: int):
    def contexts(b: pd.DataFrame) -> Iterator[tuple]:
        for key, left, right, d, t, at in zip(b["key"], b["left"], b["right"], b["d"], b["t"], b["at"], strict=True):
            yield (left, right, key % buckets), (d, t, at)

    return contexts


def _expand(length: int, reach: int):
    """A row for each context at given anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, d, t, at, left, right) for ((left, right, h), (d, t, at)) in _in_texts(length, reach, 1 << 64)(b)]
            frame = pd.DataFrame(rows, columns=["h", "d", "t", "at", "left", "right"])
            yield frame.assign(h=frame["h"].astype(np.uint64).to_numpy().view(np.int64), lo=0, hi=reach)

    return run


_HOT_ROW = "h long, lo int, hi int, left binary, right binary, d long, t long, at int"


def _split_hot(work: Scratch, rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans answered by counts, and contexts (key, left, right, d, t, at) of keys of at most HOT each."""
    spans, small = [], []
    while True:
        known = F.xxhash64("h", "lo", "hi", F.expr("substring(left, length(left) - lo + 1, lo)"), F.expr(f"substring(right, 1, {length} - hi)"))
        cut_left, cut_right = F.expr("if(length(left) > hi, substring(left, length(left) - hi + 1, hi), left)"), F.expr(f"substring(right, 1, {length} - lo)")
        rows = rows.filter(f"length(left) >= lo and length(right) >= {length} - hi")
        rows = work.put(rows.select(known.alias("key"), "h", "lo", "hi", cut_left.alias("left"), cut_right.alias("right"), "d", "t", "at"))
        same = ["key", "h", "lo", "hi", "left", "right"]
        counts = work.put(rows.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "at")).alias("own")))
        twice = work.put(counts.filter(f"n > 1 and length(left) + length(right) >= {length}").select(*same))
        place = F.col("at").cast("long")
        spans.append(rows.filter("at >= 0").join(twice, same, "left_semi").select("d", "t", (place - F.length("left")).alias("start"), (place + F.length("right")).alias("stop")))
        none = F.col("n") > 1
        alone = lambda c: F.when(none, F.lit(-1)).otherwise(F.col(f"own.{c}")).alias(c)  # noqa: E731, B023
        left = counts.select(*same, alone("d"), alone("t"), alone("at").cast("int").alias("at"))
        large = work.put(counts.groupBy("key").count().filter(F.col("count") > HOT).select("key"))
        small.append(left.join(large, "key", "left_anti").select("key", "left", "right", "d", "t", "at"))
        if large.isEmpty():
            return reduce(DataFrame.union, spans), reduce(DataFrame.union, small)
        left = left.join(large, "key", "left_semi")
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct((half + 1).alias("lo"), F.col("hi").alias("hi")))
        rows = left.withColumn("part", F.explode(halves)).select("h", "part.lo", "part.hi", "left", "right", "d", "t", "at")


def _merge(length: int, grain: int, batch: int = 4096):
    reach = length - grain

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            spans = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in rows["owner"]]
            return pd.DataFrame(np.concatenate(spans), columns=["d", "t", "start", "stop"])
        unzip = zstandard.ZstdDecompressor()
        runs, before, after, lead, owner = [], [], [], [], []
        for r in rows.itertuples():
            sizes, heads = np.frombuffer(r.after, np.uint16), np.frombuffer(r.before, np.uint16)
            runs.append(front_decode(np.frombuffer(r.shared, np.uint16), sizes, unzip.decompress(r.rest)))
            ends = np.cumsum(heads.astype(np.int64))
            before.append(heads)
            after.append(sizes)
            lead.append((unzip.decompress(r.lead), ends))
            owner.append(np.frombuffer(r.owner, np.int64).reshape(-1, 3))
        out, place = [], [0] * len(runs)
        pending: list[tuple[int, int, int]] = []

        def settle() -> None:
            if len(pending) < 2:
                return
            m = len(pending)
            left, b, a, who = np.zeros((m, reach), np.uint8), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros((m, 3), np.int64)
            for i, (k, p, _) in enumerate(pending):
                raw, ends = lead[k]
                b[i], a[i], who[i] = before[k][p], after[k][p], owner[k][p]
                if b[i]:
                    left[i, : b[i]] = np.frombuffer(raw, np.uint8, int(b[i]), int(ends[p] - b[i]))[::-1]
            low, high = repeated_at(np.array([h for _, _, h in pending]), left, b, a, length, grain)
            hit = np.flatnonzero((high >= 0) & (who[:, 2] >= 0))
            out.append(np.column_stack((who[hit, 0], who[hit, 1], who[hit, 2] - high[hit], who[hit, 2] - low[hit] + length)))

        for k, h, _ in LoserTree(runs):
            if h < grain and len(pending) >= batch:
                settle()
                pending.clear()
            pending.append((k, place[k], h))
            place[k] += 1
        settle()
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, 4), np.int64), columns=["d", "t", "start", "stop"])

    return run


def _cover(length: int):
    """Bytes removed, spans and the rest of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, spans in zip(b["text"], b["spans"], strict=True):
                raw, kept, at, removed, n = _bytes(text), [], 0, 0, 0
                for start, stop in sorted((s["start"], s["stop"]) for s in (spans if spans is not None else ())):
                    if start > at or not n:
                        kept.append(raw[at:start])
                        removed, n, at = removed + stop - start, n + 1, stop
                    elif stop > at:
                        removed, at = removed + stop - at, stop
                kept.append(raw[at:])
                rows.append((len(raw), removed, n, b"".join(kept)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": [r[0] for r in rows], "n_removed": [r[1] for r in rows], "n_spans": [r[2] for r in rows], "kept": [r[3] for r in rows]})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Rows d, t (doc_id and hash of the text), spans: (start, stop) of bytes that repeated strings cover."""
    spark = docs.sparkSession
    small_batches(spark)
    work, reach = Scratch(spark, "substrings"), length - grain
    keyed = _key(docs)
    found = work.put(keyed.mapInPandas(_find_anchors(length, grain), "h long, d long, t long, at int"))
    # written first: Spark then splits a frequent anchor's rows in the join, which it does not do above
    # an aggregate
    counts = work.put(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    places = work.put(
        found.join(counts, "h")
        .groupBy("d", "t")
        .agg(F.collect_set(F.when(F.col("n") <= HOT, F.struct("at", "h"))).alias("cool"), F.collect_set(F.when(F.col("n") > HOT, F.struct("at", "h"))).alias("hot"))
    )
    work.drop(found, counts)
    total, hot = places.agg(F.sum(F.size("cool")), F.sum(F.size("hot"))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // TASK_SUFFIXES + 1)
    texts = keyed.join(places, ["d", "t"])
    at = lambda kind: texts.filter(F.size(kind) > 0).select("d", "t", "text", F.col(f"{kind}.at").alias("places"), F.col(f"{kind}.h").alias("hashes"))
    runs = work.put(at("cool").mapInPandas(_make_runs(length, _in_texts(length, reach, buckets)), _RUN))
    answered = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("owner"), F.lit(buckets))).otherwise(F.col("bucket"))
    merged = lambda runs: runs.withColumn("bucket", answered).groupBy("bucket").applyInPandas(_merge(length, grain), _SPAN)
    spans = merged(runs)
    if hot:
        counted, contexts = _split_hot(work, at("hot").mapInPandas(_expand(length, reach), _HOT_ROW), length)
        contexts = work.put(contexts)
        buckets = max(buckets, contexts.count() // TASK_SUFFIXES + 1)
        spans = spans.union(counted).union(merged(work.put(contexts.mapInPandas(_make_runs(length, _in_rows(buckets)), _RUN))))
    spans = Scratch(spark, "spans").put(spans.groupBy("d", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    work.clear()
    return spans


def remove_repeated(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row of ``docs``."""
    rows = _key(docs).join(repeated_spans(docs, length, grain), ["d", "t"], "left")
    rows = rows.select(F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id"), "text", "spans")
    return rows.mapInPandas(_cover(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
