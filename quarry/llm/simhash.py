"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Texts become 64-bit fingerprints of their word shingles. Equal fingerprints are one node, so groups
of copies cost one row. Two fingerprints within ``radius`` bits of each other agree in one of
``radius // 2 + 1`` bands up to one bit; each node is therefore filed under its bits of each band and
looks in that shelf and those one flipped bit away (the higher one looks, so a pair meets once). A
task takes some shelves, sorts their fingerprints by Gray rank and builds a tree over the order: an
upper node holds the bits that all below it share, a lower one only what it adds. A search adds up
differences from the top and leaves a whole group as soon as they exceed the radius.

Members and lookers of a shelf of too many are dealt anew: of the bits that the shelf does not fix, two
fingerprints within the radius agree in one of ``radius + 1`` parts, so each goes to as many smaller
shelves, and so on. After four rounds a shelf fixes all but 18 bits. A task returns a spanning forest of
what it found, never the pairs, and components are joined up in ``components``.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; very long texts are read whole;
repeated rows each come back; other columns are ignored; an empty table gives no rows; a null doc_id stays null and is never chosen as component_id unless a group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import connected_components, merge_labels
from quarry.session import Scratch, small_batches, table

NAME = "op7_simhash"
SQL = None

#: Fingerprints of one shelf that a task may hold; a shelf of more is dealt anew.
SHELF_ROWS = 20_000
#: Rows for one task of the search.
TASK_ROWS = 1_000_000
_FANOUT = 3  # bits: eight children
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = 4) -> int:
    """A bit is set if it is set in more than half of the shingles' XXH64 (seed 42)."""
    if not text:
        return 0
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    line, n = b" ".join(w), max(1, len(w) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[words - 1 :] if len(w) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = [digest(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayTree:
    """Index over the fingerprints of some shelves; ``shelf`` and ``fp`` are parallel arrays."""

    def __init__(self, shelf: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), shelf))
        self.shelf, self.fp, self.order = shelf[order], fp[order], order
        full = ~np.uint64(0)
        self.mask, self.bits = [np.full(len(fp), full)], [self.fp]
        while len(self.mask[-1]) > 1:
            mask, bits = self.mask[-1], self.bits[-1]
            at = np.arange(0, len(mask), 1 << _FANOUT)
            ones, zeros = np.bitwise_and.reduceat(bits & mask, at), np.bitwise_and.reduceat(~bits & mask, at)
            self.mask.append(ones | zeros)
            self.bits.append(ones)
        # what a node adds to the bits of the node above it
        self.adds = [m & ~self.mask[k + 1][np.arange(len(m)) >> _FANOUT] if k + 1 < len(self.mask) else m for k, m in enumerate(self.mask)]

    def search(self, shelf: np.ndarray, fp: np.ndarray, radius: int, budget: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, place in the order) within the radius and on the query's shelf, in parts."""
        lo, hi = np.searchsorted(self.shelf, shelf, "left"), np.searchsorted(self.shelf, shelf, "right")
        some = np.flatnonzero(hi > lo)
        at = 0
        load = np.cumsum(np.minimum(hi - lo, SHELF_ROWS)[some] + 8)
        while at < len(some):
            stop = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + budget, "right")))
            yield self._part(some[at:stop], lo, hi, fp, radius)
            at = stop

    def _part(self, q, lo, hi, fp, radius):
        top = len(self.mask) - 1
        first, last = lo[q], hi[q] - 1
        spread = np.maximum(last - first, 0)
        begin = np.minimum((np.ceil(np.log2(spread + 1)) / _FANOUT).astype(int), top)  # at most two nodes to begin with
        who = node = np.empty(0, np.int64)
        acc = np.empty(0, np.int64)
        for level in range(top, -1, -1):
            shift = _FANOUT * level
            if len(who):
                who, acc = np.repeat(who, 1 << _FANOUT), np.repeat(acc, 1 << _FANOUT)
                node = ((node << _FANOUT)[:, None] + np.arange(1 << _FANOUT)).ravel()
                ok = (node >= first[who] >> shift) & (node <= last[who] >> shift)
                who, node, acc = who[ok], node[ok], acc[ok]
                acc = acc + np.bitwise_count((fp[q[who]] ^ self.bits[level][node]) & self.adds[level][node])
            new = np.flatnonzero(begin == level)
            if len(new):
                a, b = first[new] >> shift, last[new] >> shift
                n = b - a + 1
                more = np.repeat(new, n)
                nodes = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                diff = np.bitwise_count((fp[q[more]] ^ self.bits[level][nodes]) & self.mask[level][nodes]).astype(np.int64)
                who, node, acc = np.concatenate((who, more)), np.concatenate((node, nodes)), np.concatenate((acc, diff))
            ok = acc <= radius
            who, node, acc = who[ok], node[ok], acc[ok]
        return q[who], node


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        shelf, fp, member = rows["shelf"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["member"].to_numpy()
        del rows, parts
        if not member.any():
            return
        tree = GrayTree(shelf[member], fp[member])
        nodes = np.unique(fp)
        leaf = np.searchsorted(nodes, tree.fp)
        mine = np.searchsorted(nodes, fp)
        label = np.arange(len(nodes))
        for q, at in tree.search(shelf, fp, radius):
            label = merge_labels(label, mine[q], leaf[at])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pd.DataFrame({"a": nodes[moved].view(np.int64), "b": nodes[label[moved]].view(np.int64)})

    return run


def _ones(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1


def _part(bits: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Bits lo to hi, and all the others moved together."""
    right = lambda n: F.call_function("shiftrightunsigned", bits, n.cast("int"))
    return right(lo).bitwiseAND(_ones(hi - lo)), F.call_function("shiftleft", right(hi), lo.cast("int")).bitwiseOR(bits.bitwiseAND(_ones(lo)))


def _shelved(codes: DataFrame, radius: int) -> DataFrame:
    """Rows (shelf, fp, member, rest, width): where a fingerprint lies, and where else it looks.

    rest: the ``width`` bits of the fingerprint outside the shelf's band.
    """
    bands = radius // 2 + 1
    edges = [64 * i // bands for i in range(bands + 1)]
    structs = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        key, rest = _part(F.col("fp"), F.lit(lo), F.lit(hi)) if hi < 64 else (F.shiftrightunsigned("fp", lo), F.col("fp").bitwiseAND((1 << lo) - 1))
        structs.append(F.struct(F.lit(i).alias("i"), key.alias("key"), F.lit(hi - lo).alias("n"), rest.alias("rest"), F.lit(64 - hi + lo).alias("width")))
    filed = codes.select("fp", F.explode(F.array(*structs)).alias("s")).select("fp", "s.*")
    flips = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    places = F.concat(F.array(F.struct(F.col("key").alias("key"), F.lit(True).alias("member"))), F.transform(F.filter(flips, lambda k: k < F.col("key")), lambda k: F.struct(k.alias("key"), F.lit(False).alias("member"))))
    filed = filed.select("fp", "i", "rest", "width", F.explode(places).alias("p"))
    return filed.select(F.xxhash64("i", "p.key").alias("shelf"), "fp", "p.member", "rest", "width")


def _dealt(work: Scratch, rows: DataFrame, radius: int, rounds: int = 4) -> DataFrame:
    """``rows``, those of large shelves dealt to smaller ones inside them."""
    done = []
    for _ in range(rounds):
        large = work.put(rows.filter("member").groupBy("shelf").count().filter(F.col("count") > SHELF_ROWS).select("shelf"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "shelf", "left_anti"))
        at = lambda j: F.floor(F.col("width") * j / (radius + 1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda j: F.struct(j.alias("j"), at(j).alias("lo"), at(j + 1).alias("hi")))
        rows = rows.join(large, "shelf", "left_semi").withColumn("s", F.explode(parts))
        key, rest = _part(F.col("rest"), F.col("s.lo"), F.col("s.hi"))
        rows = work.put(rows.select(F.xxhash64("shelf", "s.j", key).alias("shelf"), "fp", "member", rest.alias("rest"), (F.col("width") - F.col("s.hi") + F.col("s.lo")).alias("width")))
    return reduce(DataFrame.union, [*done, rows])


def links(codes: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that join up all fingerprints (distinct, column fp) within the radius."""
    spark = codes.sparkSession
    work = Scratch(spark, "simhash-links")
    rows = _dealt(work, work.put(_shelved(codes, radius)), radius).select("shelf", "fp", "member")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS + 1)
    found = work.put(rows.repartition(tasks, "shelf").mapInPandas(_search(radius), "a long, b long"))
    work.clear(found)
    return found


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (signed 64 bits), component_id: the smallest doc_id that links lead to."""

    @F.pandas_udf("long")
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([fingerprint(x, words) for x in t], np.uint64).view(np.int64))

    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession, "simhash")
    coded = work.put(docs.select("doc_id", code("text").alias("fp")))
    codes = work.put(coded.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(codes.select("fp"), radius))
    # tables before each join, so that Spark splits the rows of a large component or group of copies
    rooted = work.put(codes.join(parts, codes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = work.put(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = work.put(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    work.clear(coded, named)
    return coded.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
