"""Groups of near copies: texts that share at least 0.8 of their distinct five-word shingles.

Words are cut and folded as in ``simhash``; a shingle is a 64-bit hash. Texts of equal shingle sets are
one node. Groups come from the SimHash operator's Gray-order trees; exact similarities then decide.

1. A node's fingerprint is SimHash over its distinct shingles, of ``WIDE`` x 64 bits. Two sets of
   similarity 0.8 differ in about 15 % of the bits, unrelated ones in half of them. 64 bits spread too
   much to tell these apart and leave no band of bits that can be looked up, hence the width.
2. A node lies on one shelf for each of some bands of bits drawn from the fingerprint, more and longer
   bands for more nodes: shelves then hold about ``SHELF_MEAN`` unrelated members however large the
   corpus is. A pair of similarity 0.8 shares none with a probability of about 5e-6 (8e-4 where a set of
   four shingles lies in one of five, the worst case). Every member is compared with one leader of its
   shelf; those far from it look through the shelf by a Gray tree, up to ``RADIUS`` bits of the first 64,
   and up to ``BOTH`` of the first 128 (a pair of 0.8 lies beyond with 1e-6; 5e-4 in the worst case).
   Tasks return spanning forests, whose components are the candidate groups.
3. Within a candidate group, members are compared with a leader of it by exact similarity, twice with
   other leaders. Groups that then still hold several components go to a task each, which compares closest
   pairs first and never what is linked already. Of larger groups the exact comparison is dealt out to
   smaller parts inside each, ``BANDS`` a node, by minima of permuted hashes, and so on.

Rows grow with the members of shelves, never with pairs, and no shelf is cut or left out.

Defined cases: texts without words (null, empty, white space) have the empty set and are one node; a
text of fewer words than a shingle is one shingle; very long texts are read whole; a null doc_id never
stands before one that is set; of rows with equal doc_id and text one stays, and it is arbitrary which
one where their other columns differ; extra columns pass through, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components, merge_labels
from quarry.llm.rolling import BASE, FOLD, mix, tables
from quarry.llm.simhash import GrayTree
from quarry.session import Scratch, small_batches, spread

WORDS, BANDS, MINIMA = 5, 24, 5
#: 64-bit words of a fingerprint; bits in which linked nodes differ at most, of 64 and of 128.
WIDE, RADIUS, BOTH = 17, 24, 38
#: Unrelated members of a shelf of fingerprints, and rows for one task of the search.
SHELF_MEAN, TASK_ROWS = 64, 1_000_000
#: Members, and shingles of all members, of a group or a part of one that one task compares.
SHELF_ROWS, SHELF_SHINGLES = 2_000, 1 << 22
LEADERS, DEEPEST = 2, 8
PAIRS = 1 << 18  # that a search of a shelf holds at once
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_permutations: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(FOLD), np.uint8)
    edge = np.diff(np.concatenate(([True], _BLANK[b], [True])).view(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    power, back = tables(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])))
    word = mix((sums[stops] - sums[starts]) * back[starts])
    n = max(1, len(word) - words + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(words, len(word))):
        h = h * np.uint64(BASE) + word[i : i + n]
    return np.unique(mix(h))


def simhash(found: np.ndarray) -> np.ndarray:
    """``WIDE`` words; a bit is set if it is set in more than half of the set's hashes."""
    rng = np.random.default_rng(21)  # fixed value: the hashes
    flip, times = rng.integers(0, 1 << 64, (2, WIDE - 1), np.uint64)
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(found), 255):  # as many as a byte counts
        part = found[at : at + 255, None]
        words = np.concatenate((part, mix((part ^ flip) * (times | np.uint64(1)))), axis=1)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(found), bitorder="little").view(np.uint64)


def bands(nodes: int) -> np.ndarray:
    """A row for each band, of the bits that it reads."""
    n = max(12, int(np.ceil(np.log2(max(nodes, 1) / SHELF_MEAN))))
    many = int(np.ceil(np.log(1e-4) / np.log1p(-(0.83**n))))  # a little fewer bits agree than do on average
    rng = np.random.default_rng([22, n])  # fixed value: the bands
    return np.stack([rng.choice(64 * WIDE, n, replace=False) for _ in range(many)])


def band_keys(found: np.ndarray, depth: int = 0) -> np.ndarray:
    """A key for each part of a large group, other ones at each depth; none for the empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    if depth not in _permutations:
        rng = np.random.default_rng([20, depth])  # fixed value: the permutations
        flip, times = rng.integers(0, 1 << 64, (2, BANDS * MINIMA, 1), np.uint64)
        _permutations[depth] = flip, times | np.uint64(1), rng.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)
    flip, times, join = _permutations[depth]
    least = np.full(BANDS * MINIMA, ~np.uint64(0))
    for at in range(0, len(found), 256):
        least = np.minimum(least, ((found[at : at + 256] ^ flip) * times).min(1))
    return (least.reshape(BANDS, MINIMA) * join).sum(1, dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share 0.8 or more of their union."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 5 * small < 4 * large:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 5 * common >= 4 * (small + large - common)


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _set_of(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def _code(texts: pd.Series) -> pd.DataFrame:
    found = [shingles(t) for t in texts]
    node = [xxhash.xxh64_intdigest(f.tobytes(), 7) for f in found]
    wide = np.array([simhash(f) for f in found], np.uint64).reshape(-1, WIDE)
    fp = wide[:, :2].view(np.int64)
    return pd.DataFrame({"node": np.array(node, np.uint64).view(np.int64), "fp": fp[:, 0], "fp2": fp[:, 1], "size": [len(f) for f in found], "wide": [w.tobytes() for w in wide]})


def _shelve(read: np.ndarray):
    """A row (shelf, node, fp, fp2) for each band that a fingerprint is read by."""
    many, n = read.shape
    place = np.int32(1) << np.arange(n, dtype=np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = np.frombuffer(b"".join(b["wide"]), np.uint8).reshape(-1, 8 * WIDE)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            shelf = np.stack([(i << n) + bits[:, r] @ place for i, r in enumerate(read)], axis=1)
            rest = {c: np.repeat(b[c].to_numpy(), many) for c in ("node", "fp", "fp2")}
            yield pd.DataFrame({"shelf": shelf.ravel().astype(np.int64), **rest})

    return run


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest (a, b) of the nodes that lie near each other on the shelves of a task."""
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    tree = GrayTree(rows["shelf"].to_numpy(), rows["fp"].to_numpy().view(np.uint64))
    shelf, fp, fp2 = tree.shelf, tree.fp, rows["fp2"].to_numpy().view(np.uint64)[tree.order]
    nodes, mine = np.unique(rows["node"].to_numpy()[tree.order], return_inverse=True)
    del rows, parts
    starts = np.flatnonzero(np.diff(shelf, prepend=shelf[0] - 1))
    sizes = np.diff(starts, append=len(shelf))
    near = lambda x, y: (np.bitwise_count(fp[x] ^ fp[y]) <= RADIUS) & (np.bitwise_count(fp[x] ^ fp[y]) + np.bitwise_count(fp2[x] ^ fp2[y]) <= BOTH)
    every = np.arange(len(shelf))
    # of four members of each shelf, that which most are near leads it
    tried = [starts + sizes * i // 4 for i in range(4)]
    best = np.argmax([np.add.reduceat(near(every, np.repeat(t, sizes)).astype(np.int64), starts) for t in tried], axis=0)
    lead = np.repeat(np.choose(best, tried), sizes)
    held = near(every, lead)
    label = merge_labels(np.arange(len(nodes)), mine[held], mine[lead[held]])
    # two members near their leader are joined up already: the others look, at all
    looking = np.flatnonzero(~held)
    for q, other in tree.search(shelf[looking], fp[looking], RADIUS, PAIRS):
        q = looking[q]
        ok = near(q, other)
        label = merge_labels(label, mine[q[ok]], mine[other[ok]])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})


def _candidates(work: Scratch, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join up all nodes of near fingerprints."""
    some = nodes.filter("size > 0")
    n = some.count()
    read = bands(n)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(read) // TASK_ROWS + 1)
    filed = spread(some.select("node", "fp", "fp2", "wide")).mapInPandas(_shelve(read), "shelf long, node long, fp long, fp2 long")
    return work.put(filed.repartition(tasks, "shelf").mapInPandas(_near, "a long, b long"))


def _deeper(depth: int):
    def keys(sets: pd.Series) -> pd.Series:
        return pd.Series([band_keys(np.frombuffer(x, np.uint64), depth) for x in sets], dtype=object)

    return F.pandas_udf(keys, "array<long>")


def _across(bucket: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of one group or part; what they join up is not compared again."""
    node, fp = bucket["node"].to_numpy(), bucket["fp"].to_numpy().view(np.uint64)
    label = np.unique(bucket["root"].to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in bucket["set"]]
    tree = GrayTree(np.zeros(len(fp), np.int64), fp)
    a, b = [], []
    for q, place in tree.search(np.zeros(len(fp), np.int64), fp, RADIUS, PAIRS):
        other = tree.order[place]
        new = (q < other) & (label[q] != label[other])
        q, other = q[new], other[new]
        for i in np.argsort(np.bitwise_count(fp[q] ^ fp[other]), kind="stable").tolist():
            x, y = int(q[i]), int(other[i])
            if label[x] != label[y] and similar(sets[x], sets[y]):
                a.append(node[x])
                b.append(node[y])
                label[label == label[x]] = label[y]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` in one struct, and what names a row: is doc_id absent, doc_id, a hash of the text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    absent = F.col("doc_id").isNull()
    return docs.select(absent.alias("absent"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("th"), row.alias("row"))


NAME_OF_ROW = ["absent", "id", "th"]


def _verified(work: Scratch, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets (node, set) are similar."""
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return work.put(both.filter(F.pandas_udf(_similar, "boolean")("set_a", "set_b")).select("a", "b"))


def _differ() -> Column:
    return (F.col("root") != F.col("leads.root")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("leads.fp"))) <= RADIUS)


def _rooted(work: Scratch, placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (key, node, fp, size) with the root of each node's component under all links so far."""
    roots = connected_components(links).toDF("member", "top")
    found = placed.join(roots, F.col("node") == F.col("member"), "left")
    return work.put(found.select("key", "node", "fp", "size", F.coalesce("top", "node").alias("root")))


def _mixed(work: Scratch, placed: DataFrame) -> DataFrame:
    """Groups and parts of several components, of those with the same members one, and whether they are large."""
    about = placed.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.count("*").alias("n"), F.sum("size").alias("all")
    )
    large = (F.col("n") > SHELF_ROWS) | (F.col("all") > SHELF_SHINGLES)
    return work.put(about.filter("lo < hi").groupBy("who").agg(F.min(F.struct("key", large.alias("large"))).alias("m")).select("m.*"))


def _links(work: Scratch, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) of similar nodes that join up all of them."""
    roots = connected_components(_candidates(work, nodes)).toDF("member", "key")
    placed = work.put(nodes.join(roots, F.col("node") == F.col("member")).select("key", "node", "fp", "size", F.col("node").alias("root")))
    wanted = nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", "first.*")
    texts = _rows(docs).select(*NAME_OF_ROW, F.col("row.text").alias("text")).join(work.put(wanted), NAME_OF_ROW).dropDuplicates(["node"])
    sets = work.put(texts.select("node", F.pandas_udf(_set_of, "binary")("text").alias("set")))
    links = nodes.sparkSession.createDataFrame([], "a long, b long")
    for depth in range(DEEPEST + 1):
        for turn in range(LEADERS):
            leads = work.put(placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "fp", "root")).alias("leads")))
            pairs = placed.join(leads, "key").filter(_differ()).select(F.col("node").alias("a"), F.col("leads.node").alias("b"))
            found = _verified(work, work.put(pairs.distinct()), sets)
            links = links.union(found)
            placed = _rooted(work, placed, links)
        mixed = _mixed(work, placed)
        if depth == DEEPEST:
            mixed = mixed.withColumn("large", F.lit(False))
        held = placed.join(mixed.filter("not large").select("key"), "key", "left_semi").join(sets, "node")
        links = links.union(work.put(held.select("key", "node", "fp", "root", "set").groupBy("key").applyInPandas(_across, "a long, b long").distinct()))
        rest = work.put(placed.join(mixed.filter("large").select("key"), "key", "left_semi"))
        if rest.isEmpty():
            return links
        keys = work.put(rest.select("node").distinct().join(sets, "node").select("node", _deeper(depth + 1)("set").alias("keys")))
        filed = work.put(rest.join(keys, "node").select(F.explode(F.transform("keys", lambda k: F.xxhash64("key", k))).alias("key"), "node", "fp", "size"))
        shared = work.put(filed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key"))
        placed = _rooted(work, filed.join(shared, "key"), links)
    return links


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """A row for each distinct shingle set: node, size, root of its group, first (name of its first row)."""
    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession, "nearcopies")
    rows = _rows(docs)
    coded = rows.select(F.struct(*NAME_OF_ROW).alias("first"), F.pandas_udf(_code, "node long, fp long, fp2 long, size long, wide binary")("row.text").alias("c")).select("first", "c.*")
    nodes = coded.groupBy("node").agg(F.min(F.struct("first", "fp", "fp2", "size", "wide")).alias("m"))
    nodes = work.put(nodes.select("node", "m.*"))
    roots = connected_components(_links(work, nodes, docs)).toDF("member", "top")
    found = work.put(nodes.join(roots, F.col("node") == F.col("member"), "left").select("node", "size", "first", F.coalesce("top", "node").alias("root")))
    work.clear(found)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id, then by a hash of the text."""
    kept = Scratch(docs.sparkSession, "kept").put(near_copy_groups(docs).groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    rows = _rows(docs).join(kept, NAME_OF_ROW, "left_semi").dropDuplicates(NAME_OF_ROW)
    return rows.select("row.*")
