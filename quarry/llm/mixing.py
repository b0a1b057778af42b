"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With weight w, block j (from 0) of a source is released
at slot floor(j / w) and due by slot ceil((j + 1) / w); every slot goes to the released block that is
due first (earliest deadline first). On one processor this meets all deadlines, so after any number
of slots t each source has had more than t*w - 1 and less than t*w + 1 blocks. Weights are exact.

When a source runs out, a new phase begins, in which the others share its slots in proportion: releases
and deadlines lie on a virtual time that then runs faster, so nothing is planned anew and a source
carries on with the fraction of a block that it is ahead or behind. No document is dropped or repeated.

The plan is made slot by slot on the driver, one heap step each, whatever the number of sources. Blocks
have at least ``block`` documents, more where there would else be over ``MOST_SLOTS`` of them, so the
driver holds, and tasks get, eight bytes a slot: 32 MB at most.

Documents are numbered within their source in the order of a hash of the row, in many small groups,
so that a source with most of the rows is spread over many tasks.

Defined cases: null is a source of its own; text plays no part, however long; a null or repeated doc_id
is placed like any other, equal rows next to each other; an empty table gives no rows; sources missing
from ``weights`` or given weight 0 follow after all others in proportion to their size; extra columns
pass through, but phase, block, slot and position replace columns of these names.
"""

from __future__ import annotations

import heapq
from array import array
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import Scratch, table

NAME = "op8_mix_sources"
SQL = None

#: Rows of a source that one task numbers.
GROUP_ROWS = 100_000
#: Slots that the driver plans at most; beyond them blocks are larger.
MOST_SLOTS = 1 << 22
_FINE = 32  # bits of virtual time after the point


def exact_shares(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    common = gcd(*whole)
    return [a // common for a in whole]


def pfair(shares: list[int], blocks: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """Slots of each source's blocks, and the slots at which phases begin.

    Virtual time advances by one a slot in the first phase, so block j of share a out of ``total`` is
    released at j * total / a and due at (j + 1) * total / a; later by total over the shares left.
    """
    total = left = sum(shares)
    later = [(0, i) for i in range(len(shares))]
    due: list[tuple[int, int, int]] = []
    slots = [array("q") for _ in shares]
    starts, base, begun = [0], 0, 0
    for t in range(sum(blocks)):
        now = base + ((t + 1 - begun) * total << _FINE) // left
        while later and (later[0][0] < now or not due):  # the second: the others are ahead of a finished source
            i = heapq.heappop(later)[1]
            heapq.heappush(due, (-(-((len(slots[i]) + 1) * total << _FINE) // shares[i]), -shares[i], i))
        deadline, _, i = heapq.heappop(due)
        if begun == 0 and deadline <= t << _FINE:
            raise AssertionError("a deadline was missed")
        slots[i].append(t)
        if len(slots[i]) < blocks[i]:
            heapq.heappush(later, ((len(slots[i]) * total << _FINE) // shares[i], i))
        elif left > shares[i]:
            base, begun, left = now, t + 1, left - shares[i]
            starts.append(t + 1)
    return [np.array(s, np.int64) for s in slots], starts


@dataclass(frozen=True)
class Schedule:
    """Slots and places of any (source, number) pairs."""

    block: int
    sizes: dict[str, int]
    taken: dict[str, np.ndarray]
    starts: np.ndarray

    @classmethod
    def plan(cls, sizes: dict[str, int], weights: dict[str, float], block: int) -> Schedule:
        block = max(block, -(-sum(sizes.values()) // MOST_SLOTS))
        taken: dict[str, np.ndarray] = {}
        starts: list[int] = []
        first = sorted(s for s, n in sizes.items() if n and weights.get(s, 0) > 0)
        rest = sorted({s for s, n in sizes.items() if n} - set(first))
        for names, goal in ((first, [weights[s] for s in first]), (rest, [sizes[s] for s in rest])):
            if names:
                found, begun = pfair(exact_shares(goal), [-(-sizes[s] // block) for s in names])
                at = sum(map(len, taken.values()))
                taken |= {s: f + at for s, f in zip(names, found, strict=True)}
                starts += [at + b for b in begun]
        return cls(block, sizes, taken, np.array(starts, np.int64))

    def slots(self, source: str, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phase and slot of the source's blocks of these numbers."""
        slot = self.taken[source][block]
        return np.searchsorted(self.starts, slot, "right") - 1, slot


    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of last blocks that are not full, and the rows missing up to and with each."""
        rows = []
        for s, n in self.sizes.items():
            if n % self.block:
                rows.append((int(self.slots(s, np.array([n // self.block]))[1][0]), self.block - n % self.block))
        rows.sort()
        return np.array([r[0] for r in rows], np.int64), np.concatenate(([0], np.cumsum([r[1] for r in rows], dtype=np.int64)))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, block: int = 16) -> DataFrame:
    """``docs`` with phase, block (number within the source), slot and position (from 0) added.

    ``weights``: target weight of each source; if None, its row count to the power ``temperature``.
    """
    marks = ("phase", "block", "slot", "position")
    kept = [c for c in docs.columns if c not in marks]
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    plain = [c for c, kind in docs.dtypes if c in kept and "map<" not in kind]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), source.alias("source"), F.xxhash64(*(F.col(f"`{c}`") for c in plain)).alias("order"))
    sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    goal = {s: n**temperature for s, n in sizes.items()} if weights is None else {"" if s is None else f"={s}": w for s, w in weights.items()}
    plan = Schedule.plan(sizes, goal, block)
    edge, missing = plan.short()

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(tasks, -(-max(sizes.values(), default=1) // GROUP_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("order", F.lit(8)), F.lit(groups)))
    counts = Scratch(docs.sparkSession, "mixing").put(rows.groupBy("source", "part").count())
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "part").orderBy("order")).cast("long"))
    rows = rows.join(counts, ["source", "part"]).withColumn("number", F.col("base") + F.col("n") - 1)

    @F.pandas_udf("phase long, block long, slot long, position long")
    def place(source: pd.Series, number: pd.Series) -> pd.DataFrame:
        n = number.to_numpy()
        out = np.empty((4, len(n)), np.int64)
        for s, at in source.groupby(source).indices.items():
            phase, slot = plan.slots(s, n[at] // plan.block)
            out[:, at] = phase, n[at] // plan.block, slot, slot * plan.block - missing[np.searchsorted(edge, slot, "left")] + n[at] % plan.block
        return pd.DataFrame(dict(zip(marks, out, strict=True)))

    return rows.withColumn("place", place("source", "number")).select("row.*", *(f"place.{c}" for c in marks))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
