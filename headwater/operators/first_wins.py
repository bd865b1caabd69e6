"""Greedy first-wins dedup on two keys: a row stays iff neither of its keys was seen on a row that stayed before it.

Rows are edges between the values of their two keys, and rows of different connected components never decide about each
other. So undecided rows are split into components, and each component is settled in order within one task: as many tasks as
there are components. Only components of over ``bound`` rows are settled in blocks of ``bound`` rows by order, one
block after the other, where each block drops what the kept rows before it block.

Defined cases: nulls are one value of a key; the order is unique; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.sources.tables import cut

#: So many rows or links fit into one task.
BOUND = 200_000
#: Rounds that decide what is first under both keys, before components are sought.
PEELS = 2


class _Sets:
    """Disjoint sets; the smallest member names a set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def pairs(self) -> tuple[pa.Array, pa.Array]:
        found = [(self.find(x), x) for x in list(self.up)]
        both = np.array([(r, x) for r, x in found if r != x], np.int64).reshape(-1, 2)
        return pa.array(both[:, 0]), pa.array(both[:, 1])


def _within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a batch by one link from each node to the smallest that it reaches there."""
    for batch in batches:
        sets = _Sets()
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(x, y)
        yield pa.RecordBatch.from_arrays([*sets.pairs()], ["u", "v"])


def _all_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Sets()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(x, y)
    root, node = sets.pairs()
    yield pa.RecordBatch.from_arrays([node, root], ["node", "root"])


def components(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """(node, root) of the nodes of links (u, v) that are not the root of their component.

    While more than ``bound`` links are left, each node hooks to its smallest neighbour if that is smaller, chains of
    hooks are halved until all point to a root, and the links are carried over to the roots. At most half of the nodes are roots.
    """
    layers = []
    while True:
        links = cut(links.select("u", "v").mapInArrow(_within_batches, "u long, v long").distinct(), "links")
        if links.count() <= bound:
            found = cut(links.coalesce(1).mapInArrow(_all_at_once, "node long, root long"), "roots")
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).where("root < node"), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            higher = cut(hooks.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "hooks")
            hooks = higher.select("node", "root")
            if higher.where("moved").isEmpty():
                break
        layers.append(hooks)
        for side in ("u", "v"):
            to = hooks.select(F.col("node").alias(side), F.col("root").alias("to"))
            links = links.join(to, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        links = links.where("u <> v")
    for hooks in reversed(layers):
        top = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = hooks.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(found)
    return cut(found, "roots") if layers else found


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (root, a, b, ...) sorted by root and order; keeps those that the walk keeps."""
    now, seen_a, seen_b = object(), set(), set()
    for batch in batches:
        keep = []
        for root, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if root != now:
                now, seen_a, seen_b = root, set(), set()
            fine = a not in seen_a and b not in seen_b
            if fine:
                seen_a.add(a)
                seen_b.add(b)
            keep.append(fine)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _walk(rows: DataFrame) -> DataFrame:
    """rows (root, a, b, o) with each root in one partition."""
    return rows.sortWithinPartitions("root", "o").mapInArrow(_greedy, rows.schema).select("o", "a", "b")


def _in_blocks(rows: DataFrame, bound: int, report: dict[str, int]) -> DataFrame:
    kept = None
    while True:
        block = cut(rows.orderBy("o").limit(bound), "dedup-block")
        last = block.agg(F.max("o")).first()[0]
        if last is None:
            return kept
        report["blocks"] += 1
        now = cut(_walk(block.withColumn("root", F.lit(0).cast("long")).select("root", "a", "b", "o").coalesce(1)), "dedup-kept")
        kept = now if kept is None else kept.unionByName(now)
        rows = cut(_unblocked(rows.where(F.col("o") > F.lit(last)), now), "dedup")


def _unblocked(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows without a key of a kept row."""
    return rows.join(kept.select("a"), "a", "left_anti").join(kept.select("b"), "b", "left_anti").select("o", "a", "b")


def _text(key: str) -> Column:
    """A key as text; a prefix keeps nulls apart from all values."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def first_wins(rows: DataFrame, order: str, keys: tuple[str, str], bound: int = BOUND) -> tuple[DataFrame | None, dict[str, int]]:
    """(o, a, b) of the rows that stay, as written tables (None if there are no rows), and how many steps it took."""
    left = cut(rows.select(F.col(order).alias("o"), _text(keys[0]).alias("a"), _text(keys[1]).alias("b")), "dedup")
    report, kept = {"peels": 0, "components": 0, "blocks": 0}, []
    for _ in range(PEELS):
        if left.isEmpty():
            break
        first = lambda k: left.groupBy(k).agg(F.min("o").alias(f"m{k}"))
        now = cut(left.join(first("a"), "a").join(first("b"), "b").where("o = ma and o = mb").select("o", "a", "b"), "dedup-kept")
        left = cut(_unblocked(left, now), "dedup")
        kept.append(now)
        report["peels"] += 1
    if not left.isEmpty():
        told = left.select("*", F.xxhash64(F.lit("a"), "a").alias("u"), F.xxhash64(F.lit("b"), "b").alias("v"))
        # Two values with one hash would only make one component of two.
        reach = components(told.select("u", "v"), bound)
        named = cut(told.join(reach, told.u == reach.node, "left").select(F.coalesce("root", "u").alias("root"), "a", "b", "o"), "dedup-named")
        large = cut(named.groupBy("root").count().where(F.col("count") > bound).select("root"), "dedup-large")
        report["components"] = named.select("root").distinct().count()
        kept.append(cut(_walk(named.join(large, "root", "left_anti").repartition("root")), "dedup-kept"))
        if not large.isEmpty():
            kept.append(_in_blocks(named.join(large, "root", "left_semi").select("o", "a", "b"), bound, report))
    found = None
    for part in kept:
        found = part if found is None else found.unionByName(part)
    return found, report
