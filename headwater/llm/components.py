"""Connected components of a link table by alternating large-star and small-star steps.

Each step is two aggregations and joins over links; nothing is gathered in one place. A node keeps one
link to the smallest node of its component when nothing changes any more, after a number of rounds that
is logarithmic in practice. Every round is a written table, so lost executors cost one round at most.
As soon as no more than ``FEW`` links are left, one executor task settles them, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: So many links fit into one task (some 100 MB).
FEW = 300_000
#: Nodes with more links in a round are hubs.
HUB = 100_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a batch by links from each node to its smallest, found in that batch alone."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(up, up)
                x = parent[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in parent]
        rows = np.array([(r, x) for x, r in found if r != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])


def _with_least(links: DataFrame, least: DataFrame, key: str, hubs_may_be: bool) -> DataFrame:
    """Links with the smallest neighbour of ``key``; hubs, links / HUB at most, are broadcast, others shuffled."""
    if not hubs_may_be:
        return links.join(least.select(key, "m"), key)
    hubs, others = F.broadcast(least.where(F.col("n") > HUB).select(key, "m")), least.where(F.col("n") <= HUB).select(key, "m")
    return links.join(hubs, key).unionByName(links.join(hubs, key, "left_anti").join(others, key))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links together."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if tables:
        for b in _contract(iter(pa.concat_tables(tables).combine_chunks().to_batches())):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0)], ["node", "root"])


def connected_components(links: DataFrame, contract: bool = True) -> DataFrame:
    """(node, root) of every node that has a link; ``links`` has long columns a and b."""
    pairs = links.select("a", "b").where("a <> b")
    if contract:
        pairs = pairs.mapInArrow(_contract, "a long, b long")
    edges = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] <= FEW:
            return cut(edges.coalesce(1).mapInArrow(_settle, "node long, root long"), "links-settled")
        if tuple(now) == before:
            break
        before = tuple(now)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both, least, "a", now[0] > HUB).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, down, "b", now[0] > HUB).select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).where("x <> m")
        edges = cut(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "links")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
