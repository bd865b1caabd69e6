"""Approximate nearest neighbours: coarse cells, product-quantised residuals, exact reranking.

Fitting: k-means finds the cells and, for each part of the residuals, a code book. It uses at most ``SAMPLE``
distinct vectors, in the order of a hash of their smallest id (the documented bound); a cell has four of them at
least. Indexing: every distinct vector goes to its nearest cell and is coded by its residual. Searching: a query
asks its nearest cells; a table of distances from its residual to all code words gives asymmetric distances, the
only thing computed for the members of these cells. The best ``rerank`` of all asked cells together are then
measured exactly, in double precision.

How many cells are asked and how many vectors are reranked is measured within the sample, unless given: enough
cells to hold ``COVER`` of the true neighbours, and places enough among the asymmetric distances for ``COVER`` of
them, in proportion to the whole table. Clustered vectors need few cells, vectors without structure many. A query
whose cells hold fewer than k candidates asks all cells.

Equal vectors are one entry with its ``k + 1`` smallest ids, which is all that any answer can need. Cells are put
together into blocks of bounded size, large cells are split over several, and so are many queries of one block.

Defined cases: vectors that are null, zero, or hold a null or a value that is not finite take no part, nor do
rows with a null id, nor vectors whose length is not the most frequent one (ties: the longer), as they have no
distance to the others; rows that share an id are rows of their own, and a query is answered once for each different
vector of its id; fewer than k candidates give fewer rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 20_000
#: Share of the true neighbours within the sample that cells and places must hold.
COVER = 0.97
_TRIALS = 256
PARTS = 16
CODES = 256
#: Vectors reranked at least.
RERANK = 400
BLOCK_VECTORS = 65_536
BLOCK_QUERIES = 2048


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], minlength=k)
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


@dataclass
class Coder:
    """Centres of cells and, for each part, code words; vectors are padded to whole parts."""

    centres: np.ndarray
    books: np.ndarray  # parts x codes x width

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.padded))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.books.shape[0], self.books.shape[2])

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        d = squared(x, self.centres)
        n = min(n, d.shape[1])
        return np.argpartition(d, n - 1, axis=1)[:, :n] if n > 1 else d.argmin(1)[:, None]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = self.split(x - self.centres[cell])
        return np.stack([squared(parts[:, p], self.books[p]).argmin(1) for p in range(parts.shape[1])], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the parts of the query's residual to all code words."""
        part = self.split((q - self.centres[cell])[None, :])[0]
        return ((part[:, None, :] - self.books) ** 2).sum(2)


def fit(sample: np.ndarray, cells: int, parts: int = PARTS) -> Coder:
    centres = kmeans(sample, cells)
    parts = min(parts, sample.shape[1])
    width = math.ceil(sample.shape[1] / parts)
    coder = Coder(centres, np.zeros((parts, 1, width)))
    own = np.concatenate([coder.cells(sample[i : i + 4096])[:, 0] for i in range(0, len(sample), 4096)])
    rest = coder.split(sample - centres[own])
    coder.books = np.stack([kmeans(rest[:, p], CODES) for p in range(parts)])
    return coder


def effort(coder: Coder, sample: np.ndarray, k: int, cover: float = COVER) -> tuple[int, float]:
    """(cells to ask, share of the table to rerank) that hold ``cover`` of the neighbours within the sample."""
    trial = sample[:_TRIALS]
    own = np.concatenate([coder.cells(sample[i : i + 4096])[:, 0] for i in range(0, len(sample), 4096)])
    codes, columns = coder.encode(sample, own), np.arange(coder.books.shape[0])
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(coder.centres), 1.0
    cells, places = [], []
    for i, q in enumerate(trial):
        distance = squared(q[None, :], sample)[0]
        distance[i] = np.inf
        near = np.argpartition(distance, k - 1)[:k]
        order = np.argsort(squared(q[None, :], coder.centres)[0], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cells.append(rank[own[near]])
        tables = np.stack([coder.tables(q, c) for c in range(len(coder.centres))])
        rough = tables[own[:, None], columns[None, :], codes].sum(1)
        rough[i] = np.inf
        places.append((rough[None, :] < rough[near][:, None]).sum(1))
    last = lambda x: np.quantile(np.concatenate(x), cover, method="higher")
    return int(last(cells)) + 1, (float(last(places)) + 1) / len(sample)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; v is an array of doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    rows = cut(rows, "ann-rows")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size.n if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks_of(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each cell its first block and the number of its blocks; small cells share one."""
    out, block, held = {}, 0, 0
    for cell, size in sorted(sizes.items()):
        parts = math.ceil(size / most)
        if held and (parts > 1 or held + size > most):
            block, held = block + 1, 0
        out[cell] = (block, parts)
        block, held = (block + parts, 0) if parts > 1 else (block, held + size)
    return out


def _rough(coder: Coder, rerank: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            entries = entries.sort_values("cell", kind="stable")
            codes = np.frombuffer(b"".join(entries.code), np.uint8).reshape(len(entries), -1)
            cell, key, columns = entries.cell.to_numpy(), entries.key.to_numpy(), np.arange(codes.shape[1])
            for qkey, raw, asked in zip(queries.qkey, queries.vector, queries.cells, strict=True):
                q = np.frombuffer(raw)
                begin, end = np.searchsorted(cell, asked), np.searchsorted(cell, asked, side="right")
                parts = [coder.tables(q, c)[columns, codes[b:e]].sum(1) for c, b, e in zip(asked, begin, end, strict=True) if e > b]
                if parts:
                    rough = np.concatenate(parts)
                    at = np.concatenate([np.arange(b, e) for b, e in zip(begin, end, strict=True)])
                    if len(at) > rerank:
                        best = np.argpartition(rough, rerank - 1)[:rerank]
                        rough, at = rough[best], at[best]
                    out.append(pd.DataFrame({"qkey": qkey, "key": key[at], "rough": rough}))
        empty = pd.DataFrame({"qkey": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "rough": np.zeros(0)})
        return pd.concat(out) if out else empty

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, qkey, vec_id, score) for the ids of an entry; the query's own row is left out once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        distance = np.sqrt(((_matrix(batch.column(3)) - _matrix(batch.column(4))) ** 2).sum(1))
        rows = []
        for qid, qkey, ids, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), distance.tolist(), strict=True):
            if d == 0 and qid in ids:
                ids.remove(qid)
            rows += [(qid, qkey, i, d) for i in ids]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_id", "qkey", "vec_id", "score"])


def _ask(coder: Coder, entries: DataFrame, queries: DataFrame, k: int, asked: int, rerank: int) -> DataFrame:
    """(query_id, qkey, vec_id, score) of the k nearest found in the nearest ``asked`` cells."""
    place = blocks_of({r.cell: r.n for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}, BLOCK_VECTORS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rows = []
            for qkey, v, near in zip(batch.column(0).to_pylist(), x, coder.cells(x, asked), strict=True):
                found: dict[int, list[int]] = {}
                for c in sorted(near.tolist()):
                    first, parts = place.get(c, (0, 0))
                    for b in range(first, first + parts):
                        found.setdefault(b, []).append(c)
                rows += [(b, qkey, v.tobytes(), cells) for b, cells in found.items()]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            types = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "qkey", "vector", "cells"])

    spark = entries.sparkSession
    # As many rows as cells, of which there are SAMPLE / 4 at most.
    where = F.broadcast(spark.createDataFrame([(c, *p) for c, p in place.items()], "cell int, first int, parts int"))
    dealt = cut(queries.select("qkey", "v").mapInArrow(deal, "block int, qkey long, vector binary, cells array<int>"), "ann-dealt")
    sides = F.broadcast(dealt.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("qb")))
    left = entries.join(where, "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int")).join(sides, "block")
    left = left.select("block", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "cell", "key", "code")
    right = dealt.join(sides, "block").select("block", F.pmod(F.xxhash64("qkey"), F.col("qb")).cast("int").alias("q"), "qkey", "vector", "cells")
    rough = left.groupBy("block", "q").cogroup(right.groupBy("block", "q")).applyInPandas(_rough(coder, rerank), "qkey long, key long, rough double")
    order = Window.partitionBy("qkey").orderBy("rough", "key")
    best = rough.withColumn("i", F.row_number().over(order)).where(F.col("i") <= rerank).select("qkey", "key")
    pairs = best.join(entries.select("key", "ids", "x"), "key").join(queries.select("query_id", "qkey", "v"), "qkey")
    exact = pairs.select("query_id", "qkey", "ids", "x", "v").mapInArrow(_exact, "query_id long, qkey long, vec_id long, score double")
    order = Window.partitionBy("qkey").orderBy("score", "vec_id")
    return cut(exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-found")


def search(df: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, rerank: int | None = None, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id ``is_query`` accepts."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("vec_id")  # Spark keeps the first ids of each task before it shuffles
    few = rows.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)
    kinds = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    kinds = cut(kinds.withColumn("key", F.monotonically_increasing_id()), "ann-kinds")
    n = kinds.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = kinds.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0], "v").limit(SAMPLE).select("v").toArrow()
    vectors = _matrix(sample.column(0).combine_chunks())
    coder = fit(vectors, cells or max(1, min(len(vectors) // 4, round(math.sqrt(n)))))
    asked, share = effort(coder, vectors, k)
    asked, rerank = probes or asked, rerank or max(RERANK, math.ceil(share * n))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                cell = coder.cells(x)[:, 0]
                codes = pa.array([r.tobytes() for r in coder.encode(x, cell)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(2), codes, batch.column(1), batch.column(0)], ["cell", "key", "code", "ids", "x"])

    entries = cut(kinds.select("v", "ids", "key").mapInArrow(index, "cell int, key long, code binary, ids array<long>, x array<double>"), "ann-index")
    queries = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v").distinct()
    queries = cut(queries.withColumn("qkey", F.monotonically_increasing_id()), "ann-queries")
    found = _ask(coder, entries, queries, k, asked, rerank)
    least = min(k, int(rows.limit(k + 1).count()) - 1)
    counted = found.groupBy("qkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    short = cut(queries.join(counted, "qkey", "left_anti"), "ann-short") if asked < len(coder.centres) else None
    if short is not None and not short.isEmpty():
        again = _ask(coder, entries, short, k, len(coder.centres), rerank)
        found = found.join(short.select("qkey"), "qkey", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
