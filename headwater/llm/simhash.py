"""SimHash fingerprints and near-duplicate classes by pigeonring filtering.

A text is lower-cased (A-Z), cut into words, and its 3-word shingles (repeats included) are hashed with
XXH64, seed 42. A fingerprint bit is 1 if it is set in over half of the hashes. Two texts are linked if
their fingerprints differ in at most ``radius`` bits; a class is what links reach.

Search. The 64 bits are four segments on a ring. With at most 3 differing bits some segment starts a
chain whose cumulative differences stay within 0, 1, 2, 3 (the proportional budget 3/4 for each segment,
rounded down): this is the strong pigeonring condition. The first two steps of that chain are the index: the
first segment is equal, the second differs in one bit at most, so one of its halves is equal too, and a
fingerprint has eight keys (start, first segment, half of the second). All steps of the chain and then the whole
distance are checked on those that meet, in buckets of every size. Copies are one fingerprint from the start,
and within a bucket a spanning forest is emitted instead of all pairs, so a bucket of n fingerprints yields
fewer than n links and yet loses no connection. A bucket of over ``MOST_IN_BUCKET`` is dealt out once more: the
40 bits outside its key differ in 3 at most, so of their four parts one is equal, and that part joins the key.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows
and ids are all returned; a null id never names a class unless the class has no other id (then null);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, broadcast_if_small, cut, join_hot, small_batches, words_of
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
SEGMENTS = 4
SEGMENT_BITS = 16
RADIUS = 3
_CHUNK = 8192
#: Larger buckets are dealt out by further bits.
MOST_IN_BUCKET = 4096
MOST_BROADCAST = 200_000


def shingles(words: list[bytes], width: int = SHINGLE_WORDS) -> list[bytes]:
    if not words:
        return []
    if len(words) < width:
        return [b" ".join(words)]
    line = b" ".join(words)
    lengths = [len(w) for w in words]
    ends = list(accumulate(lengths, lambda a, b: a + b + 1))
    starts = [e - n for e, n in zip(ends, lengths, strict=True)]
    return [line[a:b] for a, b in zip(starts, ends[width - 1 :], strict=False)]


def shingle_hashes(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    parts, digest = shingles(words_of(text), width), xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        some = np.ascontiguousarray(hashes[start : start + _CHUNK])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None) -> int:
    return majority(shingle_hashes(text))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = np.fromiter((fingerprint(t) for t in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _segment(fps: np.ndarray, k: int) -> np.ndarray:
    return (fps >> np.uint64(SEGMENT_BITS * (k % SEGMENTS))) & np.uint64(0xFFFF)


def _chain_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """8 rows for a fingerprint: bits 32-33 of a key hold the start, bit 24 the half, below lie the segment and the half's value."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys = []
        for k in range(SEGMENTS):
            for half in range(2):
                value = (_segment(fps, k + 1) >> np.uint64(8 * half)) & np.uint64(0xFF)
                keys.append(np.uint64(k << 32 | half << 24) | (_segment(fps, k) << np.uint64(8)) | value)
        key = np.stack(keys, axis=1).reshape(-1)
        owner = np.repeat(fps, 2 * SEGMENTS)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner.view(np.int64))], ["key", "fp"])


def _finer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4 rows for a row of a large bucket: its key with one ten-bit part of what the key leaves out."""
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        turn = np.uint64(SEGMENT_BITS) * ((key >> np.uint64(32)) & np.uint64(3))
        ring = (fps >> turn) | (fps << ((np.uint64(64) - turn) % np.uint64(64)))
        other = (ring >> (np.uint64(24) - np.uint64(8) * ((key >> np.uint64(24)) & np.uint64(1)))) & np.uint64(0xFF)
        rest = ((ring >> np.uint64(32)) << np.uint64(8)) | other
        parts = [key | np.uint64(j + 1 << 34) | (((rest >> np.uint64(10 * j)) & np.uint64(1023)) << np.uint64(40)) for j in range(4)]
        fine = np.stack(parts, axis=1).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(fine.view(np.int64)), pa.array(np.repeat(fps, 4).view(np.int64))], ["key", "fp"])


def _mask(start: np.ndarray, steps: int) -> np.ndarray:
    """The bits of ``steps`` consecutive segments from ``start`` on."""
    out = np.zeros(len(start), np.uint64)
    for s in range(steps):
        out |= np.uint64(0xFFFF) << (np.uint64(SEGMENT_BITS) * ((start + np.uint64(s)) % np.uint64(SEGMENTS)))
    return out


def _start(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)) & np.uint64(3)


def _within(start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chain budgets 1, 2 for two and three segments, then the whole distance; the key settles the first."""
    diff = a ^ b
    keep = np.bitwise_count(diff & _mask(start, 2)) <= 1
    keep &= np.bitwise_count(diff & _mask(start, 3)) <= 2
    return keep & (np.bitwise_count(diff) <= RADIUS)


def _forest(start: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one larger bucket; each step compares one against the unreached."""
    left, out_a, out_b = fps, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _within(start, left, at)
            if near.any():
                hit = left[near]
                out_a.append(np.full(len(hit), at, np.uint64))
                out_b.append(hit)
                todo.extend(hit)
                left = left[~near]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _bucket_links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal keys; the keys are sorted."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    for h, n in zip(heads[sizes > 32], sizes[sizes > 32], strict=True):
        yield _forest(_start(keys[h : h + 1]), fps[h : h + n])
    small = (sizes > 1) & (sizes <= 32)
    for gap in range(1, int(sizes[small].max(initial=1))):
        # the rows of small runs that have a fellow ``gap`` places on
        own, many = heads[small & (sizes > gap)], sizes[small & (sizes > gap)] - gap
        first = np.repeat(own, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        a, b = fps[first], fps[first + gap]
        keep = _within(_start(keys[first]), a, b)
        yield a[keep], b[keep]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; a run that a batch cuts is carried over to the next."""
    rest_k = rest_f = np.zeros(0, np.uint64)

    def emit(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in _bucket_links(keys, fps):
            if len(a):
                low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
        fps = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from emit(keys[:last], fps[:last])
        rest_k, rest_f = keys[last:], fps[last:]
    if len(rest_k):
        yield from emit(rest_k, rest_f)


def links(distinct_fps: DataFrame) -> DataFrame:
    """(a, b), a < b: true links among distinct fingerprints whose closure is that of all links."""
    keyed = distinct_fps.select("fp").mapInArrow(_chain_keys, "key long, fp long")
    full = cut(keyed.groupBy("key").count().where(F.col("count") > MOST_IN_BUCKET).select("key"), "simhash-full")
    if not full.isEmpty():
        full = broadcast_if_small(full, MOST_BROADCAST)
        finer = keyed.join(full, "key", "left_semi").mapInArrow(_finer_keys, "key long, fp long")
        keyed = keyed.join(full, "key", "left_anti").unionByName(finer)
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    return met.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: the class is named by its smallest id."""
    fps = cut(fingerprints(docs, id_col, text_col), "simhash-fps")
    kinds = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "simhash-kinds")
    reach = connected_components(links(kinds))
    named = kinds.join(reach, kinds.fp == reach.node, "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut(named.join(smallest, "root").select("fp", "rows", "component_id"), "simhash-classes")
    return join_hot(fps, classes, "fp", "rows").select("doc_id", "fp", "component_id")
