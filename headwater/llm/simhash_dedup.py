"""One row of each group of near duplicates: SimHash with pigeonring first, shingle sets to settle and complete.

Two texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is 0.8 or more; a group is
what links reach. Words and shingles are those of ``simhash``.

1. Equal sets are one from the start. Each set has a 64-bit fingerprint (majority bits of its shingle hashes, with
   repeats), and ``simhash.links`` finds the fingerprints within 3 bits by pigeonring chains. These pairs, and sets
   of one fingerprint, are compared by their sets.
2. A similarity of 0.8 is about 10 bits of 64, which no index of that radius tells from chance, so fingerprints
   alone miss most light edits. The rest is found by their shingles: shingles that are frequent in the whole table
   come last, the others first, each by hash, and texts meet in the buckets of their first ones. The first
   n - ceil(0.8 n) + 1 always have one in common with those of a similar text. Where most shingles of a text are not
   frequent fewer do: of those of two similar texts a share of q = 0.25 n / r at most differs (r: shingles that are
   not frequent), so their first t by hash all differ with a chance below q ** t; t is chosen for 1e-12 and is 20 for
   most texts. All shingles of all rows are counted, by the upper half of their hashes; which ones count as frequent
   decides the cost alone. Each member of a bucket is compared with the first of it, then, where a bucket still holds several
   classes, with some others; what is then still in different classes of a bucket is compared pair by pair. So
   groups of near copies, which the first rounds join, do not become pairs.

Sets are compared on the low 40 bits of XXH64 hashes; only the sets of texts in pairs are built.

Defined cases: texts without words have the empty set and are one class; a text of fewer than ``width`` words is
one shingle; of repeated rows one stays; rows with a null id are kept apart from others only by their group, and
the row with the smallest JSON form stays where a group's smallest id is null or repeated; an empty table gives an
empty result; the columns are those of the input, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, broadcast_if_small, cut, join_hot, partitions, small_batches
from .components import connected_components
from .simhash import SEED, links, majority, shingle_hashes

WIDTH = 5
#: The similarity as a fraction.
LEAST = (4, 5)
#: Shingles in SAMPLE * FREQUENT rows of the whole table are frequent (no text is left out, whatever SAMPLE is); how many
#: of them, the most frequent first, come last.
SAMPLE, FREQUENT, MOST_FREQUENT = 8, 2, 1_000_000
MOST_BROADCAST = 200_000
#: Members of a bucket that all others are compared with, and how often, before it comes to pairs.
STARS, ROUNDS = 4, 2
#: Chance to overlook a pair.
MISS = 1e-12
#: A text that more pairs share is dealt out to several tasks.
MOST_PAIRS = 4096


def name_of(found: np.ndarray) -> int:
    """A signed long that names a sorted set; zero if it is empty."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def _upper(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(32)).astype(np.uint32)


def _prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    n = rare = len(found)
    most = n - -(-n * LEAST[0] // LEAST[1]) + 1 if n else 0
    if len(frequent):
        upper = _upper(found)
        at = np.minimum(np.searchsorted(frequent, upper), len(frequent) - 1)
        late = frequent[at] == upper
        rare = n - int(late.sum())
        found = np.concatenate([found[~late], found[late]])
    if 4 * rare > n:
        most = min(most, math.ceil(math.log(MISS) / math.log(n / (4 * rare))))
    return found[:most]


def parity(found: np.ndarray) -> list[int]:
    """256 bits, as four longs: how many shingles fall on each, odd or even. Two texts differ in as many shingles as
    in bits at least."""
    odd = (np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _frequent(narrow: DataFrame, width: int) -> np.ndarray:
    """The upper halves, sorted, of the hashes of the shingles that many rows have, counted over all rows.

    Tasks send each part of the range of halves its sorted keys and their counts, some 4 bytes a shingle; there are as
    many parts as shuffle partitions, so a group stays small in large tables.
    """
    bits = min(16, max(6, (partitions(narrow.sparkSession) - 1).bit_length()))
    least = SAMPLE * FREQUENT

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [np.unique(_upper(shingle_hashes(t, width))) for t in as_bytes(batch.column(1))]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *found]), return_counts=True)
            if not len(keys):
                continue
            n = n.astype(np.uint32)
            part, starts = np.unique(keys >> np.uint32(32 - bits), return_index=True)
            ends = [*starts[1:], len(keys)]
            both = [pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for x in (keys, n)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), *both], ["part", "keys", "n"])

    def count(part: pa.Table) -> pa.Table:
        keys, n = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint32) for c in ("keys", "n"))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        rows = np.add.reduceat(n[order].astype(np.int64), starts)
        many = rows >= least
        return pa.table({"key": keys[starts][many].astype(np.int64), "rows": rows[many]})

    many = narrow.mapInArrow(deal, "part long, keys binary, n binary").groupBy("part").applyInArrow(count, "key long, rows long")
    top = many.orderBy(F.desc("rows"), "key").limit(MOST_FREQUENT).select("key").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.uint32))


def _sketches(narrow: DataFrame, width: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, name, fp, n, prefix, odd): the set's name, its fingerprint, its first shingles and its parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            names, fps, sizes, heads, odd = [], [], [], [], []
            for text in as_bytes(batch.column(1)):
                hashes = shingle_hashes(text, width)
                found = np.unique(hashes)
                names.append(name_of(found))
                fps.append(majority(hashes))
                sizes.append(len(found))
                heads.append(_prefix(found, frequent))
                odd.append(parity(found))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), fp, pa.array(sizes, pa.int32()), _lists(heads), pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "name", "fp", "n", "prefix", "odd"])

    return narrow.mapInArrow(run, "doc_id long, name long, fp long, n int, prefix array<long>, odd array<long>")


def _pack(found: np.ndarray) -> bytes:
    """The low 40 bits of each hash, sorted."""
    low = np.unique(found & np.uint64((1 << 40) - 1))
    return low.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _sets(narrow: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(name, h) of the wanted (name, first_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            names, rows = [], []
            for text, name in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = np.unique(shingle_hashes(text, width))
                if name_of(found) == name:  # other rows may have the same id
                    names.append(name)
                    rows.append(_pack(found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.binary())], ["name", "h"])

    wanted = broadcast_if_small(wanted, MOST_BROADCAST)
    rows = narrow.join(wanted, narrow.doc_id.eqNullSafe(wanted.first_id)).select("text", "name")
    return cut(rows.mapInArrow(run, "name long, h binary"), "near-sets")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps (a, b) where the packed sets are similar."""
    for batch in small_batches(batches):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            both = len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))
            keep.append(both * sum(LEAST) >= LEAST[0] * ((len(x) + len(y)) // 5))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _similar(pairs: DataFrame, kinds: DataFrame, narrow: DataFrame, width: int) -> DataFrame:
    """The written pairs (a, b) of names whose sets are similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    sets = _sets(narrow, cut(kinds.join(ids, "name", "left_semi").select("name", "first_id"), "near-wanted"), width)
    hot = pairs.groupBy("a").count().where(F.col("count") > MOST_PAIRS).select("a", F.ceil(F.col("count") / MOST_PAIRS).cast("int").alias("parts"))
    hot = F.broadcast(cut(hot, "near-hot"))  # pairs / MOST_PAIRS rows at most
    one = F.lit(1)
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", one)).cast("int").alias("part"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1)).alias("part")
    left = sets.join(hot, sets["name"] == hot["a"], "left").select(F.col("name").alias("a"), F.col("h").alias("ha"), every)
    right = sets.select(F.col("name").alias("b"), F.col("h").alias("hb"))
    both = dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "ha", "hb")
    return cut(both.mapInArrow(_agree, "a long, b long").distinct(), "near-links")


def _possible(a: str, b: str) -> Column:
    """Whether the shingles from the common key on suffice. Under the first key that a similar pair has in common
    all that it shares lies there, so the pair passes in that bucket at least."""
    most = f"least({a}.n - {a}.pos, {b}.n - {b}.pos)"
    differ = " + ".join(f"bit_count({a}.odd[{k}] ^ {b}.odd[{k}])" for k in range(4))
    # Similar sets differ in (1 - s) / (1 + s) of their sizes' sum at most.
    return F.expr(f"{sum(LEAST)} * ({most}) >= {LEAST[0]} * ({a}.n + {b}.n) and {sum(LEAST)} * ({differ}) <= {LEAST[1] - LEAST[0]} * ({a}.n + {b}.n)")


def _may_agree(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first half of ``_possible`` for arrays."""
    return sum(LEAST) * np.minimum(n - pos, m - at) >= LEAST[0] * (n + m)


def _pairs_and_rows(key: np.ndarray, name: np.ndarray, n: np.ndarray, pos: np.ndarray, later: bool = False) -> Iterator[pa.RecordBatch]:
    """For runs of equal keys the pairs with their first row, and all rows of runs of three or more.

    With ``later`` all is one run, of which only the first row was given before.
    """
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    star = np.repeat(heads, sizes)
    other = np.flatnonzero(star != np.arange(len(key)))
    i, j = star[other], other
    keep = _may_agree(n[i], pos[i], n[j], pos[j]) & (name[i] != name[j])
    i, j = i[keep], j[keep]
    if len(i):
        none = pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(name[j]), *none], ["a", "b", "key", "n", "pos"])
    rows = other if later else np.flatnonzero(np.repeat(sizes, sizes) > 2)
    if len(rows):
        arrays = [pa.array(name[rows]), pa.nulls(len(rows), pa.int64()), pa.array(key[rows]), pa.array(n[rows]), pa.array(pos[rows])]
        yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "key", "n", "pos"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key and name. A run that a batch cuts is carried over; of a very long one only its
    first row is."""
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
    long_run = False  # whether ``held`` is the first row of a run, the rest of which is done
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        if long_run:
            end = int(np.searchsorted(cols[0], cols[0][0], side="right"))
            if end > 1:
                yield from _pairs_and_rows(*[c[:end] for c in cols], later=True)
            if end == len(cols[0]):
                continue
            cols, long_run = [c[end:] for c in cols], False
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last:
            yield from _pairs_and_rows(*[c[:last] for c in cols])
        held = [c[last:] for c in cols]
        if len(held[0]) > 1 << 16:
            yield from _pairs_and_rows(*held)
            held, long_run = [c[:1] for c in held], True
    if len(held[0]) and not long_run:
        yield from _pairs_and_rows(*held)


def _roots(found: DataFrame) -> DataFrame:
    """(node, root) of the names that have links so far."""
    return broadcast_if_small(cut(connected_components(found), "near-roots"), MOST_BROADCAST)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose names are not of one class yet."""
    reach = _roots(found)
    for side in ("a", "b"):
        root = reach.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(root, side, "left")
    return pairs.where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False)) & (F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))).select("a", "b")


def _open(met: DataFrame, found: DataFrame) -> DataFrame:
    """The rows, with their classes so far, of the buckets that still hold several."""
    reach = _roots(found)
    named = met.join(reach, met["name"] == reach.node, "left").select("key", "name", "n", "pos", "odd", F.coalesce("root", "name").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return cut(named.join(several, "key", "left_semi"), "near-open")


def _by_fingerprint(kinds: DataFrame) -> DataFrame:
    """Pairs of names that the fingerprints suggest: within one fingerprint, and across pigeonring links."""
    first = cut(kinds.groupBy("fp").agg(F.min("name").alias("one"), F.count(F.lit(1)).alias("rows")), "near-fps")
    within = join_hot(kinds.select("fp", "name"), first, "fp", "rows").where("name <> one").select(F.col("one").alias("a"), F.col("name").alias("b"))
    x, y = first.select(F.col("fp").alias("x"), F.col("one").alias("a")), first.select(F.col("fp").alias("y"), F.col("one").alias("b"))
    met = cut(links(first), "near-fp-links").select(F.col("a").alias("x"), F.col("b").alias("y"))
    return within.unionByName(met.join(x, "x").join(y, "y").select("a", "b"))


def similar_links(kinds: DataFrame, narrow: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b): similar pairs of names whose closure is that of all similar pairs.

    kinds: (name, first_id, fp, n, prefix, odd), each set once.
    """
    found = tried = None

    def settle(pairs: DataFrame) -> None:
        nonlocal found, tried
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if found is not None:
            new = _apart(new, found).join(tried, ["a", "b"], "left_anti")
        new = cut(new, "near-pairs")
        good = _similar(new, kinds, narrow, width)
        found = good if found is None else found.unionByName(good)
        tried = new if tried is None else tried.unionByName(new)

    settle(_by_fingerprint(kinds))
    rows = kinds.select(F.posexplode("prefix").alias("pos", "key"), "name", "n").select("key", "name", "n", "pos")
    sorted_ = rows.repartition("key").sortWithinPartitions("key", "name")
    met = cut(sorted_.mapInArrow(_meet, "a long, b long, key long, n int, pos int"), "near-met")
    settle(met.where("b is not null").select("a", "b"))
    large = met.where("b is null").select("key", F.col("a").alias("name"), "n", "pos").join(kinds.select("name", "odd"), "name")
    if large.isEmpty():
        return found
    for turn in range(ROUNDS):
        left = _open(large, found)
        order = Window.partitionBy("key").orderBy(F.xxhash64("name", "key", F.lit(turn)), "name")
        stars = left.withColumn("i", F.row_number().over(order)).where(F.col("i") <= STARS)
        both = left.alias("me").join(stars.alias("one"), "key").where("me.root <> one.root").where(_possible("one", "me"))
        settle(both.select(F.col("one.name").alias("a"), F.col("me.name").alias("b")))
    left = _open(large, found)
    settle(left.alias("x").join(left.alias("y"), "key").where("x.root < y.root").where(_possible("x", "y")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b")))
    return found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, name, root, component_id) for each row: root names the group, component_id is its smallest id."""
    narrow = _narrow(docs, id_col, text_col)
    rows = cut(_sketches(narrow, width, _frequent(narrow, width)), "near-rows")
    first = rows.groupBy("name").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("fp", "n", "prefix", "odd")])
    kinds = cut(first, "near-kinds")
    reach = connected_components(similar_links(kinds, narrow, width))
    named = kinds.join(reach, kinds["name"] == reach.node, "left").select("name", "first_id", "rows", F.coalesce("root", "name").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut(named.join(smallest, "root").select("name", "rows", "root", "component_id"), "near-classes")
    return join_hot(rows.select("doc_id", "name"), classes, "name", "rows").select("doc_id", "name", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay if each group keeps one row of its smallest id."""
    found = cut(groups(docs, id_col, text_col, width), "near-groups")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # An id that also names rows of other groups is not unique in the input, so those are counted too.
    counted = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("staying")).where("staying > 0")
    counted = cut(counted, "near-ids")
    plain = counted.where("rows = 1 and doc_id is not null").select(F.col("doc_id").alias("_keep_id"))
    kept = docs.join(plain, docs[id_col].cast("long") == plain["_keep_id"], "left_semi")
    odd = counted.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("_odd"))
    if odd.isEmpty():
        return kept
    rows = docs.join(odd, docs[id_col].cast("long").eqNullSafe(odd["_odd"]), "left_semi")
    wide = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [name_of(np.unique(shingle_hashes(t, width))) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], ["row", "doc_id", "name"])

    schema = T.StructType([wide.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("name", T.LongType())])
    classes = stay.select("name", "root", "component_id").distinct()
    marked = wide.mapInArrow(add, schema).join(classes, "name").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return kept.unionByName(marked.groupBy("root").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
