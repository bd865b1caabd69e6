"""Language-model scores from an Elias-Fano n-gram trie.

Model. Absolute discounting, interpolated down to single tokens:
  P_n(w | context) = max(c(context w) - D, 0) / c(context) + D * kinds(context) / c(context) * P_(n-1)(w | shorter),
  P_1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)).
A context that training never saw passes its whole mass on. Tokens are the words of a text and then one
end; the tokens before a text count as ends.

Trie. It is split into shards by the first word of an n-gram, and by the second one where the first is frequent (a share
of ``HOT_SHARE`` of all tokens or more), so that no word's successors meet in one task. The counts of frequent words are
summed beforehand, as a bounded table; the kinds of their successors are summed over the shards. A shard holds the sorted hashes of its
words, and for each level monotone pointers from a node to its successors, the successors as numbers
relative to their context (rank in the shard's word list, plus the context's base, which makes one rising
sequence of the level), the discounted probabilities and the contexts' back-off masses in 8 bits each on a
logarithmic scale. Words, pointers and successors are Elias-Fano coded; a look-up is a successor search
within the range of its context.

Flow. Texts are tokenised once into blocks (a written table). Each block sends each shard its distinct
n-grams once, with their counts in training texts; a shard merges these, builds its trie and answers the
same n-grams, so counting and querying share one shuffle. Blocks and answers meet by block. Only two sums
(N and V) reach the driver. Counts are of all training texts; nothing is pruned. Words are told apart by
64-bit hashes.

Defined cases: null and empty texts are the end alone; rows with a null id are scored and learnt from like
others; repeated rows each count and are each returned; without training texts N = V = 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import as_bytes, cut, partitions, small_batches
from .eliasfano import EliasFano, from_buffer, to_buffer
from .tokens import coded_words, hash_all

ORDER = 2
DISCOUNT = 0.9
#: A block is closed beyond half so many tokens, and a shard is made for each so many tokens of the table at least.
BLOCK_TOKENS = 1_500_000
SHARD_TOKENS = 4_000_000
#: Words with this share of all tokens are split among the shards by their successors; there are at most twice its inverse.
HOT_SHARE = 1 / 4096
END = xxhash.xxh3_64_intdigest(b"")
_DECADES = 8.0


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes() if len(raw) else b""
    return len(raw).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities from 0 to 1 as 8 bits: 0 is zero, 1 to 255 steps of ``_DECADES``/254 decades up to 1."""
    with np.errstate(divide="ignore"):
        step = np.rint(255 + np.log10(p) * 254 / _DECADES)
    return np.where(p > 0, np.clip(step, 1, 255), 0).astype(np.uint8)


LEVELS = np.concatenate([[0.0], 10 ** ((np.arange(1, 256) - 255) * _DECADES / 254)])


def token_blocks(docs: DataFrame, id_col: str, text_col: str, train: Column, hot_share: float = HOT_SHARE) -> DataFrame:
    """Blocks of tokenised texts: ids, training flags, lengths, word hashes, local word numbers, each word's count in
    training texts, the words with half the share of a frequent word or more, and the number of tokens."""

    def close(store: list, number: int) -> pa.RecordBatch:
        hashes = np.concatenate([h for *_, h in store])
        kinds, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which compress better
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        ids, flags, lengths = ([x for part in store for x in part[k]] for k in range(3))
        codes = rank[inverse]
        learnt = np.bincount(codes[np.repeat(np.asarray(flags, bool), lengths)], minlength=len(order)).astype(np.uint32)
        top = count[order] >= hot_share / 2 * len(hashes)
        row = [[number], [ids], [flags], [lengths], [pack(kinds[order])], [pack(codes)], [pack(learnt)], [kinds[order][top].view(np.int64).tolist()], [count[order][top].tolist()], [len(hashes)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2, pa.int64()]
        names = ["block", "ids", "train", "lengths", "words", "codes", "learnt", "top", "top_n", "held"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, store, held = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in small_batches(batches, 4 << 20):
            words, codes, lengths = coded_words(as_bytes(batch.column(1)))
            hashes = np.concatenate([hash_all(words), np.array([END], np.uint64)])
            # each text is followed by its end
            ends = np.cumsum(lengths)
            flat = np.insert(codes.astype(np.int64), ends, len(words)) if len(lengths) else np.zeros(0, np.int64)
            store.append((batch.column(0).to_pylist(), batch.column(2).to_pylist(), (lengths + 1).tolist(), hashes[flat]))
            held += len(flat)
            if held >= BLOCK_TOKENS // 2:
                yield close(store, base + made)
                made, store, held = made + 1, [], 0
        if held:
            yield close(store, base + made)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return narrow.mapInArrow(run, "block long, ids array<long>, train array<boolean>, lengths array<int>, words binary, codes binary, learnt binary, top array<long>, top_n array<long>, held long")


def frequent_words(blocks: DataFrame, hot_share: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; counts in training) of the frequent words.

    A word with the share in all has half of it in blocks that hold at least half of it, and those report it;
    so words whose reported counts make half the share take in all such, and are at most twice its inverse.
    """
    reported = blocks.select(F.explode(F.arrays_zip("top", "top_n")).alias("t")).groupBy(F.col("t.top").alias("w")).agg(F.sum("t.top_n").alias("n"))
    held = blocks.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held")).first().held
    found = reported.where(F.col("n") >= hot_share / 2 * held).select("w").collect()
    hot = np.sort(np.array([r.w for r in found], np.int64).view(np.uint64))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = np.zeros(len(hot), np.int64)
            for row in frame.itertuples(index=False):
                words = unpack(row.words, np.uint64)
                at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
                own = hot[at] == words
                np.add.at(total, at[own], unpack(row.learnt, np.uint32)[own])
            yield pd.DataFrame({"i": np.arange(len(hot)), "n": total})

    counts = np.zeros(len(hot), np.int64)
    if len(hot):
        for r in blocks.select("words", "learnt").mapInPandas(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            counts[r.i] = r.n
    return hot, counts


class Block:
    """The distinct n-grams of a block, ordered by shard and then by local word numbers."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, train: np.ndarray, order: int, shards: int, hot: np.ndarray):
        self.bits = 63 // order  # of a local word number: 31 with pairs of words, 21 with three
        if len(words) >= 1 << self.bits:
            raise ValueError("a block has more distinct words than local numbers")
        self.words, self.codes, self.lengths = words, codes.astype(np.uint64), lengths
        self.end = np.uint64(np.flatnonzero(words == np.uint64(END))[0])
        self.shard = ((words >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        self.hot = np.isin(words, hot)
        flags = np.repeat(train, lengths)
        first = np.zeros(len(codes), np.int64)  # position within the text
        starts = np.cumsum(lengths) - lengths
        first = np.arange(len(codes)) - np.repeat(starts, lengths)
        self.counts1 = np.bincount(codes[flags], minlength=len(words)).astype(np.uint32)
        self.grams, self.keys, self.counts = {}, {}, {}
        for n in range(2, order + 1):
            key = self.codes.copy()
            for back in range(1, n):
                before = np.full(len(codes), self.end, np.uint64)
                before[back:] = self.codes[:-back]
                before[first < back] = self.end
                key |= before << np.uint64(self.bits * back)
            marked = np.sort((key << np.uint64(1)) | flags.astype(np.uint64)) if n * self.bits < 64 else None
            plain = marked >> np.uint64(1)
            heads = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
            trained = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), heads)
            grams = plain[heads]
            one, two = self.columns(n, grams)[:2]
            place = self.shard[np.where(self.hot[one], two, one)]
            by_shard = np.argsort(place, kind="stable")
            self.grams[n], self.keys[n], self.counts[n] = (grams, place, by_shard), key, trained.astype(np.uint32)

    def columns(self, n: int, grams: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        return [((grams >> np.uint64(self.bits * k)) & mask).astype(np.int64) for k in range(n - 1, -1, -1)]


def _read_block(row, order: int, shards: int, hot: np.ndarray) -> Block:
    return Block(unpack(row.words, np.uint64), unpack(row.codes, np.uint32), np.asarray(row.lengths, np.int64), np.asarray(row.train, bool), order, shards, hot)


def messages(blocks: DataFrame, order: int, shards: int, hot: np.ndarray) -> DataFrame:
    """For each block and shard: word hashes, n-grams as places among them, and training counts."""
    levels = [f"{kind}{n}" for n in range(2, order + 1) for kind in "gc"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                b = _read_block(row, order, shards, hot)
                cuts = {n: np.searchsorted(place[by], np.arange(shards + 1)) for n, (_, place, by) in b.grams.items()}
                out = []
                for s in range(shards):
                    parts, seen = {}, []
                    for n, (grams, _, by) in b.grams.items():
                        own = by[cuts[n][s] : cuts[n][s + 1]]
                        parts[n] = (b.columns(n, grams[own]), b.counts[n][own])
                        seen += parts[n][0]
                    if not len(seen[0]):
                        continue
                    local = np.unique(np.concatenate(seen))
                    firsts = np.unique(parts[2][0][0])
                    firsts = firsts[~b.hot[firsts]]
                    one = [int(row.block), s, pack(b.words[local]), pack(np.searchsorted(local, firsts).astype(np.uint32)), pack(b.counts1[firsts])]
                    for n in range(2, order + 1):
                        one += [pack(np.searchsorted(local, np.concatenate(parts[n][0])).astype(np.uint32)), pack(parts[n][1])]
                    out.append(one)
                yield pd.DataFrame(out, columns=["block", "shard", "words", "firsts", "c1", *levels])

    schema = "block long, shard int, words binary, firsts binary, c1 binary, " + ", ".join(f"{c} binary" for c in levels)
    return blocks.select("block", "words", "codes", "lengths", "train").mapInPandas(run, schema)


def build_trie(words: np.ndarray, grams: dict[int, list[np.ndarray]], counts: dict[int, np.ndarray], discount: float = DISCOUNT, split: np.ndarray | None = None, split_totals: np.ndarray | None = None) -> bytes:
    """One buffer for a shard. words: sorted hashes; grams: columns of places among them; counts: in training; split:
    places of words that other shards hold too, and how often they occur in all."""
    size = np.uint64(max(len(words), 1))
    arrays: list[np.ndarray] = [np.array([len(grams), len(words)], np.uint64), *EliasFano.encode(words).sections()]
    parents = np.arange(len(words), dtype=np.uint64)  # the value that names each node of the level above
    place_of = {1: None}
    for n in sorted(grams):
        columns, c = grams[n], counts[n]
        if n + 1 in grams:  # contexts of the next level that are no n-gram themselves, as the start of a text, count nothing
            longer = grams[n + 1]
            columns = [np.concatenate([columns[k], longer[k]]) for k in range(n)]
            c = np.concatenate([c, np.zeros(len(longer[0]), c.dtype)])
        above = columns[0].astype(np.uint64)
        for k in range(1, n - 1):  # walk down to the parent's place
            above = np.searchsorted(place_of[k + 1], above * size + columns[k].astype(np.uint64)).astype(np.uint64)
        value = above * size + columns[-1].astype(np.uint64)
        order = np.argsort(value, kind="stable")
        value, weight = value[order], c[order].astype(np.float64)
        heads = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        value, weight = value[heads], np.add.reduceat(weight, heads) if len(heads) else weight
        context = (value // size).astype(np.int64)
        total = np.bincount(context, weight, minlength=len(parents))
        if n == 2 and split is not None:
            total[split] = split_totals
        kinds = np.bincount(context, weight > 0, minlength=len(parents))
        pointers = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=len(parents)))]).astype(np.uint64)
        mass = np.maximum(weight - discount, 0) / np.maximum(total[context], 1)
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        arrays += [*EliasFano.encode(pointers).sections(), *EliasFano.encode(value).sections(), quantise(mass), quantise(back)]
        parents, place_of[n] = value, value
    return to_buffer(arrays)


class Trie:
    """A shard read through a memory map."""

    def __init__(self, data: bytes):
        parts = from_buffer(data)
        levels, self.size = (int(x) for x in parts[0])
        self.words, at, self.levels = EliasFano.of_sections(parts[1:5]), 5, {}
        for n in range(2, levels + 2):
            self.levels[n] = (EliasFano.of_sections(parts[at : at + 4]), EliasFano.of_sections(parts[at + 4 : at + 8]), parts[at + 8], parts[at + 9])
            at += 10

    def successor(self, n: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place in level n of the successor ``word`` of each parent, or -1: a search in the parent's range."""
        pointers, values, _, _ = self.levels[n]
        out = np.full(len(parent), -1, np.int64)
        asked = np.flatnonzero((parent >= 0) & (word >= 0))
        begin, end = pointers[parent[asked]].astype(np.int64), pointers[parent[asked] + 1].astype(np.int64)
        asked, begin, end = asked[end > begin], begin[end > begin], end[end > begin]
        want = parent[asked].astype(np.uint64) * np.uint64(self.size) + word[asked].astype(np.uint64)
        at = values.next_at_least(want)
        inside = (at >= begin) & (at < end)
        hit = np.flatnonzero(inside)
        hit = hit[values[at[hit]] == want[hit]]
        out[asked[hit]] = at[hit]
        return out

    def look_up(self, n: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """8-bit discounted probability and back-off mass of n-grams given as places of words (-1: unknown)."""
        parent = columns[0]
        for k in range(1, n - 1):
            parent = self.successor(k + 1, parent, columns[k])
        at = self.successor(n, parent, columns[n - 1])
        _, _, mass, back = self.levels[n]
        return np.where(at >= 0, mass[at] if len(mass) else 0, 0).astype(np.uint8), np.where(parent >= 0, back[parent] if len(back) else 255, 255).astype(np.uint8)


def _shard_answers(frame: pd.DataFrame, order: int, discount: float, hot: np.ndarray, hot_counts: np.ndarray) -> pd.DataFrame:
    """Merges the messages of one shard, builds its trie and answers each message in its own order."""
    frame = frame.sort_values("block")
    read = []
    for row in frame.itertuples(index=False):
        words, grams, counts = unpack(row.words, np.uint64), {}, {}
        for n in range(2, order + 1):
            grams[n] = unpack(getattr(row, f"g{n}"), np.uint32).reshape(n, -1).astype(np.int64)
            counts[n] = unpack(getattr(row, f"c{n}"), np.uint32)
        read.append((row.block, words, unpack(row.firsts, np.uint32), unpack(row.c1, np.uint32), grams, counts))
    known, grams, counts = [], {n: [] for n in range(2, order + 1)}, {n: [] for n in range(2, order + 1)}
    for _, words, _, _, g, c in read:
        used = np.zeros(len(words), bool)
        for n in g:
            used[g[n][:, c[n] > 0].reshape(-1)] = True
        known.append(words[used])
    vocabulary = np.unique(np.concatenate(known))
    firsts = np.unique(np.concatenate([w[f] for _, w, f, _, _, _ in read]))
    totals = np.zeros(len(firsts), np.int64)
    for _, words, first, c1, g, c in read:
        np.add.at(totals, np.searchsorted(firsts, words[first]), c1)
        place = np.searchsorted(vocabulary, words)
        for n in g:
            seen = c[n] > 0
            grams[n].append(place[g[n][:, seen]])
            counts[n].append(c[n][seen])
    grams = {n: list(np.concatenate(grams[n], axis=1)) for n in grams}
    here = np.flatnonzero(np.isin(hot, vocabulary))
    split = np.searchsorted(vocabulary, hot[here])
    kinds = np.zeros(len(hot), np.uint32)
    if len(here):  # distinct successors here of words that are split among the shards
        pairs = np.unique(grams[2][0].astype(np.uint64) * np.uint64(len(vocabulary)) + grams[2][1].astype(np.uint64)) // np.uint64(len(vocabulary))
        kinds[here] = np.bincount(pairs.astype(np.int64), minlength=len(vocabulary))[split]
    trie = Trie(build_trie(vocabulary, grams, {n: np.concatenate(counts[n]) for n in counts}, discount, split, hot_counts[here]))
    sums = [int(totals.sum()), int((totals > 0).sum())]
    out = []
    for block, words, first, _, g, _ in read:
        ids = trie.words.find(words)
        one = [block, int(frame.shard.iloc[0]), *sums, b"" if out else pack(kinds), pack(totals[np.searchsorted(firsts, words[first])].astype(np.uint64))]
        for n in g:
            one += [pack(x) for x in trie.look_up(n, [ids[col] for col in g[n]])]
        out.append(one)
    return pd.DataFrame(out, columns=["block", "shard", "tokens", "types", "kinds", "c1", *[f"{k}{n}" for n in range(2, order + 1) for k in "pb"]])


def _block_scores(block: pd.DataFrame, answers: pd.DataFrame, order: int, shards: int, tokens: int, types: int, hot: np.ndarray, hot_counts: np.ndarray, hot_back: np.ndarray) -> pd.DataFrame:
    row = next(block.itertuples(index=False))
    b = _read_block(row, order, shards, hot)
    answers = answers.sort_values("shard")
    counts = np.zeros(len(b.words), np.float64)
    firsts = np.unique(b.columns(2, b.grams[2][0])[0])
    firsts = firsts[~b.hot[firsts]]
    firsts = firsts[np.argsort(b.shard[firsts], kind="stable")]
    counts[firsts] = np.concatenate([unpack(x, np.uint64) for x in answers.c1])
    frequent = np.searchsorted(hot, b.words[b.hot])
    counts[b.hot] = hot_counts[frequent]
    wide = np.zeros(len(b.words))
    wide[b.hot] = hot_back[frequent]
    single = (counts + 0.5) / (tokens + 0.5 * (types + 1))
    p = single[row_codes := b.codes.astype(np.int64)]
    base = np.log10(p)
    for n in range(2, order + 1):
        grams, _, by = b.grams[n]
        mass, back = np.empty(len(grams)), np.empty(len(grams))
        mass[by] = LEVELS[np.concatenate([unpack(x, np.uint8) for x in answers[f"p{n}"]])]
        back[by] = LEVELS[np.concatenate([unpack(x, np.uint8) for x in answers[f"b{n}"]])]
        if n == 2:
            lead = b.columns(2, grams)[0]
            back = np.where(b.hot[lead], wide[lead], back)
        at = np.searchsorted(grams, b.keys[n])
        p = mass[at] + back[at] * p
    starts = np.cumsum(b.lengths) - b.lengths
    known = np.add.reduceat((counts[row_codes] > 0).astype(np.int64), starts)
    return pd.DataFrame({
        "doc_id": pd.array(np.array(row.ids, dtype=object), dtype="Int64"),
        "train": np.asarray(row.train, bool),
        "n_tokens": b.lengths,
        "n_known": known,
        "base_score": np.add.reduceat(base, starts),
        "score": np.add.reduceat(np.log10(p), starts),
    })


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, discount: float = DISCOUNT, shards: int | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """A row for each text: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (both log10).

    train: whether a row is learnt from; order: 2 or 3; hot_share: words as frequent are split among the shards, which
    leaves the scores as they are.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    blocks = cut(token_blocks(docs, id_col, text_col, train, hot_share), "lm-blocks")
    # The share of a shard stays the same however large the table is.
    shards = shards or max(partitions(docs.sparkSession), math.ceil(blocks.count() * BLOCK_TOKENS / 2 / SHARD_TOKENS))
    hot, hot_counts = frequent_words(blocks, hot_share)
    answer_schema = "block long, shard int, tokens long, types long, kinds binary, c1 binary, " + ", ".join(f"{k}{n} binary" for n in range(2, order + 1) for k in "pb")
    sent = messages(blocks, order, shards, hot)
    answers = cut(sent.groupBy("shard").applyInPandas(lambda frame: _shard_answers(frame, order, discount, hot, hot_counts), answer_schema), "lm-answers")
    per_shard = answers.groupBy("shard").agg(F.first("tokens").alias("tokens"), F.first("types").alias("types"))
    tokens, types = (int(x or 0) for x in per_shard.agg(F.sum("tokens"), F.sum("types")).first())
    tokens, types = tokens + int(hot_counts.sum()), types + int((hot_counts > 0).sum())
    hot_back = _hot_back(answers, hot_counts, discount)
    scored = (
        blocks.select("block", "ids", "train", "lengths", "words", "codes")
        .groupBy("block")
        .cogroup(answers.drop("kinds").groupBy("block"))
        .applyInPandas(lambda b, a: _block_scores(b, a, order, shards, tokens, types, hot, hot_counts, hot_back), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _hot_back(answers: DataFrame, hot_counts: np.ndarray, discount: float) -> np.ndarray:
    """Back-off masses of the frequent words, from their distinct successors summed over the shards; in 8 bits."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = np.zeros(len(hot_counts), np.int64)
            for data in frame.kinds:
                total += unpack(data, np.uint32)
            yield pd.DataFrame({"i": np.arange(len(total)), "n": total})

    kinds = np.zeros(len(hot_counts), np.int64)
    if len(kinds):
        for r in answers.where(F.length("kinds") > 0).select("kinds").mapInPandas(add, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            kinds[r.i] = r.n
    return LEVELS[quantise(np.where(hot_counts > 0, discount * kinds / np.maximum(hot_counts, 1), 1.0))]
