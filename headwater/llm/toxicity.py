"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the set of its words, its pairs of neighbouring words (n-grams) and its pairs one word
apart (skip-grams), each hashed to 32 bits. Words are lower-cased and freed of punctuation at their ends;
a word also counts by its first letters (``STEMS``), so that inflected forms share evidence. Features that
fewer than ``least_texts`` rows of the sample have are left out: they could only memorise those rows. Training is FTRL-proximal with per-coordinate rates and L1 and L2 penalties, so
that most weights are exactly zero; the rest, some thousand numbers, are what scoring ships to executors.

Bound: the model is fitted on at most ``max_rows`` labelled rows, taken in the order of a hash of the id
(the same rows on every run). Everything else runs over all rows and whole texts.

Defined cases: null and empty texts have no features and get the score of the bias alone; rows with a
null id or label teach nothing; if an id has several labels the largest holds; with no usable label
every score is 0.0; an empty table gives an empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, one_text_an_id, reserved, small_batches
from .tokens import coded_words, hash_all

MAX_ROWS = 6000
#: Tasks that make the features of the sample, whose size is bounded.
FIT_TASKS = 16
STEMS = (5, 7)
_SIEVE_BITS = 22
_ENDS = ".,;:!?\"'()[]{}<>|*#$%&"


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 8
    least_texts: int = 3


@dataclass
class Model:
    """Sorted feature hashes with their nonzero weights; ``trained`` is False if there were no labels."""

    bias: float = 0.0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    trained: bool = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(32)).astype(np.uint32)


def feature_families(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, owning row) of words, stems, neighbours and skip-grams; pairs never cross rows."""
    distinct, codes, lengths = coded_words(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    bare = [w.decode("utf-8", "replace").lower().strip(_ENDS) for w in distinct]
    hashes = hash_all([w.encode() for w in bare])[codes] if len(codes) else np.zeros(0, np.uint64)
    yield _mix(hashes), owner
    for size in STEMS:
        longer = np.fromiter((len(w) > size for w in bare), bool, len(bare))
        stems = hash_all([f"{size}:{w[:size]}".encode() for w in bare])
        if len(codes):
            has = longer[codes]
            yield _mix(stems[codes[has]]), owner[has]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(hashes) > gap:
            same = owner[gap:] == owner[:-gap]
            yield _mix(hashes[:-gap] * np.uint64(salt) + hashes[gap:])[same], owner[gap:][same]


def train(rows: list[tuple[np.ndarray, int]], how: Ftrl = Ftrl()) -> Model:
    """rows: the distinct features of a text and its label, in the order in which they are learnt."""
    if not rows:
        return Model()
    sizes = [len(f) for f, _ in rows]
    flat = np.concatenate([f for f, _ in rows])
    order = np.sort(flat)
    heads = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
    keys = order[heads][np.diff(np.append(heads, len(order))) >= how.least_texts]
    at = np.searchsorted(keys, flat)
    known = np.isin(flat, keys, assume_unique=False) if len(keys) else np.zeros(len(flat), bool)
    parts = np.split(np.stack([at.astype(np.int32), known], axis=1), np.cumsum(sizes)[:-1])
    index = [p[p[:, 1] == 1, 0] for p in parts]
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    bias, l1 = len(keys), np.full(len(keys) + 1, how.l1)
    l1[bias] = 0

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1[at], 0.0, -(own - np.sign(own) * l1[at]) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for own, (_, label) in zip(index, rows, strict=True):
            at = np.append(own, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(slice(None))
    keep = np.flatnonzero(w[:-1])
    return Model(float(w[bias]), keys[keep], w[keep].astype(np.float32), True)


def score_rows(texts: list[bytes | None], model: Model) -> np.ndarray:
    if not model.trained:
        return np.zeros(len(texts))
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[model.keys & np.uint32((1 << _SIEVE_BITS) - 1)] = True
    return _score(texts, model, sieve)


def _score(texts: list[bytes | None], model: Model, sieve: np.ndarray) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    for features, own in feature_families(texts):
        maybe = np.flatnonzero(sieve[features & np.uint32((1 << _SIEVE_BITS) - 1)])
        if not len(maybe):
            continue
        at = np.searchsorted(model.keys, features[maybe])
        at[at == len(model.keys)] = 0
        hit = model.keys[at] == features[maybe]
        pairs = np.unique((own[maybe][hit].astype(np.int64) << 32) | at[hit])  # a feature counts once in a text
        np.add.at(total, pairs >> 32, model.weights[pairs & 0xFFFFFFFF].astype(np.float64))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, how: Ftrl = Ftrl()) -> Model:
    """labels: the rows that may be learnt from. Of an id on several rows of ``docs`` one text is learnt from."""
    sample = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where("_id is not null and _label is not null")
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample has max_rows ids at most and one text of each, so its size is bounded whatever the tables hold.
    joined = one_text_an_id(texts.join(F.broadcast(sample), "_id"), "_label").repartition(FIT_TASKS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [np.unique((own << 32) | f.astype(np.int64)) for f, own in feature_families(as_bytes(batch.column(2)))]
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            cuts = np.searchsorted(pairs >> 32, np.arange(batch.num_rows + 1))
            low = (pairs & 0xFFFFFFFF).astype(np.uint32)
            sets = [low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["id", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += [(i, y, np.frombuffer(x, np.uint32)) for i, y, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        # By a hash of the id again, so that the order of learning does not depend on the plan.
        rows.sort(key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % 2**64, len(r[2]), r[2].tobytes()[:64]))
        model = train([(x, y) for _, y, x in rows], how)
        columns = [[model.bias], [model.keys.tobytes()], [model.weights.tobytes()], [model.trained]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bias", "keys", "weights", "trained"])

    # The sample is bounded, so one task holds it; the driver gets the sparse weights only.
    sets = joined.mapInArrow(features, "id long, label int, features binary").repartition(1)
    got = sets.mapInArrow(learn, "bias double, keys binary, weights binary, trained boolean").first()
    if got is None:  # nothing to learn from, and Spark saw it
        return Model()
    return Model(got.bias, np.frombuffer(got.keys, np.uint32), np.frombuffer(got.weights, np.float32), got.trained)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, a double from 0 to 1."""
    name = reserved(docs, out_col)[out_col]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[model.keys & np.uint32((1 << _SIEVE_BITS) - 1)] = True
        for batch in small_batches(batches):
            texts = as_bytes(batch.column(place))
            found = _score(texts, model, sieve) if model.trained else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
