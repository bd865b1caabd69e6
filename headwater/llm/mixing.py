"""Document rates that bring the token totals of domains to target weights.

A classifier learns domains from labelled rows and gives each text a soft membership, the posterior of each
domain. Rates r >= 0 minimise the squared error between expected totals S_k = sum r * tokens * P(k | text)
and targets T_k, each error weighted by 1/m_k with m_k the expected total at rate 1. The minimum is sought by
projected gradient from r = 1; the step for a text is scaled by 1 / tokens, so that it is
  r <- max(0, r - step * sum_k P(k | text) * (S_k - T_k) / m_k).
As the steps depend on the data only through the few totals S, a text's rate is a fold over their history, and no
state of the texts is kept. The steps are sought on a table of cells: texts whose posteriors round to the same point
of a grid, with their tokens and mean posterior, added up in one aggregation; the grid has about ``MOST_CELLS`` points
at most, whatever the size of the table. Then one pass over all texts adds up the exact totals under these steps. If
they miss the targets by more than ``TOLERANCE`` of all tokens, the goals move by what is missing and steps are added,
at most ``PASSES`` times. The largest miss that is left, as a share of all tokens, is returned with each row as
``residual``: targets that no rates reach (a domain that nobody belongs to) show there.

Classifier: multinomial logistic regression on the shares of hashed byte trigrams of a text.
Bound: it is fitted on at most ``max_rows`` labelled rows, taken in the order of a hash of the id; texts are
scored whole. Tokens are words as everywhere here.

Defined cases: null and empty texts have no tokens, the posterior of the intercepts and a rate that follows
from it; rows with a null id or domain teach nothing; an id with several domains takes the smallest; with one
labelled domain or none all texts belong to it (or to ``unknown``); domains without a target get their share
at rate 1; targets of domains that nobody belongs to are left aside and the others scaled up; repeated rows
count each; an empty table gives an empty result; clashing names of other columns get a leading underscore.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, cut, one_text_an_id, reserved, small_batches

MAX_ROWS = 2000
BUCKETS = 1 << 14
STEP = 1.0
#: Steps at most on the cells in one go; they cost no pass over the texts.
ROUNDS = 400
PASSES = 5
MOST_CELLS = 50_000
TOLERANCE = 1e-4


def trigrams(text: bytes | None) -> np.ndarray:
    """Bucket of each byte trigram; A-Z count as a-z."""
    raw = np.frombuffer(text.lower(), np.uint8).astype(np.uint32) if text else np.zeros(0, np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    key = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - 14)


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # buckets x domains
    bias: np.ndarray

    def posteriors(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.empty((len(texts), len(self.domains)))
        for i, text in enumerate(texts):
            at = trigrams(text)
            out[i] = self.bias + (self.weights[at].mean(axis=0, dtype=np.float64) if len(at) else 0)
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train(rows: list[tuple[bytes, str]], steps: int = 150, rate: float = 3.0, decay: float = 1e-6) -> Classifier:
    domains = sorted({d for _, d in rows}) or ["unknown"]
    if len(domains) == 1:
        return Classifier(domains, np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (text, _) in enumerate(rows):
        at = trigrams(text)
        if len(at):
            x[i] = np.bincount(at, minlength=BUCKETS) / len(at)
    y = np.zeros((len(rows), len(domains)), np.float32)
    y[np.arange(len(rows)), [domains.index(d) for _, d in rows]] = 1
    w, b = np.zeros((BUCKETS, len(domains)), np.float32), np.log(y.mean(axis=0))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - y) / len(rows)
        g = x.T @ error + np.float32(decay) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        b = b - 0.5 * error.sum(axis=0)
    return Classifier(domains, w, b)


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_ROWS) -> Classifier:
    """labelled: ids with their domain. Of an id on several rows of ``docs`` one text is learnt from."""
    sample = (
        labelled.select(F.col(id_col).cast("long").alias("_id"), F.col(domain_col).cast("string").alias("_domain"))
        .where("_id is not null and _domain is not null")
        .groupBy("_id")
        .agg(F.min("_domain").alias("_domain"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = one_text_an_id(texts.join(F.broadcast(sample), "_id"), "_domain")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), as_bytes(b.column(2)), b.column(1).to_pylist(), strict=True))
        model = train([(t, d) for _, t, d in found])
        columns = [pa.array([model.domains]), pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([model.bias.astype(np.float64).tolist()])]
        yield pa.RecordBatch.from_arrays(columns, ["domains", "weights", "bias"])

    # The sample has max_rows rows at most, so one task holds it; the driver gets the weights only.
    got = rows.repartition(1).mapInArrow(learn, "domains array<string>, weights binary, bias array<double>").first()
    if got is None:  # nothing to learn from, and Spark saw it
        return train([])
    return Classifier(list(got.domains), np.frombuffer(got.weights, np.float32).reshape(BUCKETS, -1), np.array(got.bias))


def _rates(p: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Folds the steps; ``history`` holds step * (S - T) / m of each round."""
    r = np.ones(len(p))
    for g in history:
        r = np.maximum(0, r - p @ g)
    return r


def grid_of(k: int) -> int:
    """The finest grid on which ``MOST_CELLS`` points or fewer have coordinates that add up."""
    g = 1
    while g < 1000 and math.comb(g + k, k - 1) <= MOST_CELLS:
        g += 1
    return g


def descend(p: np.ndarray, tokens: np.ndarray, r: np.ndarray, mass: np.ndarray, goal: np.ndarray, there: np.ndarray, step: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(steps, rates) of projected gradient on rows of posteriors and tokens, from rates ``r`` on."""
    history = []
    for _ in range(rounds):
        error = np.where(there, (tokens * r) @ p - goal, 0)
        if np.abs(error).max(initial=0) <= tolerance:
            break
        history.append(step * error / np.maximum(mass, 1e-300))
        r = np.maximum(0, r - p @ history[-1])
    return np.array(history).reshape(-1, p.shape[1]), r


def solve(members: DataFrame, domains: list[str], targets: dict[str, float] | None, step: float = STEP, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(the history of steps, the residual) for (tokens, posterior); ``targets``: weights of domains, any scale."""
    k, grid = len(domains), grid_of(len(domains))

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
        return n, np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = read(batch)
            at, inverse = np.unique(np.rint(p * grid).astype(np.int16), axis=0, return_inverse=True)
            total = np.zeros((len(at), k))
            np.add.at(total, inverse.reshape(-1), n[:, None] * p)
            cell = pa.array([row.tobytes() for row in at for _ in range(k)], pa.binary())
            yield pa.RecordBatch.from_arrays([cell, pa.array(np.tile(np.arange(k), len(at))), pa.array(total.reshape(-1))], ["cell", "k", "s"])

    def sums(history: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                n, p = read(batch)
                total += (n * _rates(p, history)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["k", "s"])

        got = members.select("tokens", "posterior").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))
        out = np.zeros(k)
        for r in got.collect():
            out[r.k] = r.s
        return out

    cells: dict[bytes, np.ndarray] = {}
    for r in members.select("tokens", "posterior").mapInArrow(compress, "cell binary, k long, s double").groupBy("cell", "k").agg(F.sum("s").alias("s")).collect():
        cells.setdefault(bytes(r.cell), np.zeros(k))[r.k] = r.s
    parts = np.array([cells[c] for c in sorted(cells)]).reshape(-1, k)
    tokens = parts.sum(axis=1)
    p = parts / np.maximum(tokens, 1e-300)[:, None]
    mass = parts.sum(axis=0)
    whole = max(mass.sum(), 1.0)
    there = mass > 1e-9 * whole
    want = np.array([(targets or {}).get(d, np.nan) for d in domains], float) if targets else np.where(there, 1.0, 0.0)
    free = np.isnan(want)
    want = np.where(there & ~free, want, 0.0)
    given = mass.sum() - mass[free].sum()
    goal = np.where(free, mass, want / max(want.sum(), 1e-300) * given)
    history, r, aim, miss = np.zeros((0, k)), np.ones(len(p)), goal.copy(), np.inf
    for _ in range(PASSES):
        more, r = descend(p, tokens, r, mass, aim, there, step, rounds, tolerance * whole / 4)
        longer = np.vstack([history, more])
        error = np.where(there, goal - sums(longer), 0)
        if np.abs(error).max(initial=0) >= miss:
            break  # no better than before: the targets are out of reach
        history, miss = longer, np.abs(error).max(initial=0)
        if miss <= tolerance * whole or not len(more):
            break
        aim = aim + error
    return history, float(miss / whole)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", max_rows: int = MAX_ROWS) -> DataFrame:
    """All columns of ``docs``, then tokens, domain (the likeliest), posterior (in order of domains), rate and residual.

    targets: weights of domains; none means the same weight for each.
    """
    model = fit_classifier(docs, labelled, id_col, text_col, domain_col, max_rows)
    own = reserved(docs, "tokens", "domain", "posterior", "rate", "residual")
    place = docs.columns.index(text_col)
    types = [("tokens", T.LongType()), ("domain", T.StringType()), ("posterior", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(own[n], t) for n, t in types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = as_bytes(batch.column(place))
            p = model.posteriors(texts)
            tokens = pa.array([len(t.split()) if t else 0 for t in texts], pa.int64())
            domain = pa.array([model.domains[i] for i in p.argmax(axis=1)])
            columns = [*batch.columns, tokens, domain, pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, own["tokens"], own["domain"], own["posterior"]])

    members = cut(docs.mapInArrow(run, schema), "mix-members")
    history, residual = solve(members.select(F.col(own["tokens"]).alias("tokens"), F.col(own["posterior"]).alias("posterior")), model.domains, targets)
    k, at = len(model.domains), members.columns.index(own["posterior"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(at).flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(p, history))], [*batch.schema.names, own["rate"]])

    rated = members.mapInArrow(add, T.StructType([*schema.fields, T.StructField(own["rate"], T.DoubleType())]))
    return rated.withColumn(own["residual"], F.lit(residual))
