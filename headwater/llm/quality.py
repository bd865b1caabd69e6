"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the rows labelled good; unlabelled rows are all web text, of either kind. With the class
prior p the risk of a scorer f is p*R+(positives) + max(0, R-(unlabelled) - p*R-(positives)), with the squared
losses (f - 1)^2 and (f + 1)^2; (f + 1) / 2, kept within 0 and 1, estimates the probability of a good text. The scorer
is additive: each of the text statistics below is cut into bins at quantiles of the unlabelled rows, and each bin
has a weight. Under that loss the risk depends on the rows through the means and the second moments of their bins
alone, so all unlabelled rows count, in one aggregation whose size is that of the bins, and the minimum is found from
these moments: the unbiased minimum where its second part is not negative, else by descent on the first part and
ascent on the second wherever that is negative, as the estimator's authors do.

Prior: estimated from positives and unlabelled rows alone. Among rows that score highest, the unlabelled share is at
least p times that of positives, so the least ratio of the two over the upper parts of the scores estimates p. No
label but 1 is used.

Bound: at most ``max_rows`` labelled positives are used, in the order of a hash of the id. All rows are scored, on
whole texts.

Defined cases: null and empty texts have all statistics zero and are scored like any other text; rows with
a null id or label teach nothing as positives; if an id has several labels the largest holds; repeated rows count
each; with no positives every score is the prior given or 0.5; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, small_batches

MAX_ROWS = 10000
BINS = 16
_KINDS = 9


def _byte_kinds() -> np.ndarray:
    """For each byte value the indicator of its kinds."""
    out = np.zeros((256, _KINDS))
    groups = [range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n", b".,;:", b"!?", b"|<>{}[]#$%&*@=^~\\_+", range(128, 256)]
    for k, group in enumerate(groups):
        out[list(group), k] = 1
    return out


_TABLE = _byte_kinds()
N_FEATURES = _KINDS + 9


def statistics(text: bytes | None) -> np.ndarray:
    """Shares of kinds of bytes, and measures of words, lines and repetition."""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    raw = np.frombuffer(text, np.uint8)
    out[:_KINDS] = np.bincount(raw, minlength=256) @ _TABLE / len(raw)
    n, distinct = len(words), len(set(words))
    lines = text.split(b"\n")
    kinds = len(set(lines))
    lengths = np.fromiter(map(len, words), np.int64, n)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    out[_KINDS:] = (
        np.log1p(n),
        np.log(distinct) / np.log(n) if n > 1 else 1.0,
        repeats / n,
        lengths.mean(),
        lengths.std(),
        n / len(lines),
        kinds / len(lines),
        np.isin(ends, np.frombuffer(b"#$%&*@|!", np.uint8)).mean(),
        (lengths == 1).mean(),
    )
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features): the statistics as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [statistics(t).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "features"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, features binary")


@dataclass
class Model:
    """``edges``: for each statistic the upper bounds of its bins; ``weights``: a weight for each bin."""

    prior: float
    edges: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """From about -1 to about 1."""
        if self.weights is None:
            return np.full(len(x), 2 * self.prior - 1)
        return self.bias + self.weights.reshape(-1)[_bins(x, self.edges)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self.raw(x) + 1) / 2, 0, 1)


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    columns = [np.searchsorted(edges[k], x[:, k], side="left") + k * BINS for k in range(x.shape[1])]
    return np.stack(columns, axis=1)


@dataclass
class Moments:
    """Rows, and the sums of x xT, of positives and of unlabelled rows; x holds the bins of a row and a one."""

    positives: float
    unlabelled: float
    of_positives: np.ndarray
    of_unlabelled: np.ndarray


def moments_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of x xT over rows."""
    size = x.shape[1] * BINS + 1
    out = np.zeros((size, size))
    for start in range(0, len(x), 4096):
        bins = _bins(x[start : start + 4096], edges)
        hot = np.zeros((len(bins), size))
        hot[np.arange(len(bins))[:, None], bins] = 1
        hot[:, -1] = 1
        out += hot.T @ hot
    return out


def risk_parts(w: np.ndarray, m: Moments, prior: float) -> tuple[float, float]:
    """(p*R+, R- of unlabelled rows less p*R- of positives)."""
    mean_p, mean_u = m.of_positives[-1] / m.positives, m.of_unlabelled[-1] / m.unlabelled
    square_p, square_u = w @ m.of_positives @ w / m.positives, w @ m.of_unlabelled @ w / m.unlabelled
    return prior * (square_p - 2 * w @ mean_p + 1), square_u + 2 * w @ mean_u + 1 - prior * (square_p + 2 * w @ mean_p + 1)


def minimise(m: Moments, prior: float, decay: float = 1e-3, steps: int = 3000) -> np.ndarray:
    """Weights of the least non-negative risk plus ``decay`` times their squares (the last weight is free)."""
    ridge = np.full(len(m.of_positives), decay)
    ridge[-1] = 1e-9
    a_u, a_p = m.of_unlabelled / m.unlabelled, m.of_positives / m.positives
    w = np.linalg.solve(a_u + np.diag(ridge), 2 * prior * a_p[-1] - a_u[-1])
    if risk_parts(w, m, prior)[1] >= 0:
        return w
    scale = np.linalg.inv(a_u + prior * a_p + np.diag(ridge))
    for _ in range(steps):
        toward = 2 * prior * (a_p @ w - a_p[-1])
        apart = 2 * (a_u @ w + a_u[-1]) - 2 * prior * (a_p @ w + a_p[-1])
        g = toward + apart + 2 * ridge * w if risk_parts(w, m, prior)[1] >= 0 else 2 * ridge * w - apart
        w = w - 0.05 * scale @ g
    return w


def model_of(w: np.ndarray, prior: float, edges: np.ndarray) -> Model:
    return Model(prior, edges, w[:-1].reshape(len(edges), BINS), float(w[-1]))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """From histograms of scores: the least ratio of upper parts that hold ``least`` of the positives or more."""
    up_p, up_u = np.cumsum(positive[::-1]) / positive.sum(), np.cumsum(unlabelled[::-1]) / unlabelled.sum()
    fit = up_p >= least
    return float(np.clip((up_u[fit] / up_p[fit]).min(), 0.01, 0.99))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES)


def _edges(rows: DataFrame) -> np.ndarray:
    """Bounds of the bins of each statistic, at quantiles of all rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(N_FEATURES, dtype=np.int32), len(x))), pa.array(x.reshape(-1))], ["k", "x"])

    at = [i / BINS for i in range(1, BINS)]
    got = rows.select("features").mapInArrow(spread, "k int, x float").groupBy("k").agg(F.percentile_approx("x", at, 10_000).alias("q")).collect()
    out = np.zeros((N_FEATURES, BINS - 1), np.float32)
    for r in got:
        out[r.k] = np.array(r.q, np.float32)
    return out


def _moments(rows: DataFrame, edges: np.ndarray) -> Moments:
    """rows: (features, positive); every row is an unlabelled one too."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = N_FEATURES * BINS + 1
        total = np.zeros((2, size, size))
        for batch in batches:
            x, positive = _matrix(batch.column(0)), np.asarray(batch.column(1).to_pylist(), bool)
            total[0] += moments_of(x[positive], edges)
            total[1] += moments_of(x, edges)
        kind, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((kind * size + i) * size + j), pa.array(total[kind, i, j])], ["at", "v"])

    size = N_FEATURES * BINS + 1
    # As many rows as there are pairs of bins, whatever the size of the table.
    got = rows.select("features", "positive").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(2 * size * size)
    flat[got.column(0).to_numpy()] = got.column(1).to_numpy()
    sums = flat.reshape(2, size, size)
    return Moments(sums[0, -1, -1], sums[1, -1, -1], sums[0], sums[1])


def _histograms(rows: DataFrame, model: Model, cells: int = 512) -> np.ndarray:
    """Counts of raw scores, of positives and of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells), np.int64)
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch.column(0))) + 2) / 4 * cells, 0, cells - 1).astype(np.int64)
            positive = np.asarray(batch.column(1).to_pylist(), bool)
            total += np.stack([np.bincount(at[positive], minlength=cells), np.bincount(at, minlength=cells)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * cells)), pa.array(total.reshape(-1))], ["at", "n"])

    got = rows.select("features", "positive").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * cells)
    for r in got:
        out[r["at"]] = r["n"]
    return out.reshape(2, cells)


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS, prior: float | None = None) -> Model:
    """rows: (doc_id, features) that may be learnt from; labels: the labels that may be learnt from."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where("_id is not null and _label is not null")
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    chosen = known.where("_label = 1").orderBy(F.xxhash64("_id"), "_id").limit(max_rows).select("_id")
    # max_rows ids at most
    marked = cut(rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left").select("features", F.col("_id").isNotNull().alias("positive")), "quality-marked")
    edges = _edges(marked)
    m = _moments(marked, edges)
    if not m.positives:
        return Model(0.5 if prior is None else prior)
    if prior is None:
        ranking = model_of(minimise(m, 0.5), 0.5, edges)
        prior = prior_of(*_histograms(marked, ranking))
    return model_of(minimise(m, prior), prior, edges)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return rows.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score). ``learn``: from an id column to whether its row may be learnt from."""
    rows = cut(features(docs, id_col, text_col), "quality")
    model = fit(rows.where(learn(F.col("doc_id"))), labels.where(learn(F.col(id_col))), id_col, label_col, max_rows)
    return score(rows, model)
