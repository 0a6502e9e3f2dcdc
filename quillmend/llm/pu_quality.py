"""Quality from positives and unlabelled text: non-negative unbiased risk.

A linear model over the shape of a text is fitted with trusted positives P, unlabelled texts U and
the share of good texts among U (the prior). With the logistic loss l, the risk is
    prior * E_P l(f) + max(0, E_U l(-f) - prior * E_P l(-f)):
what would make the second part negative is overfitting, and steps go back on it. No negative label
is used. The prior is estimated from P and U: a first model tells P from U, and over all cuts of its
score, the least ratio of the texts of U above the cut to those of P above it bounds the share; the
cut is taken where that ratio with its confidence margin is least (best bin estimation).

Features: square roots of the frequencies of pairs of character classes, and how often words repeat
(next to each other, in the whole text). All are ratios, so that long texts weigh like short ones.

The fit uses at most ``max_positive`` labelled and ``max_unlabelled`` unlabelled rows, those with the
smallest hash of their id; their ids are broadcast. Scoring covers every whole text.

Defined cases: null texts are empty; an empty text has the score of zero features. Rows with a null
label or id teach nothing; an id labelled twice has its least label. Without positives or unlabelled
texts all scores are 0.5. Other columns are kept; ``score`` replaces a column of that name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmend.llm.common import one_row, word_hashes

MAX_POSITIVE = 10_000
MAX_UNLABELLED = 20_000
SLICE_ROWS = 500


def _classes() -> np.ndarray:
    """Bytes to classes: lower and upper letters, digits, blanks, line ends, each ASCII sign, the
    rest of ASCII, and the bytes of other scripts."""
    out = np.zeros(256, np.int64)
    for kind, chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t", "\r\n",
                                  *string.punctuation), 1):
        out[[ord(c) for c in chars]] = kind
    out[128:] = out.max() + 1
    return out


CLASSES = _classes()
KINDS = int(CLASSES.max()) + 1
WIDTH = KINDS * KINDS + 6


def features(texts: list[str]) -> np.ndarray:
    """One row of WIDTH numbers, all from 0 to about 1, for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    blanks = bytes.maketrans(b"\t\r\n", b"   ")
    for k, text in enumerate(texts):
        data = text.encode()
        if not data:
            continue
        kinds = CLASSES[np.frombuffer(data, np.uint8)]
        if len(kinds) > 1:
            pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
            out[k, :KINDS * KINDS] = np.sqrt(pairs / (len(kinds) - 1))
        words, _ = word_hashes(data.lower().translate(blanks))
        n = len(words)
        counts = np.unique(words, return_counts=True)[1]
        out[k, KINDS * KINDS:] = (
            (words[1:] == words[:-1]).mean() if n > 1 else 0,
            len(counts) / n,
            (counts * (counts - 1.0)).sum() / max(1, n * (n - 1.0)),
            min(1.0, len(counts) / np.sqrt(n) / 10),
            np.log1p(n) / 12,
            min(1.0, len(data) / n / 20))
    return out


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float


def _risk_steps(p: np.ndarray, u: np.ndarray, scale: np.ndarray, prior: float, *, non_negative: bool, steps: int,
                seed: int, rate: float = 0.01, penalty: float = 1e-4, batch: int = 1000):
    """Weights (the last one is the bias) that minimise the risk, by Adam over shuffled batches. Only
    the rows of a batch are scaled at a time."""
    rng = np.random.default_rng(seed)
    w = np.zeros(p.shape[1] + 1, np.float32)
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    parts = max(1, -(-max(len(p), len(u)) // batch))
    epochs = max(2, -(-steps // parts))
    average, averaged = np.zeros_like(w), 0
    for epoch in range(epochs):
        for rows_p, rows_u in zip(np.array_split(rng.permutation(max(len(p), parts)) % len(p), parts),
                                  np.array_split(rng.permutation(max(len(u), parts)) % len(u), parts)):
            xp, xu = p[rows_p] / scale, u[rows_u] / scale
            zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            loss_p, loss_u = logistic(zp), logistic(zu)
            gain_p = loss_p - 1
            as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

            def slope(x, g):
                return np.append(x.T @ g, g.sum()) / len(x)

            negative = slope(xu, loss_u) - prior * slope(xp, loss_p)
            grad = -negative if non_negative and as_negative < 0 else prior * slope(xp, gain_p) + negative
            grad[:-1] += penalty * w[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad * grad
            w = w - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
            if epoch >= epochs // 2:
                average, averaged = average + w, averaged + 1
    return average / averaged if averaged else w


def estimate_prior(p: np.ndarray, u: np.ndarray, *, margin: float = 0.01, doubt: float = 0.1, epochs: int = 20) -> float:
    """The share of good texts in ``u``. The model that tells P from U is fitted to one half of
    both; the ratio of shares above a cut is read on the other half."""
    a, b = slice(0, None, 2), slice(1, None, 2)
    if min(len(p), len(u)) < 4:
        return 0.5
    both = np.concatenate((np.ones(len(p[a])), np.zeros(len(u[a]))))
    x = np.concatenate((p[a], u[a]))
    centre, deviation = moments(x)
    scale = np.maximum(deviation, 1e-2) * np.sqrt(x.shape[1])
    w = _telling(x, centre, scale, both, epochs)
    sp, su = (np.sort(np.concatenate([((y[k:k + 1000] - centre) / scale) @ w[:-1] for k in range(0, len(y), 1000)]))
              for y in (p[b], u[b]))
    cuts = np.unique(np.concatenate((sp, su)))
    qp = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    qu = 1 - np.searchsorted(su, cuts, "left") / len(su)
    ok = qp > 0
    noise = np.sqrt(np.log(4 / doubt) / 2 / len(su)) + np.sqrt(np.log(4 / doubt) / 2 / len(sp))
    bound = (qu[ok] + (1 + margin) * noise) / qp[ok]
    at = int(bound.argmin())
    return float(np.clip(qu[ok][at] / qp[ok][at], 0.02, 0.98))


def moments(*tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the columns of all tables together, 1000 rows at a time."""
    n = sum(len(t) for t in tables)
    parts = [t[k:k + 1000] for t in tables for k in range(0, len(t), 1000)]
    mean = sum(part.sum(0, dtype=np.float64) for part in parts) / n
    return mean, np.sqrt(sum(((part - mean) ** 2).sum(0) for part in parts) / n)


def _telling(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, y: np.ndarray, epochs: int) -> np.ndarray:
    rng = np.random.default_rng(1)
    w = np.zeros(x.shape[1] + 1)
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 1000)):
            part = (x[rows] - centre) / scale
            g = (logistic(part @ w[:-1] + w[-1]) - y[rows]) * weight[rows]
            grad = np.append(part.T @ g, g.sum()) / len(rows)
            grad[:-1] += 1e-3 * w[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad * grad
            w = w - 0.01 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w


def fit(p: np.ndarray, u: np.ndarray, *, prior: float | None = None, steps: int = 3000, seed: int = 7) -> Model:
    """Features of the positives and of the unlabelled to a model; half precision will do."""
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH), 0.0, 0.5)
    used = np.flatnonzero((p != 0).any(0) | (u != 0).any(0))  # features that no text has keep weight 0
    p, u = p[:, used], u[:, used]
    if prior is None:
        prior = estimate_prior(p, u)
    scale = np.maximum(moments(p, u)[1], 1e-2)
    w = _risk_steps(p, u, scale.astype(np.float32), prior, non_negative=True, steps=steps, seed=seed)
    weights = np.zeros(WIDTH)
    weights[used] = w[:-1] / scale
    return Model(weights, float(w[-1]), prior)


def _sample(ids: DataFrame, bound: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality",
          id_column: str = "doc_id", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
          prior: float | None = None) -> Model:
    """Fit to documents that ``labels`` marks as good and to documents it does not mark as good."""
    good = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(id_column).alias("_id")).agg(F.min(label).alias("_label")).where("_label = 1").select("_id")
    ids = docs.select(F.col(id_column).alias("_id")).where("_id is not null")
    # Both samples are bounded by their limits; a document may be in both.
    chosen = (_sample(good, max_positive).withColumn("_kind", F.lit(1))
              .unionByName(_sample(ids, max_unlabelled).distinct().withColumn("_kind", F.lit(0))))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    # Of documents that share an id, one: what reaches the driver is bounded by the samples.
    rows = one_row(rows, "_id", "_kind", text="_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_kind"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())],
                names=["_id", "_kind", "_x"])

    rows = rows.withColumn("_id", F.xxhash64("_id"))
    got = rows.mapInArrow(run, "_id long, _kind int, _x binary").toArrow()
    kinds, order = got.column("_kind").to_numpy(), np.argsort(got.column("_id").to_numpy(), kind="stable")
    # Each row goes to its place of its sample at once, out of the buffers that came.
    place = np.empty(len(order), np.int64)
    for kind in (0, 1):
        own = order[kinds[order] == kind]
        place[own] = np.arange(len(own))
    samples = [np.empty((int((kinds == kind).sum()), WIDTH), np.float16) for kind in (0, 1)]
    chunks, filled = got.column("_x").chunks, 0
    del got
    while chunks:
        part = chunks.pop(0)
        held = np.frombuffer(part.buffers()[2], np.float16) if len(part) else np.empty(0, np.float16)
        begin = np.frombuffer(part.buffers()[1], np.int32)[part.offset] // 2 if len(part) else 0
        rows_here = held[begin:begin + len(part) * WIDTH].reshape(-1, WIDTH)
        for kind in (0, 1):
            mine = np.flatnonzero(kinds[filled:filled + len(part)] == kind)
            samples[kind][place[filled + mine]] = rows_here[mine]
        filled += len(part)
        del part, held, rows_here
    pa.default_memory_pool().release_unused()
    # Handed over: nothing here keeps them.
    return fit(samples.pop(), samples.pop(), prior=prior)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of good quality of each whole text."""
    kept = [c for c in docs.columns if c != "score"]
    source = docs.select(*kept) if text in kept else docs.select(*kept, F.col(text).alias("_text"))
    read = text if text in kept else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(k, SLICE_ROWS)
                x = features([t or "" for t in batch.column(read).to_pylist()])
                values = logistic(x @ model.weights + model.bias)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(values, pa.float64())], names=[*kept, "score"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)
