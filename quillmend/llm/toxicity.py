"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, and each n-gram of its characters (white space counts as one blank) is a
feature that is there or not, hashed into a fixed number of cells. On the labelled texts the ratio
r of a cell is log((p + a) / |p|) - log((q + a) / |q|), p and q being the toxic and clean texts that
have it. A logistic regression is fitted to r times presence, over the cells whose
likelihood ratio is significant.

The fit uses at most ``max_labelled`` labelled rows (those with the smallest hash of their id); their
ids are few and known to be, so they are broadcast, and their texts are written once. Cells are counted
on the executors; the driver sees the FEATURES chosen ones at most. Scoring covers every whole text.

Defined cases: null texts are empty; an empty text gets the score of no features. Rows with a null
label or id teach nothing; an id labelled twice has its greatest label. Without labelled texts, or
with one class alone, all scores are the smoothed share of the toxic. Other columns are kept;
``score`` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmend.llm.common import one_row, stored

ORDERS = (3, 4, 5, 6)
CELLS = 1 << 20
FEATURES = 1 << 14
STRONG = 28.0
MAX_LABELLED = 20_000
SLICE_ROWS = 200
COUNT_ROWS = 1 << 16
BLOCK_ENTRIES = 1 << 20


def cells(text: str) -> np.ndarray:
    """The cell of every n-gram of the text, of all orders; with repeats."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = []
    h = points
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            if len(points) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1:]
            if n in ORDERS:
                mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                found.append((mixed >> np.uint64(44)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, np.int32)


@dataclass
class Model:
    features: np.ndarray  # cells in use
    weights: np.ndarray   # of these cells, log-count ratio times coefficient
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(CELLS, np.float32)
        out[self.features] = self.weights
        return out


def logistic(x: np.ndarray | float):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chosen_cells(counts: DataFrame, n_toxic: int, n_clean: int, most: int = FEATURES, strong: float = STRONG) -> DataFrame:
    """Of (``cell``, ``toxic``, ``clean``) the ``most`` strongest: twice the gain is a chi-square
    statistic; with as many tests as cells, only those above ``strong`` tell."""
    n = n_toxic + n_clean
    share = (F.col("toxic") + F.col("clean")) / n
    gain = F.lit(0.0)
    for name, size in (("toxic", n_toxic), ("clean", n_clean)):
        seen = F.col(name)
        rate = (seen + 1e-9) / size
        gain = gain + seen * F.log(rate / F.greatest(share, F.lit(1e-9))) + (F.lit(size) - seen) * F.log(
            F.greatest(1 - rate, F.lit(1e-9)) / F.greatest(1 - share, F.lit(1e-9)))
    return (counts.withColumn("_gain", gain).where(F.col("_gain") * 2 >= strong)
            .orderBy(F.col("_gain").desc(), "cell").limit(most).drop("_gain"))


def fit(columns: np.ndarray, sizes: np.ndarray, ratio: np.ndarray, labels: np.ndarray, *, penalty: float = 1e-3,
        rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias. ``columns`` lists the features of each text, one text after the other, and
    ``sizes`` how many each has; features are scaled by their ``ratio``. Accelerated gradient steps on
    the regularised mean loss, over BLOCK_ENTRIES entries at a time."""
    n, target = len(labels), labels.astype(np.float64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] + 1, BLOCK_ENTRIES)), n))
    prior = (labels.sum() + 1) / (n + 2)
    w, b = np.zeros(len(ratio)), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, rounds + 1):
        scaled, grad, level = ratio * w, np.zeros(len(ratio)), 0.0
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = columns[ends[lo]:ends[hi]].astype(np.intp)
            rows = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            slope = logistic(np.bincount(rows, scaled[part], hi - lo) + b) - target[lo:hi]
            grad += np.bincount(part, slope[rows], len(ratio))
            level += slope.sum()
        grad = np.append(ratio * grad / n + penalty * w, level / n)
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = 0.02 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return ratio * w, float(b)


def scores(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """Sum of the weights of the distinct cells of each text, as a probability."""
    total = np.full(len(texts), bias)
    for k, text in enumerate(texts):
        found = cells(text)
        found = found[table[found] != 0]
        total[k] += table[np.unique(found)].sum(dtype=np.float64)
    return logistic(total)


def labelled(labels: DataFrame, label: str, id_column: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids: those with the smallest hash."""
    one = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(id_column).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic",
          id_column: str = "doc_id", max_labelled: int = MAX_LABELLED, smoothing: float = 1.0,
          most_features: int = FEATURES, strong: float = STRONG) -> Model:
    """Fit to the documents that ``labels`` marks; of documents that share an id, to one. The model has the
    ``most_features`` cells that tell most of those whose chi-square is at least ``strong``. Cells are counted and chosen on the executors; the
    driver gets the chosen ones, and of each text of the bounded sample which of them it has."""
    sample = labelled(labels, label, id_column, max_labelled)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
    rows = stored(one_row(rows, "_id", text="_text").select(F.xxhash64("_id").alias("_id"), F.col("_label").cast("boolean").cast("int").alias("_label"), "_text"))
    sizes = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        prior = (n_toxic + 1) / (n_toxic + n_clean + 2)
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), float(np.log(prior / (1 - prior))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, CELLS), np.int32)
        for batch in batches:
            for whole, bad in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist()):
                seen[bad, np.unique(cells(whole or ""))] += 1
        used = np.flatnonzero(seen.any(0))
        for k in range(0, len(used), COUNT_ROWS):
            part = used[k:k + COUNT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(seen[c, part].astype(np.int64)) for c in (1, 0))],
                                             names=["cell", "toxic", "clean"])

    counts = rows.mapInArrow(count, "cell int, toxic long, clean long").groupBy("cell").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    chosen = chosen_cells(counts, n_toxic, n_clean, most_features, strong).toArrow().sort_by("cell")  # most_features rows at most
    features, p, q = (chosen.column(c).to_numpy().astype(np.int64) for c in ("cell", "toxic", "clean"))
    ratio = np.log((p + smoothing) / (n_toxic + 2 * smoothing)) - np.log((q + smoothing) / (n_clean + 2 * smoothing))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.full(CELLS, -1, np.int32)
        places[features] = np.arange(len(features))
        for batch in batches:
            found = [np.unique(places[cells(t or "")]) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array([x[x >= 0].astype(np.uint16).tobytes() for x in found], pa.binary())],
                names=["_id", "_label", "_places"])

    got = rows.mapInArrow(place, "_id long, _label int, _places binary").toArrow().sort_by("_id")
    held = got.column("_places").to_pylist()
    weights, bias = fit(np.frombuffer(b"".join(held), np.uint16), np.array([len(x) // 2 for x in held], np.int64), ratio,
                        got.column("_label").to_numpy().astype(np.int64))
    return Model(features, weights.astype(np.float32), bias)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of toxicity of each whole text."""
    kept = [c for c in docs.columns if c != "score"]
    source = docs.select(*kept) if text in kept else docs.select(*kept, F.col(text).alias("_text"))
    read = text if text in kept else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(k, SLICE_ROWS)
                values = scores([t or "" for t in batch.column(read).to_pylist()], table, model.bias)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(values, pa.float64())], names=[*kept, "score"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)
