"""Document fingerprints by a randomised edit embedding.

A walk goes over the characters of a text: at each step of a clock it looks at the character under
it, and a random bit, shared by all texts and fixed by (step, character), tells whether it moves on.
Texts at a small edit distance fall back into step, so what two walks see at the same step differs
at few steps: edit distance becomes Hamming distance. The walk stays on a character until a bit of
one comes, so it is followed from character to character over a table of the next such step.

What is seen is the run of four characters under the walk, hashed to four bits. A fingerprint keeps
SAMPLES of these for each of two clocks lengths, the least power of two that holds the text and the
one above, at steps drawn once for each length; a step behind the end of the text sees nothing. Two
fingerprints are compared at the longest clock of the two, when both have it; texts more unlike in
length have a likeness of 0.

Search: BANDS groups of BAND_SAMPLES samples, drawn from the first HEAD ones (which every text has at
its own clock, and at the next one if a text of that clock can be near), are the keys of bands.
Fingerprints of one band value are candidates, the whole fingerprints verify them, and a band returns
a spanning forest of what it verified; large bands are cut into blocks. The bands look at the first 40 %
of the clock: a pair of likeness 0.8 meets in some band with a probability over 0.999 if its edits are
spread, and of about 0.99 if all of them lie where the bands look (the tests measure both). Texts of
under eight characters have hardly a band that ends inside of them: they meet if they are equal.

Defined cases: a null text is empty; the fingerprint of an empty text is that of a walk that sees
nothing, and two empty texts have a likeness of 1. The bits repeat after PERIOD steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmend.llm.common import digest, mixed, stored
from quillmend.llm.minhash_forest import bucket_forest, components

PERIOD = 1 << 13
SYMBOLS = 256
SAMPLES = 128
NOTHING = 0xFF
SLICE_CHARS = 6_000_000
BLOCK_CELLS = 16_000_000
HEAD = 51
BANDS = 24
BAND_SAMPLES = 6


def _next_move() -> np.ndarray:
    """For each symbol and step: how many steps until the walk moves on, one at least."""
    cells = np.arange(SYMBOLS * PERIOD, dtype=np.uint64).reshape(SYMBOLS, PERIOD)
    bits = (mixed(cells + np.uint64(1)) >> np.uint64(63)).astype(bool)
    out = np.zeros((SYMBOLS, PERIOD), np.int32)
    wait = np.zeros(SYMBOLS, np.int32)
    for lap in range(2):
        for step in range(PERIOD - 1, -1, -1):
            wait = np.where(bits[:, step], 1, wait + 1)
            if lap:
                out[:, step] = wait
    return np.maximum(out, 1)


class Walks:
    """The table of moves and the sampled steps of each clock length."""

    def __init__(self):
        self.moves = _next_move().ravel()
        self.steps: dict[int, np.ndarray] = {}

    def sampled(self, scale: int) -> np.ndarray:
        """Sorted steps of the clock of 2 * 2**scale steps; the mean walk takes two a character, and what
        a slower one sees later is not sampled."""
        if scale not in self.steps:
            draws = mixed(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(scale << 20) + np.uint64(77))
            span = max(1, 2 << scale)
            self.steps[scale] = np.sort((draws % np.uint64(span)).astype(np.int64))
        return self.steps[scale]


_WALKS: list[Walks] = []


def walks() -> Walks:
    if not _WALKS:
        _WALKS.append(Walks())
    return _WALKS[0]


def scale_of(n: int) -> int:
    return max(5, (max(1, n) - 1).bit_length())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def arrivals(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The steps at which the walk comes to each character of each text, and to the end. All texts
    walk together, the longest first, so that those still walking are a head of the arrays."""
    w = walks()
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[k]) for k in order], np.int64)
    out: list = [None] * len(texts)
    k0 = 0
    while k0 < len(order):
        # Texts of like length form a block: one matrix of symbols, characters in rows.
        k1 = k0 + int((lengths[k0:] * 2 > lengths[k0]).sum()) if lengths[k0] else len(order)
        k1 = min(k1, k0 + max(1, BLOCK_CELLS // max(1, int(lengths[k0]))))
        width, height = k1 - k0, int(lengths[k0])
        symbols = np.zeros((height, width), np.int32)
        for j, k in enumerate(order[k0:k1].tolist()):
            t = texts[k]
            symbols[:len(t), j] = ((t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int32) * PERIOD
        steps = np.zeros((height + 1, width), np.int64 if height > 50_000_000 else np.int32)
        step = steps[0]
        moves, mask = w.moves, PERIOD - 1
        for i in range(height):
            step = step + moves[symbols[i] + (step & mask)]
            steps[i + 1] = step
        for j, k in enumerate(order[k0:k1].tolist()):
            out[k] = steps[:lengths[k0 + j] + 1, j]
        k0 = k1
    return out


def seen(points: np.ndarray, came: np.ndarray, scale: int) -> np.ndarray:
    """What the walk sees at the sampled steps: four bits each, or NOTHING behind the end."""
    steps = walks().sampled(scale)
    at = np.searchsorted(came, steps, "right") - 1
    padded = np.concatenate((points, np.zeros(4, np.uint32))).astype(np.uint64)
    inside = at < len(points)
    at = np.minimum(at, len(points))
    with np.errstate(over="ignore"):
        h = padded[at]
        for k in range(1, 4):
            h = h * np.uint64(0x100000001B3) + padded[np.minimum(at + k, len(padded) - 1)]
    return np.where(inside, (mixed(h) >> np.uint64(60)).astype(np.uint8), NOTHING).astype(np.uint8)


def fingerprints(texts: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Scale and what is seen on the clocks of that scale and of the next one."""
    return [(scale_of(len(t)), seen(t, c, scale_of(len(t))), seen(t, c, scale_of(len(t)) + 1))
            for t, c in zip(texts, arrivals(texts))]


def shown(print_: tuple[int, np.ndarray, np.ndarray]) -> str:
    """Scale, then five bits a sample as one character of 32."""
    digits = np.frombuffer(b"0123456789abcdef-", np.uint8)
    scale, *clocks = print_
    return f"{scale:02d}:" + ":".join(digits[np.minimum(c, 16)].tobytes().decode() for c in clocks)


def likeness(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> float:
    """Share of samples that agree at the longest clock, corrected for chance; where both texts are
    over, nothing is compared."""
    if a[0] > b[0]:
        a, b = b, a
    if b[0] - a[0] > 1:
        return 0.0
    x, y = (a[1], b[1]) if a[0] == b[0] else (a[2], b[1])
    told = (x != NOTHING) | (y != NOTHING)
    if not told.any():
        return 1.0
    agree = float((x[told] == y[told]).mean())
    return min(1.0, max(0.0, (agree - 1 / 16) / (1 - 1 / 16)))


def edited(own: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of the following one."""
    half = len(own) // 2
    return own[:len(own) - half] + following[:half]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def in_order(docs: DataFrame, id_column: str, text: str, parts: int) -> DataFrame:
    """Rows dealt by ranges of their id, sorted, each range followed by the first row of the next one
    (the last by the very first): columns ``_part``, ``_guest``, ``_id``, ``_text``.

    The ranges come from quantiles of the ids; what else is collected are the numbers of the ranges
    that have rows. No task orders more than its range."""
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    cuts = rows.where("_id is not null").approxQuantile("_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted(set(cuts))
    part = F.lit(0)
    if cuts:
        # The number of cuts at or below the id, by halving.
        def place(lo: int, hi: int):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col("_id") >= F.lit(cuts[mid]), place(mid + 1, hi)).otherwise(place(lo, mid))

        part = place(0, len(cuts))
    # Null ids come last.
    part = F.when(F.col("_id").isNull(), F.lit(len(cuts) + 1)).otherwise(part).cast("int")
    rows = rows.withColumn("_part", part)
    heads = rows.groupBy("_part").agg(F.min(F.struct("_id", "_text")).alias("_head"))
    numbers = sorted(r[0] for r in rows.select("_part").distinct().collect())
    if not numbers:
        return rows.select("_part", F.lit(False).alias("_guest"), "_id", "_text")
    before = {number: numbers[k - 1] for k, number in enumerate(numbers)}
    back = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    guests = heads.select(back[F.col("_part")].alias("_part"), F.lit(True).alias("_guest"), "_head._id", "_head._text")
    every = rows.select("_part", F.lit(False).alias("_guest"), "_id", "_text").unionByName(guests)
    return every.repartition(max(1, len(numbers)), "_part").sortWithinPartitions("_part", "_guest", "_id", "_text")


def fingerprint_documents(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """For each row of ``docs``: its fingerprint, that of its edited text, and the likeness of its
    fingerprint to that one and to the next row's, by ascending id (and text, for equal ids)."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = in_order(docs, id_column, text, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        chars = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_part", "_guest", "_id", "_text"))):
                waiting.append(row)
                chars += len(row[3])
                if chars > SLICE_CHARS and len(waiting) > 1:
                    yield measured(waiting)
                    waiting, chars = waiting[-1:], len(row[3])
        if len(waiting) > 1:
            yield measured(waiting)

    def measured(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last have what follows them; guests have no result of their own."""
        own = [k for k in range(len(rows) - 1) if not rows[k][1]]
        texts = [rows[k][3] for k in range(len(rows))]
        changed = [edited(texts[k], texts[k + 1]) for k in own]
        prints = fingerprints([code_points(t) for t in texts] + [code_points(t) for t in changed])
        first, second = prints[:len(texts)], prints[len(texts):]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[k][2] for k in own], pa.int64()),
            pa.array([len(texts[k]) for k in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([shown(first[k]) for k in own], pa.string()),
            pa.array([shown(p) for p in second], pa.string()),
            pa.array([likeness(first[k], p) for k, p in zip(own, second)], pa.float64()),
            pa.array([likeness(first[k], first[k + 1]) for k in own], pa.float64()),
        ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return stored(rows.mapInArrow(run, SCHEMA)).withColumnRenamed("doc_id", id_column)


def parsed(print_: str) -> np.ndarray:
    """The bytes of a shown fingerprint: scale, then what is seen on both clocks."""
    digits = np.full(256, NOTHING, np.uint8)
    digits[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
    scale, first, second = print_.split(":")
    raw = np.frombuffer((first + second).encode(), np.uint8)
    return np.concatenate((np.array([int(scale)], np.uint8), digits[raw]))


def bands(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the bands of both clocks, a row for each fingerprint, and which of them do not look
    behind the end of the text."""
    draws = mixed(np.arange(BANDS * HEAD, dtype=np.uint64) + np.uint64(5)).reshape(BANDS, HEAD).argsort(1)[:, :BAND_SAMPLES]
    keys, told = [], []
    for clock in range(2):
        values = prints[:, 1 + clock * SAMPLES:1 + (clock + 1) * SAMPLES][:, draws]
        scale = prints[:, :1].astype(np.uint64) + np.uint64(clock)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1000) * scale
        for k in range(BAND_SAMPLES):
            key = mixed(key * np.uint64(31) + values[:, :, k].astype(np.uint64))
        keys.append(key.view(np.int64))
        told.append((values != NOTHING).all(2))
    return np.concatenate(keys, 1), np.concatenate(told, 1)


def alike(threshold: float):
    def judge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of fingerprints whose likeness reaches the threshold, many at a time."""
        low = (a[:, :1] <= b[:, :1])
        a, b = np.where(low, a, b), np.where(low, b, a)
        gap = b[:, 0].astype(int) - a[:, 0]
        x = np.where(gap[:, None] == 0, a[:, 1:1 + SAMPLES], a[:, 1 + SAMPLES:])
        y = b[:, 1:1 + SAMPLES]
        told = (x != NOTHING) | (y != NOTHING)
        agree = ((x == y) & told).sum(1) / np.maximum(1, told.sum(1))
        return (gap <= 1) & ((agree - 1 / 16) / (1 - 1 / 16) >= threshold)

    return judge


def near_classes(prints: DataFrame, *, id_column: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``prints`` (with ``fingerprint``) and ``near_class``: the least id of those that are connected by
    fingerprints of at least that likeness. Equal fingerprints are one node."""
    known = prints.withColumn("node", digest(F.col("fingerprint")))
    unique = known.groupBy("node").agg(F.first("fingerprint").alias("_print"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([parsed(p).tobytes() for p in batch.column("_print").to_pylist()], pa.binary())],
                names=["node", "_sig"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, told = bands(np.frombuffer(b"".join(batch.column("_sig").to_pylist()), np.uint8).reshape(-1, 1 + 2 * SAMPLES))
            rows, columns = np.nonzero(told)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(rows)), pa.array(keys[rows, columns])], names=["node", "bucket"])

    # Keys are made anew where they are wanted; they would be larger than the fingerprints.
    unique = stored(unique.mapInArrow(pack, "node binary, _sig binary"))
    forest = bucket_forest(unique.mapInArrow(explode, "node binary, bucket long"), unique, 1 + 2 * SAMPLES, alike(threshold))
    roots = known.select("node", id_column).join(components(forest), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    ids = roots.groupBy("root").agg(F.min(id_column).alias("near_class"))
    of_node = roots.select("node", "root").distinct().join(ids, "root").drop("root")
    return known.join(of_node, "node").drop("node")
