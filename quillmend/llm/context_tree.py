"""Language-model scores by context-tree weighting over bytes.

A text is its words, lower-cased in ASCII, each followed by a blank, and an end. A byte is eight binary
decisions; each decision has a tree whose nodes are the last 0, 1, ... DEPTH bytes. A node with a
zeros and b ones holds the Krichevsky-Trofimov estimate Pe(a, b); its weighted probability is
    Pw = Pe / 2 + (product of Pw of the longer contexts) / 2,   and Pe at the greatest depth.
The prediction mixes the estimates of all depths on the path: q(d) = w p(d) + (1 - w) q(d + 1), where
w = Pe / 2 / Pw is the weight that the learned texts left to stopping there. It is a probability
over texts; -log2 of it per byte is the code length.

Spark's part: each task counts the runs of DEPTH + 1 bytes (context and next byte) and the words of
its documents; an aggregation adds them up for the whole corpus. Trees below two bytes of context are
built where the runs of that context lie (of one context of two bytes, whose number does not grow with the corpus without end); what is above them has at most 65,280
nodes, which is all that reaches the driver. Runs get their log-probability, words their count.
For scoring, documents are dealt into chunks of about CHUNK_BYTES; a chunk asks for the distinct runs
and words it has, a join brings their values, and the chunk is scored with them alone. So nothing that
grows with the corpus is broadcast, and what moves is distinct runs, not bytes.

Words of the base score are counted under 64-bit hashes.

Defined cases: null texts are empty; an empty text has the end alone. Repeated rows are scored each.
Without a learned text, all decisions are even and all counts 0. Other columns are not kept; the id is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmend.llm.common import mixed, stored

DEPTH = 5
CHUNK_BYTES = 24_000_000
SLICE_BYTES = 1_000_000
MOST_HELD = 3_000_000
END = np.int64(10)
LOG10_HALF = np.log10(0.5)
_BASE = 0x9E3779B97F4A7C15 | 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def stream(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace").lower()
    if len(data) > SLICE_BYTES:
        data = re.sub(rb"[\x20\x09-\x0D]+", b" ", data).strip(b" ")
        return b"".join((b"\n" * DEPTH, data, b" \n" if data else b"\n"))
    return b"\n" * DEPTH + b" ".join([*data.split(), b""]) + b"\n"


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Pieces of texts of about SLICE_BYTES together, the text each is of, and whether it ends there.

    A long text is cut behind a blank; what follows begins with the DEPTH bytes before it, as a text
    begins with as many line ends. Only the texts of one slice are there as bytes at a time."""
    streams: list[bytes] = []
    owners: list[int] = []
    ended: list[bool] = []
    size = 0
    for k, text in enumerate(texts):
        whole, at = stream(text.as_py()), DEPTH
        while at < len(whole):
            stop = whole.find(b" ", at + SLICE_BYTES) + 1 or len(whole)
            streams.append(whole[at - DEPTH:stop])
            owners.append(k)
            ended.append(stop == len(whole))
            size += stop - at + DEPTH
            at = stop
            if size >= SLICE_BYTES:
                yield streams, np.array(owners), np.array(ended)
                streams, owners, ended, size = [], [], [], 0
    if streams:
        yield streams, np.array(owners), np.array(ended)


def parts(streams: list[bytes], ended: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of the pieces and the piece of each, and the words (and the ends of texts) and the piece
    of each. Without ``ended`` every piece is a whole text."""
    raw = np.frombuffer(b"".join(streams), np.uint8)
    lengths = np.array([len(s) for s in streams])
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    text = np.repeat(np.arange(len(streams)), lengths)
    wide = raw.astype(np.int64)
    run = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        run |= wide[DEPTH - k:len(wide) - k] << (8 * (DEPTH + 1 - k))
    told = np.ones(len(raw), bool)
    for k in range(DEPTH):
        told[begins + k] = False
    run, run_text = run[told[DEPTH:]], text[told]
    # Words: from behind the previous blank, or the beginning of the text, to the next blank.
    ends = np.flatnonzero((raw == 32) & told)
    word_text = text[ends]
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
        starts = np.maximum(starts, begins[word_text] + DEPTH)
    up, down = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * up + up, dtype=np.uint64)))
        h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64)
    closed = np.arange(len(streams)) if ended is None else np.flatnonzero(ended)
    words = np.concatenate((np.where(h == END, END + 1, h), np.full(len(closed), END)))
    return run, run_text, words, np.concatenate((word_text, closed))


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, in order: a plain sort is several times as fast as looking keys up."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def counted_runs(runs: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs and how many of each were learned. A run leaves room for the mark beside it."""
    both = np.sort(runs << 1 | learned)
    keys = both >> 1
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(both & 1, first) if len(first) else both


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def count_parts(docs: DataFrame, text: str, learn: Column) -> DataFrame:
    """(kind, key, n): words (kind 0) and runs (kind 1) of all texts; n counts those of learned texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for kind, found in held.items():
                if found:
                    keys, n = counted(*map(np.concatenate, zip(*found)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n.astype(np.int64))],
                        names=["kind", "key", "n"])
                found.clear()

        for batch in batches:
            learned = np.array(batch.column("_learn").to_pylist(), np.int64)
            for streams, owners, ended in slices(batch.column("_text")):
                runs, run_text, words, word_text = parts(streams, ended)
                marks = learned[owners]
                held[0].append(counted(words, marks[word_text]))
                held[1].append(counted_runs(runs, marks[run_text]))
                size += len(held[0][-1][0]) + len(held[1][-1][0])
                if size > MOST_HELD:
                    merge = {k: [counted(*map(np.concatenate, zip(*v)))] for k, v in held.items() if v}
                    held.update(merge)
                    size = sum(len(v[0][0]) for v in merge.values())
                    if size > MOST_HELD // 2:
                        yield from merged()
                        size = 0
        yield from merged()

    found = docs.select(F.col(text).alias("_text"), learn.cast("int").alias("_learn")).mapInArrow(run, "kind tinyint, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive numbers: Stirling's series, after shifting small ones up."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        small = x < 8
        shift[small] += np.log(x[small])
        x[small] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5) - shift


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log Pe(a, b)."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


class Level:
    """The decision nodes of the contexts of one depth that the runs meet: context * 256 + the bits of
    the next byte so far, with a one in front."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        context = keys >> (8 * (DEPTH + 1 - depth))
        nxt = keys & 0xFF
        nodes = np.stack([(context << 8) | (1 << b) | (nxt >> (8 - b)) for b in range(8)])
        self.bit = np.stack([((nxt >> (7 - b)) & 1).astype(np.int8) for b in range(8)])
        self.nodes, at = np.unique(nodes, return_inverse=True)
        self.at = at.reshape(nodes.shape)
        weight = np.broadcast_to(n, nodes.shape)
        self.zeros = np.bincount(self.at.ravel(), (weight * (1 - self.bit)).ravel(), len(self.nodes))
        self.ones = np.bincount(self.at.ravel(), (weight * self.bit).ravel(), len(self.nodes))
        self.log_pe = log_estimate(self.zeros, self.ones)
        self.log_pw = self.log_pe

    def weigh(self, below: "Level") -> None:
        """Pw from the nodes one byte deeper."""
        parent = ((below.nodes >> 16) << 8) | (below.nodes & 0xFF)
        product = np.bincount(np.searchsorted(self.nodes, parent), below.log_pw, len(self.nodes))
        self.log_pw = np.logaddexp(self.log_pe, product) - np.log(2)

    def mixed(self, deeper: np.ndarray | None) -> np.ndarray:
        """The prediction of the bit that each run has, at each of its decisions."""
        return mix(self.zeros[self.at], self.ones[self.at], self.bit, self.log_pe[self.at], self.log_pw[self.at], deeper)


def mix(zeros, ones, bit, log_pe, log_pw, deeper) -> np.ndarray:
    own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
    if deeper is None:
        return own
    stop = np.exp(np.minimum(log_pe - np.log(2) - log_pw, 0))
    return stop * own + (1 - stop) * deeper


def lower_levels(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """Depths 2 to DEPTH of the runs of whole two-byte contexts, weighed."""
    levels = [Level(keys, n, d) for d in range(2, DEPTH + 1)]
    for upper, lower in reversed(list(zip(levels, levels[1:]))):
        upper.weigh(lower)
    return levels


def whole_contexts(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of a partition sorted by key, cut between two-byte contexts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("key").to_numpy(), batch.column("n").to_numpy()))
        if sum(len(k) for k, _ in held) >= least:
            keys, n = map(np.concatenate, zip(*held))
            cut = int(np.searchsorted(keys >> 8 * (DEPTH - 1), keys[-1] >> 8 * (DEPTH - 1)))
            if cut:
                yield keys[:cut], n[:cut]
            held = [(keys[cut:], n[cut:])]
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def upper_levels(rows: list) -> tuple[np.ndarray, ...]:
    """zeros, ones, log Pe, log Pw of depth 1 (256 * 256) and of depth 0 (256), from the sums of depth 2."""
    shape = (256, 256)
    zeros, ones, below = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for r in rows:
        zeros[r["context"], r["node"]], ones[r["context"], r["node"]], below[r["context"], r["node"]] = r["zeros"], r["ones"], r["below"]
    log_pe = log_estimate(zeros, ones)
    log_pw = np.logaddexp(log_pe, below) - np.log(2)
    z0, o0 = zeros.sum(0), ones.sum(0)
    pe0 = log_estimate(z0, o0)
    pw0 = np.logaddexp(pe0, log_pw.sum(0)) - np.log(2)
    return zeros, ones, log_pe, log_pw, z0, o0, pe0, pw0


def log_probabilities(runs: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of the next byte of each run (key, n), from the counts n."""
    runs = runs.withColumn("_two", F.shiftright("key", 8 * (DEPTH - 1)))
    dealt = runs.repartition("_two").sortWithinPartitions("key").select("key", "n")

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in whole_contexts(batches):
            top = lower_levels(keys, n)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(top.nodes >> 16), pa.array(top.nodes & 0xFF), pa.array(top.zeros), pa.array(top.ones), pa.array(top.log_pw)],
                names=["context", "node", "zeros", "ones", "below"])

    # At most 256 * 255 rows.
    sums = (dealt.mapInArrow(upward, "context long, node long, zeros double, ones double, below double")
            .groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).collect())
    zeros, ones, log_pe, log_pw, z0, o0, pe0, pw0 = upper_levels(sums)

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in whole_contexts(batches):
            q = None
            levels = lower_levels(keys, n)
            for level in reversed(levels):
                q = level.mixed(q)
            c, m, bit = levels[0].nodes[levels[0].at] >> 16, levels[0].nodes[levels[0].at] & 0xFF, levels[0].bit
            q = mix(zeros[c, m], ones[c, m], bit, log_pe[c, m], log_pw[c, m], q)
            q = mix(z0[m], o0[m], bit, pe0[m], pw0[m], q)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(q).sum(0))], names=["key", "value"])

    return dealt.mapInArrow(downward, "key long, value double")


class KeyTable:
    """64-bit keys to values: open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.int64).min, np.int64)
        self.values = np.zeros(1 << self.bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == np.iinfo(np.int64).min]
            self.keys[slot[free]] = keys[free]
            got = left[self.keys[slot[left]] == keys[left]]
            self.values[slot[got]] = values[got]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values; all keys must be there."""
        slot = self._slot(keys)
        todo = np.flatnonzero(self.keys[slot] != keys)
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            todo = todo[self.keys[slot[todo]] != keys[todo]]
        return self.values[slot]


def score_documents(docs: DataFrame, learn: Column, *, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (words by their
    smoothed share), ``score`` (log10 probability by the trees), ``n_bytes`` and ``bits_per_byte``.
    ``learn`` tells which documents are learned from."""
    totals = stored(count_parts(docs, text, learn))
    size = docs.select(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    tokens, known_words = totals.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    model = stored(
        log_probabilities(totals.where("kind = 1").select("key", "n")).select(F.lit(1).cast("tinyint").alias("kind"), "key", "value")
        .unionByName(totals.where("kind = 0").select("kind", "key", F.col("n").cast("double").alias("value"))))

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text")).withColumn(
        "chunk", F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)).cast("int"))

    def wanted(table: pa.Table) -> pa.Table:
        found: dict[int, list] = {0: [], 1: []}
        for streams, _, ended in slices(table.column("_text")):
            runs, _, words, _ = parts(streams, ended)
            for kind, some in ((0, words), (1, runs)):
                found[kind].append(distinct(some))
                # Merged when what is new has grown as large as what is merged.
                if sum(map(len, found[kind][1:])) > max(len(found[kind][0]), 1_000_000):
                    found[kind] = [distinct(np.concatenate(found[kind]))]
        keys = {kind: distinct(np.concatenate(v)) for kind, v in found.items()}
        n = sum(map(len, keys.values()))
        return pa.table({
            "chunk": pa.array(np.full(n, table.column("chunk")[0].as_py(), np.int32)),
            "kind": pa.array(np.repeat(np.array([0, 1], np.int8), [len(keys[0]), len(keys[1])])),
            "key": pa.array(np.concatenate((keys[0], keys[1])))})

    asked = rows.groupBy("chunk").applyInArrow(wanted, "chunk int, kind tinyint, key long")
    answers = asked.join(model.hint("merge"), ["kind", "key"]).select("chunk", "kind", "key", "value")

    def scored(table: pa.Table, values: pa.Table) -> pa.Table:
        kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
        tables = {k: KeyTable(key[kind == k], value[kind == k]) for k in (0, 1)}
        del kind, key, value
        rows = table.num_rows
        out = np.zeros((5, rows))
        for streams, owners, ended in slices(table.column("_text")):
            runs, run_text, words, word_text = parts(streams, ended)
            c = tables[0].find(words)
            n = len(streams)
            for k, sums in enumerate((
                    np.bincount(word_text, minlength=n), np.bincount(word_text, c > 0, n),
                    np.bincount(word_text, np.log10((c + 0.5) / (tokens + 0.5 * (known_words + 1))), n),
                    np.bincount(run_text, tables[1].find(runs), n), np.bincount(run_text, minlength=n))):
                np.add.at(out[k], owners, sums)
        return pa.table({
            id_column: table.column("_id"), "n_tokens": pa.array(out[0].astype(np.int64)), "n_known": pa.array(out[1].astype(np.int64)),
            "train_tokens": pa.array(np.full(rows, tokens, np.int64)), "base_score": pa.array(out[2]), "score": pa.array(out[3]),
            "n_bytes": pa.array(out[4].astype(np.int64)), "bits_per_byte": pa.array(-out[3] / np.log10(2) / out[4])})

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        scored, f"{id_column} long, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
                "n_bytes long, bits_per_byte double")
