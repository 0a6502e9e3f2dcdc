"""Importance resampling towards a target distribution, with segments deduplicated.

Features of a text are its runs of one to three words, hashed into buckets by crc32. A bucket's gain
compares its share in the target texts with that in the corpus; a document's weight is the sum of gains
of its features, and Gumbel noise from its id turns the highest scores into a draw without replacement.

New lines cut texts into lines, and lines repeat. So the corpus is not counted text by text: equal lines
(equal words) meet once in a shuffle, with their occurrences; the buckets of a distinct line are computed
once, count as often as it occurs, and give the line one weight. The runs of words that cross from one
line into others are few, up to three a line; they are taken from each document and added separately.
A document's weight is the sum of the weights of its lines and of the gains of what crosses them.

How it scales: tasks add up equal lines before the shuffle. Weights come back to documents by a join on
the line; the lines that make a thousandth of all or more (at most a thousand, whatever the input) are not
joined but sent to the tasks. The draw sorts by range over all tasks and numbers the ranges from their
sizes. What reaches the driver are sums of buckets, the common lines' weights and sizes of partitions.

Defined cases: null and empty texts have no words: weight 0, and they are not drawn, as all with fewer than
``least_words``. A null id counts as an empty text in the noise and comes last among ties. Repeated rows are
documents of their own, ranked one after the other. An empty target has gains of corpus shares alone. Other
columns are not kept.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmend.llm.common import stored

# Bytes that make words (digits, lower-case letters, all beyond ASCII) with A-Z in lower case; new lines
# stay, others are blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))
BUCKETS = 10_000
PIECE_BYTES = 1 << 20
HELD_BYTES = 16 << 20
COMMON = 1000


def _append_zeros() -> np.ndarray:
    """Tables [j, byte place, byte]: what 2**j zero bytes behind a text make of its crc32."""
    one = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ 0xEDB88320, one >> 1)
    tables = np.zeros((40, 4, 256), np.uint32)
    value = np.arange(256, dtype=np.uint64)[None, :] << (8 * np.arange(4, dtype=np.uint64)[:, None])
    tables[0] = (value >> 8) ^ one[value & 0xFF]
    for j in range(1, 40):
        tables[j] = _through(tables[j - 1], tables[j - 1])
    return tables


def _through(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    return table[0][code & 0xFF] ^ table[1][code >> 8 & 0xFF] ^ table[2][code >> 16 & 0xFF] ^ table[3][code >> 24]


ZEROS = _append_zeros()
BLANK = np.uint32(zlib.crc32(b" "))


def joined(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of texts put together, from those of their parts and the bytes of the right ones."""
    left, j, rest = left.copy(), 0, sizes.copy()
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        left[odd] = _through(ZEROS[j], left[odd])
        rest >>= 1
        j += 1
    return left ^ right


def line_buckets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of one to three words of lines (words parted by one blank), line by line, and
    how many each line has."""
    cut = [line.split() for line in lines]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    words = [w for line in cut for w in line]
    single = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    line = np.repeat(np.arange(len(lines)), counts)
    found, owners = [single], [line]
    run = single
    for more in (1, 2):
        run, last = run[:-1], single[more:]
        blank = joined(run, np.full(len(run), BLANK, np.uint32), np.ones(len(run), np.int64))
        run = joined(blank, last, sizes[more:])
        within = line[more:] == line[:-more] if more < len(line) else np.zeros(0, bool)
        found.append(run[within])
        owners.append(line[more:][within])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % BUCKETS).astype("<u2"), np.bincount(owner, minlength=len(lines))


def sized(lines: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """(words, line, overlap) of lines in parts of bounded length: a long line is cut, each part but the first
    repeating the two words before it, as ``overlap`` tells."""
    for i, line in enumerate(lines):
        at, overlap = 0, 0
        while True:
            end = line.find(b" ", at + PIECE_BYTES)
            while end >= 0 and line.count(b" ", at, end) < 2:
                end = line.find(b" ", end + 1)
            yield line[at:] if end < 0 else line[at:end], i, overlap
            if end < 0:
                break
            at = line.rfind(b" ", at, line.rfind(b" ", at, end)) + 1
            overlap = 2


def leveled(line: bytes) -> bytes:
    """The words of a line, parted by one blank each."""
    if len(line) <= PIECE_BYTES:
        return b" ".join(line.split())
    parts, at = [], 0
    while at < len(line):
        end = line.find(b" ", at + PIECE_BYTES)
        end = len(line) if end < 0 else end
        parts.append(b" ".join(line[at:end].split()))
        at = end
    return b" ".join(filter(None, parts))


def lines_of(text: str | None) -> list[bytes]:
    """The lines of a text that have words, as their words."""
    return [v for line in (text or "").encode().translate(WORD_BYTES).split(b"\n") if (v := leveled(line))]


def key_of(line: bytes) -> bytes:
    return hashlib.md5(line, usedforsecurity=False).digest()


def ends(line: bytes) -> tuple[list[bytes], list[bytes]]:
    """The first and the last two words of a line."""
    first = line.find(b" ")
    second = line.find(b" ", first + 1) if first >= 0 else -1
    return line[:second if second >= 0 else len(line)].split(b" "), line.rsplit(b" ", 2)[-2:]


def crossing(lines: list[bytes]) -> list[int]:
    """Buckets of the runs of two and three words that lie in more than one line."""
    found, tail = [], []
    for line in lines:
        head, last = ends(line)
        if tail:
            found.append(tail[-1] + b" " + head[0])
            if len(tail) > 1:
                found.append(tail[-2] + b" " + tail[-1] + b" " + head[0])
            if len(head) > 1:
                found.append(tail[-1] + b" " + head[0] + b" " + head[1])
        tail = last if len(last) > 1 else [*tail[-1:], *last]
    return [zlib.crc32(f) % BUCKETS for f in found]


def line_rows(texts: DataFrame) -> DataFrame:
    """(key, line, n): the lines of ``texts`` (text), equal ones of a task mostly added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def flush():
            nonlocal size
            out = pa.RecordBatch.from_arrays([
                pa.array([key_of(v) for v in held], pa.binary()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                names=["key", "line", "n"])
            held.clear()
            size = 0
            return out

        for batch in batches:
            for text in batch.column(0):
                for line in lines_of(text.as_py()):
                    if line not in held:
                        size += len(line) + 100
                    held[line] += 1
                    if size > HELD_BYTES:
                        yield flush()
        yield flush()

    return texts.mapInArrow(run, "key binary, line binary, n long")


def distinct_lines(texts: DataFrame) -> DataFrame:
    """(key, n, buckets): each distinct line once, how often it occurs, and the buckets of its features
    as little-endian unsigned 16-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = batch.column("key"), batch.column("n")
            for a, b, lines in slices(batch.column("line")):
                parts = list(sized(lines))
                buckets, counts = line_buckets([p for p, _, _ in parts])
                stops = np.cumsum(counts)
                values: list[bytes] = [b""] * len(lines)
                for (part, i, overlap), stop, count in zip(parts, stops.tolist(), counts.tolist()):
                    own = buckets[stop - count:stop]
                    if overlap:
                        own = without_overlap(own, count)
                    values[i] = values[i] + own.tobytes() if overlap else own.tobytes()
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), n.slice(a, b - a), pa.array(values, pa.binary())], names=["key", "n", "buckets"])

    once = line_rows(texts).groupBy("key").agg(F.first("line").alias("line"), F.sum("n").alias("n"))
    return stored(once.mapInArrow(run, "key binary, n long, buckets binary"))


def without_overlap(buckets: np.ndarray, count: int) -> np.ndarray:
    """Buckets of a part without those of the two words it repeats: two words, and the pair they make."""
    words = (count + 3) // 3
    return np.concatenate((buckets[2:words], buckets[words + 1:]))


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, stop, values) of stretches of a binary column of about ``limit`` bytes."""
    a, size, values = 0, 0, []
    for k, v in enumerate(column):
        value = v.as_py()
        values.append(value)
        size += len(value)
        if size >= limit:
            yield a, k + 1, values
            a, size, values = k + 1, 0, []
    if values:
        yield a, len(column), values


def documents_in_lines(docs: DataFrame) -> DataFrame:
    """(row, id, words, keys, times, crossing) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, keys, times, cross = [], [], [], []
            for value in batch.column("text"):
                lines = lines_of(value.as_py())
                words.append(sum(line.count(b" ") + 1 for line in lines))
                found = Counter(map(key_of, lines))
                keys.append(list(found))
                times.append(list(found.values()))
                cross.append(np.array(crossing(lines), "<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(words, pa.int64()), pa.array(keys, pa.list_(pa.binary())),
                 pa.array(times, pa.list_(pa.int64())), pa.array(cross, pa.binary())],
                names=["row", "id", "words", "keys", "times", "crossing"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return stored(numbered.mapInArrow(run, "row long, id long, words long, keys array<binary>, times array<long>, crossing binary"))


def bucket_sums(lines: DataFrame, cut: DataFrame) -> np.ndarray:
    """Features in each bucket, of all lines as often as they occur and of what crosses them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value, n in zip(batch.column(0), batch.column(1).to_pylist()):
                np.add.at(total, np.frombuffer(value.as_py(), "<u2"), n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    both = lines.select("buckets", "n").unionByName(cut.select(F.col("crossing").alias("buckets"), F.lit(1).cast("long").alias("n")))
    sums = np.zeros(BUCKETS, np.int64)
    for r in both.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"]] = r["n"]
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, rounded down."""
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(buckets: DataFrame, gain: np.ndarray, *columns: str) -> DataFrame:
    """``columns`` and ``weight``: the sum of gains of ``buckets``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) // 2 for v in (x.as_py() for x in batch.column("buckets"))], np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[np.frombuffer(b"".join(v.as_py() for v in batch.column("buckets")), "<u2")])))
            stop = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sums[stop] - sums[stop - sizes])], names=[*columns, "weight"])

    kept = buckets.select(*columns, "buckets")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, weight long")


def weights(lines: DataFrame, cut: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, id, words, weight) of every document."""
    line_weights = stored(weighed(lines, gain, "key", "n"))
    all_lines = line_weights.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most COMMON rows, as each is at least a COMMON-th of all.
    common = F.broadcast(line_weights.where(F.col("n") * COMMON >= all_lines).select("key", "weight"))
    pairs = cut.select("row", F.explode(F.arrays_zip("keys", "times")).alias("pair")).select("row", F.col("pair.keys").alias("key"), F.col("pair.times").alias("times"))
    own = weighed(cut.select("row", "id", "words", F.col("crossing").alias("buckets")), gain, "row", "id", "words")
    parts = [pairs.join(common, "key"),
             pairs.join(common.select("key"), "key", "left_anti").join(line_weights.where(F.col("n") * COMMON < all_lines).select("key", "weight"), "key")]
    rows = own
    for part in parts:
        rows = rows.unionByName(part.select("row", (F.col("times") * F.col("weight")).alias("weight")), allowMissingColumns=True)
    return rows.groupBy("row").agg(F.max("id").alias("id"), F.max("words").alias("words"), F.sum("weight").alias("weight"))


def ranks(scored: DataFrame, take: int) -> DataFrame:
    """(row, rank) of the ``take`` rows of highest score, ties to the smaller id, then as rows were read."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    ranged = stored(scored.select("row", "id", "score").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):
        if before < take:
            starts.append((part, before))
        before += n
    # One row for each partition of the sort.
    starts = F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, before long"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return (ranged.join(starts, "part").withColumn("rank", (F.col("before") + inside).cast("long"))
            .where(F.col("rank") <= take).select("row", "rank"))


def resample(docs: DataFrame, target: DataFrame, *, text: str = "text", id_column: str = "doc_id", target_text: str = "text",
             seed: int = 42, percent: int = 5, least_words: int = 20) -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn).
    ``percent`` of the documents with ``least_words`` words or more are drawn."""
    def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
        lines, cut = distinct_lines(rows.select("text")), documents_in_lines(rows)
        return lines, cut, bucket_sums(lines, cut)

    lines, cut, corpus = counted(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")))
    _, _, aim = counted(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    n = F.col("words")
    features = n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    scored = stored(weights(lines, cut, gains(corpus, aim)).select(
        "row", "id", "words", features.cast("long").alias("n_features"), "weight", (F.col("weight") + noise).cast("long").alias("score")))
    eligible = scored.where(F.col("words") >= least_words)
    drawn = ranks(eligible, percent * eligible.count() // 100)
    return scored.join(drawn, "row", "left").select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")
