"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors reach. Only a local
    session without that setting (tests) gets a temporary folder of the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillmend-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillmend-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, so that what was computed
    survives lost executors and is not computed again."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def one_row(rows: DataFrame, *keys: str, text: str) -> DataFrame:
    """Of rows with equal keys the one of the least digest of ``text``, so that what is gathered from
    rows of a bounded number of keys is bounded however often a key is repeated. Each task sends one
    row of a key."""
    first = Window.partitionBy(*keys).orderBy(digest(F.coalesce(F.col(text), F.lit(""))))
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def words_text(text: Column) -> Column:
    """Words of a text, lower-cased and parted by one blank each: letters, marks, digits and
    underscores make words, everything else parts them. A null text is an empty one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+", " "))


def digest(text: Column) -> Column:
    """128 bits of a text, as binary: the key of texts in shuffles."""
    return F.unhex(F.md5(text))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS = [np.array([1], np.uint64), np.array([1], np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` positions."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (parted by single blanks) and the offsets at which
    they begin. Polynomial hashes from running sums: a few numpy passes, whatever the words."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    cuts = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], cuts + 1))
    ends = np.concatenate((cuts, [len(raw)]))
    up, down = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    with np.errstate(over="ignore"):
        h = (sums[ends] - sums[starts]) * down[np.minimum(starts, len(raw) - 1)]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(h), starts


def shingle_hashes(words: str, size: int) -> np.ndarray:
    """Distinct 64-bit hashes, sorted, of the runs of ``size`` words of a text made by
    :func:`words_text`. A shorter text has one: all its words. An empty text has none."""
    hashes, _ = word_hashes(words.encode())
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(hashes))):
            total = total * np.uint64(0xFF51AFD7ED558CCD) + hashes[k:k + n]
    return np.unique(mixed(total))
