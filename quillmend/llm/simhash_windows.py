"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, and exact
verification by weighted shingles. Built-in functions only.

Words are lower-cased runs of letters, digits and underscores; a shingle is a run of five words (of an
item of fewer words: all of them). A document leaks an item if a window of as many words as the item
has is similar to it: the weight of a shingle is the number of its occurrences, and the sum of the
lesser weights over that of the greater weights is at least the threshold.

1. A window without any shingle of an item has similarity 0, so windows are opened only where a
   document has a shingle of an item, at the item's place relative to it. Documents are screened with
   a bit map of the items' shingles, of BITMAP_WORDS * 64 bits whatever the number of items; what it
   passes by mistake falls out in the join that follows.
2. Windows of one text and items of one text are fingerprinted once: 128 bits, each the sign of the
   sum of a random +-1 over the shingles with their weights.
3. The fingerprints are cut into BLOCKS blocks. Two fingerprints within RADIUS bits agree in some block
   up to RADIUS // BLOCKS bits, so the items' block values with all changes of so many bits, joined to
   the windows' block values, give every pair within the radius. At the threshold, more than 99.5 % of
   pairs are within it.
4. Candidates are verified exactly, on words.

Defined cases: null and empty texts and items have no words and never match. Windows do not reach over
the ends of a document: one that would is moved inside; a document shorter than the item is compared
whole. Repeated rows, equal documents and equal items all get their pairs. Other columns are kept by
:func:`decontaminate`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmend.llm.common import digest, stored, words_text

SHINGLE = 5
BITMAP_WORDS = 1 << 15
BLOCKS = 8
BLOCK_BITS = 16
RADIUS = 31


def words_of(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def shingles(words: Column, size: int, salt: int = 0) -> Column:
    """64-bit hashes of the runs of ``size`` words of an array, in order."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(salt), *[words[i + k] for k in range(size)]))


def own_shingles(words: Column, salt: int = 0) -> Column:
    """Of five words, or of all words of a shorter array."""
    out = shingles(words, SHINGLE, salt)
    for size in range(1, SHINGLE):
        out = F.when(F.size(words) == size, shingles(words, size, salt)).otherwise(out)
    return out


def shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


def simhash(hashes: Column) -> Column:
    """64 signs: a bit is one where more than half of the hashes have it."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, zero, lambda n, h: n + shifted(h, b).bitwiseAND(one))
        return acc.bitwiseOR(F.call_function("shiftleft", F.when(ones * 2 > F.size(hashes), one).otherwise(zero), b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, bit)


def fingerprinted(rows: DataFrame) -> DataFrame:
    """``rows`` (``words``) with the two halves of the fingerprint."""
    hashed = rows.withColumn("_a", own_shingles(F.col("words"), 1)).withColumn("_b", own_shingles(F.col("words"), 2))
    return hashed.withColumn("low", simhash(F.col("_a"))).withColumn("high", simhash(F.col("_b"))).drop("_a", "_b")


def blocks(rows: DataFrame, spread: int) -> DataFrame:
    """A row for each block of the fingerprint and each change of up to ``spread`` of its bits."""
    mask = (1 << BLOCK_BITS) - 1
    values = [shifted(F.col(half), F.lit(BLOCK_BITS * k)).bitwiseAND(mask).cast("int")
              for half in ("low", "high") for k in range(BLOCKS // 2)]
    changes = [sum(1 << b for b in bits) for n in range(spread + 1) for bits in combinations(range(BLOCK_BITS), n)]
    out = rows.select("*", F.posexplode(F.array(*values)).alias("block", "value"))
    if spread:
        listed = F.split(F.lit(",".join(map(str, changes))), ",").cast("array<int>")
        out = out.withColumn("_change", F.explode(listed)).withColumn("value", F.col("value").bitwiseXOR(F.col("_change"))).drop("_change")
    return out


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, their occurrences being the weights."""
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, s: n + F.least(
        F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s))))
    return both / (F.size(a) + F.size(b) - both)


def spelled_shingles(words: Column) -> Column:
    """The shingles themselves."""
    size = F.least(F.size(words), F.lit(SHINGLE))
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))


def bitmap(hashes: DataFrame) -> Column:
    """The bit map of the hashes in ``h``, as a constant array: at most BITMAP_WORDS numbers reach the
    driver, whatever the number of hashes."""
    places = hashes.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p"))
    one = F.lit(1).cast("long")
    words = places.groupBy(F.shiftrightunsigned("p", 6).bitwiseAND(BITMAP_WORDS - 1).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("p").bitwiseAND(63).cast("int"))).alias("v"))
    filled = {row["w"]: row["v"] for row in words.collect()}
    return F.split(F.lit(",".join(str(filled.get(k, 0)) for k in range(BITMAP_WORDS))), ",").cast("array<bigint>")


def in_bitmap(bits: Column, h: Column) -> Column:
    def told(p: Column) -> Column:
        word = bits[F.shiftrightunsigned(p, 6).bitwiseAND(BITMAP_WORDS - 1).cast("int")]
        return shifted(word, p.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return told(h) & told(F.shiftrightunsigned(h, 32))


def matches(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id",
            threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(key, item key, start, similarity) of the best window of each document text and item text, and
    (item key, item id). A key is the digest of the words of a text."""
    known = items.select(F.col(item_id).alias("item_id"), words_text(F.col(item_text)).alias("_words")).where("_words != ''")
    named = stored(known.withColumn("item", digest(F.col("_words"))).withColumn("words", words_of(F.col("_words"))).drop("_words"))
    unique = stored(fingerprinted(named.groupBy("item").agg(F.first("words").alias("words"))))
    sizes = [r[0] for r in unique.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()]  # five at most
    # Shingles of the items, with their places and the size of the window they open.
    offsets = stored(unique.select(F.size("words").alias("span"), F.posexplode(own_shingles(F.col("words"))).alias("offset", "h")).distinct())
    bits = bitmap(offsets.select("h").distinct())

    def holds(words: Column) -> Column:
        hit = F.lit(False)
        for size in sizes:
            hit = hit | F.exists(shingles(words, size), lambda h: in_bitmap(bits, h))
        return hit

    # Lambda variables hold the text and its words: a filter that is pushed below a projection would
    # have them computed anew for each place.
    screened = (docs.select(words_text(F.col(text)).alias("_words"))
                .where(F.exists(F.array("_words"), lambda t: F.exists(F.array(words_of(t)), holds)))
                .withColumn("key", digest(F.col("_words"))).groupBy("key").agg(F.first("_words").alias("_words")))
    screened = stored(screened).withColumn("words", words_of(F.col("_words"))).drop("_words")
    places = None
    for size in sizes:
        own = screened.select("key", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"), size)).alias("place", "h"))
        places = own if places is None else places.unionByName(own)
    if places is None:
        places = screened.select("key", F.size("words").alias("n"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("h")).limit(0)
    opened = (places.where(in_bitmap(bits, F.col("h"))).join(offsets, "h")
              .select("key", "span", F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"), F.col("n") - F.col("span"))).alias("start"))
              .distinct())
    windows = stored(opened.join(screened, "key").select(
        "key", "start", F.slice("words", F.col("start") + 1, F.col("span")).alias("words")).withColumn(
        "window", digest(F.array_join("words", " "))))
    prints = stored(fingerprinted(windows.groupBy("window").agg(F.first("words").alias("words"))))

    # All pairs of fingerprints within the radius.
    mine = blocks(prints.select("window", "low", "high"), 0)
    theirs = blocks(unique.select("item", "low", "high"), RADIUS // BLOCKS).withColumnsRenamed({"low": "item_low", "high": "item_high"})
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("item_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("item_high")))
    # Sorted and merged: the items' block values are hundreds for each item, which estimates do not see.
    near = mine.join(theirs.hint("merge"), ["block", "value"]).where(apart <= RADIUS).select("window", "item").distinct()
    judged = (near.join(prints.select("window", "words"), "window").join(unique.select("item", F.col("words").alias("item_words")), "item")
              .select("window", "item", similarity(spelled_shingles(F.col("words")), spelled_shingles(F.col("item_words"))).alias("similarity"))
              .where(F.col("similarity") >= threshold))
    best = windows.select("key", "start", "window").join(judged, "window").groupBy("key", "item").agg(
        F.max("similarity").alias("similarity"), F.min(F.struct(-F.col("similarity"), F.col("start")))["start"].alias("start"))
    return stored(best), named.select("item", "item_id")


def find_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """(id, item_id, similarity, start): one row for each document and item it leaks, with the best
    window; ``start`` counts words from 0."""
    best, named = matches(docs, items, text=text, **options)
    ids = docs.select(F.col(id_column), digest(words_text(F.col(text))).alias("key"))
    return ids.join(best.hint("merge"), "key").join(named.distinct(), "item").select(id_column, "item_id", "similarity", "start")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without those that leak an item."""
    best, _ = matches(docs, items, text=text, **options)
    leaking = best.select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", digest(words_text(F.col(text)))).join(leaking.hint("merge"), "_key", "left_anti").drop("_key").select(*docs.columns)
