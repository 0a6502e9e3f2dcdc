"""Ranked lexical search by NRA: sequential reads of lists sorted by impact.

Documents are indexed once: the distinct query terms of each and how often they occur. The index lies
in shards, a bounded number of documents each, as Spark deals them. In a shard every query term has a
list of (impact, document), highest impact first. For an item its lists are read in parallel, ever
deeper. A document that was met has a lower score, the impacts seen; its upper score adds, for each list
in which it was not met, the impact last read there. Reading stops when no unread document and no
document of smaller lower score can reach the k-th lower score, and lower and upper score of all that
can are equal: then membership, ties and scores are exact. Nothing is looked up out of order.

Every document lies in one shard, so the best k of all shards hold the best k of all documents. A task
keeps its best k so far, whose k-th score is where the next shard begins to prune.

How it scales: the index is made and read in place, without a shuffle; only k rows an item and task are
shuffled, and ranked in two steps. Terms of items reach the tasks in groups of at most ITEM_BYTES of
item text (or one longer item); each group costs one more pass. Memory is bounded by a shard.

Defined cases: null and empty texts have no terms and are never found; an item without terms finds
nothing. Equal rows of items are answered once, rows that repeat an id with another text each on its
own. Rows of documents that repeat an id are documents of their own; null ids come last among ties.
Other columns are not kept.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmend.llm.common import stored

# Bytes that make terms (digits, letters, all beyond ASCII) with A-Z in lower case; others are blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE_BYTES = 1 << 20
ITEM_BYTES = 2 << 20
SHARD_DOCS = 10_000
SHARD_MARKS = 32 << 20
FIRST_DEPTH = 64
LAST = (1 << 63) - 1


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    data = (text or "").encode().translate(TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def indexed(docs: DataFrame, vocabulary: dict[bytes, int], text: str, id_column: str) -> DataFrame:
    """(id, n, terms, counts) of every document with terms: how many, and the known ones with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, known, counts = [], [], [], []
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                n, found = 0, Counter()
                for part in terms(value.as_py()):
                    n += len(part)
                    found.update(part)
                if n:
                    hits = {code: c for t, c in found.items() if (code := vocabulary.get(t)) is not None}
                    ids.append(doc_id.as_py())
                    sizes.append(n)
                    known.append(np.fromiter(hits.keys(), np.int32, len(hits)))
                    counts.append(np.fromiter(hits.values(), np.int64, len(hits)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(known, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "counts"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n long, terms array<int>, counts array<long>")


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """NRA over lists of (documents, impacts), highest impact first, of documents 0 to n_docs - 1.

    Returns the documents that reach the k-th best score (or ``floor`` if that is higher) and a score
    above 0, their exact scores, and how many entries were read."""
    lower = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    heads = np.array([impacts[0] if len(impacts) else 0 for _, impacts in lists], np.int64)
    at, step, read = 0, FIRST_DEPTH, 0
    while True:
        for j, (members, impacts) in enumerate(lists):
            part = members[at:at + step]
            if len(part):
                lower[part] += impacts[at:at + step]
                seen[j, part] = True
                read += len(part)
                heads[j] = impacts[at + len(part) - 1] if at + len(part) < len(impacts) else 0
        at, step = at + step, 2 * step
        rest = int(heads.sum())
        kth = int(np.partition(lower, n_docs - k)[n_docs - k]) if n_docs >= k else 0
        least = max(kth, floor, 1)
        if rest >= least:
            continue
        near = np.flatnonzero(lower + rest >= least)
        open_ = heads @ ~seen[:, near]
        near, open_ = near[lower[near] + open_ >= least], open_[lower[near] + open_ >= least]
        if not open_.any():
            return near, lower[near], read


def shard_lists(shard: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of all terms of a shard, one after the other: documents, impacts, and where each list begins."""
    sizes = shard.column("n").to_numpy()
    each = pc.list_value_length(shard.column("terms")).to_numpy()
    doc = np.repeat(np.arange(len(sizes)), each)
    term = pc.list_flatten(shard.column("terms")).to_numpy()
    tf = pc.list_flatten(shard.column("counts")).to_numpy()
    m = 100 - 75 + (75 * sizes * n_docs) // n_terms
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    order = np.lexsort((-impact, term))
    return doc[order], impact[order], np.searchsorted(term[order], np.arange(len(weights) + 1))


def best_of_shards(index: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int,
                   n_terms: int, k: int) -> DataFrame:
    """(item, part, id, score): the best k documents of each item in each task. ``queries``: item
    number and its (term, how often)."""
    most = max((len(q) for _, q in queries), default=1)
    docs_a_shard = max(1, min(SHARD_DOCS, SHARD_MARKS // max(1, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            for a in range(0, batch.num_rows, docs_a_shard):
                shard = pa.Table.from_batches([batch.slice(a, docs_a_shard)])
                ids = shard.column("id").fill_null(LAST).to_numpy()
                doc, impact, start = shard_lists(shard, weights, n_docs, n_terms)
                for place, (_, query) in enumerate(queries):
                    lists = [(doc[start[t]:start[t + 1]], times * impact[start[t]:start[t + 1]]) for t, times in query if start[t] < start[t + 1]]
                    if not lists:
                        continue
                    held = best[place]
                    found, scores, _ = resolve(lists, len(ids), k, -held[-1][0] if len(held) == k else 0)
                    best[place] = heapq.nsmallest(k, [*held, *zip((-scores).tolist(), ids[found].tolist())])
        rows = [(item, part, doc_id if doc_id != LAST else None, -score) for (item, _), held in zip(queries, best) for score, doc_id in held]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["item", "part", "id", "score"])

    return index.mapInArrow(run, "item int, part int, id long, score long")


def search(docs: DataFrame, items: DataFrame, *, text: str = "text", id_column: str = "doc_id", item_text: str = "text",
           item_id: str = "item_id", k: int = 10) -> DataFrame:
    """(item id, ``rank``, document id, ``score``): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    asked = stored(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct())
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    groups = max(1, -(-size // ITEM_BYTES))
    id_type = items.schema[item_id].dataType
    out = None
    for g in range(groups):
        # At most ITEM_BYTES of text, or one longer item.
        texts = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        counted = [Counter(t for part in terms(r.text) for t in part) for r in texts]
        vocabulary = {t: code for code, t in enumerate(sorted(set().union(*counted)))}
        queries = [(i, [(vocabulary[t], n) for t, n in c.items()]) for i, c in enumerate(counted)]
        index = stored(indexed(docs, vocabulary, text, id_column))
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        found = best_of_shards(index, queries, weights, n_docs, n_terms, k)
        names = spark.createDataFrame(
            [(i, r.item_id) for i, r in enumerate(texts)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)]))
        ranked = best(best(found.withColumn("part", F.col("part") % 256), k, "item", "part"), k, "item")
        rows = ranked.join(names, "item").select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_column), "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def best(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
