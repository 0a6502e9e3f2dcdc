"""Similarity join on word shingles: MinHash LSH forest, then exact verification.

A text becomes the set of its runs of five words (lower-cased, letters and digits only); two texts
are linked when the Jaccard similarity of their sets is at least ``threshold``. Texts with the same
words are one node from the start, so exact copies are never paired.

1. A signature of ``trees * depth`` minima is cut into as many labels as there are trees: each tree is
   a trie of labels of ``depth`` minima. The shortest prefix it may take is the longest at which a pair
   at the threshold shares one in some tree with the target recall. Labels are dealt by that prefix, so
   each subtrie below it is in one place, its labels sorted; prefixes of one node fall away by a count
   before any payload moves.
2. A subtrie is searched from its full depth up: nodes whose labels agree in all minima are compared
   first, then, with the prefix shortened by one, those that part there, and so on. A prefix whose nodes
   are connected already is not searched, and it is shortened no further than the target recall asks.
   Compared are signatures (the estimate must come within five standard deviations of the threshold);
   what returns is a spanning forest, never pairs. Large subtries are cut into blocks, and each pair
   of blocks is a task of its own.
3. The forest's components collect the texts that may be linked, again in blocks where they are
   large. There the sets are intersected exactly: the result is the number of links of each node and
   a spanning forest of the links, whose components are the classes.

Nothing is dropped: blocks cover all pairs of a large bucket or component.

Defined cases: null and empty texts have no shingles and no links; each is a class of its own text,
so all texts without words form one class of copies with no links between them counted but their
own copies. Texts of fewer than five words have one shingle, all their words. Repeated rows count as
copies. Ids may be of any type that has an order. A row with a null id takes part: it has links, and
the least id of its class; a class of null ids alone has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmend.llm.common import digest, mixed, shingle_hashes, stored, words_text

BLOCK_NODES = 1024
# Sets are intersected in matrices: blocks of fewer nodes, so many columns at a time.
VERIFIED_NODES = 512
VERIFIED_COLUMNS = 4096
BLOCK_CHARS = 4_000_000


def prefix_depth(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the recall."""
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold ** length) ** trees >= recall:
            return length
    return 1


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The minimum of the set under each of the hash functions, as 32-bit numbers."""
    out = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 4096):
            part = shingles[k:k + 4096]
            values = ((part[None, :] * seeds[:, None]) >> np.uint64(32)).astype(np.uint32)
            np.minimum(out, values.min(1), out=out)
    return out


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of ``n`` nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        before = root
        root = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups of a partition that is sorted by ``keys``: a batch, completed by what
    of its last group comes in the next ones."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for key in keys:
            column = np.asarray(batch.column(key).to_numpy(zero_copy_only=False))
            same &= column == column[-1:]  # an array: numpy cuts zero bytes off the end of a scalar
        last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = []
        elif rest and not all(rest[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def in_blocks(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row in the pairs of blocks of its group that it belongs to: ``_i <= _j``; a group of one
    block has the pair (0, 0). ``_side`` tells of which block the row is; on the diagonal it is 0."""
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col(blocks)).cast("int")
    return (rows.withColumn("_own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
            .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
            .withColumn("_side", (F.col("_own") == F.col("_j")).cast("int") * (F.col("_i") < F.col("_j")).cast("int"))
            .drop("_own", "_other"))


def dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def components(edges: DataFrame, a: str = "node", b: str = "root") -> DataFrame:
    """(node, root) with the least node of each connected component, of all nodes of the edges, by
    alternating large-star and small-star steps: each round shuffles the edges by a node and hangs
    neighbours on the least one. A round's edges are written to the shared folder."""
    links = stored(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u != v").distinct())
    while True:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
            .where("u != v").distinct())
        new = stored(small)
        counts = [d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (links, new)]
        links = new
        if counts[0] == counts[1]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def bucket_forest(labels: DataFrame, payload: DataFrame, size: int, alike) -> DataFrame:
    """(node, root): a spanning forest of the pairs that share a bucket and are ``alike``.

    ``labels`` has a row for each node and bucket, ``payload`` the ``size`` bytes ``_sig`` of each node;
    ``alike`` takes two byte matrices of as many rows and tells which pairs to keep. Buckets of one
    node are dropped before the payload joins; large ones are cut into blocks, and each pair of
    blocks is compared by itself."""
    shared = labels.groupBy("bucket").agg(F.count("*").alias("_m")).where("_m > 1")
    shared = shared.select("bucket", F.ceil(F.col("_m") / BLOCK_NODES).cast("int").alias("_blocks"))
    members = labels.join(shared, "bucket").join(payload, "node")
    keys = ["bucket", "_i", "_j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            sig = np.frombuffer(b"".join(table.column("_sig").to_pylist()), np.uint8).reshape(-1, size)
            cuts = bounds(table, keys)
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            side = table.column("_side").to_numpy()
            diagonal = table.column("_i").to_numpy() == table.column("_j").to_numpy()
            root = np.arange(len(group))
            left, right, step = [], [], 1
            rows = np.arange(len(group))
            # All pairs at distance 1, then 2, ... inside the groups, until no group is that long.
            while True:
                rows = rows[rows + step < len(group)]
                rows = rows[group[rows] == group[rows + step]]
                if not len(rows):
                    break
                tried = rows[diagonal[rows] | (side[rows] != side[rows + step])]
                for k in range(0, len(tried), 100_000):
                    part = tried[k:k + 100_000]
                    good = part[alike(sig[part], sig[part + step])]
                    left.append(good)
                    right.append(good + step)
                step += 1
            if left:
                root = spanning(np.concatenate(left), np.concatenate(right), len(group))
            moved = np.flatnonzero(root != np.arange(len(group)))
            nodes = table.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.take(pa.array(moved)), pa.binary()), pa.array(nodes.take(pa.array(root[moved])), pa.binary())],
                names=["node", "root"])

    return dealt(in_blocks(members, "bucket", "_blocks"), keys, "node").mapInArrow(compare, "node binary, root binary")


def trie_forest(labels: DataFrame, payload: DataFrame, size: int, below: int, alike) -> DataFrame:
    """(node, root): a spanning forest of the pairs that share a prefix and are ``alike``.

    ``labels`` has a row for each node and tree: ``bucket`` tells tree and shortest prefix, ``rest`` has
    the ``below`` minima behind it, four bytes each, so that it sorts as the trie does. ``payload`` and
    ``alike`` as in :func:`bucket_forest`."""
    shared = labels.groupBy("bucket").agg(F.count("*").alias("_m")).where("_m > 1")
    shared = shared.select("bucket", F.ceil(F.col("_m") / BLOCK_NODES).cast("int").alias("_blocks"))
    members = labels.join(shared, "bucket").join(payload, "node")
    keys = ["bucket", "_i", "_j"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            sig = np.frombuffer(b"".join(table.column("_sig").to_pylist()), np.uint8).reshape(-1, size)
            rest = np.frombuffer(b"".join(table.column("rest").to_pylist()), np.uint32).reshape(-1, below)
            cuts = bounds(table, keys)
            group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            diagonal = table.column("_i").to_numpy() == table.column("_j").to_numpy()
            root = searched(sig, rest, group, table.column("_side").to_numpy(), diagonal, alike)
            moved = np.flatnonzero(root != np.arange(len(group)))
            nodes = table.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.take(pa.array(moved)), pa.binary()), pa.array(nodes.take(pa.array(root[moved])), pa.binary())],
                names=["node", "root"])

    return dealt(in_blocks(members, "bucket", "_blocks"), keys, "rest", "node").mapInArrow(search, "node binary, root binary")


def searched(sig: np.ndarray, rest: np.ndarray, group: np.ndarray, side: np.ndarray, diagonal: np.ndarray, alike) -> np.ndarray:
    """Roots of the forest of subtries (rows of one ``group`` are one, sorted by ``rest``), prefixes being
    shortened minimum by minimum. Rows of a block pair are compared across its sides alone."""
    n, below = rest.shape
    root = np.arange(n)
    agree = np.cumprod(rest[1:] == rest[:-1], 1).sum(1) if n > 1 else np.empty(0, np.int64)
    agree[group[1:] != group[:-1]] = -1
    for level in range(below, -1, -1):
        run = np.concatenate(([0], np.cumsum(agree < level)))
        shared, step = np.full(n, below), 1
        rows = np.arange(n)
        while True:
            # Prefixes whose nodes are all connected are done.
            least, most = np.full(run[-1] + 1, n), np.full(run[-1] + 1, -1)
            np.minimum.at(least, run, root)
            np.maximum.at(most, run, root)
            rows = rows[rows + step < n]
            rows = rows[(run[rows] == run[rows + step]) & (least < most)[run[rows]]]
            if not len(rows):
                break
            shared[rows] = np.minimum(shared[rows], agree[rows + step - 1])
            tried = rows[(shared[rows] == level) & (root[rows] != root[rows + step])
                         & (diagonal[rows] | (side[rows] != side[rows + step]))]
            linked = [part[alike(sig[part], sig[part + step])] for part in np.array_split(tried, len(tried) // 100_000 + 1)]
            linked = np.concatenate(linked)
            if len(linked):
                known = np.flatnonzero(root != np.arange(n))
                root = spanning(np.concatenate((linked, known)), np.concatenate((linked + step, root[known])), n)
            step += 1
    return root


def nodes_of(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("_id"), words_text(F.col(text)).alias("_words")).withColumn(
        "node", digest(F.col("_words")))


def similarity_join(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", shingle: int = 5,
                    threshold: float = 0.8, recall: float = 0.998, trees: int = 16, depth: int = 8) -> DataFrame:
    """One row per row of ``docs``: the id, ``class_id`` (the least id of its class), ``n_links`` (the
    other documents similar to it, copies among them) and ``n_copies`` (documents of the same words)."""
    signed, per_node = _classes(docs, text, id_column, shingle, threshold, recall, trees, depth)
    ids = per_node.groupBy("root").agg(F.min("_rep").alias("class_id"))
    answer = per_node.join(ids, "root").select(
        "node", "class_id", (F.col("_links") + F.col("_n") - 1).alias("n_links"), F.col("_n").alias("n_copies"))
    return signed.select(F.col("_id").alias(id_column), "node").join(answer, "node").drop("node")


def first_of_classes(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", shingle: int = 5,
                     threshold: float = 0.8, recall: float = 0.998, trees: int = 16, depth: int = 8) -> DataFrame:
    """One row of ``docs`` of each class of similar texts: that of the least id (null ids last), of rows
    that share it that of the least digest, of equal rows any."""
    _, per_node = _classes(docs, text, id_column, shingle, threshold, recall, trees, depth)
    order = F.struct(F.col("_rep").isNull(), F.col("_rep"), F.col("node"))
    heads = per_node.groupBy("root").agg(F.min(order).alias("_head")).select("_head.node")
    named = docs.withColumn("_node", digest(words_text(F.col(text))))
    # Each task sends one row of a text, however often it has it.
    first = Window.partitionBy("_node").orderBy(F.col(id_column).asc_nulls_last(), digest(F.coalesce(F.col(text), F.lit(""))))
    once = named.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return once.join(heads.withColumnRenamed("node", "_node").hint("merge"), "_node").select(*docs.columns)


def _classes(docs: DataFrame, text: str, id_column: str, shingle: int, threshold: float, recall: float, trees: int,
             depth: int) -> tuple[DataFrame, DataFrame]:
    """(_id, node) and more of every row, and (node, root, _rep, _n, _links) of every text."""
    id_type = docs.schema[id_column].dataType
    length = prefix_depth(threshold, recall, trees, depth)
    size = trees * depth
    seeds = mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    slack = 5 * (threshold * (1 - threshold) / size) ** 0.5

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, rests, compact = [], [], []
            for words in batch.column("_words").to_pylist():
                found = shingle_hashes(words, shingle)
                minima = signature(found, seeds)
                whole = minima.reshape(trees, depth)
                prefixes = whole[:, :length].astype(np.uint64)
                label = np.arange(trees, dtype=np.uint64)
                for k in range(length):
                    label = mixed(label ^ prefixes[:, k])
                labels.append(label.astype(np.int64) if len(found) else np.empty(0, np.int64))
                rests.append([r.tobytes() for r in whole[:, length:].astype(">u4")] if len(found) else [])
                compact.append((minima & 0xFF).astype(np.uint8).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_id", "node", "_chars")), pa.array(labels, pa.list_(pa.int64())),
                 pa.array(rests, pa.list_(pa.binary())), pa.array(compact, pa.binary())],
                names=["_id", "node", "_chars", "_labels", "_rests", "_sig"])

    found = nodes_of(docs, text, id_column).select("_id", "node", F.length("_words").alias("_chars"), "_words")
    signed = stored(found.mapInArrow(sign, T.StructType([T.StructField("_id", id_type), *(T.StructField(n, t) for n, t in (
        ("node", T.BinaryType()), ("_chars", T.IntegerType()), ("_labels", T.ArrayType(T.LongType())),
        ("_rests", T.ArrayType(T.BinaryType())), ("_sig", T.BinaryType())))])))
    copies = signed.groupBy("node").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), F.first("_chars").alias("_chars"))
    unique = signed.where("_sig is not null").groupBy("node").agg(
        F.first(F.arrays_zip("_labels", "_rests")).alias("_labels"), F.first("_sig").alias("_sig"))

    # 2. Prefixes of more than one node; a forest of the pairs that may be linked.
    need = threshold - slack

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # One byte agrees by chance once in 256 times.
        return ((a == b).mean(1) - 1 / 256) / (1 - 1 / 256) >= need

    labels = unique.select("node", F.inline("_labels")).withColumnsRenamed({"_labels": "bucket", "_rests": "rest"})
    forest = trie_forest(labels, unique.select("node", "_sig"), size, depth - length, alike)
    near = components(forest)

    # 3. Exact similarities inside the components.
    inside = near.union(near.select(F.col("root").alias("node"), "root").distinct())
    sized = inside.join(copies.where("_chars > 0"), "node")
    blocks = sized.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / VERIFIED_NODES), F.ceil(F.sum(F.col("_chars").cast("long")) / BLOCK_CHARS)).cast("int").alias("_blocks"))
    sized = stored(sized.join(blocks, "root").select("node", "root", "_n", "_blocks", F.col("_rep").alias("_id")))
    # Sorted and merged at every size: the candidates grow with the documents.
    # The row of the least id stands for a text, of texts without any id one row.
    every = nodes_of(docs, text, id_column)
    nameless = every.where("_id is null").withColumn("_nth", F.row_number().over(
        Window.partitionBy("node").orderBy("_words"))).where("_nth = 1").drop("_nth", "_id")
    texts = every.join(sized.where("_id is not null").hint("merge"), ["_id", "node"]).drop("_id").unionByName(
        nameless.join(sized.where("_id is null").drop("_id").hint("merge"), "node"))
    keys3 = ["root", "_i", "_j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys3):
            cuts = bounds(table, keys3)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = table.slice(lo, hi - lo)
                names = part.column("node").to_pylist()
                fresh = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
                part = part.take(pa.array(fresh)) if len(fresh) < len(names) else part
                names = part.column("node").to_pylist()
                side = part.column("_side").to_numpy()
                cross = part.column("_i")[0].as_py() != part.column("_j")[0].as_py()
                weight = part.column("_n").to_numpy()
                a, b = linked_pairs([shingle_hashes(w, shingle) for w in part.column("_words").to_pylist()], threshold,
                                    side if cross else None)
                if not len(a):
                    continue
                links = np.bincount(a, weight[b], len(names)) + np.bincount(b, weight[a], len(names))
                root = spanning(a, b, len(names))
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in hit], pa.binary()), pa.array([names[k] for k in root[hit]], pa.binary()),
                     pa.array(links[hit].astype(np.int64))], names=["node", "root", "_links"])

    verified = stored(dealt(in_blocks(texts, "root", "_blocks").select(*keys3, "_side", "node", "_n", "_words"), keys3, "node")
                      .mapInArrow(verify, "node binary, root binary, _links long"))
    links = verified.groupBy("node").agg(F.sum("_links").alias("_links"))
    classes = components(verified.select("node", "root"))
    # The class of a node: the component's root, or itself; its id: the least of all its documents.
    per_node = (copies.join(classes, "node", "left").join(links, "node", "left")
                .select("node", F.coalesce("root", "node").alias("root"), "_rep", "_n", F.coalesce("_links", F.lit(0)).alias("_links")))
    return signed, stored(per_node)


def linked_pairs(sets: list[np.ndarray], threshold: float, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets of at least that similarity, exactly; with ``side``, between sides only.
    Elements of one set alone add to no intersection; the others are columns of 0/1 matrices whose
    product counts them, a bounded number of columns at a time."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.append(True, every[1:] != every[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    common = np.zeros((n, n), np.float32)
    width = VERIFIED_COLUMNS
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            x = np.zeros((n, min(width, int(column[hi - 1] - column[lo]) + 1)), np.float32)
            x[owner[lo:hi], column[lo:hi] - column[lo]] = 1
            common += x @ x.T
    a, b = np.nonzero(np.triu(common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-3, 1))
    exact = common[a, b].astype(np.float64)
    keep = (exact > 0) & (exact >= threshold * (sizes[a] + sizes[b] - exact) - 1e-9)
    if side is not None:
        keep &= side[a] != side[b]
    return a[keep], b[keep]
