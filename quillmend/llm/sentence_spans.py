"""Removal of repeated sentence spans.

A text is cut into sentences: stretches up to stops or line ends, with what blank follows. Every run
of consecutive sentences is hashed that begins at a sentence and is the shortest with at least
``sentences`` sentences and ``words`` words, white space being levelled. The hashes of all documents
are joined, and the sentences are removed that any repeated run covers which is not the first one:
the first is in the document of the least id, at its first place there.

Inside a document, repeats are seen at once, so a document sends each hash once, with its id and
no place. The least id of a hash is an aggregation with partial aggregation before the shuffle, and
the join back to it is one that adaptive execution may split, where a passage is in very many
documents. No group is ever collected but the repeated hashes of one document.

Defined cases: null texts stay null, empty ones empty. Texts without a long enough run keep all. Rows
that repeat the id of a first document keep their sentences as it does. Null ids come last; of rows
without an id, those of equal text are one document, others are documents of their own, in the order of
a hash. Ids may be of any type that has an order. Other columns are kept; ``n_sentences`` and
``n_removed`` replace columns of these names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmend.llm.common import stored

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+")

def runs(text: str, sentences: int, words: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of a text, and of each run its first and last sentence and 128 bits of hash."""
    pieces = SENTENCE.findall(text)
    level = [p.encode().split() for p in pieces]
    total = np.cumsum([0, *map(len, level)])
    first = np.arange(len(pieces))
    last = np.maximum(first + sentences - 1, np.searchsorted(total, total[:-1] + words) - 1)
    first, last = first[last < len(pieces)], last[last < len(pieces)]
    joined = [b" ".join(t) for t in level]
    hashed = b"".join(
        hashlib.md5(b" ".join(filter(None, joined[a:b + 1])), usedforsecurity=False).digest()
        for a, b in zip(first.tolist(), last.tolist()))
    return pieces, first, last, np.frombuffer(hashed, np.int64).reshape(-1, 2)


def remove_repeated_spans(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", sentences: int = 2,
                          words: int = 10) -> DataFrame:
    """``docs`` with what is left of ``text``, ``n_sentences`` (before) and ``n_removed``."""
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    # Names of our own, so that columns may be called anything.
    own_names = [f"c{k}" for k in range(len(kept))]
    doc = docs[id_column]
    # Rows without an id are told apart by their text.
    nameless = F.when(doc.isNull(), F.xxhash64(docs[text]))
    id_type = docs.schema[id_column].dataType
    named = docs.select(*[docs[c].alias(name) for c, name in zip(kept, own_names)], doc.alias("doc"), nameless.alias("sub"))
    at_text = own_names[kept.index(text)]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes = [], []
            for row, content in enumerate(batch.column("text")):
                content = content.as_py()
                own = runs(content, sentences, words)[3] if content else ()
                if len(own):
                    own = np.unique(own, axis=0)
                    hashes.append(own)
                    rows.append(np.full(len(own), row))
            if rows:
                both, at = np.concatenate(hashes), pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("sub").take(at), pa.array(both[:, 0]), pa.array(both[:, 1])],
                    names=["doc", "sub", "h", "g"])

    shape = T.StructType([T.StructField("doc", id_type), *(T.StructField(n, T.LongType()) for n in ("sub", "h", "g"))])
    found = stored(named.select("doc", "sub", F.col(at_text).alias("text")).mapInArrow(spans, shape))
    first = (found.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("sub").alias("least"), F.max("sub").alias("most"))
             .where("first < last OR (first IS NOT NULL AND most IS NOT NULL) OR (first IS NULL AND least < most)").select("h", "g", "first", "least"))
    again = found.join(first.hint("merge"), ["h", "g"]).where(
        "doc > first OR (doc IS NULL AND (first IS NOT NULL OR sub > least))").select("doc", "sub", "h")
    per_doc = again.groupBy(F.col("doc").alias("at_doc"), F.col("sub").alias("at_sub")).agg(F.collect_set("h").alias("again"))
    marked = named.join(per_doc.hint("merge"), named["doc"].eqNullSafe(per_doc["at_doc"]) & named["sub"].eqNullSafe(per_doc["at_sub"]), "left").select(
        *own_names, "again")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, removed = [], [], []
            for content, again in zip(batch.column(at_text), batch.column("again")):
                content, again = content.as_py(), again.as_py()
                pieces, first, last, hashed = runs(content or "", sentences, words)
                own = hashed[:, 0]
                gone = np.zeros(len(pieces) + 1, np.int64)
                if len(own):
                    repeated = np.ones(len(own), bool)
                    repeated[np.unique(own, return_index=True)[1]] = False
                    repeated |= np.isin(own, np.array(again or [], np.int64))
                    np.add.at(gone, first[repeated], 1)
                    np.add.at(gone, last[repeated] + 1, -1)
                covered = np.cumsum(gone[:-1]) > 0
                n = int(covered.sum())
                texts.append("".join(p for p, c in zip(pieces, covered.tolist()) if not c) if n else content)
                before.append(len(pieces))
                removed.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == at_text else batch.column(c) for c in own_names]
                + [pa.array(before, pa.int64()), pa.array(removed, pa.int64())], names=[*own_names, "n_sentences", "n_removed"])

    schema = T.StructType([*(T.StructField(name, docs.schema[c].dataType) for c, name in zip(kept, own_names)),
                           T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return marked.mapInArrow(remove, schema).select(
        *[F.col(name).alias(c) for c, name in zip(kept, own_names)], "n_sentences", "n_removed")
