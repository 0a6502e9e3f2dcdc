"""From documents to tokens: five stages, each written and read again before the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmend.llm import minhash_forest, pu_quality, simhash_windows, surrogates
from quillmend.llm.common import stored
from quillmend.llm.piece_bpe import encode_documents
from quillmend.llm.queries import PIECES, SURROGATE_KEY, table

LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from all labelled documents."""
    model = pu_quality.train(docs, table(spark, sf_dir, "labels"))
    return pu_quality.score(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id, of documents that share the
    id that of the least digest. Documents without an id are judged as others are, and come last."""
    return minhash_forest.first_of_classes(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return simhash_windows.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data and secrets; n_chars follows the text."""
    changed = surrogates.replace_entities(docs, SURROGATE_KEY, count="_entities")
    return changed.withColumn("n_chars", F.when(F.col("_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the digests of ids and decoded texts."""
    return encode_documents(docs, public_tokenizers.path(PIECES), keep_decoded=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("surrogates", private),
    ("sentencepiece", encode),
]

#: SQL has no means for classifiers, keyed digests of spans and merge-type vocabularies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k + 1 < len(STAGES) else docs
    return docs
