"""The operators of this subpackage as registered queries over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmend.llm import (
    context_tree, edit_embedding, impact_search, line_resampling, minhash_forest, pu_quality, sentence_spans, simhash_windows, site_templates, surrogates,
    toxicity, warc)
from quillmend.llm.common import remainder
from quillmend.llm.piece_bpe import encode_documents

PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def classified(spark: SparkSession, folder: str, operator, label: str, threshold: float) -> DataFrame:
    """Scores of all documents by a model that learns labels of three parts of four."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, folder, "labels").select("doc_id", label).where(~held_out)
    model = operator.train(docs, labels, label=label)
    return operator.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


#: Keys are parameters; this one makes the registered query repeatable.
SURROGATE_KEY = b"registered query"


def op1_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, folder, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return classified(spark, folder, toxicity, "toxic", 0.3)


def op3_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_spans.remove_repeated_spans(table(spark, folder, "documents").select("doc_id", "text"))


def op4_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    return warc.deduplicate(pages).select(
        F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op5_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 1
    return context_tree.score_documents(docs, ~held_out).withColumn("held_out", held_out)


def op6_simhash_windows(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_windows.find_leaks(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classified(spark, folder, pu_quality, "quality", 0.7)


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path(PIECES), keep_ids=False, keep_decoded=False).drop("text")


def op9_edit_embedding(spark: SparkSession, folder: str) -> DataFrame:
    prints = edit_embedding.fingerprint_documents(table(spark, folder, "documents").select("doc_id", "text"))
    return edit_embedding.near_classes(prints)


def op10_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_forest.similarity_join(table(spark, folder, "documents").select("doc_id", "text"))


def op11_site_templates(spark: SparkSession, folder: str) -> DataFrame:
    return site_templates.extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))


def op12_impact_search(spark: SparkSession, folder: str) -> DataFrame:
    return impact_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_line_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return line_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_toxicity": op2_toxicity,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_context_tree": op5_context_tree,
    "op6_simhash_windows": op6_simhash_windows,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_edit_embedding": op9_edit_embedding,
    "op10_minhash_forest": op10_minhash_forest,
    "op11_site_templates": op11_site_templates,
    "op12_impact_search": op12_impact_search,
    "op13_line_resampling": op13_line_resampling,
}

OP3_SQL = r"""
WITH cut AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+') AS pieces FROM documents),
leveled AS (
    SELECT *, list_transform(pieces, lambda x: trim(regexp_replace(x, '[ \t\r\n\f\v]+', ' ', 'g'))) AS level FROM cut),
counted AS (
    SELECT doc_id, level, unnest(range(1, len(level) + 1)) AS pos FROM leveled),
words AS (
    SELECT doc_id, pos, level[pos] AS sentence,
        CASE WHEN level[pos] = '' THEN 0 ELSE length(level[pos]) - length(replace(level[pos], ' ', '')) + 1 END AS w
    FROM counted),
sums AS (
    SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM words),
ends AS (
    SELECT a.doc_id, a.pos, min(b.pos) AS stop
    FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.upto - a.upto + a.w >= 10
    GROUP BY a.doc_id, a.pos),
spans AS (
    SELECT e.doc_id, e.pos, e.stop,
        list_aggregate(list_filter(list_slice(l.level, e.pos, e.stop), lambda x: x <> ''), 'string_agg', ' ') AS run
    FROM ends e JOIN leveled l USING (doc_id)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM spans),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, stop + 1)) AS pos FROM ranked WHERE nth > 1),
lists AS (
    SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id)
SELECT l.doc_id,
    CASE WHEN g.gone IS NULL THEN l.text ELSE array_to_string(
        list_transform(list_filter(range(1, len(l.pieces) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: l.pieces[i]), '') END AS text,
    CAST(len(l.pieces) AS BIGINT) AS n_sentences, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed
FROM leveled l LEFT JOIN lists g USING (doc_id)
"""

OP4_SQL = """
WITH sized AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
firsts AS (
    SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""

OP12_SQL = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents),
docs AS (SELECT doc_id, r, t, len(t) AS n FROM words WHERE len(t) > 0),
sizes AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY item_id, term),
postings AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM postings, sizes GROUP BY term, big_n),
scores AS (
    SELECT a.item_id, d.doc_id, d.r, CAST(sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * d.n * s.big_n) // s.big_l)))) AS BIGINT) AS score
    FROM asked a JOIN postings p USING (term) JOIN weights w USING (term) JOIN docs d USING (r) CROSS JOIN sizes s
    GROUP BY a.item_id, d.doc_id, d.r),
ranked AS (
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op12_impact_search": OP12_SQL,
    "op3_sentence_spans": OP3_SQL,
    "op4_warc_revisits": OP4_SQL,
}
