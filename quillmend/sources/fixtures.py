"""The curation tables derived from the test tables (``documents``, ``pages``, ``nation``...).

Used by the registered queries, the benchmark and the tests. Each view reads its base table
once and computes its rows with built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

GEONAMES = "valuesuggest:geonames:geonames"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("""
        SELECT doc_id + 1 AS id, 'items' AS resource_name,
               NULLIF(CAST(doc_id % 7 AS INT), 0) AS owner_id,
               CAST(doc_id % 4 AS INT) AS resource_class_id,
               CAST(NULL AS INT) AS resource_template_id,
               CASE WHEN doc_id % 3 = 0 THEN CAST(100 + doc_id % 2 AS INT) END AS thumbnail_id,
               p.page_id + 20000000 AS primary_media_id,
               source || ' ' || CAST(doc_id AS STRING) AS title, doc_id % 10 <> 0 AS is_public
        FROM {documents} d LEFT JOIN {pages} p ON p.page_id = d.doc_id * 4
        UNION ALL
        SELECT page_id + 20000000, 'media', 1, NULL, NULL, NULL, NULL,
               'Page ' || CAST(page_id AS STRING), page_id % 3 <> 0 FROM {pages}
        UNION ALL
        SELECT CAST(r_regionkey AS BIGINT) + 30000000, 'item_sets', 1, NULL, NULL, NULL, NULL,
               r_name, TRUE FROM {region}
        """, documents=table(spark, sf_dir, "documents"), pages=table(spark, sf_dir, "pages"),
        region=table(spark, sf_dir, "region"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("""
        SELECT page_id + 20000000 AS id, CAST(FLOOR(page_id / 4.0) AS BIGINT) + 1 AS item_id,
               CAST(page_id % 4 + 1 AS BIGINT) AS position,
               'Page ' || CAST((page_id * 7) % 12 AS STRING) AS title, url AS source,
               CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png'
                                WHEN 2 THEN 'application/pdf' ELSE 'text/html' END AS media_type,
               CASE page_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png'
                                WHEN 2 THEN 'pdf' ELSE 'html' END AS extension,
               CASE page_id % 4 WHEN 3 THEN 'html' WHEN 2 THEN 'upload' ELSE 'url' END AS ingester,
               CASE page_id % 4 WHEN 3 THEN 'html' ELSE 'file' END AS renderer,
               page_id % 3 <> 0 AS is_public,
               html
        FROM {pages}
        """, pages=table(spark, sf_dir, "pages"))


def page_counts(media_table: DataFrame) -> DataFrame:
    return media_table.where("media_type = 'application/pdf'").select(
        F.col("id").alias("media_id"), (F.col("id") % 5).cast("int").alias("page_count"))


def _row(k: int, prop: str, pos: int, *, kind: str = "literal", lang: str = "NULL",
         value: str = "NULL", uri: str = "NULL", link: str = "NULL", keep: str = "true") -> str:
    return (f"struct(doc_id * 20 + {k} AS value_id, '{prop}' AS property, {pos}L AS pos,"
            f" '{kind}' AS type, CAST({lang} AS STRING) AS lang, CAST({value} AS STRING) AS value,"
            f" CAST({uri} AS STRING) AS uri, CAST({link} AS BIGINT) AS value_resource_id,"
            f" {keep} AS keep)")


N = "CAST(doc_id AS STRING)"
PERSON = "CAST(doc_id % 97 AS STRING)"

# The values a document has by itself.
OWN_VALUES = (
    _row(0, "dcterms:title", 0, lang="lang", value="text"),
    _row(1, "dcterms:title", 1, lang="'en'", value=f"'Title ' || {N}"),
    _row(2, "dcterms:title", 2, lang="'de'", value=f"'Titel ' || {N}", keep="doc_id % 2 = 1"),
    _row(3, "dcterms:description", 0, value="text", lang="if(doc_id % 6 = 0, '', lang)"),
    _row(4, "dcterms:source", 0,
         value="if(doc_id % 5 = 0, '  ' || source || chr(9) || chr(160), source)"),
    _row(5, "dcterms:source", 1, value="source", keep="doc_id % 4 = 0"),
    _row(6, "dcterms:source", 2, value="upper(source)", keep="doc_id % 8 = 0"),
    _row(7, "dcterms:subject", 0, lang="lang",
         value="source || ';' || lang || '; ;kw' || CAST(doc_id % 13 AS STRING)"),
    _row(8, "dcterms:identifier", 0, value=f"'doc-' || lpad({N}, 8, '0')"),
    _row(9, "dcterms:isPartOf", 0,
         value="'files/doc-' || lpad(CAST(doc_id div 2 AS STRING), 8, '0') || '.pdf'"),
    _row(10, "dcterms:relation", 0, kind="resource", link="30000000 + doc_id % 5"),
    _row(12, "dcterms:creator", 0, value=f"'Name ' || {PERSON}"),
    _row(13, "dcterms:creator", 1, value=f"'https://example.org/p/' || {PERSON}",
         keep="doc_id % 5 <> 1"),
    _row(14, "dcterms:spatial", 0, kind=GEONAMES, value="if(doc_id % 3 <> 0, 'Old label', NULL)",
         uri="'https://www.geonames.org/' || CAST(1000 + doc_id % 25 AS STRING)"
             " || if(doc_id % 2 = 0, '/x.html', '')"),
    _row(16, "dcterms:abstract", 0, lang="lang",
         value="CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE text END"),
    _row(17, "dcterms:alternative", 0, value=f"if(doc_id % 2 = 0, 'cafÃ© ', 'café ') || {N}"),
)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 15 values per document: several languages, padded and repeated text, links, uris,
    name and address pairs, damaged characters, blanks."""
    reference = _row(11, "dcterms:references", 0, kind="uri", uri="url",
                     value=f"if(doc_id % 2 = 1, 'Ref ' || {N}, NULL)")
    coverage = _row(15, "dcterms:coverage", 0, value="n_name")
    return spark.sql(f"""
        SELECT value_id, doc_id + 1 AS resource_id, property, pos, type, lang, value, uri,
               value_resource_id, doc_id % 11 <> 0 AS is_public,
               if(doc_id % 32 = 0 AND value_id % 20 = 5, 40000000 + doc_id, NULL)
                   AS value_annotation_id
        FROM (SELECT doc_id, inline(array({", ".join(OWN_VALUES)})) FROM {{documents}}
              UNION ALL
              SELECT doc_id, inline(array({reference})) FROM {{documents}}
              JOIN {{pages}} ON page_id = doc_id
              UNION ALL
              SELECT doc_id, inline(array({coverage})) FROM {{documents}}
              JOIN {{nation}} ON n_nationkey = doc_id % 25)
        WHERE keep""", documents=table(spark, sf_dir, "documents"),
        pages=table(spark, sf_dir, "pages"), nation=table(spark, sf_dir, "nation"))


def annotation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return (table(spark, sf_dir, "documents").where((doc % 16).isin(4, 8))
            .select("doc_id", F.explode(F.array(F.lit(4), F.lit(5))).alias("k"))
            .select((doc * 20 + F.col("k")).alias("id"), (doc + 1).alias("annotation_id"),
                    F.when((doc % 16 == 4) | (F.col("k") == 4), "body").otherwise("target")
                    .alias("field"), F.lit(1).cast("short").alias("ordinal")))


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"""
        SELECT '{GEONAMES}' AS datatype,
               'https://www.geonames.org/' || CAST(1000 + n_nationkey AS STRING) AS uri,
               'name' AS kind, CAST(NULL AS STRING) AS lang, n_name AS label, 3 AS priority
        FROM {{nation}}
        UNION ALL
        SELECT '{GEONAMES}', 'https://www.geonames.org/' || CAST(1000 + n_nationkey AS STRING),
               'official', 'fr', 'FR ' || n_name, 1 FROM {{nation}} WHERE n_nationkey % 2 = 0
        UNION ALL
        SELECT '{GEONAMES}', 'https://www.geonames.org/' || CAST(2000 + n_nationkey AS STRING),
               'name', NULL, n_name, 3 FROM {{nation}} WHERE n_nationkey % 5 = 0
        """, nation=table(spark, sf_dir, "nation"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("""
        SELECT CAST(1000 + n_nationkey AS BIGINT) AS geoname_id, n_name AS toponym,
               r_name AS country, CAST(n_nationkey AS DOUBLE) + 0.5 AS lat,
               CAST(n_nationkey AS DOUBLE) - 12.25 AS lon
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        """, nation=table(spark, sf_dir, "nation"), region=table(spark, sf_dir, "region"))


def values_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four short values per order (the benchmark table)."""
    return spark.sql("""
        SELECT o_orderkey * 10 + k AS value_id, o_custkey AS resource_id,
               CASE k WHEN 0 THEN 'ex:status' WHEN 1 THEN 'ex:priority'
                      WHEN 2 THEN 'ex:month' ELSE 'ex:list' END AS property,
               CAST(NULL AS BIGINT) AS pos, 'literal' AS type,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'en' END AS lang,
               CASE k WHEN 0 THEN o_orderstatus
                      WHEN 1 THEN CASE WHEN o_orderkey % 7 = 0
                                       THEN '  ' || lower(o_orderpriority) || ' '
                                       ELSE o_orderpriority END
                      WHEN 2 THEN substr(CAST(o_orderdate AS STRING), 1, 7)
                      ELSE o_orderstatus || ';' || o_orderpriority || ';'
                           || substr(CAST(o_orderdate AS STRING), 1, 7) END AS value,
               CAST(NULL AS STRING) AS uri, CAST(NULL AS BIGINT) AS value_resource_id,
               TRUE AS is_public, CAST(NULL AS BIGINT) AS value_annotation_id
        FROM {orders} LATERAL VIEW explode(array(0, 1, 2, 3)) AS k
        """, orders=table(spark, sf_dir, "orders"))
