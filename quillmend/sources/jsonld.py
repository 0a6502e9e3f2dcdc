"""Records as JSON-LD documents, one per line.

A document holds, per term, the ordered list of its values. A record with very many values is
written as several documents (``o:part`` 0, 1, 2...), each with the place its lists begin at
(``o:start``), so that no row or task has to hold a record whole. Nothing of a values table is lost:
a position that is not the place in the list, identifiers and a missing visibility are written too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmend import schema
from quillmend.operators import _shared as s

# Values of one term in one document.
PART_ROWS = 1000

# Ids of changed records that are sent to all tasks; more of them meet the documents in a shuffle.
FEW_IDS = 1_000_000

# Keys of a value in a document and their types. The last four say what the place
# in the list does not: identifier, annotation, another position, no visibility.
VALUE_KEYS = ("type STRING, is_public STRING, value_resource_id BIGINT, `@id` STRING,"
              " `o:label` STRING, `@value` STRING, `@language` STRING, `o:value_id` BIGINT,"
              " `o:annotation_id` BIGINT, `o:pos` STRING, `o:is_public` STRING")
NONE = "none"


def to_jsonld(values: DataFrame, *, types: schema.DataTypes = schema.DEFAULT_TYPES,
              part_rows: int = PART_ROWS) -> DataFrame:
    """Documents (resource_id, part, json) of a values table.

    Values are listed by position, those without one behind the others. A row without a property
    stands under an empty term.
    """
    is_uri = types.main_column(F.col("type")) == "uri"
    noted = s.group_rows(values) is not None
    group, record = s.largest_record(values)
    if record <= s.BLOCK_ROWS:
        # Every record fits in one task: numbering, lists and documents share one shuffle of the rows.
        values = s.stamp(values.repartition("resource_id"), group)
    placed = s.in_order(values, noted)
    entry = F.struct(
        F.col("_at"), F.col("type"), F.col("is_public"), F.col("value_resource_id"),
        F.col("uri").alias("@id"), F.when(is_uri, F.col("value")).alias("o:label"),
        F.when(~is_uri, F.col("value")).alias("@value"), F.col("lang").alias("@language"),
        F.col("value_id").alias("o:value_id"), F.col("value_annotation_id").alias("o:annotation_id"),
        F.when(~F.col("pos").eqNullSafe(F.col("_at")), F.coalesce(F.col("pos").cast("string"), F.lit(NONE))).alias("o:pos"),
        F.when(F.col("is_public").isNull(), F.lit(NONE)).alias("o:is_public"))
    listed = (placed.withColumns({"part": F.floor(F.col("_at") / part_rows).cast("int"),
                                  "property": F.coalesce("property", F.lit(""))})
              .groupBy("resource_id", "part", "property")
              .agg(F.sort_array(F.collect_list(entry)).alias("_list"))
              .withColumn("_list", F.transform("_list", lambda v: v.dropFields("_at"))))
    documents = listed.groupBy("resource_id", "part").agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct("property", "_list")))).alias("_terms"))
    start = F.col("part").cast("long") * part_rows
    return documents.select("resource_id", "part", F.concat(
        _head(F.col("part"), start), F.lit(","), F.substring(F.to_json("_terms"), 2, 2147483647)).alias("json"))


def _head(part, start):
    """Beginning of a document, up to the keys of its content."""
    return F.concat(
        F.lit('{"o:id":'), F.coalesce(F.col("resource_id").cast("string"), F.lit("null")),
        F.when(part > 0, F.concat(F.lit(',"o:part":'), part.cast("string"), F.lit(',"o:start":'), start.cast("string")))
        .otherwise(F.lit("")))


def from_jsonld(documents: DataFrame, column: str = "json", *,
                types: schema.DataTypes = schema.DEFAULT_TYPES,
                part_rows: int = PART_ROWS) -> DataFrame:
    """A values table from documents. Terms are the keys that hold a list of values and do not begin
    with ``o:`` or ``@``. Visibility is public where a value does not state it. `part_rows` is
    only used for parts that do not say where they begin."""
    keys = F.from_json(F.col(column), "MAP<STRING, STRING>")

    def number(key: str):
        return F.get_json_object(column, f"$['{key}']").cast("long")

    entries = documents.select(
        number("o:id").alias("resource_id"),
        F.coalesce(number("o:start"), number("o:part") * part_rows, F.lit(0)).alias("_start"),
        F.explode(keys).alias("property", "_json"))
    terms = entries.where(~F.col("property").startswith("o:") & ~F.col("property").startswith("@")
                          & F.col("_json").startswith("[{"))
    rows = terms.select(
        "resource_id", F.nullif("property", F.lit("")).alias("property"), "_start",
        F.posexplode(F.from_json("_json", f"ARRAY<STRUCT<{VALUE_KEYS}>>")).alias("_i", "v"))
    is_uri = types.main_column(F.col("v.type")) == "uri"
    place = F.col("v.`o:pos`")
    return rows.select(
        F.col("v.`o:value_id`").alias("value_id"), "resource_id", "property",
        F.when(place.isNull(), F.col("_start") + F.col("_i")).otherwise(place.try_cast("long")).alias("pos"),
        F.col("v.type").alias("type"), F.col("v.`@language`").alias("lang"),
        F.when(is_uri, F.coalesce("v.`o:label`", "v.`@value`")).otherwise(F.col("v.`@value`"))
        .alias("value"),
        F.col("v.`@id`").alias("uri"), F.col("v.value_resource_id").alias("value_resource_id"),
        F.when(F.col("v.`o:is_public`").isNull(), F.coalesce(F.col("v.is_public").try_cast("boolean"), F.lit(True)))
        .alias("is_public"),
        F.col("v.`o:annotation_id`").alias("value_annotation_id"))


# ---------------------------------------------------------------- pending edits

def overlay(documents: DataFrame, pending: DataFrame, column: str = "json") -> DataFrame:
    """Documents (resource_id, part, json) with pending edits laid over them.

    A key of a pending document replaces that key of its record whole, in all parts; other keys
    stay, new keys and new records are added. Documents of records without pending edits pass
    untouched, byte for byte; only the others are opened, shuffled and put together again. A
    document without a record's id passes too.
    """
    base, delta = _identified(documents, column), _identified(pending, column)
    ids = delta.where("resource_id IS NOT NULL").select("resource_id").distinct()
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    untouched = base.join(ids, "resource_id", "left_anti")
    old, new = _keys(base.join(ids, "resource_id", "left_semi")), _keys(delta)
    replaced = new.select("resource_id", "key").distinct()
    kept = old.join(replaced, ["resource_id", "key"], "left_anti").select(*new.columns)
    member = F.concat(F.lit(","), F.col("_name"), F.lit(":"), F.col("content"))
    merged = (kept.unionByName(new).withColumn("_name", F.substr(F.to_json(F.array("key")), F.lit(2), F.length(F.to_json(F.array("key"))) - 2))
              .groupBy("resource_id", "part", "start")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", member.alias("member")))),
                                            lambda m: m["member"]), "").alias("_members")))
    rebuilt = merged.select("resource_id", "part", F.concat(
        _head(F.col("part"), F.col("start")), "_members", F.lit("}")).alias("json"))
    return untouched.select("resource_id", "part", "json").unionByName(rebuilt)


def _identified(documents: DataFrame, column: str) -> DataFrame:
    def number(key: str):
        return F.get_json_object(column, f"$['{key}']").cast("long")

    part = F.coalesce(number("o:part"), F.lit(0)).cast("int")
    return documents.select(
        number("o:id").alias("resource_id"), part.alias("part"),
        F.coalesce(number("o:start"), number("o:part") * PART_ROWS, F.lit(0)).alias("start"), F.col(column).alias("json"))


def _keys(documents: DataFrame) -> DataFrame:
    """One row per key of a document, with its content as JSON text."""
    return documents.sparkSession.sql("""
        SELECT resource_id, part, start, key, to_json(value) AS content
        FROM {documents}, LATERAL variant_explode(try_parse_json(json)) AS member(pos, key, value)
        WHERE resource_id IS NOT NULL AND key NOT IN ('o:id', 'o:part', 'o:start')
        """, documents=documents)


def write_jsonld(values: DataFrame, folder: str, **options) -> None:
    to_jsonld(values, **options).select("json").write.text(folder)


def read_jsonld(spark, folder: str, **options) -> DataFrame:
    return from_jsonld(spark.read.text(folder), "value", **options)
