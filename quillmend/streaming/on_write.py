"""Cleaning of records as they are saved: trim, precise link types, optional deduplication.

A record is one row with its values in an array column ``values`` of structs (property, type,
lang, value, uri, value_resource_id, is_public and any other field). Everything happens inside
one record, so no state outlives a batch and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmend import schema
from quillmend.functions import text
from quillmend.operators._shared import zero


def _trimmed(c: Column) -> Column:
    return text.blank_to_null(text.trim_unicode(c))


def clean_on_write(records: DataFrame, resources: DataFrame, *, key: str = "record_id",
                   deduplicate: bool = False) -> DataFrame:
    """Clean a batch of records. `key` names a column that is unique per row of the batch.

    Only the link targets leave the record: they are looked up, gathered again as a small map
    per record, and applied in place.
    """
    def trim(v: Column) -> Column:
        return v.withField("value", _trimmed(v["value"])).withField(
            "uri", _trimmed(v["uri"])).withField("lang", _trimmed(v["lang"]))

    trimmed = records.withColumn("values", F.transform("values", trim))
    generic = F.filter("values", lambda v: (v["type"] == "resource")
                       & v["value_resource_id"].isNotNull())
    links = trimmed.select(key, F.explode(F.array_distinct(F.transform(
        generic, lambda v: v["value_resource_id"]))).alias("_link"))
    kinds = resources.select(F.col("id").alias("_link"), schema.mapped(
        F.col("resource_name"), schema.LINK_TYPES).alias("_type")).where("_type IS NOT NULL")
    # Records may share a key, and rows of the resources an id: one type for each link.
    found = links.join(kinds, "_link").groupBy(key, "_link").agg(F.min("_type").alias("_type")).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("_link", "_type"))).alias("_types"))

    def specify(v: Column) -> Column:
        known = F.try_element_at(F.col("_types"), v["value_resource_id"])
        return v.withField("type", F.when(v["type"] == "resource", F.coalesce(known, v["type"]))
                           .otherwise(v["type"]))

    result = trimmed.join(found, key, "left").withColumn(
        "values", F.when(F.col("_types").isNull(), F.col("values"))
        .otherwise(F.transform("values", specify)))
    if deduplicate:
        result = result.withColumn("values", F.array_distinct("values"))
    return result.select(*records.columns)


def clean_values_on_write(values: DataFrame, resources: DataFrame) -> DataFrame:
    """Trim and specify single values, batch or stream (a stateless stream–static join)."""
    trimmed = values.withColumns({
        name: _trimmed(F.col(name)) for name in ("value", "uri", "lang")})
    kinds = resources.select(F.col("id").alias("_link"), schema.mapped(
        F.col("resource_name"), schema.LINK_TYPES).alias("_kind"))
    link = F.when(F.col("type") == "resource", F.col("value_resource_id"))
    # Values that are no links have no key; they are spread over the tasks of the join.
    spread = F.when(link.isNull(), F.hash("resource_id", "property", "value")).otherwise(F.lit(0))
    joined = trimmed.withColumns({"_to": link, "_spread": spread}).join(
        kinds.withColumn("_none", zero("_link")),
        (F.col("_to") == F.col("_link")) & (F.col("_spread") == F.col("_none")), "left")
    return joined.withColumn("type", F.coalesce("_kind", "type")).select(*values.columns)


def start_cleaning(records: DataFrame, resources: DataFrame, sink: Callable[[DataFrame, int], None],
                   checkpoint: str, *, key: str = "record_id", deduplicate: bool = False,
                   trigger: dict | None = None) -> StreamingQuery:
    """Clean a stream of records batch by batch and hand each clean batch to `sink(batch, id)`.

    The sink should replace what it wrote for the same batch id: a batch is repeated after a
    failure.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        sink(clean_on_write(batch, resources, key=key, deduplicate=deduplicate), batch_id)

    return (records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def parquet_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per batch, overwritten when the batch is repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write
