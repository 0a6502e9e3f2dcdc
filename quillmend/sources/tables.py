"""Curation tables as parquet folders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmend import schema
from quillmend.operators import _shared as s

SCHEMAS = {
    "values": schema.VALUES,
    "resources": schema.RESOURCES,
    "media": schema.MEDIA,
    "annotation_values": schema.ANNOTATION_VALUES,
    "authority": schema.AUTHORITY,
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in canonical order and type; absent ones are null."""
    return df.select(*[
        (F.col(field.name) if field.name in df.columns else F.lit(None))
        .cast(field.dataType).alias(field.name) for field in SCHEMAS[name].fields])


def with_positions(values: DataFrame) -> DataFrame:
    """Give values that come without positions (a database table) the order of their ids."""
    return s.close_up(conform(values, "values"))


def read_tables(spark: SparkSession, folder: str, names=("values", "resources", "media")) -> dict:
    return {name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") for name in names}


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write each table; values are kept together by record, in order, so that scans of some
    records and later groupings by record touch few row groups."""
    for name, df in tables.items():
        if name == "values":
            # By ranges of all three: a record larger than a partition is split.
            df = df.repartitionByRange("resource_id", "property", "pos").sortWithinPartitions(
                "resource_id", "property", "pos")
        df.write.parquet(f"{folder}/{name}")


def property_terms(values: DataFrame, properties: DataFrame) -> DataFrame:
    """Replace a numeric ``property_id`` by its term. Values of unknown properties stay, under the
    name ``property:`` and the number.

    `properties` holds id and term, one row per property of the vocabulary.
    """
    terms = properties.select(F.col("id").alias("property_id"), F.col("term").alias("property"))
    unknown = F.concat(F.lit("property:"), F.coalesce(F.col("property_id").cast("string"), F.lit("")))
    named = values.join(terms, "property_id", "left")
    return named.withColumn("property", F.coalesce("property", unknown)).drop("property_id")


# ---------------------------------------------------------------- write back

def write_buckets(values: DataFrame, folder: str, buckets: int = 256) -> None:
    """Write a values table whose files hold the records of one bucket each, so that an edit of some
    records rewrites some files (see :func:`write_changed`)."""
    _write(values, folder, buckets, "errorifexists")


def read_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _with_buckets(spark, folder).select(*schema.VALUES.names)


def _with_buckets(spark: SparkSession, folder: str) -> DataFrame:
    parted = "buckets INT, bucket INT"
    return spark.read.schema(schema.VALUES.simpleString()[7:-1].replace(":", " ") + ", " + parted).parquet(folder)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("resource_id"), F.lit(buckets)).cast("int")


def _write(values: DataFrame, folder: str, buckets: int, mode: str) -> None:
    placed = conform(values, "values").withColumns({"buckets": F.lit(buckets), "bucket": _bucket(buckets)})
    # By ranges: the bucket of a record larger than a partition is written by several tasks.
    order = ["bucket", "resource_id", "property", "pos"]
    (placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode)
     .option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(folder))


def _prints(values: DataFrame, name: str) -> DataFrame:
    """Rows of each bucket and sums of two hashes of all they say: equal for equal rows in any order."""
    def total(*seed):
        return F.sum(F.xxhash64(*seed, *schema.VALUES.names).cast("decimal(38,0)"))

    return values.groupBy("bucket").agg(F.struct(
        F.count(F.lit(1)).alias("rows"), total().alias("a"), total(F.lit(1)).alias("b")).alias(name))


def write_changed(values: DataFrame, folder: str) -> DataFrame:
    """Make the table in `folder` (of :func:`write_buckets`) hold `values`, writing only buckets
    that differ. Returns (bucket, rows_before, rows_after) of these.

    `values` may be planned from the same folder: the buckets are replaced when all of them are
    written, and the files of the others are not touched. Bucket sizes, not rows, reach the driver.
    Calling it again changes nothing; a call that was cut off is repeated with a table that does
    not depend on the folder (a checkpoint), or with an edit that may be applied twice.
    """
    spark = values.sparkSession
    before = _with_buckets(spark, folder)
    known = before.select("buckets").first()
    if known is None:
        raise ValueError(f"no table of buckets in {folder}")
    buckets = known[0]
    # Compared, sampled and written, but computed once.
    values = conform(values, "values").persist(StorageLevel.DISK_ONLY)
    try:
        return _write_changed(values, before, folder, buckets)
    finally:
        values.unpersist()


def _write_changed(values: DataFrame, before: DataFrame, folder: str, buckets: int) -> DataFrame:
    spark = values.sparkSession
    prints = _prints(before, "old").join(_prints(values.withColumn("bucket", _bucket(buckets)), "new"), "bucket", "full")
    changed = prints.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        "bucket", F.coalesce("old.rows", F.lit(0)).alias("rows_before"), F.coalesce("new.rows", F.lit(0)).alias("rows_after")).collect()
    filled = [row["bucket"] for row in changed if row["rows_after"]]
    if filled:
        _write(values.where(_bucket(buckets).isin(filled)), folder, buckets, "overwrite")
    for row in changed:
        if not row["rows_after"]:
            # Nothing replaces a bucket that has no row left.
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/buckets={buckets}/bucket={row['bucket']}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.createDataFrame(changed, "bucket INT, rows_before BIGINT, rows_after BIGINT")
