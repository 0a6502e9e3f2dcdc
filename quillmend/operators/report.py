"""Counts of changed rows and distinct choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def facets(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, in order."""
    return df.select(column).distinct().orderBy(column)


def changes(before: DataFrame, after: DataFrame, key: str = "value_id") -> DataFrame:
    """One row: how many rows were added, removed and changed between two states of a table.

    Both states are stacked and grouped by the key, so nothing wide is shuffled: a row travels
    as its key and a fingerprint of its columns. Rows without a key are counted by what they say:
    of rows with the same fingerprint, those that one state has more of were added or removed.
    A mere change of position is no change.
    """
    columns = [name for name in before.columns if name not in (key, "pos")]

    def prints(df: DataFrame, side: int):
        # Nulls are spelled out, so that a null and a neighbour's text cannot be confused.
        whole = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        return df.select(F.col(key).alias("_key"), F.lit(side).alias("_side"), whole.alias("_print"))

    stacked = prints(before, 0).unionByName(prints(after, 1))
    loose = F.when(F.col("_key").isNull(), F.col("_print"))
    more = F.when(F.col("_key").isNull(), F.sum(F.col("_side") * 2 - 1)).otherwise(F.lit(0))
    compared = stacked.groupBy("_key", loose.alias("_loose")).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_print"))).alias("_old"),
        F.max(F.when(F.col("_side") == 1, F.col("_print"))).alias("_new"), more.alias("_more"))
    saved = F.col("_key").isNotNull()
    count = F.lit(0).cast("long")
    return compared.agg(
        F.coalesce(F.sum(F.when(saved, F.col("_old").isNull().cast("long")).otherwise(
            F.greatest(F.col("_more"), count))), count).alias("added"),
        F.coalesce(F.sum(F.when(saved, F.col("_new").isNull().cast("long")).otherwise(
            F.greatest(-F.col("_more"), count))), count).alias("removed"),
        F.count_if(saved & (F.col("_old") != F.col("_new"))).alias("changed"))
