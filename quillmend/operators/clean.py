"""Set-based cleaning of a values table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmend import schema
from quillmend.functions import text
from quillmend.operators import _shared as s


def _edit(values: DataFrame, sel, properties, edits) -> DataFrame:
    marked, condition = s.scope(values, properties, sel)
    return marked.withColumns({
        name: F.when(condition, edit).otherwise(F.col(name)) for name, edit in edits.items()
    }).select(*values.columns)


def trim_values(values: DataFrame, *, sel=None, renumber: bool = True) -> DataFrame:
    """Trim Unicode white space of value, lang and uri, blank becomes null, then drop the
    selected rows that hold no value, uri or link."""
    marked, condition = s.selected(values, sel)
    trims = {name: F.when(condition, text.blank_to_null(text.trim_unicode(F.col(name))))
             .otherwise(F.col(name)) for name in ("value", "lang", "uri")}
    # Tested on the text as it was: the first visible character decides, nothing is trimmed twice.
    empty = (F.col("value_resource_id").isNull() & ~text.has_visible_text(F.col("value"))
             & ~text.has_visible_text(F.col("uri")))
    kept = (marked.where(~(condition & empty)).withColumns(trims).select(*values.columns))
    return s.close_up(kept) if renumber else kept


def clean_empty_values(values: DataFrame, *, sel=None) -> DataFrame:
    """Blank value and uri become null."""
    return _edit(values, sel, s.ALL, {
        name: text.blank_to_null(F.col(name)) for name in ("value", "uri")})


def clean_languages(values: DataFrame, *, sel=None) -> DataFrame:
    """Blank language becomes null."""
    return _edit(values, sel, s.ALL, {"lang": text.blank_to_null(F.col("lang"))})


def clean_language_codes(values: DataFrame, from_: str | None, to: str | None, properties, *,
                         sel=None) -> DataFrame:
    """Replace one language code. Blank `from_` means no language, blank `to` removes it."""
    lang = F.col("lang")
    if text_or_none(from_) is None:
        hit = lang.isNull() | (lang == "")
    else:
        hit = lang == from_
    return _edit(values, sel, properties, {
        "lang": F.when(hit, F.lit(text_or_none(to))).otherwise(lang)})


def text_or_none(parameter: str | None) -> str | None:
    return parameter or None


def specify_datatypes(values: DataFrame, resources: DataFrame, *, sel=None,
                      linked: DataFrame | None = None) -> DataFrame:
    """Give generic links the precise type of the record they point to.

    Only generic links are shuffled to the records; a link without a record keeps its type. `linked`
    is a values table that holds all links of `values`, as the one a chain starts from does while no
    edit makes new links: where they point to few records, no row is shuffled.
    """
    marked, condition = s.selected(values, sel)
    generic = condition & (F.col("type") == "resource") & F.col("value_resource_id").isNotNull()

    def specify(links: DataFrame) -> DataFrame:
        kinds = resources.select(
            F.col("id").alias("_record"),
            schema.mapped(F.col("resource_name"), schema.LINK_TYPES).alias("_kind"))
        if linked is not None:
            kinds = s.few_asked(kinds, "_record", linked.select("value_resource_id"))
        joined = s.lookup(links, F.col("value_resource_id"), kinds, "_record")
        return joined.withColumn("type", F.coalesce(F.col("_kind"), F.col("type")))

    return s.divert(marked, generic, specify, values.columns)


def deduplicate_values(values: DataFrame, *, annotation_values: DataFrame | None = None,
                       case_sensitive: bool = False, sel=None,
                       renumber: bool = True) -> DataFrame:
    """Keep one row per group of equal values: the smallest value_id, then position, then (rows that
    have neither) the one that `row_order` puts first.

    Equal values have equal prints of 256 bits, so rows shuffle by a print and carry their texts
    once. Each task keeps the first row of a print before the shuffle, so a value repeated a
    billion times sends one row per task. A table without hot groups is partitioned as numbering
    wants it instead; one that is renumbered is measured for that. Rows outside the selection all stay.
    """
    columns, bound = values.columns, s.group_rows(values)
    if renumber:
        values = s.measured(values)
    marked, condition = s.selected(values, sel)
    if annotation_values is not None:
        marked = _with_annotation_part(marked, annotation_values)

    def key(name: str) -> Column:
        return F.col(name) if case_sensitive else F.lower(F.col(name))

    compared = [F.col("value_resource_id"), key("type"), key("lang"), key("value"), key("uri"),
                F.col("is_public"), F.col("value_annotation_id")]
    if annotation_values is not None:
        compared += [F.col("_field"), F.col("_ordinal")]
    compared = {f"_key{i}": c for i, c in enumerate(compared)}
    first = [F.col("value_id").asc_nulls_last(), *s.row_order()]

    # Nulls are spelled out, so that a null and a neighbour's text cannot be confused.
    named = F.struct(*[c.alias(name) for name, c in compared.items()])
    whole = F.unhex(F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256))

    def numbered(rows: DataFrame) -> DataFrame:
        copies = Window.partitionBy(*s.GROUP, "_print").orderBy(*first)
        return rows.withColumn("_print", whole).withColumn("_copy", F.row_number().over(copies))

    marked = marked.withColumn("_hit", F.coalesce(condition, F.lit(False)))
    if s.is_small(values):
        # Numbered first, so that both windows share one shuffle.
        placed = s.running_start(marked.withColumn("_print", whole), s.GROUP, {}, s.row_order(), "_now", small=True)
        copies = Window.partitionBy(*s.GROUP, "_print", "_hit").orderBy(first[0], "_now")
        kept = placed.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1 OR NOT _hit").select(*columns)
    elif sel is None and s.MARK not in columns:
        kept = numbered(marked).where("_copy = 1").select(*columns)
    else:
        kept = numbered(marked.where("_hit")).where("_copy = 1").select(*columns).unionByName(
            marked.where("NOT _hit").select(*columns))
    kept = s.stamp(kept, s.group_rows(values))
    return s.stamp(s.close_up(kept, noted=bound is not None or s.in_chain()), bound) if renumber else kept


def _with_annotation_part(values: DataFrame, annotation_values: DataFrame) -> DataFrame:
    parts = annotation_values.select(
        F.col("id").alias("value_id"), s.zero("id").alias("_spread"),
        F.lower("field").alias("_field"), F.col("ordinal").alias("_ordinal"))
    # Unsaved rows have no id: a second key spreads them over the tasks of the join.
    spread = F.when(F.col("value_id").isNull(), F.hash("resource_id", "property", "pos"))
    return (values.withColumn("_spread", F.coalesce(spread, F.lit(0)))
            .join(parts, ["value_id", "_spread"], "left"))
