"""Missing labels and uris, looked up in an authority table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from quillmend import schema
from quillmend.functions import text
from quillmend.operators import _shared as s

# Fill modes, language policies, and the data types that can be filled.
MODES = ("label_missing", "label_all", "label_remove", "uri_missing", "uri_all")
LANGUAGE_POLICIES = ("keep", "update", "remove")
MANAGED_TYPES = (
    "literal",
    "uri",
    "valuesuggest:geonames:geonames",
    "valuesuggest:idref:all",
    "valuesuggest:idref:person",
    "valuesuggest:idref:corporation",
    "valuesuggest:idref:conference",
    "valuesuggest:idref:subject",
    "valuesuggest:idref:rameau",
)
RAMEAU = "valuesuggest:idref:rameau"


def precise_type(mode: str, listed: list[str], datatype: str | None) -> tuple[list[str], str]:
    """The managed types to fill and the one to fill them with."""
    listed = [name for name in MANAGED_TYPES if s.ALL in listed or name in listed]
    if not datatype and len(listed) == 1:
        datatype = listed[0]
    if datatype not in MANAGED_TYPES:
        raise ValueError(f"filling data type {datatype!r} is not supported")
    if datatype in ("literal", "uri") and (
            {"literal", "uri"} & set(listed) or mode.startswith("uri_")):
        raise ValueError("a precise data type is required")
    return listed, datatype


def fill_values(values: DataFrame, authority: DataFrame | None, mode: str, properties, datatypes, *,
                datatype: str | None = None, language: str = "", update_language: str = "keep",
                featured_subject: bool = False, sel=None) -> DataFrame:
    """Fill or remove the labels of uris, or find the uri of labels.

    Only the rows to fill are joined, on a canonical form of the uri or on the label, with an
    authority table reduced to one row per key.
    """
    s.choice("mode", mode, MODES)
    listed = s.as_list(datatypes)
    listed, datatype = precise_type(mode, listed, datatype)
    if update_language not in LANGUAGE_POLICIES or (update_language == "update" and not language):
        update_language = "keep"

    marked, condition = s.scope(values, properties, sel)
    condition = F.coalesce(condition, F.lit(False))
    lang = {"keep": F.col("lang"), "update": F.lit(language),
            "remove": F.lit(None).cast("string")}[update_language]

    if mode == "label_remove":
        typed = condition & F.col("type").isin(listed) & (F.col("type") != "literal")
        labelled = typed & ~text.is_blank(F.col("uri")) & text.has_text(F.col("value"))
        return marked.withColumns({
            "uri": F.when(typed & text.is_blank(F.col("uri")), None).otherwise(F.col("uri")),
            "value": F.when(labelled, None).otherwise(F.col("value")),
            "lang": F.when(labelled, lang).otherwise(F.col("lang")),
        }).select(*values.columns)

    if authority is None:
        raise ValueError("an authority table is required")
    known = authority.where(F.col("datatype") == datatype)
    # Badly stored blank uris become null on every visited row.
    visited = marked.withColumn(
        "uri", F.when(condition & text.is_blank(F.col("uri")), None).otherwise(F.col("uri")))
    typed = condition & F.col("type").isin(listed) & F.col("type").isin("literal", "uri", datatype)

    if mode.startswith("label_"):
        uri = F.when(F.col("type") == "literal", F.col("value")).otherwise(F.col("uri"))
        wanted = typed & ~text.is_blank(uri)
        if mode == "label_missing":
            wanted = wanted & ((F.col("type") == "literal") | ~text.has_text(F.col("value")))
        labels = _labels(known, datatype, re.sub(r"[^a-zA-Z0-9_-]+", "", language), featured_subject)

        def fill(rows: DataFrame) -> DataFrame:
            joined = s.lookup(rows.withColumn("_found_uri", uri),
                              text.authority_key(uri, datatype), labels, "_key")
            return _filled(joined, F.col("_label").isNotNull(), datatype, lang,
                           value=F.col("_label"), uri=F.col("_found_uri"))
    else:
        label = F.col("value")
        wanted = typed & ~text.is_blank(label) & text.has_text(text.trim(label))
        if mode == "uri_missing":
            wanted = wanted & ~text.is_http_url(F.col("uri"))
        uris = _uris(known)

        def fill(rows: DataFrame) -> DataFrame:
            joined = s.lookup(rows, text.trim(F.col("value")), uris, "_key")
            kept_label = F.when(F.col("value") != F.col("_uri"), F.col("value"))
            return _filled(joined, F.col("_uri").isNotNull(), datatype, lang,
                           value=kept_label, uri=F.col("_uri"))

    return s.divert(visited, wanted, fill, values.columns)


def _filled(rows: DataFrame, found: Column, datatype: str, lang: Column, *, value: Column,
            uri: Column) -> DataFrame:
    return rows.withColumns({
        "value": F.when(found, value).otherwise(F.col("value")),
        "uri": F.when(found, uri).otherwise(F.col("uri")),
        "type": F.when(found, F.lit(datatype)).otherwise(F.col("type")),
        "lang": F.when(found, lang).otherwise(F.col("lang")),
    })


def label_rank(language: str, featured_subject: bool, datatype: str) -> Column:
    """Preference among the labels of one uri, smallest first; null rows are no candidates."""
    kind = F.col("kind")
    rank = F.when(F.lit(False), 0)
    if language:
        rank = (rank.when((kind == "official") & (F.col("lang") == language), 0)
                .when((kind == "alternate") & (F.col("lang") == language), 1))
    rank = rank.when(kind == "name", 2).when(kind == "short", 3)
    rank = rank.when(kind == "official", 4).when(kind == "alternate", 5)
    heading = "featured" if featured_subject and datatype == RAMEAU else "heading"
    return rank.when(kind == heading, 6)


def _labels(known: DataFrame, datatype: str, language: str, featured_subject: bool) -> DataFrame:
    rank = label_rank(language, featured_subject, datatype)
    best = F.struct(F.col("_rank"), F.coalesce("priority", F.lit(0)).alias("priority"),
                    F.col("label").alias("label"))
    return (known.withColumns({"_key": text.authority_key(F.col("uri"), datatype), "_rank": rank,
                               "label": text.trim(F.col("label"))})
            .where(F.col("_key").isNotNull() & F.col("_rank").isNotNull()
                   & text.has_text(F.col("label")))
            .groupBy("_key").agg(F.min(best).alias("_best"))
            .select("_key", F.col("_best.label").alias("_label")))


def _uris(known: DataFrame) -> DataFrame:
    """Labels that name exactly one uri."""
    return (known.where(text.has_text(F.col("uri")))
            .groupBy(text.trim(F.col("label")).alias("_key"))
            .agg(F.min("uri").alias("_uri"), F.max("uri").alias("_last"))
            .where(F.col("_uri") == F.col("_last")).select("_key", "_uri"))
