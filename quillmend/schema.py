"""Table schemas, the data type registry, and value validators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F, types as T

VALUES = T.StructType([
    T.StructField("value_id", T.LongType()),
    T.StructField("resource_id", T.LongType()),
    T.StructField("property", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("value_resource_id", T.LongType()),
    T.StructField("is_public", T.BooleanType()),
    T.StructField("value_annotation_id", T.LongType()),
])

RESOURCES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("resource_name", T.StringType()),
    T.StructField("owner_id", T.IntegerType()),
    T.StructField("resource_class_id", T.IntegerType()),
    T.StructField("resource_template_id", T.IntegerType()),
    T.StructField("thumbnail_id", T.IntegerType()),
    T.StructField("primary_media_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("is_public", T.BooleanType()),
])

MEDIA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("position", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("extension", T.StringType()),
    T.StructField("ingester", T.StringType()),
    T.StructField("renderer", T.StringType()),
    T.StructField("is_public", T.BooleanType()),
    T.StructField("html", T.StringType()),
])

ANNOTATION_VALUES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("annotation_id", T.LongType()),
    T.StructField("field", T.StringType()),
    T.StructField("ordinal", T.ShortType()),
])

AUTHORITY = T.StructType([
    T.StructField("datatype", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("priority", T.IntegerType()),
])

# Main type (literal, uri or resource) of each known data type.
MAIN_TYPES = {
    "literal": "literal",
    "html": "literal",
    "xml": "literal",
    "boolean": "literal",
    "geography:coordinates": "literal",
    "uri": "uri",
    "place": "uri",
    "resource": "resource",
    "resource:item": "resource",
    "resource:itemset": "resource",
    "resource:media": "resource",
    "resource:annotation": "resource",
    "annotation": "resource",
}

# Data type prefixes and their main type, when the name is not listed above.
MAIN_TYPE_PREFIXES = {
    "valuesuggest:": "uri",
    "valuesuggestall:": "uri",
    "resource:": "resource",
}

# Kind of resource, its precise link type, and its name in a site url.
LINK_TYPES = {
    "items": "resource:item",
    "media": "resource:media",
    "item_sets": "resource:itemset",
    "annotations": "resource:annotation",
}
SITE_NAMES = {"items": "item", "media": "media", "item_sets": "item-set", "annotations": "annotation"}

# Kind of resource a link type demands (types not listed accept any).
REQUIRED_KINDS = {
    "resource:item": "items",
    "resource:itemset": "item_sets",
    "resource:media": "media",
    "resource:annotation": "annotations",
    "annotation": "annotations",
}


class DataTypes:
    """Registry of data types: the known names above plus those the caller registers, such as
    ``DataTypes({"customvocab:7": "resource"})``. An unregistered name counts as literal."""

    def __init__(self, extra: Mapping[str, str] | None = None):
        self.names = {**MAIN_TYPES, **(extra or {})}
        unknown = set(self.names.values()) - {"literal", "uri", "resource"}
        if unknown:
            raise ValueError(f"unknown main types: {sorted(unknown)}")

    def main(self, name: str) -> str:
        if name in self.names:
            return self.names[name]
        for prefix, main in MAIN_TYPE_PREFIXES.items():
            if name.startswith(prefix):
                return main
        return "literal"

    def main_column(self, c: Column) -> Column:
        """Main type of a data type column."""
        chosen = None
        for main in ("resource", "uri", "literal"):
            names = [name for name, value in self.names.items() if value == main]
            hit = c.isin(names)
            chosen = F.when(hit, main) if chosen is None else chosen.when(hit, main)
        for prefix, main in MAIN_TYPE_PREFIXES.items():
            chosen = chosen.when(c.startswith(prefix), main)
        return chosen.otherwise("literal")


DEFAULT_TYPES = DataTypes()


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed mapping, null when the key is absent."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), c)


def valid_coordinates(c: Column) -> Column:
    """``lat,lon`` with latitude within 90 and longitude within 180 degrees."""
    number = r"\s*([-+]?\d+(?:\.\d+)?)\s*"
    shape = f"^{number},{number}$"
    lat = F.regexp_extract(c, shape, 1).try_cast("double")
    lon = F.regexp_extract(c, shape, 2).try_cast("double")
    return F.coalesce(c.rlike(shape) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
