"""Conversion of values from one data type to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmend import schema
from quillmend.functions import text
from quillmend.operators import _shared as s
from quillmend.operators.fill import label_rank

GEONAMES = "valuesuggest:geonames:geonames"
COORDINATES = "geography:coordinates"

# How a uri becomes text, and how an identifier is read from a text.
LITERAL_VALUES = ("label_uri", "uri_label", "label_or_uri", "label", "uri", "coordinates")
PREPROCESSES = ("full", "basename", "filename")

# Names of records in urls, and the kind of record each stands for.
URL_KINDS = {
    "item": "items",
    "items": "items",
    "item-set": "item_sets",
    "item_sets": "item_sets",
    "media": "media",
    "annotation": "annotations",
    "annotations": "annotations",
}

# What a conversion may change; the result of a rule is a set of these, prefixed.
PAYLOAD = ("type", "lang", "value", "uri", "value_resource_id")


def convert(values: DataFrame, resources: DataFrame | None, from_: str, to: str, properties, *,
            literal_value: str | None = None, strip_html: bool = False,
            only_tagged: bool = False, preprocess: str = "full", identifier_properties=(),
            extract_label: bool = False, uri_label: str | None = None,
            uri_base: str | None = None, uri_is_api: bool = False, uri_language: str = "",
            places: DataFrame | None = None, vocab: DataFrame | None = None,
            contains: str = "", sel=None,
            types: schema.DataTypes = schema.DEFAULT_TYPES) -> DataFrame:
    """Convert the values of exactly type `from_`; a result that is not valid for the target
    type leaves the row as it was.

    Only the rows of the source type take part in the lookups (records, places, vocabulary). Places
    may be one row each, or one row for each of their names (columns ``kind`` and ``lang``): then the
    name that fits `uri_language` best is taken.
    """
    if not from_ or not to:
        raise ValueError("a source and a target data type are required")
    if from_ == to:
        return values
    main = (types.main(from_), types.main(to))
    marked, condition = s.scope(values, properties, sel)
    hit = condition & (F.col("type") == from_)
    if contains and from_ == "literal":
        hit = hit & F.col("value").contains(contains)
    if contains and from_ == "uri":
        hit = hit & F.col("uri").contains(contains)
    if main[0] == "literal":
        hit = hit & F.col("value").isNotNull()
        if only_tagged and to in ("html", "xml"):
            tagged = text.trim(F.col("value"))
            hit = hit & tagged.startswith("<") & tagged.endswith(">")
    elif main[0] == "uri":
        hit = hit & F.col("uri").isNotNull()
    else:
        hit = hit & F.col("value_resource_id").isNotNull()

    source_text = F.col("value")
    if strip_html and from_ in ("html", "xml"):
        source_text = text.strip_tags(source_text)
    if places is not None:
        places = best_names(places, uri_language)
    options = dict(to=to, types=types, resources=resources, places=places)

    if main == ("literal", "literal"):
        rule = _literal_to_literal(source_text, vocab=vocab, **options)
    elif main == ("literal", "resource"):
        rule = _literal_to_link(source_text, values, s.choice("preprocess", preprocess, PREPROCESSES),
                                s.as_list(identifier_properties), **options)
    elif main == ("literal", "uri"):
        rule = _literal_to_uri(source_text, extract_label, uri_label, **options)
    elif main == ("resource", "resource"):
        rule = _link_to_link(**options)
    elif main == ("resource", "literal"):
        rule = _link_to_literal(**options)
    elif main == ("resource", "uri"):
        rule = _link_to_uri(_required(uri_base, "uri_base"), uri_is_api, uri_label, **options)
    elif main == ("uri", "uri"):
        rule = _uri_to_uri(from_, **options)
    elif main == ("uri", "literal"):
        rule = _uri_to_literal(
            s.choice("literal_value", literal_value or "", LITERAL_VALUES), **options)
    else:
        rule = _uri_to_link(_required(uri_base, "uri_base"), **options)

    def edit(rows: DataFrame) -> DataFrame:
        candidates = rule(rows)
        valid = F.col("_hit") & F.coalesce(F.col("_valid"), F.lit(False))
        return candidates.withColumns({
            name: F.when(valid, F.col(f"_{name}")).otherwise(F.col(name)) for name in PAYLOAD})

    return s.divert(marked, hit, edit, values.columns)


def _required(parameter, name: str):
    if not parameter:
        raise ValueError(f"this conversion needs {name}")
    return parameter


def _result(rows: DataFrame, to: str, valid: Column, *, lang: Column | None = None,
            value: Column | None = None, uri: Column | None = None,
            link: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return rows.withColumns({
        "_type": F.lit(to),
        "_lang": F.col("lang") if lang is None else lang.cast("string"),
        "_value": (null if value is None else value).cast("string"),
        "_uri": (null if uri is None else uri).cast("string"),
        "_value_resource_id": (null if link is None else link).cast("long"),
        "_valid": valid,
    })


# ---------------------------------------------------------------- from literal

def _literal_to_literal(value, *, to, types, resources, places, vocab):
    def rule(rows):
        if to == COORDINATES:
            if places is None:
                return _result(rows, to, schema.valid_coordinates(value), value=value)
            # Place addresses are looked up, ready-made coordinates only retyped.
            is_place = F.col("value").contains("geonames.org/")
            found = _with_place(rows, text.geonames_id(text.trim(value)), places)
            coordinates = F.when(is_place, F.col("_coordinates")).otherwise(value)
            lang = F.when(~is_place, F.col("lang"))
            return _result(found, to, schema.valid_coordinates(coordinates), lang=lang,
                           value=coordinates)
        if to.startswith("customvocab:"):
            terms = _required(vocab, "vocab")
            terms = terms.select(F.col(terms.columns[0]).alias("_term")).distinct()
            terms = terms.withColumn("_known", F.lit(True))
            joined = s.lookup(rows, value, terms, "_term")
            return _result(joined, to, F.col("_known"), value=value)
        return _result(rows, to, text.has_text(text.trim(value)), value=value)

    return rule


def _literal_to_link(value, values, preprocess, properties, *, to, types, resources, places):
    if not properties:
        raise ValueError("identifier_properties must name where identifiers are stored")
    _required(resources, "resources")
    key = {"full": lambda c: c, "basename": text.basename, "filename": text.filename}[preprocess](value)

    def rule(rows):
        # One record per identifier, the smallest id.
        index = (s.saved(values).where(F.col("property").isin(properties) & text.has_text(F.col("value")))
                 .groupBy(F.col("value").alias("_key")).agg(F.min("resource_id").alias("_found")))
        joined = s.lookup(rows, key, index, "_key")
        checked = _with_record(joined, F.col("_found"), resources)
        return _result(checked, to, _kind_fits(to, types), link=F.col("_found"))

    return rule


def _literal_to_uri(value, extract_label, uri_label, *, to, types, resources, places):
    def rule(rows):
        default = F.lit(uri_label or None)
        if not extract_label:
            return _result(rows, to, text.has_text(value), value=default, uri=value)
        uri = F.substring_index(value, " ", 1)
        rest = text.trim(F.substr(value, F.length(uri) + 2))
        label = F.when(text.has_text(rest), rest).otherwise(default)
        return _result(rows, to, text.has_text(uri), value=label, uri=uri)

    return rule


# ---------------------------------------------------------------- from link

def _linked(rows, resources):
    return _with_record(rows, F.col("value_resource_id"), _required(resources, "resources"))


def _link_to_link(*, to, types, resources, places):
    return lambda rows: _result(_linked(rows, resources), to, _kind_fits(to, types),
                                link=F.col("value_resource_id"))


def _link_to_literal(*, to, types, resources, places):
    return lambda rows: _result(_linked(rows, resources), to, text.has_text(F.col("_title")),
                                value=F.col("_title"))


def _link_to_uri(uri_base, uri_is_api, uri_label, *, to, types, resources, places):
    def rule(rows):
        name = F.col("_kind") if uri_is_api else schema.mapped(F.col("_kind"), schema.SITE_NAMES)
        uri = F.concat(F.lit(uri_base), name, F.lit("/"), F.col("value_resource_id").cast("string"))
        label = F.lit(uri_label) if uri_label else F.col("_title")
        return _result(_linked(rows, resources), to, F.col("_kind").isNotNull(), value=label, uri=uri)

    return rule


# ---------------------------------------------------------------- from uri

def _uri_to_uri(from_, *, to, types, resources, places):
    def rule(rows):
        if to != "place":
            return _result(rows, to, text.has_text(F.col("uri")), value=F.col("value"),
                           uri=F.col("uri"))
        if from_ != GEONAMES:
            return _result(rows, to, F.lit(False))
        found = _with_place(rows, text.authority_key(F.col("uri"), GEONAMES),
                            _required(places, "places"))
        record = F.to_json(F.col("_place"))
        known = (F.col("_place.geonameId") > 0) & text.has_text(F.col("_place.toponym"))
        return _result(found, to, known, value=record, uri=F.col("uri"))

    return rule


def _uri_to_literal(literal_value, *, to, types, resources, places):
    def rule(rows):
        label, uri = F.col("value"), F.col("uri")
        labelled = text.has_text(label)
        if literal_value == "coordinates":
            found = _with_place(rows, text.authority_key(uri, GEONAMES), _required(places, "places"))
            return _result(found, COORDINATES, schema.valid_coordinates(F.col("_coordinates")),
                           lang=F.lit(None), value=F.col("_coordinates"))
        composed = {
            "label_uri": F.when(labelled, F.concat(label, F.lit(" ("), uri, F.lit(")"))).otherwise(uri),
            "uri_label": F.when(labelled, F.concat(uri, F.lit(" ("), label, F.lit(")"))).otherwise(uri),
            "label_or_uri": F.when(labelled, label).otherwise(uri),
            "label": F.when(labelled, label),
            "uri": uri,
        }[literal_value]
        return _result(rows, to, text.has_text(composed), value=composed)

    return rule


def _uri_to_link(uri_base, *, to, types, resources, places):
    def rule(rows):
        # The last two parts of an address of this site: kind of record, then its number.
        parts = r"/([^/]+)/+(\d+)/*\z"
        link = F.when(F.col("uri").startswith(uri_base),
                      F.regexp_extract(F.col("uri"), parts, 2).try_cast("long"))
        named = schema.mapped(F.regexp_extract(F.col("uri"), parts, 1), URL_KINDS)
        checked = _with_record(rows.withColumn("_link", link), F.col("_link"),
                               _required(resources, "resources"))
        return _result(checked, to, _kind_fits(to, types) & (F.col("_kind") == named),
                       link=F.col("_link"))

    return rule


# ---------------------------------------------------------------- lookups

def _with_record(rows: DataFrame, link: Column, resources: DataFrame) -> DataFrame:
    """Add kind and title of the record `link` points to."""
    records = resources.select(F.col("id").alias("_record"), F.col("resource_name").alias("_kind"),
                               F.col("title").alias("_title"))
    return s.lookup(rows, link, records, "_record")


def _kind_fits(to: str, types: schema.DataTypes) -> Column:
    required = schema.REQUIRED_KINDS.get(to)
    if to.startswith("customvocab:") and types.main(to) == "resource":
        required = "items"
    return F.col("_kind").isNotNull() if required is None else F.col("_kind") == required


def best_names(places: DataFrame, language: str) -> DataFrame:
    """One row for each place: of its names, the official or an alternate one in the language, else the
    plain, short, official or alternate name that comes first."""
    if not {"kind", "lang"} <= set(places.columns):
        return places
    rank = label_rank(language[:2].lower(), False, GEONAMES)
    order = F.coalesce(F.col("priority") if "priority" in places.columns else F.lit(None), F.lit(0))
    record = F.struct("toponym", "country", "lat", "lon")
    return (places.where(rank.isNotNull() & text.has_text(F.col("toponym"))).groupBy("geoname_id")
            .agg(F.min_by(record, F.struct(rank.alias("rank"), order.alias("order"), "toponym")).alias("_best"))
            .select("geoname_id", "_best.*"))


def _with_place(rows: DataFrame, place_id: Column, places: DataFrame) -> DataFrame:
    """Add the place record and its coordinates."""
    record = places.select(
        F.col("geoname_id").cast("string").alias("_place_id"),
        F.concat(F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"))
        .alias("_coordinates"),
        F.struct(F.col("geoname_id").alias("geonameId"), "toponym", "country",
                 F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("_place"))
    return s.lookup(rows, place_id, record, "_place_id")
