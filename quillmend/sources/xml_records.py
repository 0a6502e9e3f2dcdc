"""Authority and place tables from XML records (columns ``uri`` and ``xml``).

Each record is parsed once, into a nested column; a broken record yields no row here and one in
the tables of rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmend.functions import text
from quillmend.operators.fill import RAMEAU

GEONAMES = "valuesuggest:geonames:geonames"

# Elements read from a place record, and from a MARC-like record.
PLACE_SCHEMA = (
    "Feature STRUCT<_about: STRING,"
    " name: ARRAY<STRUCT<_VALUE: STRING, _lang: STRING>>,"
    " shortName: ARRAY<STRUCT<_VALUE: STRING, _lang: STRING>>,"
    " officialName: ARRAY<STRUCT<_VALUE: STRING, _lang: STRING>>,"
    " alternateName: ARRAY<STRUCT<_VALUE: STRING, _lang: STRING>>,"
    " countryCode: STRING, lat: STRING, long: STRING>")
MARC_SCHEMA = ("datafield ARRAY<STRUCT<_tag: STRING,"
               " subfield: ARRAY<STRUCT<_code: STRING, _VALUE: STRING>>>>")

# Element of each kind of place name; tags that hold the heading of each type,
# best first, with and without the preference for featured subjects.
NAME_ELEMENTS = {"name": "name", "short": "shortName", "official": "officialName",
                 "alternate": "alternateName"}
HEADING_TAGS = {
    "valuesuggest:idref:person": ("900", "901", "902"),
    "valuesuggest:idref:corporation": ("910", "911", "912"),
    "valuesuggest:idref:conference": ("910", "911", "912"),
    "valuesuggest:idref:subject": ("250", "915"),
    "valuesuggest:idref:rameau": ("950",),
}
FEATURED_TAGS = ("250", "915", "910", "950")


# Column that holds the text of a record that cannot be parsed.
BROKEN = "_corrupt_record"


def _parsed(xml: Column, schema: str) -> Column:
    return F.from_xml(xml, f"{schema}, {BROKEN} STRING", {
        "ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})


def parse_authority(xml_df: DataFrame, datatype: str) -> DataFrame:
    """Labels of each record with kind, language and preference: an ``authority`` table."""
    labels = _labels(datatype)[1]
    return (xml_df.select(F.lit(datatype).alias("datatype"), "uri", F.inline(labels))
            .where(text.has_text(F.col("label"))))


def authority_rejects(xml_df: DataFrame, datatype: str) -> DataFrame:
    """The records :func:`parse_authority` finds no label in (uri, xml, reason): missing ones, those
    that are no XML, and those without a label."""
    record, labels = _labels(datatype)
    found = F.exists(labels, lambda label: text.has_text(label["label"]))
    return _rejects(xml_df, record, found, "no label")


def place_rejects(xml_df: DataFrame) -> DataFrame:
    """The records :func:`parse_places` finds no place in (uri, xml, reason)."""
    record = _parsed(F.col("xml"), PLACE_SCHEMA)
    found = (_place_id(record["Feature"]) > 0) & _toponym(record["Feature"], "").isNotNull()
    return _rejects(xml_df, record, found, "no place")


def _rejects(xml_df: DataFrame, record: Column, found: Column, without: str) -> DataFrame:
    reason = (F.when(~text.has_visible_text(F.col("xml")), F.lit("no record")).when(record[BROKEN].isNotNull(), F.lit("no XML"))
              .when(~F.coalesce(found, F.lit(False)), F.lit(without)))
    return xml_df.select("uri", "xml", reason.alias("reason")).where("reason IS NOT NULL")


def _labels(datatype: str) -> tuple[Column, Column]:
    """The parsed record and the array of its labels."""
    if datatype == GEONAMES:
        record = _parsed(F.col("xml"), PLACE_SCHEMA)
        return record, _place_labels(record["Feature"])
    if datatype not in HEADING_TAGS:
        raise ValueError(f"records of data type {datatype!r} are not understood")
    record = _parsed(F.col("xml"), MARC_SCHEMA)
    labels = _headings(record["datafield"], "heading", HEADING_TAGS[datatype])
    if datatype == RAMEAU:
        labels = F.concat(labels, _headings(record["datafield"], "featured", FEATURED_TAGS))
    return record, labels


def _label(kind: str, lang: Column, label: Column, priority: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), lang.cast("string").alias("lang"),
                    text.trim(label).alias("label"), priority.cast("int").alias("priority"))


def _place_labels(feature: Column) -> Column:
    def listed(kind: str, element: str) -> Column:
        labels = F.transform(feature[element], lambda name, i: _label(
            kind, name["_lang"], name["_VALUE"], i))
        return F.coalesce(labels, F.array())

    return F.concat(*[listed(kind, element) for kind, element in NAME_ELEMENTS.items()])


def _headings(fields: Column, kind: str, tags: tuple[str, ...]) -> Column:
    """The first heading of each tag; an earlier tag is preferred."""
    def heading(i: int, tag: str) -> Column:
        codes = F.flatten(F.transform(
            F.filter(fields, lambda field: field["_tag"] == tag),
            lambda field: F.slice(F.filter(field["subfield"], lambda sub: sub["_code"] == "a"), 1, 1)))
        return _label(kind, F.lit(None), F.get(codes, F.lit(0))["_VALUE"], F.lit(i))

    return F.array(*[heading(i, tag) for i, tag in enumerate(tags)])


def parse_places(xml_df: DataFrame, countries: DataFrame | None = None,
                 language: str = "") -> DataFrame:
    """Place records: number, name (in the language when there is one), country, coordinates.

    `countries` (code, name) names the country; without it, or for an unknown code, the code
    stays.
    """
    feature = _parsed(F.col("xml"), PLACE_SCHEMA)["Feature"]
    places = xml_df.select(
        _place_id(feature).alias("geoname_id"), _toponym(feature, language[:2].lower()).alias("toponym"),
        text.blank_to_null(text.trim(feature["countryCode"])).alias("country"),
        *_position(feature)).where((F.col("geoname_id") > 0) & F.col("toponym").isNotNull())
    return _with_countries(places, countries)


def parse_place_names(xml_df: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """All names of place records (one row each, with kind, language and order in the record), from
    which :func:`convert` takes the one that fits its language. `countries`
    as in :func:`parse_places`."""
    feature = _parsed(F.col("xml"), PLACE_SCHEMA)["Feature"]
    names = xml_df.select(
        _place_id(feature).alias("geoname_id"), F.inline(_place_labels(feature)),
        text.blank_to_null(text.trim(feature["countryCode"])).alias("country"), *_position(feature)).where(
            (F.col("geoname_id") > 0) & text.has_text(F.col("label"))).withColumnRenamed("label", "toponym")
    return _with_countries(names, countries)


def _place_id(feature: Column) -> Column:
    return F.regexp_extract(feature["_about"], r".*/(\d+)", 1).try_cast("long")


def _position(feature: Column) -> list[Column]:
    return [text.trim(feature["lat"]).try_cast("double").alias("lat"), text.trim(feature["long"]).try_cast("double").alias("lon")]


def _toponym(feature: Column, language: str) -> Column:
    def first(element: str, lang: str = "") -> Column:
        names = feature[element]
        if lang:
            names = F.filter(names, lambda name: name["_lang"] == lang)
        return text.blank_to_null(text.trim(F.get(names, F.lit(0))["_VALUE"]))

    preferred = [first("officialName", language), first("alternateName", language)] if language else []
    return F.coalesce(*preferred, first("name"), first("shortName"), first("officialName"), first("alternateName"))


def _with_countries(places: DataFrame, countries: DataFrame | None) -> DataFrame:
    if countries is None:
        return places
    code, name = countries.columns[:2]
    names = countries.select(F.upper(code).alias("_code"), F.col(name).alias("_name"))
    return places.join(names, F.upper("country") == F.col("_code"), "left").withColumn(
        "country", F.coalesce("_name", "country")).select(*places.columns)
