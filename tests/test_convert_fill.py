from __future__ import annotations

import pytest

import quillmend as q
from tests.helpers import rows, shown, table

GEO = "valuesuggest:geonames:geonames"


@pytest.fixture(scope="module")
def resources(spark):
    return spark.createDataFrame(
        [(1, "items", "One"), (2, "media", "Two"), (3, "item_sets", None)],
        "id BIGINT, resource_name STRING, title STRING").cache()


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(10, "Town", "Land", 1.5, -2.25)],
                                 "geoname_id BIGINT, toponym STRING, country STRING, lat DOUBLE, lon DOUBLE")


def after(values, *args, **options):
    return shown(q.convert(values, *args, "all", **options), "type", "value", "uri", "value_resource_id")


def test_from_literal(spark, resources, places):
    values = table(spark, [dict(value="http://x My label", lang="fr"), dict(value="<b>t</b>"),
                           dict(value="1.5,-200"), dict(value="48.5,2.25"), dict(value=" "), dict()])
    assert after(values, None, "literal", "uri", extract_label=True)[:2] == [
        ("uri", "My label", "http://x", None), ("uri", None, "<b>t</b>", None)]
    assert after(values, None, "literal", "uri", uri_label="L", contains="http")[:2] == [
        ("uri", "L", "http://x My label", None), ("literal", "<b>t</b>", None, None)]
    assert [r[0] for r in after(values, None, "literal", "html", only_tagged=True)] == [
        "literal", "html", "literal", "literal", "literal", "literal"]
    assert [r[0] for r in after(values, None, "literal", "geography:coordinates")] == [
        "literal", "literal", "literal", "geography:coordinates", "literal", "literal"]
    # Blank texts are no valid html and stay as they are.
    assert [r[0] for r in after(values, None, "literal", "html")] == ["html"] * 4 + ["literal"] * 2
    html = table(spark, [dict(type="html", value="<p>a <b>b</b></p>", lang="fr", is_public=False)])
    converted = q.convert(html, None, "html", "literal", "all", strip_html=True).first()
    assert (converted.value, converted.lang, converted.is_public) == ("a b", "fr", False)
    vocab = spark.createDataFrame([("red",), ("red",)], "term STRING")
    colours = table(spark, [dict(value="red"), dict(value="blue")])
    assert [r[0] for r in after(colours, None, "literal", "customvocab:1", vocab=vocab)] == [
        "customvocab:1", "literal"]
    towns = table(spark, [dict(value="https://www.geonames.org/10/town.html", lang="fr"),
                          dict(value="https://www.geonames.org/99"), dict(value="1,2", lang="fr")])
    assert shown(q.convert(towns, None, "literal", "geography:coordinates", "all", places=places),
                 "type", "value", "lang") == [
        ("geography:coordinates", "1.5,-2.25", None), ("literal", "https://www.geonames.org/99", None),
        ("geography:coordinates", "1,2", "fr")]


def test_literal_to_link(spark, resources):
    values = table(spark, [
        dict(resource_id=1, property="id", value="doc"), dict(resource_id=2, property="id", value="img"),
        dict(resource_id=5, property="id", value="doc"), dict(value="/files/doc.pdf"),
        dict(value="/files/img.png"), dict(value="none")])
    options = dict(preprocess="filename", identifier_properties=["id"])
    result = q.convert(values, resources, "literal", "resource:item", ["p"], **options)
    assert shown(result.where("property = 'p'"), "type", "value", "value_resource_id") == [
        ("resource:item", None, 1), ("literal", "/files/img.png", None), ("literal", "none", None)]
    loose = q.convert(values, resources, "literal", "resource", ["p"], **options)
    assert [r.value_resource_id for r in loose.where("property = 'p'").orderBy("pos").collect()] == [1, 2, None]
    with pytest.raises(ValueError):
        q.convert(values, resources, "literal", "resource", ["p"])


def test_from_link(spark, resources):
    values = table(spark, [dict(type="resource", value_resource_id=i, lang="fr") for i in (1, 2, 3, 9)])
    assert [r[0] for r in after(values, resources, "resource", "resource:media")] == [
        "resource", "resource:media", "resource", "resource"]
    assert [r[:2] for r in after(values, resources, "resource", "literal")] == [
        ("literal", "One"), ("literal", "Two"), ("resource", None), ("resource", None)]
    site = after(values, resources, "resource", "uri", uri_base="http://h/s/x/", uri_label="L")
    assert [r[1:3] for r in site] == [("L", "http://h/s/x/item/1"), ("L", "http://h/s/x/media/2"),
                                      ("L", "http://h/s/x/item-set/3"), (None, None)]
    api = after(values, resources, "resource", "uri", uri_base="http://h/api/", uri_is_api=True)
    assert [r[2] for r in api] == ["http://h/api/items/1", "http://h/api/media/2",
                                   "http://h/api/item_sets/3", None]
    with pytest.raises(ValueError):
        after(values, resources, "resource", "uri")


def test_from_uri(spark, resources, places):
    values = table(spark, [dict(type="uri", uri="u", value="L"), dict(type="uri", uri="u")])
    texts = {option: [r[:2] for r in after(values, None, "uri", "literal", literal_value=option)]
             for option in ("label_uri", "uri_label", "label_or_uri", "label", "uri")}
    assert texts == {
        "label_uri": [("literal", "L (u)"), ("literal", "u")],
        "uri_label": [("literal", "u (L)"), ("literal", "u")],
        "label_or_uri": [("literal", "L"), ("literal", "u")],
        "label": [("literal", "L"), ("uri", None)],
        "uri": [("literal", "u"), ("literal", "u")]}
    addresses = ["http://h/api/items/1", "http://h/s/x/item/1/", "http://h/media/1", "http://o/item/1",
                 "http://h/resource/1", "http://h/item-set/3", "http://h/item/x", "http://h/item/77"]
    sites = table(spark, [dict(type="uri", uri=uri) for uri in addresses])
    assert [r[3] for r in after(sites, resources, "uri", "resource", uri_base="http://h/")] == [
        1, 1, None, None, None, 3, None, None]
    towns = table(spark, [dict(type=GEO, uri="http://sws.geonames.org/10/about.rdf", value="T", lang="fr"),
                          dict(type=GEO, uri="http://example.org/10", value="T", lang="fr")])
    assert shown(q.convert(towns, None, GEO, "place", "all", places=places), "type", "value", "lang") == [
        ("place", '{"geonameId":10,"toponym":"Town","country":"Land","latitude":1.5,"longitude":-2.25}', "fr"),
        (GEO, "T", "fr")]
    assert shown(q.convert(towns, None, GEO, "literal", "all", literal_value="coordinates", places=places),
                 "type", "value", "uri", "lang") == [
        ("geography:coordinates", "1.5,-2.25", None, None), (GEO, "T", "http://example.org/10", "fr")]
    assert q.convert(values, None, "uri", "uri", "all") is values


# ---------------------------------------------------------------- fill

@pytest.fixture(scope="module")
def authority(spark):
    base = "https://www.geonames.org/"
    return spark.createDataFrame([
        (GEO, f"{base}1", "alternate", "fr", "Alt FR", 0), (GEO, f"{base}1/", "name", None, "Name", 0),
        (GEO, f"{base}1", "official", "fr", "Off FR", 0), (GEO, f"{base}2", "official", "de", "Off DE", 1),
        (GEO, f"{base}2", "short", None, "Short", 0), (GEO, f"{base}3", "name", None, "Twice", 0),
        (GEO, f"{base}4", "name", None, "Twice", 0),
        ("valuesuggest:idref:rameau", "https://www.idref.fr/7.xml", "heading", None, "Plain", 0),
        ("valuesuggest:idref:rameau", "https://www.idref.fr/7", "featured", None, "Featured", 1),
    ], "datatype STRING, uri STRING, kind STRING, lang STRING, label STRING, priority INT").cache()


def test_fill_labels(spark, authority):
    uri = "http://www.geonames.org/"
    values = table(spark, [
        dict(type=GEO, uri=f"{uri}1/x.html", lang="en"), dict(type=GEO, uri=f"{uri}2", value="Old"),
        dict(type=GEO, uri="http://other.org/1"), dict(type="literal", value=f"{uri}2"),
        dict(type=GEO, uri=""), dict(type="uri", uri=f"{uri}1")])

    def filled(mode, datatypes=(GEO,), **options):
        return shown(q.fill_values(values, authority, mode, "all", list(datatypes), **options),
                     "type", "value", "uri", "lang")

    missing = filled("label_missing")
    assert [r[1] for r in missing] == ["Name", "Old", None, f"{uri}2", None, None]
    assert missing[4][2] is None
    assert [r[1] for r in filled("label_all", language="fr")][:2] == ["Off FR", "Short"]
    assert filled("label_missing", language="fr", update_language="update")[0][3] == "fr"
    assert filled("label_missing", update_language="update")[0][3] == "en"
    assert filled("label_missing", update_language="remove")[0][3] is None
    wide = filled("label_missing", ("literal", "uri", GEO), datatype=GEO)
    assert wide[3] == (GEO, "Short", f"{uri}2", None) and wide[5] == (GEO, "Name", f"{uri}1", None)
    removed = filled("label_remove", update_language="remove")
    assert [r[1] for r in removed] == [None, None, None, f"{uri}2", None, None]
    rameau = table(spark, [dict(type="valuesuggest:idref:rameau", uri="http://idref.fr/7")])
    # Every form of a record's address leads to the record.
    named = q.fill_values(rameau, authority, "label_all", "all", "valuesuggest:idref:rameau")
    assert shown(named, "value", "uri") == [("Plain", "http://idref.fr/7")]
    site = table(spark, [dict(type="valuesuggest:idref:rameau", uri="https://www.idref.fr/7")])
    for featured, label in ((False, "Plain"), (True, "Featured")):
        got = q.fill_values(site, authority, "label_all", "all", "valuesuggest:idref:rameau",
                            featured_subject=featured).first()
        assert got.value == label


def test_fill_uris(spark, authority):
    values = table(spark, [
        dict(value=" Name "), dict(value="Twice"), dict(value="none"),
        dict(type=GEO, uri="https://www.geonames.org/9", value="Short"), dict(type=GEO, uri="bad", value="Short")])

    def uris(mode):
        after = q.fill_values(values, authority, mode, "all", ["literal", GEO], datatype=GEO)
        return [(r.type, r.uri) for r in after.orderBy("pos").collect()]

    one, two = "https://www.geonames.org/1/", "https://www.geonames.org/2"
    assert uris("uri_missing") == [(GEO, one), ("literal", None), ("literal", None),
                                   (GEO, "https://www.geonames.org/9"), (GEO, two)]
    assert uris("uri_all")[3] == (GEO, two)


def test_fill_guards(spark, authority):
    values = table(spark, [dict(value="x")])
    for bad in (dict(mode="nope", datatypes=[GEO]), dict(mode="label_all", datatypes=["literal"]),
                dict(mode="label_all", datatypes=["literal", GEO]),
                dict(mode="uri_all", datatypes=["uri"], datatype="uri"),
                dict(mode="label_all", datatypes=["valuesuggest:idref:geo"])):
        with pytest.raises(ValueError):
            q.fill_values(values, authority, properties="all", **bad)
