from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import quillmend as q
from quillmend import schema
from quillmend.functions import patterns, text
from quillmend.sources import tables as stored
from tests.helpers import rows, shown, table

VALUES = [dict(value="a \"quoted\"", lang="fr"), dict(value="b", is_public=False), dict(type="uri", uri="http://x", value="L"),
          dict(property="q:r", type="resource:item", value_resource_id=7, resource_id=2)]


def test_jsonld_round_trip(spark, tmp_path):
    values = table(spark, [dict(v, property=v.get("property", "p:q")) for v in VALUES])
    documents = q.to_jsonld(values).orderBy("resource_id").collect()
    assert documents[1].json == ('{"o:id":2,"q:r":[{"type":"resource:item","is_public":true,"value_resource_id":7,"o:value_id":4}]}')
    odd = table(spark, [dict(VALUES[0], property="p:q"), dict(property=None, value="no property"), dict(resource_id=None, value="no record"),
                        dict(value="late", pos=None, value_id=None), dict(value="far", pos=9), dict(value="far", pos=9),
                        dict(value="unset", is_public=None), dict(value="noted", value_annotation_id=77), dict(property="plain", value="x"),
                        *(dict(property="loose", value=f"v{k}", pos=None, value_id=None) for k in range(9))])
    for k, df in enumerate((values, odd, q.measure_groups(odd), odd.limit(0))):
        for part_rows in (1000, 2):
            folder = str(tmp_path / f"d{k}-{part_rows}")
            q.write_jsonld(df, folder, part_rows=part_rows)
            assert rows(q.read_jsonld(spark, folder)) == rows(df)
    # No document lists more than its share, placed or not.
    longest = q.to_jsonld(odd, part_rows=2).select(F.explode(F.from_json("json", "MAP<STRING, STRING>"))).where("value LIKE '[%'").select(
        F.max(F.json_array_length("value")))
    assert longest.first()[0] == 2
    assert q.to_jsonld(values, part_rows=2).count() == 3
    foreign = spark.createDataFrame(
        [('{"o:id":5,"@type":"o:Item","o:owner":{"o:id":1},"o:media":[{"o:id":3}],"p:q":[{"type":"literal","@value":"x"},'
          '{"type":"uri","@id":"u","o:label":"L","is_public":0}]}',), ("broken",)], "json STRING")
    assert shown(q.from_jsonld(foreign), "resource_id", "pos", "value", "uri", "is_public") == [
        (5, 0, "x", None, True), (5, 1, "L", "u", False)]


def test_pending_edits_are_laid_over_documents(spark):
    base = spark.createDataFrame([(j,) for j in (
        '{"o:id":1,"@type":"o:Item","o:owner":{"o:id":1},"p:q":[{"type":"literal","@value":"a"},{"type":"literal","@value":"b"}],"p:r":[{"type":"literal","@value":"r \\"1\\""}]}',
        '{"o:id":1,"o:part":1,"o:start":2,"p:q":[{"type":"literal","@value":"c"}],"p:r":[{"type":"literal","@value":"r2"}]}',
        '{"o:id":2, "p:q":[{"type":"literal","@value":"as it was"}]}', "broken", '{"p:q":[]}')], "json STRING")
    pending = spark.createDataFrame([(j,) for j in (
        '{"o:id":1,"p:q":[{"type":"literal","@value":"new"}],"p:s":[{"type":"literal","@value":"s"}],"@type":null}',
        '{"o:id":3,"p:q":[{"type":"literal","@value":"three"}]}')], "json STRING")
    done = q.overlay(base, pending)
    found = {(r.resource_id, r.part): r.json for r in done.collect() if r.resource_id is not None}
    assert found[2, 0] == '{"o:id":2, "p:q":[{"type":"literal","@value":"as it was"}]}'
    import json
    first = json.loads(found[1, 0])
    assert first["@type"] is None and first["o:owner"] == {"o:id": 1} and first["p:r"][0]["@value"] == 'r "1"' and [v["@value"] for v in first["p:q"]] == ["new"]
    assert "p:q" not in json.loads(found[1, 1]) and json.loads(found[1, 1])["o:start"] == 2
    assert sorted(r.json for r in done.where("resource_id IS NULL").collect()) == ["broken", '{"p:q":[]}']
    assert shown(q.from_jsonld(done).where("resource_id <> 2"), "resource_id", "property", "pos", "value") == [
        (1, "p:q", 0, "new"), (1, "p:r", 0, 'r "1"'), (1, "p:r", 2, "r2"), (1, "p:s", 0, "s"), (3, "p:q", 0, "three")]
    assert sorted(r.json for r in q.overlay(base, pending.limit(0)).collect()) == sorted(r.json for r in base.collect())
    assert q.overlay(base.limit(0), pending).count() == 2


def test_write_back_of_changed_buckets(spark, tmp_path):
    folder = tmp_path / "b"
    values = table(spark, [dict(resource_id=i % 40, value=f"v{i}") for i in range(200)] + [dict(resource_id=None, value="no record")])
    q.write_buckets(values, str(folder), 8)

    def files():
        return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}

    before = files()
    assert rows(q.read_buckets(spark, str(folder))) == rows(values)
    assert q.write_changed(q.read_buckets(spark, str(folder)), str(folder)).count() == 0 and files() == before
    one = q.set_visibility(q.read_buckets(spark, str(folder)), False, "all", sel=[7])
    expected = rows(one)
    changed = q.write_changed(one, str(folder)).collect()
    assert len(changed) == 1 and changed[0].rows_before == changed[0].rows_after
    bucket = f"bucket={changed[0].bucket}"
    assert {p: t for p, t in files().items() if bucket not in str(p)} == {p: t for p, t in before.items() if bucket not in str(p)}
    assert rows(q.read_buckets(spark, str(folder))) == expected
    # Again it changes nothing; a bucket that loses all rows is emptied.
    assert q.write_changed(values.withColumn("is_public", F.expr("coalesce(resource_id, 0) <> 7")), str(folder)).count() == 0
    gone = q.read_buckets(spark, str(folder)).where(F.pmod(F.xxhash64("resource_id"), F.lit(8)) != changed[0].bucket)
    left = rows(gone)
    assert [r.rows_after for r in q.write_changed(gone, str(folder)).collect()] == [0]
    assert rows(q.read_buckets(spark, str(folder))) == left
    with pytest.raises(ValueError):
        q.write_buckets(values.limit(0), str(tmp_path / "e"), 8)
        q.write_changed(values, str(tmp_path / "e"))


def test_rejects(spark):
    xml = spark.createDataFrame([
        ("u1", PLACE.format(id=12, names="<gn:name>Paris</gn:name>")), ("u2", "<broken"), ("u3", None), ("u4", "  "),
        ("u5", PLACE.format(id=3, names="<gn:name> </gn:name>")), ("u6", PLACE.format(id=0, names="<gn:name>x</gn:name>"))], "uri STRING, xml STRING")
    assert sorted((r.uri, r.reason) for r in q.place_rejects(xml).collect()) == [
        ("u2", "no XML"), ("u3", "no record"), ("u4", "no record"), ("u5", "no place"), ("u6", "no place")]
    kinds = {r.uri: r.reason for r in q.authority_rejects(xml, "valuesuggest:geonames:geonames").collect()}
    assert kinds == {"u2": "no XML", "u3": "no record", "u4": "no record", "u5": "no label"}
    assert {r.uri for r in q.parse_authority(xml, "valuesuggest:geonames:geonames").collect()} == {"u1", "u6"}
    assert q.place_rejects(xml.limit(0)).count() == 0


def test_names_of_places_by_language(spark):
    from quillmend.operators.convert import best_names

    named = ('<gn:name>Paris</gn:name><gn:officialName xml:lang="en">City</gn:officialName><gn:alternateName xml:lang="fr">B</gn:alternateName>'
             '<gn:alternateName xml:lang="fr">A</gn:alternateName><gn:shortName>P</gn:shortName>')
    xml = spark.createDataFrame([("u", PLACE.format(id=12, names=named)), ("v", PLACE.format(id=9, names='<gn:alternateName xml:lang="de">Alt</gn:alternateName>')),
                                 ("w", "<broken")], "uri STRING, xml STRING")
    names = q.parse_place_names(xml, spark.createDataFrame([("FR", "France")], "code STRING, name STRING"))
    for language, expected in (("", "Paris"), ("EN-us", "City"), ("fr", "B"), ("es", "Paris")):
        assert {(r.geoname_id, r.toponym, r.country) for r in best_names(names, language).collect()} == {(12, expected, "France"), (9, "Alt", "France")}
        # Where a record is read for one language, the same name is found.
        assert {(r.geoname_id, r.toponym) for r in q.parse_places(xml, language=language).collect()} == {(12, expected), (9, "Alt")}
    values = table(spark, [dict(type="valuesuggest:geonames:geonames", uri="https://www.geonames.org/12")])
    spec = {"convert": {"from": "valuesuggest:geonames:geonames", "to": "place", "properties": ["p"], "uri_language": "fr"}}
    done = q.run_pipeline({"values": values, "resources": spark.createDataFrame([], "id BIGINT, resource_name STRING"), "places": names}, spec)
    assert '"toponym":"B"' in done["values"].first().value


def test_tables(spark, tmp_path):
    values = table(spark, VALUES)
    q.write_tables({"values": values}, str(tmp_path / "t"))
    assert rows(q.read_tables(spark, str(tmp_path / "t"), ["values"])["values"]) == rows(values)
    loose = spark.createDataFrame([(9, 1, "p", "b"), (4, 1, "p", "a")],
                                  "value_id BIGINT, resource_id BIGINT, property STRING, value STRING")
    assert shown(q.with_positions(loose), "value_id", "pos") == [(4, 0), (9, 1)]
    terms = spark.createDataFrame([(1, "dcterms:title")], "id INT, term STRING")
    named = stored.property_terms(spark.createDataFrame([(1, "a"), (2, "b")], "property_id INT, value STRING"), terms)
    assert sorted(tuple(r) for r in named.select("property", "value").collect()) == [("dcterms:title", "a"), ("property:2", "b")]


PLACE = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:gn="http://www.geonames.org/ontology#"
 xmlns:wgs84_pos="http://www.w3.org/2003/01/geo/wgs84_pos#"><gn:Feature rdf:about="https://sws.geonames.org/{id}/">{names}
<gn:countryCode>fr</gn:countryCode><wgs84_pos:lat>48.5</wgs84_pos:lat><wgs84_pos:long>2</wgs84_pos:long>
</gn:Feature></rdf:RDF>"""


def test_places(spark):
    named = ('<gn:name>Paris</gn:name><gn:officialName xml:lang="en">City</gn:officialName>'
             '<gn:officialName xml:lang="fr">Ville</gn:officialName><gn:alternateName xml:lang="de">Stadt</gn:alternateName>'
             '<gn:alternateName>Any</gn:alternateName>')
    xml = spark.createDataFrame([
        ("u1", PLACE.format(id=12, names=named)), ("u2", PLACE.format(id=0, names="<gn:name>x</gn:name>")),
        ("u3", PLACE.format(id=3, names="<gn:name> </gn:name>")), ("u4", "<broken"), ("u5", None),
        ("u6", PLACE.format(id=6, names="<gn:shortName>S</gn:shortName>"))], "uri STRING, xml STRING")
    countries = spark.createDataFrame([("FR", "France")], "code STRING, name STRING")

    def toponyms(language=""):
        return [tuple(r) for r in q.parse_places(xml, countries, language).orderBy("geoname_id").collect()]

    assert toponyms() == [(6, "S", "France", 48.5, 2.0), (12, "Paris", "France", 48.5, 2.0)]
    assert [r[1] for r in toponyms("fr-FR")] == ["S", "Ville"] and toponyms("de")[1][1] == "Stadt"
    assert q.parse_places(xml).first().country == "fr"
    labels = q.parse_authority(xml.where("uri = 'u1'"), "valuesuggest:geonames:geonames")
    assert sorted((r.kind, r.lang or "", r.label, r.priority) for r in labels.collect()) == [
        ("alternate", "", "Any", 1), ("alternate", "de", "Stadt", 0), ("name", "", "Paris", 0),
        ("official", "en", "City", 0), ("official", "fr", "Ville", 1)]


def test_headings(spark):
    xml = spark.createDataFrame([("u", "<record><datafield tag='950'><subfield code='b'>no</subfield>"
                                  "<subfield code='a'> Nine </subfield></datafield><datafield tag='250'>"
                                  "<subfield code='a'>Two</subfield></datafield></record>"), ("v", "<x>")],
                                "uri STRING, xml STRING")
    got = q.parse_authority(xml, "valuesuggest:idref:rameau").collect()
    assert sorted((r.kind, r.label, r.priority) for r in got) == [
        ("featured", "Nine", 3), ("featured", "Two", 0), ("heading", "Nine", 0)]
    with pytest.raises(ValueError):
        q.parse_authority(xml, "valuesuggest:idref:all")


def test_patterns(spark):
    def found(pattern, subject):
        return spark.range(1).select(F.lit(subject).rlike(patterns.checked_pattern(pattern))).first()[0]

    for pattern, subject, expected in (
            ("/a.c/", "abc", True), ("/a.c/", "a\nc", False), ("/a.c/s", "a\nc", True), ("/^b$/m", "a\nb", True),
            ("{x{2}}", "axx", True), ("~A~i", "a", True), ("/a b/x", "ab", True), ("/é/iu", "É", True),
            ("/[[:digit:]]+$/D", "12\n", False), ("/[[:digit:]]+$/", "12\n", True), ("/[]a]/", "]", True),
            ("/[^]a]/", "]", False), ("/[a[b]/", "[", True), ("/[a&&b]/", "&", True), ("/b/A", "ab", False),
            (r"/(?P<w_1>a)(?P=w_1)/", "aa", True), (r"/(a)\g{1}/", "aa", True), (r"/\Qa.b\E/", "a.b", True)):
        assert found(pattern, subject) is expected, pattern
    for bad in ("", "abc", "/abc", "/a/U", "/(?R)/", r"/a\Kb/", "/(?(1)a)/", "/(?|a)/", "/(/"):
        with pytest.raises(ValueError):
            patterns.checked_pattern(bad)
    assert patterns.unescape_separator(r"\n\t\\n") == "\n\t\\n"
    assert patterns.split_list([" fr = en", "", "fr"]) == ["fr", "en"]
    assert text.entity_form("é<") == "&eacute;&lt;"


def test_registry():
    types = schema.DataTypes({"customvocab:3": "resource"})
    assert [types.main(n) for n in ("customvocab:3", "customvocab:4", "valuesuggest:x:y", "resource:item", "html")] == [
        "resource", "literal", "uri", "resource", "literal"]
    with pytest.raises(ValueError):
        schema.DataTypes({"x": "nope"})


# ---------------------------------------------------------------- streaming

RECORD = ("record_id BIGINT, values ARRAY<STRUCT<property: STRING, type: STRING, lang: STRING, value: STRING,"
          " uri: STRING, value_resource_id: BIGINT, is_public: BOOLEAN>>")


def test_stream_equals_batch(spark, tmp_path):
    entries = [("p", "literal", " ", " a\xa0", None, None, True), ("p", "literal", None, "a", "", None, True),
               ("p", "literal", None, "A", None, None, True), ("p", "literal", None, "  ", None, None, True),
               ("q", "resource", None, None, None, 7, True), ("q", "resource", None, None, None, 8, True)]
    records = spark.createDataFrame([(i, entries[i % 3:] + entries[:1]) for i in range(6)] + [(9, [])], RECORD)
    resources = spark.createDataFrame([(7, "items")], "id BIGINT, resource_name STRING")
    clean = q.clean_on_write(records, resources, deduplicate=True)
    first = [tuple(v) for v in clean.where("record_id = 0").first()["values"]]
    assert first == [("p", "literal", None, "a", None, None, True), ("p", "literal", None, "A", None, None, True),
                     ("p", "literal", None, None, None, None, True), ("q", "resource:item", None, None, None, 7, True),
                     ("q", "resource", None, None, None, 8, True)]
    assert len(q.clean_on_write(records, resources).where("record_id = 0").first()["values"]) == 7
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    records.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q.start_cleaning(stream, resources, q.parquet_sink(out), str(tmp_path / "state"),
                     deduplicate=True).awaitTermination()
    assert rows(spark.read.parquet(out).drop("batch")) == rows(clean)


def test_value_stream(spark, tmp_path):
    values = table(spark, [dict(value=" a "), dict(type="resource", value_resource_id=7), dict(type="resource")])
    resources = spark.createDataFrame([(7, "items")], "id BIGINT, resource_name STRING")
    values.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(values.schema).parquet(str(tmp_path / "in"))
    (q.clean_values_on_write(stream, resources).writeStream.format("parquet")
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got) == rows(q.clean_values_on_write(values, resources))
    assert shown(got, "type", "value") == [("literal", "a"), ("resource:item", None), ("resource", None)]
