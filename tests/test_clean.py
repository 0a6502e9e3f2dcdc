from __future__ import annotations

import pytest

import quillmend as q
from tests.helpers import rows, shown, table


def test_trim(spark):
    values = table(spark, [
        dict(value=" \ta\xa0　"), dict(value="  ", lang="fr"), dict(value=None, lang="fr"),
        dict(type="uri", uri=" http://x ", lang=" en "), dict(type="resource", value_resource_id=4),
        dict(value="a\n b"), dict(resource_id=2, value=" keep ")])
    after = q.trim_values(values, sel=[1])
    assert shown(after, "pos", "value", "uri", "lang") == [
        (0, "a", None, None), (1, None, "http://x", "en"), (2, None, None, None),
        (3, "a\n b", None, None), (0, " keep ", None, None)]
    assert rows(q.trim_values(after, sel=[1])) == rows(after)


def test_clean_empty_and_languages(spark):
    values = table(spark, [dict(value="", uri="", lang=""), dict(value=" ", lang="fr")])
    assert shown(q.clean_empty_values(values), "value", "uri", "lang") == [
        (None, None, ""), (" ", None, "fr")]
    assert shown(q.clean_languages(values), "value", "lang") == [("", None), (" ", "fr")]
    assert rows(q.clean_languages(values, sel=[])) == rows(values)


def test_language_codes(spark):
    values = table(spark, [dict(lang="fr"), dict(lang=""), dict(lang=None), dict(lang="en"),
                           dict(lang="fr", property="o"), dict(lang="", resource_id=2)])

    def langs(*args, **options):
        after = q.clean_language_codes(values, *args, **options)
        return [r.lang for r in after.orderBy("value_id").collect()]

    assert langs("fr", "fra", ["p"]) == ["fra", "", None, "en", "fr", ""]
    assert langs("fr", "", "all") == [None, "", None, "en", None, ""]
    # Blank means blank or null, within the selection only.
    assert langs("", "und", "all", sel=[1]) == ["fr", "und", "und", "en", "fr", ""]
    assert langs("fr", "fra", ["unknown"]) == ["fr", "", None, "en", "fr", ""]
    with pytest.raises(ValueError):
        langs("fr", "fra", [])


def test_specify(spark):
    resources = spark.createDataFrame(
        [(1, "items"), (2, "media"), (3, "item_sets"), (4, "annotations"), (5, "other")],
        "id BIGINT, resource_name STRING")
    values = table(spark, [dict(type="resource", value_resource_id=i) for i in (1, 2, 3, 4, 5, 99, None)]
                   + [dict(type="resource:item", value_resource_id=2), dict(value="x")])
    types = [r.type for r in q.specify_datatypes(values, resources).orderBy("value_id").collect()]
    assert types == ["resource:item", "resource:media", "resource:itemset", "resource:annotation",
                     "resource", "resource", "resource", "resource:item", "literal"]


# Cases of pairs of equal texts: annotation parts of each row, and the rows that stay.
PAIRS = {
    "true duplicates": (None, [], [1]),
    "no annotation table": (None, [], [1]),
    "annotation and body": (None, [(1, "annotation", 0), (2, "body", 1)], [1, 2]),
    "annotation and target": (None, [(1, "annotation", 0), (2, "target", 1)], [1, 2]),
    "body and target": (None, [(1, "body", 1), (2, "target", 1)], [1, 2]),
    "two bodies": (None, [(1, "body", 1), (2, "body", 2)], [1, 2]),
    "same body": (None, [(1, "body", 1), (2, "body", 1)], [1]),
    "other annotation": (7, [], [1, 2]),
}


@pytest.mark.parametrize("measured", [False, True])
def test_deduplicate_pairs(spark, measured):
    data, parts, expected = [], [], []
    for k, (annotation, fields, kept) in enumerate(PAIRS.values()):
        data += [dict(resource_id=k + 1, value="same", value_id=10 * k + 1),
                 dict(resource_id=k + 1, value="same", value_id=10 * k + 2,
                      value_annotation_id=annotation)]
        parts += [(10 * k + i, 1, field, ordinal) for i, field, ordinal in fields]
        expected += [10 * k + i for i in kept]
    annotations = spark.createDataFrame(
        parts, "id BIGINT, annotation_id BIGINT, field STRING, ordinal SMALLINT")
    values = table(spark, data)
    if measured:
        values = q.measure_groups(values)
    after = q.deduplicate_values(values, annotation_values=annotations)
    assert sorted(r.value_id for r in after.collect()) == expected
    plain = q.deduplicate_values(values)
    assert sorted(r.value_id for r in plain.where("resource_id = 5").collect()) == [41]
    assert rows(q.deduplicate_values(after, annotation_values=annotations)) == rows(after)


@pytest.mark.parametrize("measured", [False, True])
def test_deduplicate_keys(spark, measured):
    values = table(spark, [
        dict(value="a", value_id=5), dict(value="A", value_id=3), dict(value="a", value_id=None),
        dict(value="a", lang="fr"), dict(value="a", is_public=False), dict(value="a", type="html"),
        dict(value="a", property="o"), dict(resource_id=2, value="b", value_id=20),
        dict(resource_id=2, value="b", value_id=21)])
    if measured:
        values = q.measure_groups(values)
    after = q.deduplicate_values(values, sel=[1])
    assert shown(after.where("property = 'p'"), "pos", "value", "value_id") == [
        (0, "A", 3), (1, "a", 4), (2, "a", 5), (3, "a", 6), (0, "b", 20), (1, "b", 21)]
    strict = q.deduplicate_values(values, case_sensitive=True)
    assert sorted(r.value_id for r in strict.where("property = 'p'").collect()) == [3, 4, 5, 5, 6, 20]


def test_counts_of_changes(spark):
    before = table(spark, [dict(value="a"), dict(value="b "), dict(value=" ")])
    resources = spark.createDataFrame([(1,)], "id BIGINT")
    after = q.create_values(q.trim_values(before, renumber=False), resources, "p", "literal", value="n")
    assert tuple(q.changes(before, after).first()) == (1, 1, 1)
    assert [r.property for r in q.facets(before, "property").collect()] == ["p"]
