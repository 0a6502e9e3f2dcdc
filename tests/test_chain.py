from __future__ import annotations

import pytest

import quillmend as q
from quillmend.operators import _shared
from quillmend.plans import edits
from tests.helpers import rows, shown, table
from tests.test_media import media_table


def tables(spark, data):
    resources = spark.createDataFrame(
        [(1, "items", None, None, None, "I"), (2, "media", None, None, None, "M")],
        "id BIGINT, resource_name STRING, owner_id INT, thumbnail_id INT, primary_media_id BIGINT, title STRING")
    media = media_table(spark, [dict(id=2, item_id=1, media_type="image/png", source="a.png")])
    return {"values": table(spark, data), "resources": resources, "media": media}


def names(spec):
    return [e.name for e in q.normalise(spec)]


def test_normalise_orders_and_drops_incomplete_edits():
    spec = {
        "media_type": {"from": "a/b", "to": "image/png"}, "remove": {"properties": ["p"]},
        "replace": {"mode": "raw", "properties": ["p"], "prepend": "  x ", "append": " y  "},
        "cleaning": {"deduplicate_values": True, "trim_values": True, "clean_language_codes": True},
        "copy": {"from": ["a"], "to": ""}, "explode": {"properties": ["p"], "separator": ""},
        "convert": {"from": "uri", "to": "uri", "properties": ["p"]}, "merge": {},
        "order_values": {"languages": [" = "], "properties": ["p"]},
        "properties_visibility": {"visibility": "", "properties": ["p"]}, "fill_data": {"owner": "x"},
        "fill_values": {"mode": "nope", "properties": ["p"]}, "thumbnails": {"mode": "fill"},
        "media_remove": {"mode": "media_type"}, "media_order": {"order": "size"},
        "explode_item": {"mode": "nope"}, "media_html": {"mode": "raw"}, "media_visibility": {},
        "create_values": {"properties": "p", "datatype": "literal", "value": " "},
    }
    assert names(spec) == ["replace", "remove", "media_type", "trim_values", "deduplicate_values"]
    params = q.normalise(spec)[0].params
    assert (params["prepend"], params["append"], params["part"]) == ("x ", " y", "value")
    assert names({"media_source": {"mode": "basename"}}) == ["media_source"]
    assert names({"media_type": {"from": "a/b", "to": "nope"}}) == []
    assert names({"cleaning": {"clean_language_codes": True, "clean_language_codes_properties": ["p"]}}) == [
        "clean_language_codes"]
    assert q.normalise({"properties_visibility": {"visibility": "0", "properties": ["p"]}})[0].params["visible"] is False
    assert q.normalise({"fill_data": {"owner": "0"}})[0].params == {"owner_id": None}
    with pytest.raises(ValueError):
        q.normalise({"nope": {}})


def test_edits_follow_each_other_in_fixed_order(spark):
    t = tables(spark, [dict(value=" a;b "), dict(value="b", is_public=True), dict(property="l", type="resource", value_resource_id=2)])
    after = q.run_pipeline(t, {
        "cleaning": {"deduplicate_values": True, "specify_datatypes": True},
        "explode": {"properties": ["p"], "separator": ";"},
        "replace": {"mode": "raw", "from": "a", "to": "A", "properties": ["p"]},
        "fill_data": {"owner": 4}, "thumbnails": {"mode": "fill", "asset": 8},
        "media_source": {"mode": "filename"}, "media_visibility": {"visibility": 0},
    })
    assert shown(after["values"], "property", "pos", "value", "type") == [
        ("l", 0, None, "resource:media"), ("p", 0, "A", "literal"), ("p", 1, "b", "literal")]
    assert "_open" not in after["values"].columns
    # Of the two texts "b" the older row stays; the piece of row 1 is new.
    assert [r.value_id for r in after["values"].where("property = 'p'").orderBy("pos").collect()] == [1, 2]
    assert [(r.owner_id, r.thumbnail_id) for r in after["resources"].collect()] == [(4, 8)] * 2
    assert [(r.source, r.is_public) for r in after["media"].collect()] == [("a", False)]
    assert [r.edit for r in after["audit"].orderBy("step").collect()] == [
        "replace", "explode", "fill_data", "thumbnails", "media_source", "media_visibility",
        "specify_datatypes", "deduplicate_values"]
    assert tuple(after["counts"].first()) == (0, 0, 2)


@pytest.mark.parametrize("hot", [False, True])
def test_new_properties_are_closed_to_later_edits(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(_shared, "BLOCK_ROWS", 1)
    t = tables(spark, [dict(property="a", value="x1"), dict(property="a", value="x2"), dict(property="b", value="y"),
                       dict(property="b", value="z", resource_id=2), dict(property="c", value="x", resource_id=2)])
    after = q.run_pipeline(t, {
        "create_values": {"properties": "c", "datatype": "literal", "value": "x"},
        "copy": {"from": ["a"], "to": "b"},
        "displace": {"from": ["b"], "to": "new", "contains": "z"},
        "replace": {"mode": "raw", "from": "y", "to": "Y", "properties": "all"},
        "explode": {"properties": ["a", "b", "c", "new"], "separator": "x"},
    })
    found = {}
    for r in after["values"].orderBy("resource_id", "property", "pos").collect():
        found.setdefault((r.resource_id, r.property), []).append(r.value)
    assert found == {(1, "a"): ["1", "2"], (1, "b"): ["Y", "1", "2"], (1, "c"): ["x"], (2, "new"): ["z"]} | (
        {(2, "c"): []} if (2, "c") in found else {})


def test_scope_by_kind(spark):
    t = tables(spark, [dict(value="a", resource_id=1), dict(value="a", resource_id=2)])
    spec = {"replace": {"mode": "raw", "from": "a", "to": "b", "properties": ["p"]},
            "media_visibility": {"visibility": 0}, "media_remove": {"mode": "all"}}
    items = q.run_pipeline(t, spec, kind="items")
    assert shown(items["values"], "value") == [("b",), ("a",)] and items["media"].count() == 0
    media = q.run_pipeline(t, spec, kind="media")
    assert shown(media["values"], "value") == [("a",), ("b",)]
    assert [r.is_public for r in media["media"].collect()] == [False]
    sets = q.run_pipeline(t, spec, kind="item_sets")
    assert rows(sets["media"]) == rows(t["media"]) and rows(sets["values"]) == rows(t["values"])
    one = q.run_pipeline(t, spec, kind="items", sel=[2])
    assert rows(one["values"]) == rows(t["values"])


def test_hot_and_small_chains_agree(spark, monkeypatch):
    data = [dict(resource_id=i % 3, value=f"v{i % 7} ;w{i}", lang=("fr", "en", None)[i % 3]) for i in range(40)]
    data += [dict(resource_id=i % 3, property="o", value=f"https://h/{i}" if i % 2 else f"N{i}") for i in range(24)]
    spec = {
        "create_values": {"properties": "p", "datatype": "literal", "value": "new;w1"},
        "replace": {"mode": "regex", "from": "/v[35]/", "to": "", "properties": ["p"]},
        "copy": {"from": "all", "to": "o", "contains": "v1", "max_values": 2},
        "explode": {"properties": ["p"], "separator": ";"},
        "merge": {"properties": ["o"]},
        "convert": {"from": "literal", "to": "html", "properties": ["o"]},
        "order_values": {"languages": ["en"], "properties": ["p"]},
        "remove": {"properties": ["p"], "max_values": -2},
        "cleaning": {"trim_values": True, "specify_datatypes": True, "deduplicate_values": True},
    }

    def run():
        return rows(q.run_pipeline(tables(spark, data), spec)["values"])

    small = run()
    monkeypatch.setattr(_shared, "BLOCK_ROWS", 2)
    assert run() == small


def test_chain_shuffles_rows_once(spark, tmp_path):
    table(spark, [dict(value="a;b")]).write.parquet(str(tmp_path / "v"))
    values = q.measure_groups(spark.read.parquet(str(tmp_path / "v")))
    t = tables(spark, []) | {"values": values}
    after = q.run_pipeline(t, {
        "explode": {"properties": ["p"], "separator": ";"},
        "order_values": {"languages": ["en"], "properties": ["p"]},
        "merge": {"properties": ["p"]},
        "cleaning": {"trim_values": True, "deduplicate_values": True}})
    plan = after["values"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


CHOSEN = {
    "replace": {"mode": "raw", "from": "v", "to": "w", "properties": ["p"]},
    "copy": {"from": ["p"], "to": "o", "max_values": 1},
    "explode": {"properties": ["p"], "separator": ";"},
    "order_values": {"languages": ["en"], "properties": ["p"]},
    "remove": {"properties": ["o"], "max_values": 1},
    "cleaning": {"trim_values": True, "deduplicate_values": True},
}


def test_a_selection_is_joined_once(spark, tmp_path):
    table(spark, [dict(value="a;b")]).write.parquet(str(tmp_path / "v"))
    t = tables(spark, []) | {"values": spark.read.parquet(str(tmp_path / "v"))}
    spec = {name: CHOSEN[name] for name in ("replace", "explode", "order_values", "cleaning")}
    done = q.run_pipeline(t, spec, kind="items")["values"]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1, plan
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("property" in line for line in windows)


def test_selections_agree_however_they_are_given(spark, monkeypatch):
    data = [dict(resource_id=i % 4, value=f"v{i % 5} ;x{i}", lang=("fr", "en")[i % 2]) for i in range(60)]
    data += [dict(resource_id=1, property="o", value=f"v{i % 3}") for i in range(20)]
    resources = spark.createDataFrame([(i, "items" if i < 3 else "media", 1, None, None, "r") for i in range(4)],
                                      "id BIGINT, resource_name STRING, owner_id INT, thumbnail_id INT, primary_media_id BIGINT, title STRING")
    t = tables(spark, data) | {"resources": resources}
    ids = spark.createDataFrame([(1,), (2,), (1,), (None,), (99,)], "any BIGINT")

    def run(**selection):
        return rows(q.run_pipeline(t, CHOSEN, **selection)["values"])

    listed = run(sel=[1, 2])
    assert run(sel=ids) == listed and run(sel=ids, kind="items") == listed != run()
    assert run(sel=[1, 2, 3], kind="items") == listed
    assert run(sel=ids.limit(0)) == run(sel=[])
    monkeypatch.setattr(_shared, "BLOCK_ROWS", 3)
    monkeypatch.setattr(_shared, "HOT_SPREAD", 5)
    assert _shared.hot_records(t["values"]) == [0, 1, 2, 3]
    assert run(sel=ids) == listed and run(sel=ids, kind="items") == listed


@pytest.mark.parametrize("hot", [False, True])
def test_counts_of_edits(spark, monkeypatch, tmp_path, hot):
    if hot:
        monkeypatch.setattr(_shared, "BLOCK_ROWS", 2)
    t = tables(spark, [dict(value=" a;b;; "), dict(value="a"), dict(value="A", is_public=True), dict(property="q", value="http://x"),
                       dict(property="q", value="Name"), dict(property="e", value=" "), dict(resource_id=2, value="m")])
    done = q.run_pipeline(t, {
        "create_values": {"properties": "p", "datatype": "literal", "value": "b"},
        "copy": {"from": ["e"], "to": "q2"}, "displace": {"from": ["e"], "to": "e2"},
        "explode": {"properties": ["p"], "separator": ";"}, "merge": {"properties": ["q"]}, "fill_data": {"owner": 9},
        "explode_item": {"mode": "append"}, "media_visibility": {"visibility": 0},
        "cleaning": {"trim_values": True, "deduplicate_values": True}}, count_edits=True)
    for name in ("values", "resources", "media"):
        done[name].write.parquet(str(tmp_path / name))
        assert "_was" not in done[name].columns
    found = {(r.edit, r.table): (r.added, r.changed, r.removed) for r in done["edit_counts"].table().collect()}
    assert found == {
        ("create_values", "values"): (2, 0, 0), ("copy", "values"): (1, 0, 0), ("displace", "values"): (0, 1, 0),
        ("explode", "values"): (1, 1, 0), ("merge", "values"): (0, 1, 1), ("fill_data", "resources"): (0, 2, 0),
        # The item has one media: nothing is made, the media's values (one, and the new one) pass on.
        ("explode_item", "resources"): (0, 1, 0), ("explode_item", "media"): found["explode_item", "media"],
        ("explode_item", "values"): (2, 0, 0), ("media_visibility", "media"): (0, 1, 0),
        ("trim_values", "values"): (0, 0, 2), ("deduplicate_values", "values"): (0, 0, 4)}
    assert sum(r.changed for r in done["edit_counts"].table().where("edit = 'explode_item'").collect()) >= 1
