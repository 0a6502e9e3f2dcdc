from __future__ import annotations

import pytest

import quillmend as q
from quillmend import schema
from quillmend.functions import text
from quillmend.operators import _shared, media as m
from pyspark.sql import functions as F
from tests.helpers import rows, shown, table


def media_table(spark, data):
    out = []
    for i, given in enumerate(data):
        row = dict(id=i + 1, item_id=1, position=i + 1, title=None, source=None, media_type=None,
                   extension=None, ingester="url", renderer="file", is_public=True, html=None)
        row.update(given)
        out.append(tuple(row[name] for name in schema.MEDIA.names))
    return spark.createDataFrame(out, schema.MEDIA)


def test_thumbnails_and_owner(spark):
    resources = spark.createDataFrame(
        [(1, None, None, 1), (2, 5, None, 2), (3, None, 9, None), (4, 6, 9, 4)],
        "id BIGINT, thumbnail_id INT, primary_media_id BIGINT, owner_id INT")

    def thumbs(mode, asset=5, sel=None):
        after = q.set_thumbnail(resources, mode, asset, sel=sel)
        return [r.thumbnail_id for r in after.orderBy("id").collect()]

    assert thumbs("fill", 7) == [7] * 4
    assert thumbs("append", 7) == [7, 5, 7, 6]
    assert thumbs("append_no_primary", 7) == [7, 7, None, 6]
    assert thumbs("append_no_primary_no_thumbnail", 7) == [7, 5, None, 6]
    assert thumbs("replace", 7) == [None, 7, None, 7]
    assert thumbs("remove", 5) == [None, None, None, 6]
    assert thumbs("remove_primary", None) == [None, 5, None, None]
    assert thumbs("delete", None, sel=[4]) == [None, 5, None, None]
    for bad in (("nope", 1), ("fill", None)):
        with pytest.raises(ValueError):
            thumbs(*bad)
    owners = q.set_owner(resources, 0, sel=spark.createDataFrame([(2,)], "id INT"))
    assert [r.owner_id for r in owners.orderBy("id").collect()] == [1, None, None, 4]


def test_flat_edits(spark):
    media = media_table(spark, [
        dict(media_type="text/html", extension="html", ingester="html", html=" <p>a</p> ", source="/a/b.html"),
        dict(media_type="image/png", extension="png", source="http://h/c.PNG", html="<p>", is_public=False),
        dict(media_type="image/png", extension="png", item_id=2, renderer="x", ingester="html", html="")])

    def of(df, column):
        return [r[column] for r in df.orderBy("id").collect()]

    assert of(q.remove_media(media, "all", sel=[1]), "id") == [3]
    assert of(q.remove_media(media, "media_type", media_types=["image/png"]), "id") == [1]
    assert of(q.remove_media(media, "media_extension", extensions=["html = gif"]), "id") == [2, 3]
    assert of(q.edit_media_html(media, "raw_i", from_="<P>", to="<i>", prepend="!"), "html") == [
        "! <i>a</p>", "<p>", ""]
    assert of(q.edit_media_html(media, "remove"), "html") == ["", "<p>", ""]
    assert of(q.edit_media_source(media, "basename"), "source") == ["b.html", "c.PNG", None]
    assert of(q.edit_media_source(media, "filename", append="!", by="id", sel=[2]), "source") == [
        "/a/b.html", "c!", None]
    assert of(q.edit_media_source(media, "remove"), "source") == [None] * 3
    assert of(q.set_media_type(media, " IMAGE/png", "image/WebP", sel=[1]), "media_type") == [
        "text/html", "image/webp", "image/png"]
    assert of(q.set_media_visibility(media, False, media_types=["image/png"], renderers=["x"]), "is_public") == [
        True, False, False]
    for bad in (lambda: q.remove_media(media, "media_type"), lambda: q.set_media_type(media, "a/b", "nope"),
                lambda: q.edit_media_html(media, "basename"), lambda: q.order_media(media, "size")):
        with pytest.raises(ValueError):
            bad()
    assert [r[0] for r in spark.createDataFrame([("image/png",), ("x",), (None,)], "t STRING").select(
        m.valid_media_type(F.col("t"))).collect()] == [True, False, False]


FILES = [
    dict(title="img12", source="z/B.png", media_type="image/png", extension="png"),
    dict(title="IMG2", source="z/a.jpg", media_type="image/jpeg", extension="jpg"),
    dict(title="img10", source="y/c.mp4", media_type="video/mp4", extension="mp4"),
    dict(title="b", source="x/a.png", media_type="image/png", extension="png"),
    dict(title="a", source="w/d.avi", media_type="video/avi", extension="avi"),
]


@pytest.mark.parametrize("order, options, expected", [
    ("title", {}, [5, 4, 2, 3, 1]),
    ("source", {}, [5, 4, 3, 2, 1]),
    ("basename", {}, [2, 4, 1, 3, 5]),
    ("mediatype", dict(media_types=["video", "image/png"]), [3, 5, 1, 4, 2]),
    ("extension", dict(extensions=["png"]), [1, 4, 5, 2, 3]),
    ("mediatype/title", {}, [2, 4, 1, 5, 3]),
    ("mediatype/title", dict(media_types=["video"]), [5, 3, 2, 4, 1]),
    ("mediatype/basename", dict(media_types=["image"]), [2, 4, 1, 5, 3]),
    ("basename/mediatype", dict(media_types=["image", "image/png"]), [4, 2, 1, 3, 5]),
    ("basename/extension", dict(extensions=["png"]), [4, 2, 1, 3, 5]),
    ("extension/source", {}, [5, 2, 3, 4, 1]),
])
def test_order(spark, order, options, expected):
    media = media_table(spark, FILES)
    once = q.order_media(media, order, **options)
    assert [r.id for r in once.orderBy("position").collect()] == expected
    assert sorted(r.position for r in once.collect()) == [1, 2, 3, 4, 5]


def test_order_without_second_criterion(spark):
    files = [dict(f, source=None, item_id=2, id=i + 10) for i, f in enumerate(FILES)]
    media = media_table(spark, files + FILES)
    after = q.order_media(media, "mediatype/source")
    # Blank everywhere in item 2: natural order of the first criterion, ties as they were.
    assert [r.id - 9 for r in after.where("item_id = 2").orderBy("position").collect()] == [2, 1, 4, 5, 3]
    kept = q.order_media(media, "title", sel=[1]).where("item_id = 2")
    assert [r.id - 9 for r in kept.orderBy("position").collect()] == [1, 2, 3, 4, 5]


def test_order_of_large_items(spark):
    media = media_table(spark, [dict(title=f"t{(i * 37) % 101}", item_id=1 + (i % 5 == 0)) for i in range(90)])
    for order in ("title", "title/mediatype"):
        assert rows(q.order_media(media, order, item_rows=20)) == rows(q.order_media(media, order))
        assert rows(q.order_media(media, order, item_rows=1)) == rows(q.order_media(media, order))
    tied = media_table(spark, [dict(title="t", position=None if i % 2 else 3) for i in range(50)])
    assert rows(q.order_media(tied, "title", item_rows=4)) == rows(q.order_media(tied, "title"))


def test_order_runs_no_job_while_planning(spark):
    media = media_table(spark, FILES)
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        q.order_media(media, "title/mediatype", item_rows=2)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_explode_items_reads_values_three_times_at_most(spark, tmp_path):
    table(spark, [dict(value="a")]).write.parquet(str(tmp_path / "vals"))
    values = spark.read.parquet(str(tmp_path / "vals"))
    resources = spark.createDataFrame([(1, "items", None)], "id BIGINT, resource_name STRING, primary_media_id BIGINT")
    media = media_table(spark, [dict(id=11), dict(id=12)])
    for mode, given in (("append", values), ("append", q.measure_groups(values)), ("update", values), ("replace", values), ("none", values)):
        plan = q.explode_items(resources, media, given, mode)[2]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") <= (2 if mode == "update" or _shared.is_small(given) else 3 if mode == "append" else 1), plan


def test_explode_items_in_blocks_and_chains(spark, monkeypatch):
    """Hot items give the same rows; new items are not selected for what follows."""
    resources = spark.createDataFrame(
        [(1, "items", None, 5), (2, "items", None, 5), (11, "media", None, 5), (12, "media", None, 5), (13, "media", None, 5)],
        "id BIGINT, resource_name STRING, primary_media_id BIGINT, owner_id INT")
    media = media_table(spark, [dict(id=12, position=None), dict(id=11, position=7), dict(id=13, item_id=2)])
    values = table(spark, [dict(resource_id=r, property=p, value=f" {p}{k} ", pos=k * 3 if r != 12 else None)
                           for r in (1, 2, 11, 12) for p in ("t", "d") for k in range(3) if (r, p) != (11, "d")])

    def run():
        return [rows(q.explode_items(resources, media, values, mode)[2]) for mode in m.EXPLODE_MODES]

    whole = run()
    monkeypatch.setattr(_shared, "BLOCK_ROWS", 2)
    assert run() == whole
    t = {"values": values, "resources": resources, "media": media}
    done = q.run_pipeline(t, {"explode_item": {"mode": "append"}, "media_visibility": {"visibility": 0},
                              "cleaning": {"trim_values": True}}, sel=spark.createDataFrame([(1,)], "id BIGINT"))
    trimmed = {r.resource_id: r.value == r.value.strip() for r in done["values"].collect()}
    # 25 is the item made for media 12.
    assert trimmed == {1: True, 2: False, 11: False, 12: False, 25: False}
    assert {r.id: r.is_public for r in done["media"].collect()} == {11: False, 12: True, 13: True}
    assert set(done["values"].columns) == set(schema.VALUES.names)


def test_explode_items(spark):
    resources = spark.createDataFrame(
        [(1, "items", None, "I"), (2, "items", None, "J"), (11, "media", None, "M"), (12, "media", None, "N"),
         (50, "item_sets", None, "S")],
        "id BIGINT, resource_name STRING, primary_media_id BIGINT, title STRING")
    media = media_table(spark, [dict(id=12, position=2), dict(id=11, position=1), dict(id=13, item_id=99)])
    values = table(spark, [
        dict(resource_id=1, property="t", value="item"), dict(resource_id=1, property="d", value="desc"),
        dict(resource_id=11, property="t", value="first"), dict(resource_id=12, property="t", value="second"),
        dict(resource_id=2, property="t", value="other")])

    def result(mode):
        after = q.explode_items(resources, media, values, mode)[2]
        found = {}
        for r in after.orderBy("resource_id", "property", "pos").collect():
            found.setdefault((r.resource_id, r.property), []).append(r.value)
        assert found[(2, "t")] == ["other"] and found[(11, "t")] == ["first"]
        return [found.get((i, p)) for i in (1, 62) for p in ("t", "d")]

    assert result("append") == [["item", "first"], ["desc"], ["item", "second"], ["desc"]]
    assert result("update") == [["first"], ["desc"], ["second"], ["desc"]]
    assert result("replace") == [["first"], None, ["second"], None]
    assert result("none") == [["item"], ["desc"], ["item"], ["desc"]]
    new_resources, new_media, _ = q.explode_items(resources, media, values, "none")
    assert shown(new_resources.orderBy("id"), "id", "primary_media_id", "title") == [
        (1, 11, "I"), (2, None, "J"), (11, None, "M"), (12, None, "N"), (50, None, "S"), (62, 12, "I")]
    assert shown(new_media.orderBy("id"), "id", "item_id", "position") == [(11, 1, 1), (12, 62, 1), (13, 99, 3)]


def test_page_manifest(spark):
    pdf = dict(media_type="application/pdf")
    media = media_table(spark, [
        dict(id=1, source="/x/Café (1).pdf", **pdf), dict(id=2, media_type="image/jpeg", source="b.0002.jpg"),
        dict(id=3, source="b.pdf", **pdf), dict(id=4, item_id=2, source="none.pdf", **pdf)])
    counts = spark.createDataFrame([(1, 2), (3, 3), (4, 0)], "media_id BIGINT, page_count INT")

    def pages(**options):
        after = q.page_manifest(media, counts, **options).orderBy("position")
        return shown(after, "item_id", "media_id", "page", "source", "position")

    first = [(1, 1, 1, "Cafe_[1].0001.jpg", 4), (1, 1, 2, "Cafe_[1].0002.jpg", 5)]
    assert pages() == [*first, (1, 3, 1, "b.0001.jpg", 6), (1, 3, 2, "b.0002.jpg", 7), (1, 3, 3, "b.0003.jpg", 8)]
    assert pages(mode="first") == first
    assert [p[4] for p in pages(mode="last")] == [4, 5, 6]
    assert [(p[2], p[4]) for p in pages(mode="last", skip_existing=True)] == [(1, 4), (3, 6)]
    assert pages(sel=[2]) == []


def test_names(spark):
    names = ["Éléphant Æsop & co.txt", " a/b:c ", "straße", "x" * 200, "<b>t</b>(1)"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    got = [r[0] for r in df.select(text.ascii_name(text.sanitize_name(F.col("n")))).collect()]
    assert got == ["Elephant_AEsop_co.txt", "a_b_c", "strasze", "x" * 180, "t[1]"]
    keys = spark.createDataFrame([(n,) for n in ("a10", "A2", "a1b", "a01c", "a", "a100000000000000000000000")],
                                 "n STRING").orderBy(text.natural_key(F.col("n")))
    assert [r.n for r in keys.collect()] == ["a", "a01c", "a1b", "A2", "a10", "a100000000000000000000000"]


@pytest.mark.parametrize("ordered", [
    ["IMG0.png", "img1.png", "img2.png", "IMG3.png", "img10.png", "img12.png"],
    ["0", "5", "08", "9", "010", "11"],                       # zeros in front of the text do not count
    ["x0", "x00", "x01", "x010", "x02", "x1", "x2", "x10"],   # elsewhere they make fractions
    ["v" + "9" * 30, "v1" + "0" * 30, "v1" + "0" * 29 + "1"],
    ["a", "a ", "a1", "a1 ", "a1 b", "a1b", "a b"],
    ["", "1", "2 x", "2a", "12", "A", "_", "\u00c9", "\u00e9"],
    ["1.5", "1.10", "1a", "1z9", "1z10"],
])
def test_natural_order(spark, ordered):
    """Cases worked out by hand from the rules of natural, case-insensitive comparison."""
    shuffled = spark.createDataFrame([(n,) for n in sorted(ordered, key=lambda n: (len(n) % 3, n))], "n STRING")
    found = [r.n for r in shuffled.orderBy(text.natural_key(F.col("n")), "n").collect()]
    assert found == ordered
    assert spark.range(1).select(text.natural_key(F.lit(None).cast("string"))).first()[0] is None
    same = spark.createDataFrame([("a b",), ("A  B",), (" ab",)], "n STRING").select(text.natural_key(F.col("n"))).distinct()
    assert same.count() == 1
