from __future__ import annotations

import pytest

import quillmend as q
from quillmend import schema
from quillmend.operators import _shared
from tests.helpers import rows, shown, table


def texts(df, prop="p", column="value"):
    return [r[column] for r in df.where(f"property = '{prop}'").orderBy("resource_id", "pos").collect()]


# ---------------------------------------------------------------- replacement batches

@pytest.mark.parametrize("count, needle, to, mode, text, checked", [
    (50, "FIND_ME_SMALL", "REPLACED_SMALL", "raw", "FIND_ME_SMALL", range(50)),
    (260, "FIND_ME_LARGE", "REPLACED_LARGE", "raw", "FIND_ME_LARGE", (0, 99, 100, 199, 200, 259)),
    (110, "SELECT_ALL_TEST", "SELECTED_REPLACED", "raw", "SELECT_ALL_TEST", range(110)),
    (100, "EXACT_100", "REPLACED_100", "raw", "EXACT_100", (0, 99)),
    (55, r"/REGEX_\d+_TEST/", "REGEX_REPLACED", "regex", "REGEX_{i}_TEST", (0, 54)),
])
def test_replace_batches(spark, count, needle, to, mode, text, checked):
    data = []
    for i in range(1, count + 1):
        found = text.format(i=i) if mode == "regex" else text
        data.append(dict(resource_id=i, property="dcterms:title", value=f"Item {i}"))
        data.append(dict(resource_id=i, property="dcterms:description",
                         value=f"Description with {found} for item {i}"))
    sel = None if needle == "SELECT_ALL_TEST" else list(range(1, count + 1))
    result = q.replace(table(spark, data), mode, ["all"], from_=needle, to=to, sel=sel)
    described = {r.resource_id: r.value for r in result.where(
        "property = 'dcterms:description'").collect()}
    assert len(described) == count
    for i in checked:
        assert described[i + 1] == f"Description with {to} for item {i + 1}"
    assert texts(result.where("resource_id = 7"), "dcterms:title") == ["Item 7"]


@pytest.mark.parametrize("mode, options, before, after", [
    ("raw", dict(from_="a", to="b"), "banana", "bbnbnb"),
    ("raw", dict(from_="", to="b"), " banana ", "banana"),
    ("raw_i", dict(from_="A.", to="$1"), "xa.yA.z", "x$1y$1z"),
    ("raw_i", dict(from_="a\\Eb", to="-"), "1A\\EB2", "1-2"),
    ("html", dict(from_="café", to="tea"), "café, caf&eacute;", "tea, tea"),
    ("unicode", {}, "cafÃ©", "café"),
    ("unicode", {}, "café", "café"),
    ("unicode", {}, "日本 Ã©", "日本 Ã©"),
    ("regex", dict(from_="~(\\d)(\\d)~", to="\\2${1}0"), "12-34", "210-430"),
    ("regex", dict(from_="/X/i", to="a$b\\"), "x", "a$b\\"),
    ("basename", {}, "/a/b/c.tar.gz/", "c.tar.gz"),
    ("filename", {}, "/a/b/c.tar.gz", "c.tar"),
    ("filename", {}, ".htaccess", None),
    ("remove", dict(prepend="X"), "abc", "X"),
    ("remove", {}, "abc", None),
    ("raw", dict(prepend="<", append=" >"), " abc ", "<abc >"),
])
def test_replace_modes(spark, mode, options, before, after):
    result = q.replace(table(spark, [dict(value=before)]), mode, ["p"], **options)
    assert texts(result) == ([] if after is None else [after])


def test_replace_parts(spark):
    data = [
        dict(value="x", type="literal"),
        dict(value="x", type="html"),
        dict(value="x", uri="http://x", type="uri"),
        dict(value_resource_id=5, type="resource"),
        dict(value="x", type="literal", is_public=False, property="other"),
    ]
    values = table(spark, data)

    def changed(part, **options):
        after = q.replace(values, "raw", ["p"], part=part, from_="x", to="y", **options)
        return [(r.type, r.value, r.uri, r.lang) for r in after.orderBy("property", "pos").collect()]

    assert changed("value", language="fr") == [
        ("literal", "x", None, None), ("literal", "y", None, "fr"), ("html", "y", None, "fr"),
        ("uri", "x", "http://x", None), ("resource", None, None, None)]
    assert changed("literal")[1:3] == [("literal", "y", None, None), ("html", "x", None, None)]
    assert changed("uri")[3] == ("uri", "x", "http://y", None)
    assert changed("uri_label")[3] == ("uri", "y", "http://x", None)


def test_replace_drops_emptied_rows_and_closes_up(spark):
    values = table(spark, [dict(value="a"), dict(value="b"), dict(value="a"), dict(value="c")])
    result = q.replace(values, "raw", "all", from_="a")
    assert shown(result, "pos", "value") == [(0, "b"), (1, "c")]
    uris = table(spark, [dict(type="uri", uri="http://x", value="L")])
    assert shown(q.replace(uris, "remove", "all", part="uri_label"), "uri", "value") == [("http://x", None)]
    assert q.replace(uris, "remove", "all", part="uri").count() == 0


def test_replace_checks_parameters(spark):
    values = table(spark, [dict(value="a")])
    for bad in (dict(mode="nope", properties="p"), dict(mode="raw", properties=[]),
                dict(mode="raw", properties="p", part="nope"),
                dict(mode="regex", properties="p", from_="/(/"),
                dict(mode="regex", properties="p", from_=""),
                dict(mode="regex", properties="p", from_="/(?R)/")):
        with pytest.raises(ValueError):
            q.replace(values, **bad)


# ---------------------------------------------------------------- selection

def test_selection(spark):
    values = table(spark, [dict(resource_id=i, value="a") for i in (1, 2, 3)])
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id INT")

    def touched(sel):
        after = q.replace(values, "raw", "all", from_="a", to="b", sel=sel)
        assert after.count() == 3
        return [r.resource_id for r in after.where("value = 'b'").orderBy("resource_id").collect()]

    assert touched(None) == [1, 2, 3]
    assert touched([]) == []
    assert touched([0, "3"]) == [3]
    assert touched(ids) == [2]


# ---------------------------------------------------------------- create, copy, displace

def test_create(spark):
    values = table(spark, [dict(resource_id=1, value="a"), dict(resource_id=1, value="b")])
    resources = spark.createDataFrame([(1,), (2,)], "id BIGINT")
    added = q.create_values(values, resources, "p", "literal", value=" new ", language="fr",
                            visibility=False)
    assert shown(added, "resource_id", "pos", "value", "lang", "is_public", "value_id") == [
        (1, 0, "a", None, True, 1), (1, 1, "b", None, True, 2),
        (1, 2, "new", "fr", False, None), (2, 0, "new", "fr", False, None)]
    uri = q.create_values(values, resources, "p", "uri", value="http://x", uri_label="X",
                          language="fr", sel=[2]).where("resource_id = 2").first()
    assert (uri.uri, uri.value, uri.lang) == ("http://x", "X", None)
    link = q.create_values(values, resources, "p", "resource:item", value_resource_id=5,
                           sel=[2]).where("resource_id = 2").first()
    assert (link.value_resource_id, link.value) == (5, None)
    for bad in (dict(value=" "), dict(value="x", datatype="")):
        with pytest.raises(ValueError):
            q.create_values(values, resources, "p", **{"datatype": "literal", **bad})


SOURCES = [dict(property="t", value="t1"), dict(property="a", value="a1", lang="fr"),
           dict(property="a", value="a2", lang="en"), dict(property="a", value="a3", lang="fr"),
           dict(property="b", value="b1", is_public=False)]


def test_copy(spark):
    values = table(spark, SOURCES)
    assert texts(q.copy_values(values, ["b", "a"], "t"), "t") == ["t1", "b1", "a1", "a2", "a3"]
    assert texts(q.copy_values(values, "all", "t"), "t") == ["t1", "a1", "a2", "a3", "b1"]
    assert texts(q.copy_values(values, ["a", "t"], "t", languages=["fr"]), "t") == ["t1", "a1", "a3"]
    assert texts(q.copy_values(values, "all", "t", visibility=False), "t") == ["t1", "b1"]
    assert texts(q.copy_values(values, "all", "t", contains="2", datatype="html"), "t", "type") == [
        "literal", "html"]
    assert texts(q.copy_values(values, "all", "t", match="/[ab]1/"), "t") == ["t1", "a1", "b1"]
    # N means N (not one more).
    assert texts(q.copy_values(values, "all", "t", max_values=2), "t") == ["t1", "a1", "a2", "b1"]
    copied = q.copy_values(values, ["a"], "t")
    assert copied.count() == 8 and texts(copied, "a") == ["a1", "a2", "a3"]
    assert texts(copied, "t", "value_id") == [1, None, None, None]
    with pytest.raises(ValueError):
        q.copy_values(values, ["t"], "t")
    with pytest.raises(ValueError):
        q.copy_values(values, ["a"], "t", max_values=-1)


def test_displace(spark):
    values = table(spark, SOURCES)
    moved = q.displace_values(values, ["a"], "t", languages=["fr"], max_values=1)
    assert texts(moved, "t") == ["t1", "a1"] and texts(moved, "a") == ["a2", "a3"]
    assert texts(moved, "a", "pos") == [0, 1] and texts(moved, "t", "value_id") == [1, 2]
    assert moved.count() == len(SOURCES)
    everything = q.displace_values(values, "all", "t", datatype="html")
    assert texts(everything, "t", "type") == ["literal", "html", "html", "html", "html"]
    assert everything.select("property").distinct().count() == 1


def test_filters_skip_rows_without_text(spark):
    values = table(spark, [dict(property="a", value="x", uri="http://x", type="uri"),
                           dict(property="a", value_resource_id=4, type="resource"),
                           dict(property="a")])
    assert texts(q.copy_values(values, ["a"], "t", contains="x"), "t") == []


# ---------------------------------------------------------------- explode, merge

@pytest.mark.parametrize("limit, parts", [
    (None, ["a", "b", "c", "d"]), (2, ["a", "b;c;d"]), (-2, ["a;b;c", "d"]), (-3, ["a;b", "c", "d"]),
    (1, ["a;b;c;d"]), (-1, ["a;b;c;d"]), (9, ["a", "b", "c", "d"]), (-9, ["a", "b", "c", "d"])])
def test_explode_limits(spark, limit, parts):
    values = table(spark, [dict(value="a;b;c;d")])
    assert texts(q.explode_values(values, ["p"], ";", max_values=limit)) == parts


def test_explode(spark):
    values = table(spark, [
        dict(value="a; ;b", lang="fr", is_public=False), dict(value=";"), dict(value="plain"),
        dict(type="uri", uri="http://x", value="c;d"), dict(property="other", value="e;f")])
    after = q.explode_values(values, ["p"], ";")
    assert texts(after) == ["a", "b", "plain", "c;d"]
    assert texts(after, column="value_id") == [1, None, 3, 4]
    assert texts(after, column="lang") == ["fr", "fr", None, None]
    assert texts(after, column="pos") == [0, 1, 2, 3]
    assert texts(after, "other") == ["e;f"]
    lines = table(spark, [dict(value="a\nb.c")])
    assert texts(q.explode_values(lines, ["p"], "\\n")) == ["a", "b.c"]
    assert texts(q.explode_values(lines, ["p"], ".")) == ["a\nb", "c"]
    only = table(spark, [dict(value="a-1"), dict(value="b-x"), dict(value="c-2")])
    assert texts(q.explode_values(only, ["p"], "-", match=r"/\d/")) == ["a", "1", "b-x", "c", "2"]
    assert texts(q.explode_values(only, ["p"], "-", contains="c", match=r"/\d/")) == ["a-1", "b-x", "c", "2"]
    with pytest.raises(ValueError):
        q.explode_values(lines, ["p"], "")


@pytest.mark.parametrize("given, expected", [
    ([("literal", "Name"), ("literal", "http://x"), ("literal", "http://y"), ("literal", "Other")],
     [("http://x", "Name"), ("http://y", "Other")]),
    ([("literal", "Name"), ("literal", "http://x"), ("literal", "Alone")], None),
    ([("literal", "Name"), ("literal", "http://x"), ("literal", "A"), ("literal", "B")], None),
    ([("literal", "http://x"), ("literal", "http://x")], [("http://x", "http://x")]),
    ([("literal", "http://x"), ("literal", "http://y")], None),
    ([("uri", "http://x"), ("literal", "Name")], [("http://x", "Name")]),
    ([("uri", "http://x"), ("uri", "http://x")], None),
])
def test_merge(spark, given, expected):
    data = [dict(type=kind, value=None if kind == "uri" else text, uri=text if kind == "uri" else None)
            for kind, text in given]
    values = table(spark, data)
    after = q.merge_values(values, ["p"])
    if expected is None:
        assert rows(after) == rows(values)
    else:
        assert shown(after, "uri", "value", "type") == [(u, v, "uri") for u, v in expected]
        assert [r.pos for r in after.orderBy("pos").collect()] == list(range(len(expected)))


def test_merge_refuses_labelled_uris(spark):
    values = table(spark, [dict(type="uri", uri="http://x", value="Has"), dict(value="Name")])
    assert rows(q.merge_values(values, ["p"])) == rows(values)


# ---------------------------------------------------------------- order, visibility, remove

def test_order(spark):
    langs = ["de", None, "en", "es", "fr", "de", None]
    values = table(spark, [dict(value=str(i + 1), lang=lang) for i, lang in enumerate(langs)])
    once = q.order_values(values, ["fr=en"], ["p"])
    assert texts(once) == ["5", "3", "1", "6", "2", "7", "4"]
    assert texts(once, column="value_id") == [5, 3, 1, 6, 2, 7, 4]
    assert rows(q.order_values(once, ["fr", "en"], "all")) == rows(once)


def test_visibility(spark):
    values = table(spark, [dict(value="ab", lang="fr"), dict(value="b", lang="fr"),
                           dict(value="ab", type="html", lang="fr"), dict(value="ab"),
                           dict(value="ab", uri="http://x", type="uri", lang="fr")])
    after = q.set_visibility(values, False, "all", languages=["fr"], datatypes=["literal", "uri"],
                             contains="a")
    assert texts(after, column="is_public") == [False, True, True, True, True]


def test_remove(spark):
    values = table(spark, [dict(value=c) for c in "abcd"] + [dict(property="o", value="x")])

    def left(**options):
        return texts(q.remove_values(values, ["p"], **options))

    assert left() == []
    assert left(keep_max_values=2) == ["a", "b"] and left(keep_max_values=-2) == ["c", "d"]
    assert left(max_values=2) == ["c", "d"] and left(max_values=-2) == ["a", "b"]
    assert left(match="/[bd]/", max_values=1) == ["a", "c", "d"]
    assert left(match="/[bd]/", keep_max_values=1) == ["a", "b", "c"]
    assert left(contains="c") == ["a", "b", "d"]
    assert texts(q.remove_values(values, ["p"], contains="b"), column="pos") == [0, 1, 2]
    assert q.remove_values(values, ["p"]).count() == 1
    with pytest.raises(ValueError):
        left(max_values=1, keep_max_values=1)


def test_remove_compares_by_main_type(spark):
    values = table(spark, [dict(value="5"), dict(type="uri", uri="5"),
                           dict(type="resource", value_resource_id=5),
                           dict(type="resource", value_resource_id=6), dict(value=None)])
    assert texts(q.remove_values(values, "all", equal="5"), column="value_id") == [4, 5]
    # A link has no text, so contains and match never hit it.
    assert texts(q.remove_values(values, "all", contains="5"), column="value_id") == [3, 4, 5]
    assert texts(q.remove_values(values, "all", match="/./"), column="value_id") == [3, 4, 5]
    assert texts(q.remove_values(values, "all", visibility=False), column="value_id") == [1, 2, 3, 4, 5]


# ---------------------------------------------------------------- large groups

def test_numbering_is_the_same_in_small_blocks(spark, monkeypatch):
    """A property larger than a block is cut, numbered in pieces, and comes out the same."""
    data = [dict(resource_id=i % 2, value=f"{i % 5};x{i}", lang=("fr", None, "en", "de")[i % 4])
            for i in range(60)] + [dict(resource_id=0, property="o", value=f"y{i}") for i in range(9)]
    values = table(spark, data)
    pairs = table(spark, [dict(value=f"http://x/{i}" if i % 2 else f"N{i}") for i in range(40)])

    def run(values=values, pairs=pairs):
        return [rows(df) for df in (
            q.explode_values(values, ["p"], ";"),
            q.order_values(values, ["en"], "all"),
            q.remove_values(values, ["p"], keep_max_values=7),
            q.remove_values(values, ["p"], max_values=-11, languages=["fr"]),
            q.copy_values(values, ["p"], "o", max_values=13),
            q.copy_values(values, "all", "new"),
            q.displace_values(values, ["o"], "p"),
            q.merge_values(pairs, ["p"]),
            q.deduplicate_values(values),
            q.with_positions(values.drop("pos")),
        )]

    whole = run()
    # Inside a chain the edits read their input once and get all rows.
    with _shared.chain(values):
        assert run(pairs=pairs)[:-1] == whole[:-1]
    # A measured table without hot groups takes plain windows instead.
    assert run(q.measure_groups(values), q.measure_groups(pairs)) == whole
    monkeypatch.setattr(_shared, "BLOCK_ROWS", 4)
    assert run() == whole


def test_known_sizes_change_no_result(spark):
    """Rows without identifiers and positions, and with positions that repeat, come out alike whether
    the sizes of groups are known or not."""
    data = [dict(value="AaBbCc"[i % 6] + (";z" if i % 4 == 0 else ""), lang=("fr", "en", "de", None)[i % 4], resource_id=i % 2,
                 value_id=None if i % 3 else i, pos=(None, 0, None, i)[i % 4]) for i in range(24)]
    values = table(spark, data)
    pairs = table(spark, [dict(value=f"http://x/{i}" if i % 2 else f"N{i}", value_id=None) for i in range(8)])
    records = spark.createDataFrame([(0,), (1,)], "id BIGINT")

    def run(prepared):
        v = prepared(values)
        return {name: rows(df) for name, df in dict(
            create=q.with_positions(q.create_values(v, records, "p", "literal", value="new")), explode=q.explode_values(v, ["p"], ";"),
            order=q.order_values(v, ["de"], "all"), keep=q.remove_values(v, ["p"], keep_max_values=3),
            first=q.remove_values(v, ["p"], max_values=2, languages=["fr"]), copy=q.copy_values(v, ["p"], "o"), some=q.copy_values(v, ["p"], "o", max_values=2),
            copy_all=q.copy_values(v, "all", "o"), displace=q.displace_values(v, ["p"], "o"), merge=q.merge_values(prepared(pairs), ["p"]),
            dedup=q.deduplicate_values(v), dedup_cased=q.deduplicate_values(v, case_sensitive=True), dedup_some=q.deduplicate_values(v, sel=[1]),
            trim=q.trim_values(v), placed=q.with_positions(v), documents=q.to_jsonld(v, part_rows=3)).items()}

    plain, measured = run(lambda df: df), run(q.measure_groups)
    for name in plain:
        assert plain[name] == measured[name], name
    two = table(spark, [dict(value="A", value_id=None, pos=0), dict(value="a", value_id=None, pos=None)])
    assert [texts(q.deduplicate_values(t)) for t in (two, q.measure_groups(two))] == [["A"], ["A"]]


def test_duplicates_shrink_before_the_shuffle(spark, tmp_path):
    table(spark, [dict(value="a")]).write.parquet(str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    plan = q.deduplicate_values(values, renumber=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1, plan
    # Equal rows out of reach all stay.
    same = table(spark, [dict(value="x", value_id=None, pos=None, resource_id=1 + i % 2) for i in range(8)])
    for given in (same, q.measure_groups(same)):
        assert sorted(r.resource_id for r in q.deduplicate_values(given, sel=[2]).collect()) == [1, 1, 1, 1, 2]


@pytest.mark.parametrize("limit", [1, 3, -3, 200])
def test_kept_rows_are_chosen_before_the_shuffle(spark, tmp_path, limit):
    """A hot property sends no more than the limit from a task; equal rows each count."""
    data = [dict(value=f"v{i % 7}", value_id=None if i % 3 == 0 else i, pos=None if i % 2 else i // 2,
                 property="p" if i % 5 else "q") for i in range(400)]
    data += [dict(value="same", value_id=None, pos=None, resource_id=2) for _ in range(9)]
    table(spark, data).repartition(5).write.parquet(str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    kept = q.remove_values(values, ["p"], keep_max_values=limit, renumber=False)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert ("WindowGroupLimit" in plan) == (abs(limit) <= _shared.TOP_ROWS), plan
    measured = q.remove_values(q.measure_groups(values), ["p"], keep_max_values=limit)
    assert rows(q.remove_values(values, ["p"], keep_max_values=limit)) == rows(measured)

    def order(row):
        return (row.pos is None, row.pos or 0, row.value_id is None, row.value_id or 0)

    for record in (1, 2):
        have = sorted((order(r) for r in values.collect() if r.resource_id == record and r.property == "p"), reverse=limit < 0)
        got = sorted((order(r) for r in kept.collect() if r.resource_id == record and r.property == "p"), reverse=limit < 0)
        assert got == have[:abs(limit)]
    assert kept.where("property = 'q'").count() == 80


def test_no_exchange_in_row_local_edits(spark, tmp_path):
    table(spark, [dict(value="a")]).write.parquet(str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    plans = [
        q.replace(values, "raw", ["p"], from_="a", to="b", renumber=False),
        q.trim_values(values, renumber=False), q.clean_empty_values(values),
        q.clean_languages(values), q.clean_language_codes(values, "fr", "fra", "all"),
        q.set_visibility(values, True, "all"), q.remove_values(values, ["x"], renumber=False),
        q.convert(values, None, "literal", "uri", ["p"]),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan


def test_one_exchange_of_rows_per_numbering(spark, tmp_path):
    """Window and join of a numbering share the partitioning of the rows."""
    table(spark, [dict(value="a;b")]).write.parquet(str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q.explode_values(values, ["p"], ";")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One for the rows, three for the one-row-per-block sizes.
    assert plan.count("Exchange hashpartitioning") <= 4, plan
