from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

import quillmend as q
from quillmend.operators import _shared as s
from quillmend.plans import catalog
from tests.helpers import rows, table


@contextlib.contextmanager
def no_broadcast(spark):
    """Tables are too large to be sent to all tasks, unless an operator says so."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles(df) -> list[str]:
    """Where rows with their texts are shuffled."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]


def small_tables(spark, folder, parts: int):
    """Documents in a folder of files, as large tables are stored."""
    docs = spark.createDataFrame(
        [(i, f" text {i} ", "en", "web", 8) for i in range(12)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    docs.repartition(parts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"u{i}", "") for i in range(3)], "page_id LONG, url STRING, html STRING").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, f"R{i}") for i in range(5)], "r_regionkey INT, r_name STRING").write.parquet(f"{folder}/region.parquet")


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    small_tables(spark, str(tmp_path), 3)
    done = catalog.QUERIES["stream_clean"](spark, str(tmp_path))
    texts = done.where("property = 'dcterms:description'")
    assert sorted((r["record_id"], r["value"]) for r in texts.collect()) == [(i, f"text {i}") for i in range(12)]
    assert {r["type"] for r in done.where("value_resource_id IS NOT NULL AND value_resource_id < 30000005").collect()} == {"resource:itemset"}


def test_rows_without_a_key_are_spread_in_a_lookup(spark):
    with no_broadcast(spark):
        values = table(spark, [dict(value=str(i)) for i in range(5)]).withColumn("_hit", F.col("value") == "1")
        names = spark.createDataFrame([("1", "one")], "key STRING, name STRING")
        found = s.lookup(values, F.col("value"), names, "key")
        assert [line for line in shuffles(found) if "_wanted" in line and "_spread" in line], shuffles(found)
        assert sorted((r["value"], r["name"]) for r in found.collect()) == [
            ("0", None), ("1", "one"), ("2", None), ("3", None), ("4", None)]


def test_unmeasured_values_are_deduplicated_in_one_shuffle(spark):
    data = [dict(resource_id=i % 3, value=f"v{i % 4}", pos=None) for i in range(24)]
    with no_broadcast(spark):
        done = q.deduplicate_values(table(spark, data))
        assert len(shuffles(done)) == 1, shuffles(done)
        assert s.group_rows(done) is None
        assert [(r["resource_id"], r["pos"]) for r in done.orderBy("resource_id", "pos").collect()] == [
            (i, k) for i in range(3) for k in range(4)]


def test_unmeasured_values_get_positions_without_a_join(spark):
    from quillmend.sources.tables import with_positions

    values = table(spark, [dict(resource_id=i % 3, pos=None) for i in range(9)])
    with no_broadcast(spark):
        done = with_positions(values)
        assert len(shuffles(done)) == 1 and "Join" not in done._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["pos"] for r in done.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]


CHAIN = {"explode": {"properties": ["p"], "separator": ";"},
         "cleaning": {"trim_values": True, "specify_datatypes": True, "deduplicate_values": True}}


def linked_tables(spark, tmp_path):
    data = [dict(resource_id=i % 4, value="a; b;a") for i in range(8)] + [
        dict(resource_id=i, property="link", type="resource", value_resource_id=100 + i) for i in range(4)]
    table(spark, data).write.parquet(str(tmp_path / "v"))
    resources = spark.createDataFrame([(100, "items"), (101, "media"), (7, "items")], "id LONG, resource_name STRING")
    resources.write.parquet(str(tmp_path / "r"))
    return {"values": spark.read.parquet(str(tmp_path / "v")), "resources": spark.read.parquet(str(tmp_path / "r"))}


def test_chain_with_a_lookup_shuffles_rows_once(spark, tmp_path, monkeypatch):
    t = linked_tables(spark, tmp_path)
    with no_broadcast(spark):
        done = q.run_pipeline(t, CHAIN)["values"]
        plan = done._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in shuffles(done) if "resource_id" in line]
        assert len(wide) == 1 and "SortMergeJoin" not in plan, plan
        few = rows(done)
        assert sorted(r["type"] for r in done.where("property = 'link'").collect()) == [
            "resource", "resource", "resource:item", "resource:media"]
        # Many links: the rows meet the records in a shuffle.
        monkeypatch.setattr(s, "FEW_KEYS", 1)
        many = q.run_pipeline(t, CHAIN)["values"]
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert rows(many) == few
        # Records with many rows: the chain is not dealt by records.
        monkeypatch.setattr(s, "BLOCK_ROWS", 2)
        assert rows(q.run_pipeline(t, CHAIN)["values"]) == few


def test_links_made_by_an_edit_are_looked_up(spark, tmp_path):
    t = linked_tables(spark, tmp_path)
    made = {"create_values": {"properties": "new", "datatype": "resource", "value_resource_id": 7},
            "cleaning": {"specify_datatypes": True}}
    done = q.run_pipeline(t, made)["values"].where("property = 'new'")
    assert {(r["value_resource_id"], r["type"]) for r in done.collect()} == {(7, "resource:item")}


def test_documents_of_small_records_take_one_shuffle(spark, monkeypatch):
    data = [dict(resource_id=i % 5, property="pq"[i % 2], value=f"v{i}") for i in range(40)]
    values = table(spark, data)
    with no_broadcast(spark):
        documents = q.to_jsonld(values, part_rows=2)
        assert len(shuffles(documents)) == 1, shuffles(documents)
        assert rows(q.from_jsonld(documents)) == rows(values)
        small = rows(documents)
        monkeypatch.setattr(s, "BLOCK_ROWS", 4)
        assert rows(q.to_jsonld(values, part_rows=2)) == small


def test_values_to_write_back_are_computed_once(spark, tmp_path):
    folder = str(tmp_path / "b")
    values = table(spark, [dict(resource_id=i, value=f"v{i}") for i in range(20)])
    q.write_buckets(values, folder, 4)
    seen = spark.sparkContext.accumulator(0)

    def told(value):
        seen.add(1)
        return value + "x"

    edited = q.read_buckets(spark, folder).withColumn("value", F.udf(told)("value"))
    q.write_changed(edited, folder)
    assert seen.value == 20
    assert sorted(r["value"] for r in q.read_buckets(spark, folder).collect()) == sorted(f"v{i}x" for i in range(20))


def test_records_with_one_key_are_cleaned(spark):
    entry = "struct('link' AS property, 'resource' AS type, CAST(NULL AS STRING) AS lang, CAST(NULL AS STRING) AS value," \
            " CAST(NULL AS STRING) AS uri, {}L AS value_resource_id, true AS is_public)"
    records = spark.sql(f"SELECT 1L AS record_id, array({entry.format(7)}, {entry.format(8)}) AS values UNION ALL "
                        f"SELECT 1L, array({entry.format(7)}) UNION ALL SELECT 2L, array({entry.format(9)})")
    resources = spark.createDataFrame([(7, "items"), (7, "items"), (8, "media")], "id LONG, resource_name STRING")
    done = q.clean_on_write(records, resources)
    assert sorted((r["record_id"], [v["type"] for v in r["values"]]) for r in done.collect()) == [
        (1, ["resource:item"]), (1, ["resource:item", "resource:media"]), (2, ["resource"])]
