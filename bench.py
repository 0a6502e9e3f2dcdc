"""Headline queries: one warm-up, then the median of three runs. Prints one JSON line.

The tables under edit are derived from the test tables once and stored; ``curation_report``
alone includes the derivation.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

import quillmend as q  # noqa: E402
from quillmend.plans import catalog  # noqa: E402
from quillmend.sources import fixtures as fx  # noqa: E402
from quillmend.sources.session import configure  # noqa: E402

RUNS = 3

CHAIN = {
    "replace": {"mode": "regex", "from": "/^(\\d)-/", "to": "$1 ", "properties": ["ex:priority"]},
    "copy": {"from": ["ex:status"], "to": "ex:list"},
    "explode": {"properties": ["ex:list"], "separator": ";"},
    "order_values": {"languages": ["en"], "properties": ["ex:list"]},
    "cleaning": {"trim_values": True, "clean_languages": True, "deduplicate_values": True},
}


def staged(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """The derived table as a stored one, in as many files as there are cores: edits are timed
    on it, not on its derivation."""
    df.repartition(spark.sparkContext.defaultParallelism, "resource_id").write.parquet(folder)
    return spark.read.parquet(folder)


def headline(spark: SparkSession, folder: str) -> dict:
    scratch = tempfile.mkdtemp(prefix="bench-")
    plain = staged(spark, fx.values_large(spark, folder), f"{scratch}/large")
    # Known group sizes, as a stored table carries them: edits number in one pass.
    large = q.measure_groups(plain)
    values = q.measure_groups(staged(spark, fx.values(spark, folder), f"{scratch}/values"))
    authority = fx.authority(spark, folder)
    resources = fx.resources(spark, folder)
    return {
        "measure_groups": lambda: q.measure_groups(plain),
        "trim": lambda: q.trim_values(large),
        "trim_in_blocks": lambda: q.trim_values(plain),
        "trim_row_local": lambda: q.trim_values(large, renumber=False),
        "replace_regex": lambda: q.replace(large, "regex", ["ex:priority"], from_="/^(\\d)-/", to="$1 ",
                                           renumber=False),
        "explode": lambda: q.explode_values(large, ["ex:list"], ";"),
        "dedup": lambda: q.deduplicate_values(large, renumber=False),
        "order_by_language": lambda: q.order_values(large, ["en"], "all"),
        "remove_keep_first": lambda: q.remove_values(large, ["ex:status"], keep_max_values=2),
        "merge": lambda: q.merge_values(values, ["dcterms:creator"]),
        "specify_links": lambda: q.specify_datatypes(values, resources),
        "fill_labels": lambda: q.fill_values(values, authority, "label_all", ["dcterms:spatial"],
                                             [fx.GEONAMES], language="fr"),
        "chain_of_edits": lambda: q.run_pipeline(
            {"values": plain, "resources": resources}, CHAIN)["values"],
        "curation_report": lambda: catalog.QUERIES["curation_report"](spark, folder),
    }


def timed(build) -> float:
    start = time.perf_counter()
    df: DataFrame = build()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("quillmend-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, build in headline(spark, folder).items():
        timed(build)
        times[name] = round(statistics.median(timed(build) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "curation_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
        "runs": RUNS, "driver_memory": "16g"}))
    spark.stop()


if __name__ == "__main__":
    main()
