import os
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.sources import readers, schemas, shared, writers

SCHEMA = T.StructType(
    [T.StructField("v", T.IntegerType()), T.StructField("d", T.DateType())]
)


@pytest.fixture()
def days(spark):
    return spark.createDataFrame([(i, date(2025, 11, 1 + i % 5)) for i in range(20)], SCHEMA)


def test_partitions_are_replaced_and_writing_twice_is_writing_once(spark, days, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        writers.sink_partition_replace(days, path, "d")
    assert spark.read.parquet(path).count() == 20
    third = days.where(F.col("d") == F.lit(date(2025, 11, 3))).limit(1)
    writers.sink_partition_replace(third, path, "d")
    assert spark.read.parquet(path).count() == 17


def test_range_scan_prunes_partitions(spark, days, tmp_path):
    path = str(tmp_path / "t")
    writers.sink_partition_replace(days, path, "d")
    df = readers.scan_partition_range(
        spark, path, "2025-11-02", "2025-11-03", "d", {"d": "day", "v": "value"}, SCHEMA
    )
    assert df.columns == ["day", "value"] and df.count() == 8
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan


def test_range_scan_of_a_missing_path_is_empty(spark, tmp_path):
    path = str(tmp_path / "nothing")
    df = readers.scan_partition_range(spark, path, "2025-11-01", "2025-11-02", "d", schema=SCHEMA)
    assert df.count() == 0 and df.columns == ["v", "d"]
    with pytest.raises(Exception):
        readers.scan_partition_range(spark, path, "2025-11-01", "2025-11-02", "d")


def test_sql_with_parameters(spark, days):
    out = readers.scan_sql(
        spark,
        "select count(*) as N from {days} where d >= cast(:first as date)",
        {"first": "2025-11-04"},
        days=days,
    )
    assert out.columns == ["n"] and out.first()["n"] == 8


def test_run_columns(spark):
    out = writers.with_run(spark.range(1), "2025-11-15", "default").first()
    assert (out["zip_count"], out["zip_count_tag"]) == (999999, "all")
    assert writers.with_run(spark.range(1), "2025-11-15", "x", 50).first()[
        "zip_count_tag"
    ] == "partial"


def test_metrics_of_two_counts_stay_apart(spark, tmp_path):
    path = str(tmp_path)
    for count in (50, 999999):
        df = writers.with_run(spark.range(count % 7 + 1), "2025-11-15", "default", count)
        writers.sink_metrics({"m": df}, path)
    back = spark.read.parquet(f"{path}/m").groupBy("zip_count").count()
    assert rows(back) == [(50, 2), (999999, 999999 % 7 + 1)]


def test_saved_once_writes_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    first = shared.saved_once(spark, "test/once", build)
    second = shared.saved_once(spark, "test/once", build)
    assert first.count() == second.count() == 3 and len(calls) == 1


def test_without_a_shared_folder_nothing_is_guessed(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.table_path(spark, "x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.saved_once(spark, "test/never", lambda: spark.range(1))


def test_declared_schemas_are_not_inferred(spark, tmp_path):
    """Days are pruned, and a file without a key or with another type is told."""
    path = str(tmp_path / "lines")
    row = (1, "a", 1, 2, date(2025, 11, 1))
    lines = spark.createDataFrame([row], schemas.schema("order_lines"))
    writers.sink_partition_replace(lines, path, "order_placed_date")
    read = readers.scan_partition_range(spark, path, "2025-11-01", "2025-11-02", table="order_lines")
    assert [tuple(r) for r in read.collect()] == [row]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_placed_date" in plan
    # Another day's file without a key: read only if its day is.
    lines.drop("qty", "order_placed_date").write.parquet(f"{path}/order_placed_date=2025-11-02")
    assert read.where("order_placed_date = '2025-11-01'").count() == 1
    with pytest.raises(Exception, match="order_lines: a row without qty"):
        readers.scan_partition_range(spark, path, "2025-11-01", "2025-11-02", table="order_lines").collect()
    lines.withColumn("qty", F.lit("two")).drop("order_placed_date").write.parquet(
        f"{path}/order_placed_date=2025-11-03"
    )
    with pytest.raises(Exception, match="(?i)parquet"):
        readers.scan_partition_range(spark, path, "2025-11-03", "2025-11-03", table="order_lines").collect()
    missing = readers.scan_partition_range(spark, path + "x", "2025-11-01", "2025-11-02", table="order_lines")
    assert missing.count() == 0 and missing.schema == schemas.schema("order_lines")


def test_a_repeated_append_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    kind = "zip5 string, run_name string, run_date date"
    day = date(2025, 11, 1)
    first = spark.createDataFrame([("00001", "a", day), ("00002", "a", day), ("00003", None, day)], kind)
    keys = ("run_name", "run_date")
    told = writers.sink_append_history(first, path, keys)
    assert told.success and told.rows == 3 and told.chunks >= 1
    again = writers.sink_append_history(first, path, keys)
    assert again.rows == 0
    more = first.unionAll(spark.createDataFrame([("00004", "b", day)], kind))
    assert writers.sink_append_history(more, path, keys).rows == 1
    assert spark.read.schema(kind).parquet(path).count() == 4


def test_append_to_a_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "n int, run string")
    name = "appended_runs"
    spark.sql(f"drop table if exists {name}")
    try:
        assert writers.sink_append_table(df, name, ("run",)).rows == 2
        assert writers.sink_append_table(df, name, ("run",)).rows == 0
        assert writers.sink_append_table(df, name).rows == 2
        assert spark.table(name).count() == 4
    finally:
        spark.sql(f"drop table if exists {name}")


def test_projected_inputs_are_read_through(spark, tmp_path):
    """Order lines and inventory follow from the written lines; they are not written too."""
    from checks.inputs import Inputs, key_of

    sf = str(tmp_path / "sf")
    lines = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    spark.createDataFrame(
        [(1, 1, 4, 2, 3.0), (1, 1, 4, 2, 5.0), (1, 2, 6, 2, 1.0), (15, 1, 5, 3, 2.0)], lines
    ).write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (15, None)], "o_orderkey long, o_custkey long").write.parquet(
        f"{sf}/orders.parquet"
    )
    given = Inputs(spark, sf)
    assert rows(given.order_lines) == [
        (1, "1-0", 2, 1, date(2025, 11, 2)),
        (1, "1-1", 1, 5, date(2025, 11, 2)),
        (15, "15-1", 1, 2, date(2025, 11, 2)),
    ]
    held = rows(given.inventory.where("fc_name in ('AVP1', 'AVP2')"))
    assert held == [
        (1, 1, "AVP1", 124 % 90),
        (1, 1, "AVP2", (4 * 31 + 17) % 90),
        (1, 2, "AVP2", (6 * 31 + 17) % 90),
        (15, 1, "AVP1", 155 % 90),
    ]
    folder = os.path.dirname(shared.table_path(spark, key_of(sf, "lines")))
    assert sorted(os.listdir(folder.removeprefix("file:"))) == ["fcs", "lines"]


def test_a_written_stage_leaves_no_shuffle_behind(spark):
    """Shuffles of a stage go with its write, not when the driver collects garbage."""
    from time import sleep

    from lanewise.sources.shared import CLEANUP, bucketed, stored

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP)
    df = spark.range(1000).repartition("id")
    kept = [stored(df, "gone"), bucketed(df, "gone-too", 3, ["id"])]
    for _ in range(50):
        left = shuffled() - before
        if not left:
            break
        sleep(0.1)
    assert not left
    assert [k.count() for k in kept] == [1000, 1000]
    assert spark.conf.get(CLEANUP) == setting


def test_a_large_result_is_written_where_its_rows_are(spark, tmp_path):
    """No shuffle, a file of each value for each task, and other partitions stay."""
    named = "spark.sql.maxConcurrentOutputFileWriters"
    setting = spark.conf.get(named)
    df = spark.range(0, 100, 1, 3).withColumn("part", F.col("id") % 2)
    for _ in range(2):
        writers.sink_partition_replace(df, str(tmp_path), "part", gather=False)
    found = spark.read.parquet(str(tmp_path))
    assert rows(found, "id", "part") == rows(df, "id", "part")
    assert len(found.inputFiles()) == 6
    one = df.where("part = 1").withColumn("id", F.lit(7))
    writers.sink_partition_replace(one, str(tmp_path), "part", gather=False)
    assert spark.read.parquet(str(tmp_path)).where("part = 0").count() == 50
    assert spark.conf.get(named) == setting
