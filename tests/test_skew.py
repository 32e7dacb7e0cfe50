import pytest
from conftest import rows
from pyspark.sql import functions as F

from lanewise.operators import shipmap, skew


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows under one key, nulls and a key without partner."""
    many = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 50 == 0, None)
        .otherwise(F.col("id") % 7 + 2)
        .cast("int")
        .alias("k"),
    )
    few = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (99, "e"), (None, "f")], "k int, v string"
    )
    return many, few


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_gives_what_the_plain_join_gives(sides, how):
    many, few = sides
    hot = skew.hot_keys(many, ["k"], rows_per_slice=100)
    salted = skew.salted_join(many, few, ["k"], how, ["id"], hot)
    plain = many.join(few, ["k"], how)
    assert rows(salted, *plain.columns) == rows(plain)


def test_every_hot_key_is_sliced(spark, sides):
    many, _ = sides
    hot = {r["k"]: r["_slices"] for r in skew.hot_keys(many, ["k"], 100).collect()}
    sizes = {r["k"]: r["count"] for r in many.groupBy("k").count().collect()}
    assert hot == {k: -(-n // 100) for k, n in sizes.items() if n > 100}


def test_no_hot_keys_below_the_slice_size(sides):
    many, _ = sides
    assert skew.hot_keys(many, ["k"]).count() == 0


def test_sizes_are_counted_up_to_a_limit(spark):
    small, large = spark.range(10), spark.range(1000)
    assert skew.within_rows({"s": small, "l": large, "e": small.limit(0)}, 100) == {
        "s": True,
        "l": False,
        "e": True,
    }


def test_running_total_over_blocks(spark):
    data = [(i, float((i * 37) % 101) if i % 11 else None, i % 5) for i in range(500)]
    df = spark.createDataFrame(data, "i int, score double, n int")
    out = skew.running_total(df, "score", "i", {"n": "total"}, blocks=16)
    found = {r["i"]: r["total"] for r in out.collect()}
    total = 0
    ordered = sorted(data, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    for i, _, n in ordered:
        total += n
        assert found[i] == total


def test_running_total_of_equal_scores(spark):
    df = spark.createDataFrame([(i, 1.0, 1) for i in range(20)], "i int, s double, n int")
    out = skew.running_total(df, "s", "i", {"n": "total"})
    assert rows(out, "i", "total") == [(i, i + 1) for i in sorted(range(20), key=str)]


def test_latest_snapshot_keeps_ties_and_copies(spark):
    data = [("z1", "a", 1), ("z1", "a", 2), ("z1", "a", 2), ("z1", "b", 2), ("z2", "a", 1)]
    data += [("hot", "a", 3)] * 300 + [("hot", "a", 1)] * 50 + [("hot", "b", 3)]
    df = spark.createDataFrame(data, "zip5 string, route string, g int")
    out = shipmap.latest_snapshot(df, ["zip5"], "g", rows_per_slice=40)
    kept = sorted(r for r in data if r[2] == max(g for z, _, g in data if z == r[0]))
    assert sorted(map(tuple, out.collect())) == kept


@pytest.mark.parametrize("score", ["cast(null as double)", "1.0d", "if(id % 3 = 0, null, 2.0d)"])
def test_blocks_of_equal_and_unknown_scores_are_even(spark, score):
    """Rows of one score are split by their tie, so no task gets all of them."""
    df = spark.range(4_000).selectExpr("id", f"{score} as score", "lpad(id, 5, '0') as zip5")
    blocks = skew.ranked_blocks(df, "score", "zip5", 8)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 4_000 / 8
    out = skew.running_total(df.withColumn("one", F.lit(1)), "score", "zip5", {"one": "place"}, blocks=8)
    ordered = sorted(out.collect(), key=lambda r: (r["score"] is None, r["score"] or 0.0, r["zip5"]))
    assert [r["place"] for r in ordered] == list(range(1, 4_001))


def test_shuffles_have_partitions_for_the_rows(spark):
    names = ("coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes")
    names = [f"spark.sql.adaptive.{n}" for n in names]
    try:
        skew.shuffles_for(spark, 10)
        assert int(spark.conf.get(names[0])) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        skew.shuffles_for(spark, 100 * skew.ROWS_PER_PARTITION + 1)
        assert int(spark.conf.get(names[0])) == 101
    finally:
        for name in names:
            spark.conf.unset(name)


def test_a_task_reads_a_bounded_part_of_a_table(spark, tmp_path):
    """Rows that compress well are shared out, too: 24 MB are not one task's."""
    name = "spark.sql.files.maxPartitionBytes"
    least = "spark.sql.files.minPartitionNum"
    noise = spark.range(600_000, numPartitions=8).select(F.sha2(F.col("id").cast("string"), 256))
    noise.write.parquet(f"{tmp_path}/noise")
    others = ("coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes")
    try:
        spark.conf.unset(name)
        spark.conf.set(least, "1")
        assert spark.read.parquet(f"{tmp_path}/noise").rdd.getNumPartitions() == 1
        skew.shuffles_for(spark, 10)
        assert spark.read.parquet(f"{tmp_path}/noise").rdd.getNumPartitions() >= 4
    finally:
        for conf in (name, least, *(f"spark.sql.adaptive.{n}" for n in others)):
            spark.conf.unset(conf)
