"""All selections from one pass against one splice for each of them."""

import random
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks import whatif_checks
from lanewise.operators import shares, sweep, whatif
from lanewise.plans import planning
from lanewise.sources import writers

BASE = (
    "order_id long, tracking_number string, order_placed_date date, zip5 string, "
    "base_fc_name string, base_carrier_code string, base_transit_cost double"
)
ZIPS = [f"{z:05}" for z in range(14)]
COUNTS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 999999]


def made(draw, repeats):
    """Packages, some with two rows, unknown codes, zips or tracking numbers, or in two zips."""
    out = []
    for k in range(400):
        day = date(2025, 11, 1) + timedelta(days=draw.randrange(3))
        package = [k % 300, f"t{k % 280}", day, draw.choice(ZIPS)]
        if k % 23 == 0:
            package[1 + 2 * (k % 2)] = None
        for _ in range(1 + (repeats and k % 7 == 0)):
            lane = (draw.choice(["AVP1", "MCI1", "DFW1", None]), draw.choice(["FDXHD", "ONTRGD", None]))
            out.append((*package, *lane, draw.choice([None, 1.5, 2.25, 4.0])))
    return out


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(17)
    sim = BASE.replace("base_", "sim_")
    base = spark.createDataFrame(made(draw, True), BASE)
    keys = [tuple(r)[:4] for r in base.collect()]
    scenarios = []
    for _ in range(2):
        same = [(*draw.choice(keys), "MCI1", draw.choice(["FDXHD", "ONTRGD"]), 3.5) for _ in range(200)]
        scenarios.append(spark.createDataFrame(same + made(draw, False), sim))
    # The lists share one zip; the first has it.
    lists = [ZIPS[:6], ZIPS[5:12]]
    ranked = [spark.createDataFrame([(z, i + 1) for i, z in enumerate(x)], "zip5 string, zip_rank int") for x in lists]
    proxy = spark.createDataFrame(
        [(d, fc, c, 0.7, 0.3) for d in range(7) for fc in ("AVP1", "MCI1", "DFW1") for c in ("FDXHD", "ONTRGD")],
        "dayofweek int, fc string, proxy_carrier string, fdxhd_proxy double, ontrgd_proxy double",
    )
    return base, list(zip(scenarios, ranked, strict=True)), proxy


def one_by_one(base, choices, proxy, count):
    picked = [(s, z.where(F.col("zip_rank") <= count)) for s, z in choices]
    # In the list of the first, whatever its rank there.
    taken = choices[0][1].select("zip5")
    picked[1] = (picked[1][0], picked[1][1].join(taken, "zip5", "left_anti"))
    final = whatif.splice_scenario(base, picked)
    by_zip = whatif.cost_by_zip(base, final)
    return {
        "carrier_net_before_wms_proxy": whatif.carrier_change(base, final),
        "carrier_net_after_wms_proxy": whatif.carrier_change_proxy(base, final, proxy),
        "cost_saving": whatif.cost_saving(by_zip),
        "cost_saving_by_zip": by_zip,
        "fc_charge_changes": whatif.fc_charge_change(base, final),
        "fc_flow": whatif.fc_flow(base, final),
        "fc_carrier_flow": whatif.fc_carrier_flow(base, final),
    }, final


def values(df, columns):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows(df, *columns)]


def test_every_count_equals_its_own_splice(spark, world):
    base, choices, proxy = world
    swept = sweep.Sweep(base, choices, COUNTS)
    metrics = {name: df.cache() for name, df in swept.metrics(proxy).items()}
    columns = [c.replace("base_", "sim_") for c in base.columns]
    spliced = swept.spliced(base, columns).cache()
    for count in COUNTS:
        expected, final = one_by_one(base, choices, proxy, count)
        for name, df in expected.items():
            found = metrics[name].where(F.col("zip_count") == count)
            assert values(found, df.columns) == values(df, df.columns), (name, count)
        of_count = spliced.where(F.col("zip_count") == count)
        assert rows(of_count, *columns) == rows(final, *columns), count


def test_no_list_changes_nothing(spark, world):
    base, _, proxy = world
    metrics = sweep.Sweep(base, [], [5]).metrics(proxy)
    assert all(r["abs_percent_change"] == 0 for r in metrics["fc_charge_changes"].collect())
    assert metrics["cost_saving"].first()["cost_saving"] == 0


def test_packages_are_shuffled_once_for_all_counts(spark, world):
    base, choices, _ = world
    chosen = sweep.ranked_choices([z for _, z in choices])
    packages = sweep.package_lanes_of(base, [s for s, _ in choices], chosen)
    plan = sweep.counted_events(packages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    # Above it only the sums by key and rank move.
    assert plan.split("REPARTITION_BY_COL")[0].count("Exchange") == 2
    assert "Expand" not in plan


def test_a_zip_of_two_lists_has_the_rows_of_both(spark):
    lane = "order_id long, tracking_number string, zip5 string, {0}_fc_name string"
    base = spark.createDataFrame([(1, "a", "z1", "AVP1"), (2, "b", "z2", "AVP1")], lane.format("base"))
    first = spark.createDataFrame([(1, "a", "z1", "MCI1")], lane.format("sim"))
    second = spark.createDataFrame([(1, "a", "z1", "DFW1"), (2, "b", "z2", "DFW1")], lane.format("sim"))
    z1 = spark.createDataFrame([("z1",), ("z1",), (None,)], "zip5 string")
    both = spark.createDataFrame([("z1",), ("z2",)], "zip5 string")
    out = whatif.splice_scenario(base, [(first, z1), (second, both)])
    assert rows(out, "order_id", "sim_fc_name") == [
        (1, "DFW1"),
        (1, "MCI1"),
        (2, "DFW1"),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1


def test_counts_keep_their_run_columns(spark):
    df = spark.createDataFrame([(3,), (999999,)], "zip_count int")
    out = writers.with_run_of_counts(df, "2025-11-15 06:00:00", "default")
    assert rows(out, "zip_count", "zip_count_tag", "run_name") == [
        (3, "partial", "default"),
        (999999, "all", "default"),
    ]


def test_cost_change_is_the_total_of_the_iteration_less_that_of_the_baseline(spark):
    """Both totals enter, those without any known cost as zero, and so does the query."""
    lane = "order_id long, tracking_number string, zip5 string, {0}_transit_cost double"
    base = spark.createDataFrame([(1, "a", "z1", 2.5), (2, "b", "z2", None)], lane.format("base"))
    after = spark.createDataFrame([(1, "a", "z1", 4.0), (3, "c", "z3", 1.25)], lane.format("sim"))
    assert rows(whatif.cost_totals(base, after)) == [(2.5, 5.25, 2.75)]
    assert rows(whatif.cost_totals(base.limit(0), after)) == [(0.0, 5.25, 5.25)]
    assert rows(whatif.cost_change(base, after)) == [(2.75,)]

    class Made:
        spliced = after

    Made.base = base
    found = whatif_checks.agg_cost_change(Made)
    assert rows(found, "base_cost", "iteration_cost", "cost_change") == [(2.5, 5.25, 2.75)]


def events_of(packages):
    return rows(sweep.counted_events(packages))


def test_packages_alike_count_as_often_as_they_are(spark, world):
    """One for all of the same days, lanes and ranks gives the events of them all."""
    base, choices, _ = world
    copies = F.explode(F.sequence(F.lit(0), F.lit(4)))

    def more(df):
        new = F.concat_ws("/", "tracking_number", "_copy")
        known = F.col("tracking_number").isNotNull()
        return df.withColumn("_copy", copies).withColumn("tracking_number", F.when(known, new))

    chosen = sweep.ranked_choices([z for _, z in choices])
    packages = sweep.package_lanes_of(more(base), [more(s) for s, _ in choices], chosen)
    alike = sweep.alike_packages(packages).cache()
    assert alike.select("tracking_number").distinct().count() * 5 <= (
        packages.select("tracking_number").distinct().count()
    )
    assert events_of(alike) == events_of(packages)


def test_costs_of_zips_need_no_shuffle_of_packages(spark, world):
    base, choices, _ = world
    chosen = sweep.ranked_choices([z for _, z in choices]).cache()
    chosen.count()
    costs = sweep.zip_costs(sweep.lane_rows(base, [s for s, _ in choices], chosen))
    plan = costs._jdf.queryExecution().executedPlan().toString()
    assert "tracking_number" not in plan.split("HashAggregate")[1]
    assert "REPARTITION" not in plan


def test_planning_counts_packages_alike_once(spark, world):
    """All five metrics from one small table of each result, with odd packages too."""
    base, choices, proxy = world
    final = choices[0][0]
    lanes = whatif.lanes_alike(base)
    assert rows(whatif.carrier_change(base, final)) == rows(
        whatif.carrier_change(lanes, whatif.lanes_alike(final))
    )
    metrics = planning.planning_metrics(base, final, proxy)
    expected = {
        "carrier_change": whatif.carrier_change(base, final),
        "fc_carrier_change": whatif.fc_carrier_change(base, final),
        "carrier_change_proxy": whatif.carrier_change_proxy(base, final, proxy),
        "fc_carrier_change_proxy": whatif.fc_carrier_change_proxy(base, final, proxy),
        "fc_charge_change": whatif.fc_charge_change(base, final),
    }
    assert set(metrics) == set(expected)
    for name, df in expected.items():
        assert values(metrics[name], df.columns) == values(df, df.columns), name
        # What is read are the written tables of packages alike.
        assert shares.TIMES in metrics[name]._jdf.queryExecution().executedPlan().toString()


def test_a_group_of_rows_without_a_key_stays_with_no_value(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y")], "p string, g string")
    for frame in (df, shares.alike(df, "p", [F.col("g")])):
        out = shares.share_of_total(frame, ["g"], "p", "nunique")
        assert rows(out, "g", "value") == [("x", 2), ("y", 0)]
