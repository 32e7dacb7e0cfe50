from datetime import date, datetime

from conftest import rows
from pyspark.sql import functions as F

from lanewise.operators import scoring, shares, signals, whatif, zips
from lanewise.plans import execution

SERVICE = (
    "zip5 string, carrier_code string, unpadded_edd date, on_time_count long, "
    "package_count long"
)


def service(spark, *zip_rates, days=3):
    return spark.createDataFrame(
        [
            (z, carrier, date(2025, 11, 1 + d), int(rate * 10), 10)
            for z, fdx, ont in zip_rates
            for carrier, rate in (("FDXHD", fdx), ("ONTRGD", ont))
            if rate is not None
            for d in range(days)
        ],
        SERVICE,
    )


def test_reason_service(spark):
    rates = [
        ("both low", 0.2, 0.3),
        ("both high", 0.9, 0.5),
        ("ours low", 0.9, 0.1),
        ("theirs low", 0.1, 0.9),
        ("ours only", None, 0.1),
    ]
    found = dict(
        rows(signals.reason_service(service(spark, *rates), 0.5), "zip5", "reason_code_dea")
    )
    assert found == {
        "both low": "ok",
        "both high": "ok",
        "ours low": "deactivate",
        "theirs low": None,
        "ours only": None,
    }


def test_reason_service_needs_three_days(spark):
    short = service(spark, ("z", 0.9, 0.1), days=2)
    assert signals.reason_service(short, 0.5).count() == 0


BACKLOG = "date date, dest_facility_num int, zip5 string, days_behind double, carrier_code string"


def test_reason_backlog(spark):
    day = date(2025, 11, 2)
    data = [
        (day, 1, zip5, behind, carrier)
        for zip5, fdx, ont in [
            ("both late", 1.0, 1.0),
            ("ours late", 0.0, 1.0),
            ("theirs late", 1.0, 0.0),
            ("none late", 0.0, 0.0),
            ("ours only late", None, 1.0),
            ("ours only", None, 0.0),
        ]
        for carrier, behind in (("FDXHD", fdx), ("ONTRGD", ont))
        if behind is not None
    ]
    data += [
        (date(2025, 11, 3), 1, "both late", 0.0, "FDXHD"),  # a later day, one carrier only
        (day, 1, None, 5.0, "FDXHD"),
        (day, 0, "none late", None, "FDXHD"),  # unknown value of a lower station
        (day, 9, "none late", 7.0, "FDXHD"),  # a higher station
    ]
    df = spark.createDataFrame(data, BACKLOG)
    found = dict(rows(signals.reason_backlog(df, 0.5), "zip5", "reason_code_backlog"))
    assert found == {
        "both late": "activate",
        "ours late": "deactivate",
        "theirs late": "activate",
        "none late": "ok",
        "ours only late": "deactivate",
        "ours only": None,
    }


def test_reason_backlog_without_a_common_day(spark):
    df = spark.createDataFrame([(date(2025, 11, 2), 1, "z", 1.0, "FDXHD")], BACKLOG)
    assert signals.reason_backlog(df, 0.5).count() == 0


def test_reason_backlog_shows_transit(spark):
    day = date(2025, 11, 3)
    df = spark.createDataFrame(
        [(day, 1, "z", 0.0, "FDXHD"), (day, 1, "z", 0.0, "ONTRGD")], BACKLOG
    )
    base = spark.createDataFrame(
        [(day, "z", "AVP1", "t1"), (day, "z", "AVP1", "t2")],
        "order_placed_date date, zip5 string, act_fc_name string, tracking_number string",
    )
    ship_map = spark.createDataFrame(
        [(day, "z", "AVP1", "FDXHD", 4), (day, "z", "MCI1", "FDXHD", 1)],
        "shipdate date, zip5 string, fcname string, mode string, adjtnt int",
    )
    out = signals.reason_backlog(df, 0.5, base, ship_map).first()
    assert out["FDXHD_weighted_adjtnt_avg"] == 4.0
    assert out["ONTRGD_weighted_adjtnt_avg"] == 2.0


def test_reason_shutdown(spark):
    run, tomorrow = date(2025, 11, 15), date(2025, 11, 16)
    shut = spark.createDataFrame(
        [
            ("ours", "ONTRGD", tomorrow, date(2025, 11, 25)),
            ("theirs", "FDXHD", tomorrow, None),
            ("short", "ONTRGD", tomorrow, tomorrow),
            ("later", "ONTRGD", date(2025, 11, 17), None),
        ],
        "zip5 string, carrier_code string, start_date date, end_date date",
    )
    base = spark.createDataFrame(
        [], "order_placed_date date, zip5 string, act_fc_name string, tracking_number string"
    )
    ship_map = spark.createDataFrame(
        [], "shipdate date, zip5 string, fcname string, mode string, adjtnt int"
    )
    out = signals.reason_shutdown(run, shut, base, ship_map)
    assert dict(rows(out, "zip5", "reason_code_shutdown")) == {
        "ours": "deactivate",
        "theirs": "activate",
        "short": "ok",
    }


def test_last_recommendation_filters_the_run_after_taking_the_newest(spark):
    schema = (
        "zip5 string, final_recommendation string, run_dttm timestamp, run_name string, "
        "zip_count_tag string, final_reason_dea string, final_reason_shutdown string, "
        "final_reason_backlog string"
    )

    def row(zip5, what, day, run="default", tag="all"):
        return (zip5, what, datetime(2025, 11, day), run, tag, "ok", "ok", "ok")

    removed = spark.createDataFrame(
        [
            row("1", "deactivate", 1),
            row("1", "deactivate", 5, run="trial"),
            row("2", "deactivate", 2),
            row("3", "deactivate", 15),
            row("4", "deactivate", 3, tag="partial"),
            row("5", "deactivate", 4),
        ],
        schema,
    )
    added = spark.createDataFrame([row("2", "activate", 6), row("5", "activate", 4)], schema)
    out = signals.last_recommendation(removed, added, "2025-11-15")
    assert rows(out, "zip5", "last_recommendation", "recommendation_date") == [
        ("2", "activate", "2025-11-06"),
        ("5", "activate", "2025-11-04"),
    ]


def test_shares_leave_out_unknown_groups(spark):
    df = spark.createDataFrame(
        [("a", "p1"), ("a", "p2"), ("b", "p2"), (None, "p3")], "g string, p string"
    )
    out = shares.share_of_total(df, ["g"], "p", "nunique")
    assert rows(out) == [("a", 2, 3, 66.6667), ("b", 1, 3, 33.3333)]


def test_shares_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", 0)], "g string, v int")
    assert rows(shares.share_of_total(df, ["g"], "v", "sum")) == [("a", 0, 0, None)]


def results(spark):
    schema = (
        "order_id long, tracking_number string, order_placed_date date, zip5 string, "
        "units int, sim_fc_name string, sim_carrier_code string, sim_tnt int, "
        "sim_transit_cost double"
    )
    day = date(2025, 11, 1)
    base = spark.createDataFrame(
        [
            (i, f"t{i}", day, f"z{i % 3}", 1, "AVP1", "ONTRGD" if i % 2 else "FDXHD", 2, 5.0)
            for i in range(12)
        ],
        schema,
    )
    other = base.withColumn("sim_carrier_code", F.lit("FDXHD")).withColumn(
        "sim_fc_name", F.lit("MCI1")
    )
    return base, other


def test_splice_keeps_every_package_once(spark):
    base, other = results(spark)
    twice = spark.createDataFrame([("z1",), ("z1",)], "zip5 string")
    out = whatif.splice_scenario(whatif.as_base(base), [(other, twice)])
    assert out.count() == base.count()
    assert dict(rows(out.groupBy("sim_fc_name").count())) == {"AVP1": 8, "MCI1": 4}


def test_switch_counts(spark):
    base, other = results(spark)
    out = signals.fc_carrier_switch(whatif.as_base(base), other)
    assert rows(out, "zip5", "fc_switch_package_per", "carrier_switch_package_count") == [
        ("z0", 1.0, 2),
        ("z1", 1.0, 2),
        ("z2", 1.0, 2),
    ]


def test_flow_shares_sum_to_hundred(spark):
    base, other = results(spark)
    out = whatif.fc_flow(whatif.as_base(base), other)
    assert rows(out) == [("AVP1", "MCI1", 12, 100.0)]


def test_top_zips_and_sentinel(spark):
    scored = spark.createDataFrame(
        [("a", 0.5), ("b", None), ("c", 0.9), ("d", 0.5)], "zip5 string, priority_score double"
    )
    assert rows(zips.top_zips(scored, 2), "zip5") == [("a",), ("c",)]
    assert zips.top_zips(scored, 999999).count() == 4
    tagged = zips.top_zips_per_count(scored, [1, 3, 50])
    assert rows(tagged.groupBy("zip_count").count()) == [(1, 1), (3, 3), (999999, 4)]


def test_priority_score_with_unknown_and_constant_measures(spark):
    df = spark.createDataFrame(
        [("a", 10, 0.5, None), ("b", 30, None, None), ("c", 20, 0.5, None)],
        "zip5 string, act_package_count long, unpadded_edd_dea double, days_behind double",
    )
    out = scoring.priority_score_exec(df.fillna({"days_behind": 1.0}))
    found = dict(rows(out, "zip5", "priority_score"))
    assert found == {"a": 0.25, "b": 0.9, "c": 0.575}
    unknown = scoring.priority_score_exec(df)
    assert {r["priority_score"] for r in unknown.collect()} == {None}


def test_constraints_drop_unknown_values_and_can_be_off(spark):
    df = spark.createDataFrame(
        [("a", 30.0, 0.1), ("b", 30.0, None), ("c", 10.0, 0.1)],
        "zip5 string, daily_package_count_avg double, fc_switch_package_per double",
    )
    assert rows(execution.meet_constraints(df, 25, 0.15), "zip5") == [("a",)]
    assert execution.meet_constraints(df, None, 0).count() == 3


def test_target_change_rounds_half_to_even(spark):
    df = spark.createDataFrame(
        [("ONTRGD", f"o{i}") for i in range(2)] + [("FDXHD", f"f{i}") for i in range(7)],
        "base_carrier_code string, tracking_number string",
    )
    assert scoring.target_change(df, 0.5).first()[0] == 2


def test_switch_counts_without_expanding_the_rows(spark):
    """No distinct count multiplies the rows; unknown codes are no switch."""
    keys = "order_id long, tracking_number string, order_placed_date date, zip5 string"
    day = date(2025, 11, 1)
    base = spark.createDataFrame(
        [
            (1, "a", day, "00001", "AVP1", "FDXHD"),
            (2, "b", day, "00001", "AVP1", "FDXHD"),
            (3, "c", day, "00001", None, "FDXHD"),
            (4, None, day, "00001", "AVP1", "FDXHD"),
        ],
        f"{keys}, base_fc_name string, base_carrier_code string",
    )
    other = spark.createDataFrame(
        [
            (1, "a", day, "00001", "MCI1", "FDXHD"),
            (1, "a", day, "00001", "MCI1", "ONTRGD"),
            (2, "b", day, "00001", "AVP1", "FDXHD"),
            (3, "c", day, "00001", "AVP1", "ONTRGD"),
        ],
        f"{keys}, sim_fc_name string, sim_carrier_code string",
    )
    out = signals.fc_carrier_switch(base, other)
    row = out.first()
    assert (row["package_count"], row["fc_switch_package_count"]) == (3, 1)
    assert row["carrier_switch_package_count"] == 2
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_switches_are_counted_without_a_set_for_each_package(spark):
    """Repeated rows and pairs count once, unknown keys and codes not at all."""
    import random

    draw = random.Random(5)
    keys = "order_id long, tracking_number string, order_placed_date date, zip5 string"
    day = date(2025, 11, 1)

    def made(n):
        return [
            (
                draw.randrange(4),
                draw.choice(["a", "b", "c", "d", None]),
                day,
                draw.choice(["00001", "00002", None]),
                draw.choice(["AVP1", "MCI1", None]),
                draw.choice(["FDXHD", "ONTRGD", None]),
            )
            for _ in range(n)
        ]

    left, right = made(40), made(30)
    base = spark.createDataFrame(left, f"{keys}, base_fc_name string, base_carrier_code string")
    other = spark.createDataFrame(right, f"{keys}, sim_fc_name string, sim_carrier_code string")
    packages, moves = {}, {4: {}, 5: {}}
    for b in left:
        for s in right:
            if b[:4] != s[:4] or None in b[:4]:
                continue
            packages.setdefault(b[3], set()).add(b[1])
            for at, found in moves.items():
                if None not in (b[at], s[at]) and b[at] != s[at]:
                    found.setdefault(b[3], set()).add((b[1], b[at], s[at]))
    expected = [
        (z, len(p), *(len(found.get(z, ())) for found in moves.values()))
        for z, p in sorted(packages.items())
    ]
    out = signals.fc_carrier_switch(base, other)
    counts = ("package_count", "fc_switch_package_count", "carrier_switch_package_count")
    assert rows(out, "zip5", *counts) == expected
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "Expand" not in plan
