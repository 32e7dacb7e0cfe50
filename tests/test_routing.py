from dataclasses import replace
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lanewise.operators import lanes as lane_ops
from lanewise.operators import rates, stock

DAY = date(2025, 11, 1)


@pytest.fixture(scope="module")
def lines(spark):
    order_lines = spark.createDataFrame(
        [
            (1, "a", 1, 2, DAY),
            (1, "a", 2, 1, DAY),
            (2, "b", 1, 5, DAY),
            (2, "b", 2, 1, DAY),
            (3, "c", 1, 9, DAY),
        ],
        "order_id long, tracking_number string, order_line_id int, qty int, "
        "order_placed_date date",
    )
    inventory = spark.createDataFrame(
        [
            (1, 1, "AVP1", 2),
            (1, 2, "AVP1", 9),
            (1, 1, "MCI1", 9),
            (2, 1, "AVP1", 4),
            (2, 1, "MCI1", 5),
            (3, 1, "AVP1", 1),
            (2, 1, "XXX9", 7),
        ],
        "order_id long, order_line_id int, fc_name string, quantity_available int",
    )
    return order_lines, inventory


def test_fcs_hold_every_line_that_has_stock_somewhere(lines):
    stocked = stock.stocked_lines(*lines, DAY, DAY)
    assert rows(stock.qualified_fcs(stocked)) == [
        (1, "a", "AVP1"),
        (2, "b", "MCI1"),
        (2, "b", "XXX9"),
    ]


def test_fc_sets_agree_for_listed_fcs(lines):
    stocked = stock.stocked_lines(*lines, DAY, DAY)
    sets = stock.fc_sets(stocked).withColumn("fc_name", F.explode("fcs")).drop("fcs")
    assert rows(sets) == [(1, "a", "AVP1"), (2, "b", "MCI1")]


def test_fc_sets_beyond_the_bits_of_a_number(lines):
    stocked = stock.stocked_lines(*lines, DAY, DAY)
    many = [f"F{i:03}" for i in range(70)] + ["AVP1", "MCI1"]
    sets = stock.fc_sets(stocked, many).withColumn("fc_name", F.explode("fcs"))
    assert rows(sets.drop("fcs")) == [(1, "a", "AVP1"), (2, "b", "MCI1")]


def test_served_sets_equal_those_of_stocked_lines(spark):
    """Repeated rows, nulls, unlisted FCs; the join has no row for every FC."""
    order_lines = spark.createDataFrame(
        [(o, t, n, q, DAY) for o in (1, 2, 3, None) for t, n, q in
         (("a", 1, 2), ("a", 1, 7), ("a", 2, 1), ("b", 1, 3), (None, 2, 4), ("c", 3, None))],
        "order_id long, tracking_number string, order_line_id int, qty int, order_placed_date date",
    )
    inventory = spark.createDataFrame(
        [(o, n, fc, (3 * (o or 0) + 5 * n + 7 * i) % 9) for o in (1, 2, None) for n in (1, 2, 3)
         for i, fc in enumerate(("AVP1", "AVP1", "MCI1", "XXX9", None))]
        + [(3, 1, "XXX9", 9), (3, 2, "AVP1", 9), (3, 2, "MCI1", None)],
        "order_id long, order_line_id int, fc_name string, quantity_available int",
    )
    stocked = stock.stocked_lines(order_lines, inventory, DAY, DAY)
    for fcs in (["AVP1", "MCI1"], [f"F{i:03}" for i in range(70)] + ["MCI1", "AVP1"]):
        found = stock.served_sets(order_lines, inventory, DAY, DAY, fcs)
        assert rows(found) == rows(stock.fc_sets(stocked, fcs)) != []
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("max(quantity_available") > plan.index("Join")


def test_a_bucket_holds_what_a_task_sorts_in_memory(spark, world, monkeypatch):
    """More packages make more buckets, not larger ones."""
    assert lane_ops.PACKAGES_PER_BUCKET <= 50_000
    monkeypatch.setattr(lane_ops, "PACKAGES_PER_BUCKET", 1)
    asked = []
    kept = lane_ops.bucketed
    monkeypatch.setattr(lane_ops, "bucketed", lambda *a: asked.append(a[2]) or kept(*a))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stage_of(world)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert asked == [world[0].count()]


def card(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


@pytest.fixture(scope="module")
def cards(spark):
    year = (date(2025, 1, 1), date(2025, 12, 31))
    band = (
        "carrier_code string, zone int, {0}_lower double, {0}_upper double, "
        "amount double, charge_type string, start_date date, end_date date"
    )
    flat = "carrier_code string, {} double, {} date, {} date"
    return rates.RateCards(
        base_rates=card(
            spark,
            "carrier_code string, zone int, bill_weight int, base_charge double, "
            "start_date date, end_date date",
            ("FDXHD", 2, 10, 5.0, *year),
            ("ONTRGD", 2, 10, 4.0, *year),
        ),
        resi=card(
            spark,
            flat.format("resi_amount", "start_date", "end_date"),
            ("FDXHD", 1.0, date(2025, 1, 1), date(2025, 10, 31)),
            ("FDXHD", 2.0, date(2025, 11, 1), date(2025, 12, 31)),
        ),
        das=card(
            spark,
            "carrier_code string, zipcode string, amount double, start_date date, "
            "end_date date",
            ("FDXHD", "00001", 0.5, *year),
        ),
        weight_bands=card(
            spark, band.format("weight"), ("FDXHD", 2, 50.0, 70.0, 9.0, "oversize", *year)
        ),
        longest_bands=card(
            spark,
            band.format("longest_side"),
            ("FDXHD", 2, 48.0, 60.0, 12.0, "additional_handling", *year),
            ("FDXHD", 2, 60.0, 99.0, 60.0, "oversize", *year),
        ),
        second_bands=card(
            spark,
            band.format("second_longest_side"),
            ("FDXHD", 2, 30.0, 99.0, 20.0, "oversize", *year),
        ),
        girth_bands=card(
            spark,
            band.format("length_plus_girth"),
            ("FDXHD", 2, 105.0, 999.0, 13.0, "additional_handling", *year),
        ),
        peak=card(
            spark,
            "shipmode string, peak_surcharge_application_week date, peak_surcharge double",
            ("FDXHD", date(2025, 11, 3), 0.4),
        ),
        fuel=card(
            spark,
            flat.format("fsc_per", "start_dt", "end_dt"),
            ("FDXHD", 0.1, *year),
        ),
    )


LANES = (
    "i int, mode string, cost_zone int, zip5 string, charged_weight long, weight double, "
    "longest_side double, second_side double, length_plus_girth double, ship_date date"
)
CASES = [
    # plain lane, residential before and after its change, peak week
    (1, "FDXHD", 2, "00001", 10, 10.0, 40.0, 10.0, 90.0, date(2025, 10, 31)),
    (2, "FDXHD", 2, "00002", 10, 10.0, 40.0, 10.0, 90.0, date(2025, 11, 1)),
    (3, "FDXHD", 2, "00002", 10, 10.0, 40.0, 10.0, 90.0, date(2025, 11, 9)),
    # band edges: 48 is outside, 60 belongs to the lower band
    (4, "FDXHD", 2, "00002", 10, 10.0, 48.0, 10.0, 90.0, date(2025, 11, 1)),
    (5, "FDXHD", 2, "00002", 10, 10.0, 60.0, 10.0, 90.0, date(2025, 11, 1)),
    # a band that does not count adds nothing alone, but may be the greatest
    (6, "FDXHD", 2, "00002", 10, 10.0, 40.0, 31.0, 90.0, date(2025, 11, 1)),
    (7, "FDXHD", 2, "00002", 10, 10.0, 40.0, 31.0, 106.0, date(2025, 11, 1)),
    # no fuel, no base rate
    (8, "ONTRGD", 2, "00002", 10, 10.0, 40.0, 10.0, 90.0, date(2025, 11, 1)),
    (9, "FDXHD", 2, "00002", 11, 10.0, 40.0, 10.0, 90.0, date(2025, 11, 1)),
]
PARTS = {1: 6.51, 2: 7.01, 3: 7.41, 4: 7.01, 5: 19.01, 6: 7.01, 7: 27.01}


def check_totals(df):
    found = dict(rows(df, "i", "total_amount"))
    assert set(found) == {c[0] for c in CASES}
    for i, parts in PARTS.items():
        assert found[i] == pytest.approx(parts * 1.1)
    assert found[8] is None and found[9] is None


def test_charges(spark, cards):
    lanes = spark.createDataFrame(CASES, LANES)
    priced = rates.with_charges(lanes, cards)
    check_totals(priced)
    classes = dict(rows(priced, "i", "handling_class"))
    assert classes[5] == classes[7] == "additional_handling" and classes[6] is None


def test_charges_of_checked_cards(spark, cards):
    """The size check adds hints and changes no result."""
    checked = cards.checked()
    assert checked.small == frozenset(rates.CARDS)
    check_totals(rates.with_charges(spark.createDataFrame(CASES, LANES), checked))


def test_charges_with_overlapping_bands(spark, cards):
    again = cards.longest_bands.where("amount = 12").withColumn("amount", F.lit(14.0))
    doubled = replace(cards, longest_bands=cards.longest_bands.unionAll(again))
    lanes = spark.createDataFrame(CASES[4:5], LANES)
    amounts = [r[0] for r in rows(rates.with_charges(lanes, doubled), "total_amount")]
    assert amounts == pytest.approx([19.01 * 1.1, 21.01 * 1.1])


def test_charges_are_broadcast_joins(spark, cards):
    lanes = spark.createDataFrame(CASES, LANES)
    cards = replace(cards, small=frozenset(rates.CARDS))
    plan = rates.with_charges(lanes, cards)._jdf.queryExecution().executedPlan()
    lane_side = plan.toString().split("BroadcastExchange")[0]
    assert lane_side.count("BroadcastHashJoin") >= 3
    assert "lambdafunction" not in plan.toString()


def test_overlapping_rates_give_one_row_each(spark, cards):
    twice = cards.resi.unionAll(
        cards.resi.where("resi_amount = 2").withColumn("resi_amount", F.lit(3.0))
    )
    doubled = replace(cards, resi=twice)
    lanes = spark.createDataFrame(CASES[1:2], LANES)
    amounts = [r[0] for r in rows(rates.with_charges(lanes, doubled), "total_amount")]
    assert amounts == pytest.approx([7.01 * 1.1, 8.01 * 1.1])


@pytest.fixture(scope="module")
def world(spark, cards, lines):
    """Three packages of one zip; the second has two shipment rows."""
    ts = datetime(2025, 11, 1, 10)
    shipments = spark.createDataFrame(
        [
            (o, t, "00001", fc, "FDXHD", "r", ts, ts, ts, ts, DAY, 10.0, 10.0, 10.0, 10.0, 2)
            for o, t, fc in (
                (1, "a", "AVP1"),
                (2, "b", "AVP1"),
                (2, "b", "MCI1"),
                (2, "b", "ELSE"),
                (3, "c", "AVP1"),
            )
        ],
        "order_id long, tracking_number string, zip5 string, fc_name string, "
        "carrier_code string, route string, order_placed_ts timestamp, "
        "release_ts timestamp, actual_ship_ts timestamp, first_attempt_ts timestamp, "
        "promised_date date, length double, width double, height double, weight double, "
        "units int",
    )
    ship_map = spark.createDataFrame(
        [
            (DAY, fc, "00001", mode, f"{mode}-{fc}", 2, "16:30:00", 1, 1, 2)
            for fc in ("AVP1", "MCI1")
            for mode in ("FDXHD", "ONTRGD")
        ],
        "shipdate date, fcname string, zip5 string, mode string, routeid string, "
        "zone int, cutoff string, tnt int, adjtnt int, nextadjtnt int",
    )
    far = spark.createDataFrame(
        [("AVP1", "00001", 5.0)], "fc_name string, postcode string, dist_miles double"
    )
    return shipments, lines, ship_map, cards, far


def routed(world):
    shipments, lines, ship_map, cards, far = world
    stage = lane_ops.routing_stage(shipments, *lines, cards, DAY, DAY)
    return lane_ops.routing_result(stage, ship_map, far)


def stage_of(world):
    shipments, lines, _, cards, _ = world
    candidates = stock.fulfillable_fcs(shipments, *lines, DAY, DAY)
    packages = lane_ops.candidate_packages(candidates, shipments)
    return lane_ops.lane_stage(packages, shipments, cards)


@pytest.fixture(params=[20_000, 1])
def slices(request, monkeypatch):
    """Ordinary slices, and slices so small that every key is cut."""
    monkeypatch.setattr(lane_ops, "PACKAGES_PER_SLICE", request.param)


def test_every_shipment_row_of_a_package_stays(world, slices):
    found = rows(routed(world), "order_id", "sim_fc_name", "act_fc_name", "act_transit_cost")
    assert [r[:3] for r in found] == [
        (1, "AVP1", "AVP1"),
        (2, "MCI1", "AVP1"),
        (2, "MCI1", "ELSE"),
        (2, "MCI1", "MCI1"),
    ]
    costs = {r[2]: r[3] for r in found if r[0] == 2}
    assert costs["AVP1"] is None and costs["ELSE"] is None and costs["MCI1"] is not None


def test_lane_operators_agree_with_the_result(world, slices):
    _, _, ship_map, _, far = world
    stage = stage_of(world)
    costs = lane_ops.lane_cost(stage, ship_map)
    assert rows(costs, "order_id", "fc_name", "mode") == [
        (1, "AVP1", "FDXHD"),
        (1, "AVP1", "ONTRGD"),
        (2, "MCI1", "FDXHD"),
        (2, "MCI1", "ONTRGD"),
    ]
    chosen = lane_ops.choose_lane(stage, ship_map, far)
    winners = rows(routed(world).select("order_id", "sim_fc_name", "sim_carrier_code").distinct())
    assert rows(chosen, "order_id", "fc_name", "carrier_code") == winners
    neutral = lane_ops.cost_neutral_fcs(stage, ship_map, far)
    assert rows(neutral, "order_id", "cost_neutral_fc") == rows(
        routed(world).select("order_id", "cost_neutral_fc").distinct()
    )


def test_sources_are_read_once(spark, world, tmp_path):
    """Packages come from one scan of each table, lanes from the stage alone."""
    shipments, lines, ship_map, cards, far = world
    tables = {"shipments": shipments, "order_lines": lines[0], "inventory": lines[1]}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    packages = lane_ops.served_packages(*read.values(), DAY, DAY)
    plan = packages._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(f"{tmp_path}/{name}") for name in tables] == [1, 1, 1]
    stage = lane_ops.lane_stage(packages, read["shipments"], cards)
    plan = lane_ops.routing_result(stage, ship_map, far)._jdf.queryExecution()
    assert str(tmp_path) not in plan.executedPlan().toString()


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_packages_are_never_shuffled_again(spark, world, slices, threshold):
    """No exchange above the bucketed scan, whether sides may be broadcast or not."""
    shipments, lines, ship_map, cards, far = world
    stage = stage_of((shipments, lines, ship_map, cards.checked(), far))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for df in (
            lane_ops.choose_lane(stage, ship_map, far),
            lane_ops.cost_neutral_fcs(stage, ship_map, far),
            lane_ops.lane_cost(stage, ship_map),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString()
            above = plan.split("SortMergeJoin", 1)[0]
            assert "Bucketed: true" in plan and "lambdafunction" not in plan
            assert "Exchange" not in above.replace("BroadcastExchange", "")
            assert plan.count("routing_packages") + plan.count("lanes_packages") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sizes_meet_the_bands_of_plain_comparisons(spark, cards):
    """Gaps, overlaps, empty and unbounded bands, and measures on a bound."""
    year = (date(2025, 1, 1), date(2025, 12, 31))
    bands = [
        ("FDXHD", 2, 48.0, 60.0, 1.0, "oversize", *year),
        ("FDXHD", 2, 48.0, 62.0, 2.0, "oversize", date(2025, 6, 1), date(2025, 11, 1)),
        ("FDXHD", 2, 61.0, 61.0, 3.0, "oversize", *year),
        ("FDXHD", 2, 62.0, 999.0, 4.0, "oversize", date(2025, 11, 2), date(2025, 11, 1)),
        ("FDXHD", 2, None, 60.0, 5.0, "oversize", *year),
        ("FDXHD", 3, -5.0, 1e10, 6.0, "oversize", *year),
    ]
    values = [None, -1.0, 48.0, 48.5, 60.0, 61.0, 62.0, 1e9]
    days = [date(2024, 5, 5), date(2025, 5, 31), date(2025, 6, 1), date(2025, 11, 1), None]
    lanes = [
        (i, "FDXHD", 2, "00002", 10, 10.0, value, 10.0, 90.0, day)
        for i, (value, day) in enumerate((v, d) for v in values for d in days)
    ]
    expected = []
    for i, _, _, _, _, _, value, _, _, day in lanes:
        met = [
            amount
            for _, zone, low, high, amount, _, start, end in bands
            if zone == 2 and None not in (low, value, day)
            and low < value <= high and start <= day <= end
        ]
        expected += [(i, amount) for amount in met or [0.0]]
    changed = replace(cards, longest_bands=spark.createDataFrame(bands, cards.longest_bands.schema))
    priced = rates.with_charges(spark.createDataFrame(lanes, LANES), changed)
    assert sorted(map(tuple, priced.select("i", "handling_amount").collect())) == expected


def test_a_package_gathers_its_facts_in_one_set(spark):
    """Known parts are distinct, and rows of other days or FCs add no scope or price."""
    schema = (
        "order_id bigint, tracking_number string, zip5 string, fc_name string, "
        "carrier_code string, route string, order_placed_ts timestamp, release_ts timestamp, "
        "actual_ship_ts timestamp, first_attempt_ts timestamp, promised_date date, "
        "length double, width double, height double, weight double, units int"
    )
    noon, later = datetime(2025, 11, 1, 12), datetime(2025, 11, 9, 12)

    def row(order, fc, placed, units):
        times = (placed, None, noon, None)
        return (order, "t", "00001", fc, "FDXHD", "r", *times, DAY, 1.0, 2.0, 3.0, 4.0, units)

    given = [
        row(1, "AVP1", noon, 1), row(1, "AVP1", noon, 1), row(1, "AVP1", noon, 2),
        row(1, "XXX1", noon, 2), row(2, "AVP1", later, 1), row(None, "AVP1", noon, 1),
    ]
    facts = lane_ops.package_facts(spark.createDataFrame(given, schema), DAY, DAY, ["AVP1"])
    names = ("scopes", "prices", "releases", "outcomes")
    sizes = {r["order_id"]: [len(r[n]) for n in names] for r in facts.collect()}
    assert sizes == {1: [1, 1, 1, 3], 2: [0, 0, 1, 1]}
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set(") == 1


def test_facts_come_from_sorted_rows_ready_to_be_joined(spark):
    """No map of sets, one shuffle, and the join with the FC sets sorts them no more."""
    schema = (
        "order_id long, tracking_number string, zip5 string, fc_name string, carrier_code string, "
        "route string, order_placed_ts timestamp, release_ts timestamp, actual_ship_ts timestamp, "
        "first_attempt_ts timestamp, promised_date date, length double, width double, "
        "height double, weight double, units long"
    )
    noon = datetime(2025, 11, 1, 12)

    def row(order, parcel, units, release=None):
        times = (noon, release, noon, None)
        return (order, parcel, "00001", "AVP1", "FDXHD", "r", *times, DAY, 1.0, 2.0, 3.0, 4.0, units)

    given = [row(1, "a", i % 3, noon if i % 2 else None) for i in range(600)]
    given += [row(1, "b", 7), row(1, None, 7), row(2, "a", None), row(2, "a", None)]
    facts = lane_ops.package_facts(spark.createDataFrame(given, schema), DAY, DAY)
    found = {
        (r["order_id"], r["tracking_number"]): (
            len(r["scopes"]), len(r["prices"]), len(r["releases"]),
            sorted((o["units"] for o in r["outcomes"]), key=str),
        )
        for r in facts.collect()
    }
    assert found == {
        (1, "a"): (1, 1, 2, [0, 1, 2]),
        (1, "b"): (1, 1, 1, [7]),
        (2, "a"): (1, 1, 1, [None]),
    }
    served = spark.createDataFrame([(1, "a", "x")], "order_id long, tracking_number string, k string")
    joined = facts.join(served.hint("merge"), stock.PACKAGE)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Sort [") == 2


def test_lanes_are_ranked_in_one_pass(spark):
    """The winner's cost counts as 0 if unknown, unless it is the only lane."""
    schema = (
        "p int, total_amount double, preferred int, tnt int, distance double, mode string, "
        "fc_name string, routeid string"
    )
    given = [
        (1, 5.0, 0, 2, 1.0, "m", "a", "r"), (1, 4.0, 0, 2, 1.0, "m", "b", "r"),
        (2, None, 0, 2, 1.0, "m", "a", "r"), (2, None, 0, 2, 2.0, "m", "a", "r"),
        (3, None, 0, 2, 1.0, "m", "a", "r"),
        (4, -900.0, 0, 2, 1.0, "m", "a", "r"), (4, 1.0, 0, None, 1.0, "m", "b", "r"),
    ]
    ranked = lane_ops.rank_lanes(spark.createDataFrame(given, schema), ["p"])
    found = {}
    for r in ranked.collect():
        found.setdefault(r["p"], set()).add(r["selected_cost"])
    penalty = ranked.where("p = 1").first()["tnt_penalty"]
    assert found == {1: {4.0 + penalty}, 2: {0.0}, 3: {None}, 4: {0.0}}
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_a_result_passes_through_its_lanes_once(world):
    """Ranks, equally cheap and really used lanes share a window; the map has the other."""
    shipments, lines, ship_map, cards, far = world
    stage = lane_ops.routing_stage(shipments, *lines, cards, DAY, DAY)
    result = lane_ops.routing_result(stage, ship_map, far)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2
