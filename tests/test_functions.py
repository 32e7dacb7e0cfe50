from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, codes, numbers, package


def one(spark, column, **values):
    """Value of a column over a one-row frame."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "raw, padded", [("7066", "07066"), ("07066", "07066"), ("123456", "12345"), (None, None)]
)
def test_zip_pad_pads_and_cuts(spark, raw, padded):
    df = spark.createDataFrame([(raw,)], "z string")
    assert df.select(codes.zip_pad("z")).first()[0] == padded


def test_zip_from_number_reads_float_text(spark):
    df = spark.createDataFrame([("7066.0",), ("501",)], "z string")
    assert rows(df.select(codes.zip_from_number("z"))) == [("00501",), ("07066",)]


def test_joined_key_is_null_with_a_null_part(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert rows(df.select("i", codes.joined_key("i", "s"))) == [(1, "1-a"), (2, None)]


@pytest.mark.parametrize(
    "cutoff, clock",
    [(93000, "09:30:00"), (193000, "19:30:00"), (240000, "00:00:00"), (253000, "01:30:00")],
)
def test_cutoff_wraps_after_midnight(spark, cutoff, clock):
    assert one(spark, calendar.wrapped_clock("c"), c=cutoff) == clock


def test_plain_clock_takes_digits_or_clock(spark):
    assert one(spark, calendar.plain_clock("c"), c="193000") == "19:30:00"
    assert one(spark, calendar.plain_clock("c"), c="19:30:00") == "19:30:00"


@pytest.mark.parametrize(
    "day, label",
    [
        (date(2025, 11, 16), "2025-11-09"),
        (date(2025, 11, 17), "2025-11-16"),
        (date(2025, 11, 22), "2025-11-16"),
    ],
)
def test_week_label_puts_a_sunday_in_the_week_before(spark, day, label):
    assert one(spark, calendar.week_label("d"), d=day) == label


def test_weekdays(spark):
    sunday = date(2025, 11, 16)
    assert one(spark, calendar.dow_sunday0("d"), d=sunday) == 0
    assert one(spark, calendar.dow_monday0("d"), d=sunday) == 6


def test_business_day_turns_at_four(spark):
    day = calendar.business_day("t")
    assert one(spark, day, t=datetime(2025, 11, 2, 3, 59)) == date(2025, 11, 1)
    assert one(spark, day, t=datetime(2025, 11, 2, 4, 0)) == date(2025, 11, 2)


def test_lookback_window_has_one_day_more_than_its_length():
    start, end = calendar.lookback_window("2025-11-15", 7)
    assert (start, end) == (date(2025, 11, 7), date(2025, 11, 14))


@pytest.mark.parametrize(
    "release, days",
    [
        (datetime(2025, 11, 1, 16, 30), 1),
        (datetime(2025, 11, 1, 16, 30, 1), 2),
        (datetime(2025, 11, 2, 0, 0), 2),
        (None, 2),
    ],
)
def test_cutoff_decides_transit(spark, release, days):
    df = spark.createDataFrame(
        [(date(2025, 11, 1), release, "16:30:00")], "d date, r timestamp, c string"
    )
    transit = calendar.transit_days(
        calendar.clock_seconds("c"),
        calendar.seconds_into_day("r", "d"),
        F.lit(1),
        F.lit(2),
    )
    assert df.select(transit).first()[0] == days


@pytest.mark.parametrize("x, even", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (48.5, 48.0)])
def test_half_even(spark, x, even):
    assert one(spark, numbers.half_even("x"), x=x) == even


def test_ratio_by_zero_is_null(spark):
    assert one(spark, numbers.ratio("a", "b"), a=1, b=0) is None


SIDES = "length double, width double, height double"


@pytest.mark.parametrize(
    "sides, longest, second, third",
    [
        ((10.0, 20.0, 30.0), 30.0, 20.0, 10.0),
        ((20.0, 20.0, 5.0), 20.0, 20.0, 5.0),
        ((7.0, 7.0, 7.0), 7.0, 7.0, 7.0),
        ((None, 2.0, 1.0), None, None, None),
    ],
)
def test_sides_are_unknown_if_one_is(spark, sides, longest, second, third):
    df = spark.createDataFrame([sides], SIDES)
    found = df.select(
        package.longest_side(), package.second_side(), package.third_side()
    ).first()
    assert tuple(found) == (longest, second, third)


@pytest.mark.parametrize(
    "longest, second, girth, bill, day, charged",
    [
        (100.0, 10.0, 100.0, 50, "2025-11-01", 90),
        (100.0, 10.0, 100.0, 95, "2025-11-01", 95),
        (50.0, 10.0, 100.0, 20, "2025-01-12", 20),
        (50.0, 10.0, 100.0, 20, "2025-01-13", 40),
        (40.0, 31.0, 100.0, 20, "2025-11-01", 40),
        (48.0, 30.0, 105.0, 20, "2025-11-01", 20),
        (20.0, 10.0, 131.0, 20, "2025-11-01", 90),
        (20.0, 10.0, 166.0, 20, "2025-11-01", 20),
        (100.0, 10.0, 100.0, None, "2025-11-01", 90),
    ],
)
def test_charged_weight(spark, longest, second, girth, bill, day, charged):
    df = spark.createDataFrame(
        [(longest, second, girth, bill, date.fromisoformat(day))],
        "longest_side double, second_side double, length_plus_girth double, "
        "bill_weight long, ship_date date",
    )
    assert df.select(package.charged_weight()).first()[0] == charged


def test_transit_penalty_steps(spark):
    df = spark.createDataFrame([(d,) for d in [None, *range(0, 12)]], "d int")
    steps = dict(rows(df.select("d", package.transit_penalty("d"))))
    assert steps[None] is None
    assert [steps[d] for d in (0, 1, 2)] == [2.1] * 3
    assert [steps[d] for d in range(3, 9)] == [2.4, 2.8, 3.6, 35.1, 36.1, 37.1]
    assert [steps[d] for d in (9, 10, 11)] == [38.1] * 3


@pytest.mark.parametrize(
    "promised, attempted, flag",
    [
        (date(2025, 11, 2), datetime(2025, 11, 2, 23), 1),
        (date(2025, 11, 2), datetime(2025, 11, 3), 0),
        (None, datetime(2025, 11, 3), 0),
        (date(2025, 11, 2), None, None),
        (None, None, None),
    ],
)
def test_on_time_flag(spark, promised, attempted, flag):
    df = spark.createDataFrame([(promised, attempted)], "p date, a timestamp")
    assert df.select(package.on_time_flag("p", "a")).first()[0] == flag


def test_every_fc_has_a_region(spark):
    df = spark.createDataFrame([(fc,) for fc in [*P.FCS, "ZZZ9"]], "fc string")
    found = dict(rows(df.select("fc", codes.fc_region("fc"))))
    assert found.pop("ZZZ9") == P.NONE
    assert len(found) == 13 and P.NONE not in found.values()


def test_scaling_a_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "i int, x double")
    zero = numbers.min_max_scale(df, {"x": "s"}, "zero")
    none = numbers.min_max_scale(df, {"x": "s"}, "null")
    assert rows(zero, "i", "s") == [(1, 0.0), (2, 0.0), (3, None)]
    assert rows(none, "i", "s") == [(1, None), (2, None), (3, None)]


def test_impute_mean_leaves_an_empty_column(spark):
    df = spark.createDataFrame(
        [(1, 2.0, None), (2, None, None), (3, 4.0, None)], "i int, x double, y double"
    )
    assert rows(numbers.impute_mean(df, "x", "y")) == [
        (1, 2.0, None),
        (2, 3.0, None),
        (3, 4.0, None),
    ]
