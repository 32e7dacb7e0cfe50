"""Columns over package dimensions, charges and delivery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions.codes import col


def _sides() -> list[Column]:
    return [F.col("length"), F.col("width"), F.col("height")]


def _if_all(sides: list[Column], value: Column) -> Column:
    known = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull()
    return F.when(known, value)


def longest_side() -> Column:
    return _if_all(_sides(), F.greatest(*_sides()))


def third_side() -> Column:
    return _if_all(_sides(), F.least(*_sides()))


def second_side() -> Column:
    return _if_all(_sides(), F.array_sort(F.array(*_sides()))[1])


def length_plus_girth(longest="longest_side", second="second_side", third="third_side"):
    return col(longest) + 2 * (col(second) + col(third))


def dim_volume() -> Column:
    length, width, height = _sides()
    return length * width * height / P.DIM_DIVISOR


def dim_weight() -> Column:
    return F.ceil(dim_volume())


def bill_weight() -> Column:
    """Greater of scale and volume weight, rounded up; null if either is unknown."""
    weight, volume = F.col("weight"), dim_volume()
    known = weight.isNotNull() & volume.isNotNull()
    return F.when(known, F.ceil(F.greatest(weight, volume)))


def charged_weight(
    bill="bill_weight",
    longest="longest_side",
    second="second_side",
    girth="length_plus_girth",
    ship_date="ship_date",
) -> Column:
    """Bill weight with the minimum of oversize and of additional-handling packages."""
    bill, longest, second, girth = map(col, (bill, longest, second, girth))
    # Size limits in inches, minimum weights in pounds.
    oversize = longest.between(96.001, 108) | girth.between(130.001, 165)
    handling = (
        longest.between(48.001, 96) | (second > 30) | girth.between(105.001, 130)
    )
    since = F.lit(P.ADDITIONAL_HANDLING_MINIMUM_FROM).cast("date")
    in_force = col(ship_date) >= since

    def at_least(minimum: int) -> Column:
        return F.when(bill > minimum, bill).otherwise(F.lit(minimum))

    return (
        F.when(oversize, at_least(90))
        .when(handling & in_force, at_least(40))
        .otherwise(bill)
    )


def transit_penalty(c: str | Column, steps: dict = P.TRANSIT_PENALTY) -> Column:
    days = sorted(steps)
    out = F.when(col(c) <= days[0], steps[days[0]])
    for day in days[1:-1]:
        out = out.when(col(c) == day, steps[day])
    return out.when(col(c) >= days[-1], steps[days[-1]])


def transit_floor(c: str | Column) -> Column:
    """One day counts as two when lanes are ranked."""
    return F.when(col(c) == 1, 2).otherwise(col(c))


def on_time_flag(promised: str | Column, attempted: str | Column) -> Column:
    """1 attempted by the promised day, 0 later or without a promise, null not attempted."""
    on_time = col(promised).cast("date") >= col(attempted).cast("date")
    return F.when(on_time, 1).when(col(attempted).isNull(), None).otherwise(0)
