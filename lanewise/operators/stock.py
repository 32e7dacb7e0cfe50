"""Which FCs could have served a package from stock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, codes

PACKAGE = ["order_id", "tracking_number"]
MASK_BITS = 63


def stocked_lines(order_lines: DataFrame, inventory: DataFrame, start, end) -> DataFrame:
    """Order lines of the days with every FC that has enough of the item."""
    wanted = order_lines.where(
        calendar.within_days("order_placed_date", start, end)
    ).select(*PACKAGE, "order_line_id", "qty")
    stock = inventory.select(
        F.col("order_id").alias("_order"),
        F.col("order_line_id").alias("_line"),
        "fc_name",
        "quantity_available",
    )
    enough = (
        (F.col("order_id") == F.col("_order"))
        & (F.col("order_line_id") == F.col("_line"))
        & (F.col("quantity_available") >= F.col("qty"))
    )
    return wanted.join(stock, enough).select(*PACKAGE, "order_line_id", "fc_name")


def qualified_fcs(stocked: DataFrame) -> DataFrame:
    """FCs holding every line of the package that any FC holds.

    Each line carries its FC set (one entry per FC at most) plus one marker
    entry, so a single count by (package, FC) yields both the lines per FC and
    the lines per package; the window then sees one row per FC.
    """
    per_line = stocked.groupBy("order_id", "order_line_id", "tracking_number").agg(
        F.collect_set("fc_name").alias("fcs")
    )
    marker = F.array(F.lit(None).cast("string"))
    counts = (
        per_line.select(*PACKAGE, F.explode(F.concat("fcs", marker)).alias("fc_name"))
        .groupBy(*PACKAGE, "fc_name")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    all_lines = F.max(F.when(F.col("fc_name").isNull(), F.col("lines")))
    return (
        counts.withColumn("all_lines", all_lines.over(Window.partitionBy(*PACKAGE)))
        .where(F.col("fc_name").isNotNull() & (F.col("lines") == F.col("all_lines")))
        .select(*PACKAGE, "fc_name")
    )


def _bits(fcs) -> dict[str, dict[str, int]]:
    """A bit for every FC, in one number for every 63 FCs."""
    names = list(dict.fromkeys(fcs))
    groups = [names[i : i + MASK_BITS] for i in range(0, len(names), MASK_BITS)]
    return {f"_mask{n}": {fc: 1 << i for i, fc in enumerate(g)} for n, g in enumerate(groups)}


def _bit(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _sets(lines: DataFrame, bits: dict, masks: dict[str, Column]) -> DataFrame:
    """FCs of a package: the 'or' of the rows of a line, the 'and' of its lines."""
    held = F.array(
        *(
            F.when(F.col(mask).bitwiseAND(_bit(b)) != 0, F.lit(fc))
            for mask, of in bits.items()
            for fc, b in of.items()
        )
    )
    return (
        lines.groupBy("order_id", "order_line_id", "tracking_number")
        .agg(*(F.bit_or(value).alias(mask) for mask, value in masks.items()))
        .groupBy(*PACKAGE)
        .agg(*(F.bit_and(mask).alias(mask) for mask in bits))
        .select(*PACKAGE, F.array_compact(held).alias("fcs"))
        .where(F.size("fcs") > 0)
    )


def fc_sets(stocked: DataFrame, fcs=P.FCS) -> DataFrame:
    """Per package the array ``fcs`` of those given FCs that hold all its lines.

    Every FC is one bit, aggregated before the shuffle into one number for every
    63 FCs, however many lines a package has.
    """
    bits = _bits(fcs)
    masks = {m: codes.lookup("fc_name", of, 0).cast("bigint") for m, of in bits.items()}
    return _sets(stocked, bits, masks)


def served_sets(
    order_lines: DataFrame, inventory: DataFrame, start, end, fcs=P.FCS
) -> DataFrame:
    """:func:`fc_sets` of the stocked lines, without a row for every line and FC.

    The stock of a line becomes one row with the largest quantity of each FC
    before it is shuffled, so the join moves and sorts lines only.  A line
    counts if any FC holds it, given or not.
    """
    bits = _bits(fcs)
    most = {fc: f"_most{i}" for i, fc in enumerate(fc for of in bits.values() for fc in of)}
    quantity = F.col("quantity_available")
    stock = inventory.groupBy(
        F.col("order_id").alias("_order"), F.col("order_line_id").alias("_line")
    ).agg(
        F.max(quantity).alias("_any"),
        *(F.max(F.when(F.col("fc_name") == fc, quantity)).alias(c) for fc, c in most.items()),
    )
    wanted = order_lines.where(
        calendar.within_days("order_placed_date", start, end)
    ).select(*PACKAGE, "order_line_id", "qty")
    enough = (
        (F.col("order_id") == F.col("_order"))
        & (F.col("order_line_id") == F.col("_line"))
        & (F.col("_any") >= F.col("qty"))
    )

    def held_by(of: dict[str, int]) -> Column:
        held = (F.when(F.col(most[fc]) >= F.col("qty"), _bit(b)) for fc, b in of.items())
        return reduce(Column.bitwiseOR, (F.coalesce(h, _bit(0)) for h in held))

    return _sets(wanted.join(stock, enough), bits, {m: held_by(of) for m, of in bits.items()})


def shipped_packages(shipments: DataFrame, start, end, fcs=P.FCS) -> DataFrame:
    return shipments.where(
        F.col("fc_name").isin(*fcs)
        & calendar.within_days("order_placed_ts", start, end)
    )


def fulfillable_fcs(
    shipments: DataFrame,
    order_lines: DataFrame,
    inventory: DataFrame,
    start,
    end,
    fcs=P.FCS,
    candidate_fcs=None,
) -> DataFrame:
    """(package, FC) pairs: the FC has stock for every counted line of the package.

    ``fcs`` limits the shipping FCs; any FC of the inventory is a candidate
    unless ``candidate_fcs`` names them, which is the cheaper way.

    The order lines meet the inventory before the shipments, so the fact tables
    shuffle once by line and once by package.
    """
    packages = shipped_packages(shipments, start, end, fcs).select(
        *PACKAGE, "zip5", "order_placed_ts"
    )
    # Packages are made distinct, not their many pairs, where the join needs them.
    packages = packages.repartition(*PACKAGE).distinct()
    if candidate_fcs is None:
        qualified = qualified_fcs(stocked_lines(order_lines, inventory, start, end))
    else:
        served = served_sets(order_lines, inventory, start, end, candidate_fcs)
        qualified = served.select(*PACKAGE, F.explode("fcs").alias("fc_name"))
    return qualified.join(packages, PACKAGE).select(
        "order_id", "order_placed_ts", "zip5", "tracking_number", "fc_name"
    )
