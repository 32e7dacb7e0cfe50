"""Effect of many selections of zips, from one pass over the packages.

Zips are switched in the order of their rank.  A row of the baseline is there
until its zip is switched, a row of the scenario from then on, so what a
selection of any size counts is a prefix sum over ranks of what each rank adds
and takes away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import numbers
from lanewise.operators.shares import TIMES, relative_change, share_change, share_of_total
from lanewise.operators.signals import MATCH
from lanewise.operators.whatif import moved_by_proxy, with_proxy
from lanewise.operators.zips import rank_within
from lanewise.sources.shared import stored

#: Rank of a zip that no selection has.
NEVER = 2**31 - 1
LANE = ("fc_name", "carrier_code")
#: Key columns of the counts; those of flows say where a package goes.
COUNTS = {
    "carrier": ("to_carrier",),
    "fc": ("to_fc",),
    "day_lane": ("day", "to_fc", "to_carrier"),
    "fc_flow": ("from_fc", "to_fc"),
    "lane_flow": ("from_fc", "from_carrier", "to_fc", "to_carrier"),
}
WIDTH = max(map(len, COUNTS.values()))


def ranked_choices(lists: list[DataFrame]) -> DataFrame:
    """``zip5, choice, zip_rank`` of ranked lists; the first list with a zip has it.

    The lists of a run share no zip, as each zip has one decision.
    """
    named = [
        zips.where("zip5 is not null").select(
            "zip5", F.lit(k).alias("choice"), F.col("zip_rank").cast("int").alias("zip_rank")
        )
        for k, zips in enumerate(lists)
    ]
    first = F.min(F.struct("choice", "zip_rank")).alias("first")
    return reduce(DataFrame.unionAll, named).groupBy("zip5").agg(first).select("zip5", "first.*")


def spliced_at(
    base: DataFrame,
    scenarios: list[DataFrame],
    chosen: DataFrame,
    counts,
    columns: list[str],
) -> DataFrame:
    """The spliced result of every count, tagged with ``zip_count``.

    ``chosen`` comes from :func:`ranked_choices`; each side is read once.
    """
    wanted = F.explode(F.array(*(F.lit(int(c)) for c in counts))).alias("zip_count")
    rank = F.coalesce("zip_rank", F.lit(NEVER))
    kept = base.join(chosen, "zip5", "left").select("*", wanted)
    out = kept.where(rank > F.col("zip_count"))
    out = out.select(*(_from_base(base, c) for c in columns), "zip_count")
    for k, scenario in enumerate(scenarios):
        own = chosen.where(F.col("choice") == k)
        rows = scenario.join(own, "zip5").select("*", wanted)
        rows = rows.where(rank <= F.col("zip_count"))
        out = out.unionByName(rows.select(*columns, "zip_count"))
    return out


def _from_base(base: DataFrame, column: str) -> Column:
    own = {"sim_": "base_", "cost_neutral_fc": "base_cost_neutral_fc"}
    for new, old in own.items():
        if column.startswith(new) and old + column[len(new) :] in base.columns:
            return F.col(old + column[len(new) :]).alias(column)
    return F.col(column)


def lane_rows(base: DataFrame, scenarios: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """Rows of the baseline and, for the zips of their lists, those of the scenarios."""

    def side(df: DataFrame, prefix: str, switched: bool) -> DataFrame:
        return df.select(
            *MATCH,
            "zip_rank",
            F.lit(switched).alias("switched"),
            F.struct(
                F.col(f"{prefix}_fc_name").alias("fc"),
                F.col(f"{prefix}_carrier_code").alias("carrier"),
            ).alias("lane"),
            F.coalesce(f"{prefix}_transit_cost", F.lit(0.0)).alias("cost"),
        )

    rows = side(base.join(chosen, "zip5", "left"), "base", False)
    for k, scenario in enumerate(scenarios):
        own = chosen.where(F.col("choice") == k)
        rows = rows.unionAll(side(scenario.join(own, "zip5"), "sim", True))
    return rows


def zip_costs(rows: DataFrame) -> DataFrame:
    """Cost of each zip before and after it is switched, null where it has no rows."""
    before, after = ~F.col("switched"), F.col("switched")
    return rows.where("zip5 is not null").groupBy("zip5", "zip_rank").agg(
        F.sum(F.when(before, F.col("cost"))).alias("before"),
        F.sum(F.when(after, F.col("cost"))).alias("after"),
    )


def package_lanes_of(
    base: DataFrame, scenarios: list[DataFrame], chosen: DataFrame
) -> DataFrame:
    """One row per package with its lanes before and after its zip is switched.

    ``before`` and ``after`` hold the distinct lanes, ``matched`` tells whether both
    results can be joined by the package.  Rows are shuffled once, by tracking number;
    those without one count for nothing.
    """
    rows = lane_rows(base, scenarios, chosen).where("tracking_number is not null")
    before, after = ~F.col("switched"), F.col("switched")
    lanes = rows.repartition("tracking_number").groupBy(*MATCH, "zip_rank").agg(
        F.collect_set(F.when(before, F.col("lane"))).alias("before"),
        F.collect_set(F.when(after, F.col("lane"))).alias("after"),
    )
    matched = reduce(Column.__and__, (F.col(c).isNotNull() for c in MATCH))
    return lanes.select(
        "tracking_number",
        "order_placed_date",
        "zip_rank",
        matched.alias("matched"),
        F.sort_array("before").alias("before"),
        F.sort_array("after").alias("after"),
        F.lit(1).cast("bigint").alias(TIMES),
    )


def alike_packages(packages: DataFrame) -> DataFrame:
    """The packages of one tracking number for all that have the same set of them.

    Day, rank and lanes are all that counts, and most tracking numbers share theirs with
    many others; ``TIMES`` tells how many.  The tracking number is a new number.
    """
    fact = ("order_placed_date", "zip_rank", "matched", "before", "after")
    sets = (
        packages.groupBy("tracking_number")
        .agg(F.sort_array(F.collect_set(F.struct(*fact))).alias("_facts"))
        .groupBy("_facts")
        .agg(F.count(F.lit(1)).alias(TIMES))
    )
    number = F.monotonically_increasing_id().alias("tracking_number")
    # Numbered before the facts fan out.
    numbered = sets.select(number, TIMES, "_facts")
    return numbered.select("tracking_number", TIMES, F.inline("_facts"))


def _timed(lanes: str, since: Column, until: Column, origin: Column | None = None) -> Column:
    """An entry for each lane: what it counts for, and from when until when."""
    nothing = F.lit(None).cast("string")

    def entry(lane: Column) -> Column:
        start = origin if origin is not None else F.struct(
            nothing.alias("fc"), nothing.alias("carrier")
        )
        return F.struct(
            F.lit(origin is not None).alias("flow"),
            start["fc"].alias("from_fc"),
            start["carrier"].alias("from_carrier"),
            lane["fc"].alias("to_fc"),
            lane["carrier"].alias("to_carrier"),
            since.alias("since"),
            until.alias("until"),
        )

    return F.transform(lanes, entry)


def counted_events(packages: DataFrame) -> DataFrame:
    """``of, k0.., rank, n``: how the distinct tracking numbers of a key change at a rank.

    ``packages`` come from :func:`package_lanes_of` or :func:`alike_packages`.

    A tracking number counts for a key while any of its rows does: until the last
    baseline row goes, and from the first scenario row on.
    """
    rank = F.coalesce("zip_rank", F.lit(NEVER))
    zero, never = F.lit(0), F.lit(NEVER)
    flows = [
        F.flatten(F.transform("before", lambda o: _timed(lanes, since, until, o)))
        for lanes, since, until in (("before", zero, rank), ("after", rank, never))
    ]
    none = F.filter(flows[0], lambda e: F.lit(False))
    entries = F.concat(
        _timed("before", zero, rank),
        _timed("after", rank, never),
        *(F.when(F.col("matched"), f).otherwise(none) for f in flows),
    )
    lanes = packages.select(
        "tracking_number", TIMES, F.col("order_placed_date").cast("string").alias("day"),
        F.inline(entries),
    )
    keyed = []
    for of, columns in COUNTS.items():
        known = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
        wanted = known & (F.col("flow") == F.lit(of.endswith("flow")))
        keys = [F.col(c) for c in columns] + [F.lit(None).cast("string")] * (WIDTH - len(columns))
        named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
        keyed.append(F.when(wanted, F.struct(F.lit(of).alias("of"), *named)))
    lanes = lanes.select(
        "tracking_number", TIMES, "since", "until",
        F.explode(F.array_compact(F.array(*keyed))).alias("key"),
    )
    keys = ["of", *(f"k{i}" for i in range(WIDTH))]
    # A tracking number stands for as many in all its rows.
    each = lanes.select("tracking_number", TIMES, "key.*", "since", "until")
    each = each.groupBy("tracking_number", TIMES, *keys).agg(
        F.max(F.when(F.col("since") == 0, F.col("until")).otherwise(0)).alias("gone"),
        F.min(F.when(F.col("since") > 0, F.col("since")).otherwise(NEVER)).alias("back"),
    )
    gone, back = F.col("gone"), F.col("back")

    def event(at: Column, n: int) -> Column:
        return F.struct(at.alias("rank"), (F.col(TIMES) * n).alias("n"))

    events = F.array(
        F.when(gone > 0, event(zero, 1)),
        F.when((gone > 0) & (gone < back), event(gone, -1)),
        F.when(gone < back, event(back, 1)),
    )
    return (
        each.select(*keys, F.inline(F.array_compact(events)))
        .where(F.col("rank") < NEVER)
        .groupBy(*keys, "rank")
        .agg(F.sum("n").alias("n"))
    )


class Sweep:
    """Metrics of the selections of the ``counts`` best zips of each list.

    ``choices`` pairs scenarios with zips ranked from 1 on.  Every frame has a
    column ``zip_count``.  The packages are shuffled once, whatever the number of
    counts, and those alike are counted as one; what is left are small tables by key
    and zip.
    """

    def __init__(self, base: DataFrame, choices: list[tuple[DataFrame, DataFrame]], counts):
        self.counts = sorted({int(c) for c in counts})
        self.spark = base.sparkSession
        chosen = ranked_choices([zips for _, zips in choices]) if choices else self._no_zips(base)
        # Only the first count that has a zip matters, not its rank.
        first = (F.when(F.col("zip_rank") <= c, F.lit(c)) for c in self.counts)
        chosen = chosen.withColumn("zip_rank", F.coalesce(*first, F.lit(NEVER)))
        self.chosen = stored(chosen, "chosen-zips")
        self.scenarios = [scenario for scenario, _ in choices]
        packages = package_lanes_of(base, self.scenarios, self.chosen)
        packages = stored(alike_packages(packages), "swept")
        slot = sum(((F.col("rank") > c).cast("int") for c in self.counts), F.lit(0))
        slot = F.when(F.col("rank") == 0, 0).otherwise(slot + 1)
        keys = ["of", *(f"k{i}" for i in range(WIDTH))]
        events = counted_events(packages).withColumn("slot", slot)
        events = events.where(F.col("slot") <= len(self.counts))
        events = events.groupBy(*keys, "slot").agg(F.sum("n").alias("n"))
        self.events = stored(events, "sweep-events")
        rows = lane_rows(base, self.scenarios, self.chosen)
        self.costs = stored(zip_costs(rows), "sweep-costs")

    @staticmethod
    def _no_zips(base: DataFrame) -> DataFrame:
        none = base.select("zip5", F.lit(0).alias("choice"), F.lit(0).alias("zip_rank"))
        return none.limit(0)

    def _counted(self, of: str, *names: str) -> tuple[DataFrame, DataFrame]:
        """The counts of the baseline and of each selection, by ``zip_count`` and keys."""
        keys = [F.col(f"k{i}").alias(name) for i, name in enumerate(names)]
        last = len(self.counts)
        events = self.events.where(F.col("of") == of).select(*keys, "slot", "n")
        at = events.withColumn("at", F.explode(F.sequence("slot", F.lit(last))))
        sums = at.groupBy(*names, "at").agg(F.sum("n").alias("value")).where("value > 0")
        counts = F.array(*(F.lit(c) for c in self.counts))
        base = sums.where("at = 0").select(F.explode(counts).alias("zip_count"), *names, "value")
        after = sums.where("at > 0").select(
            F.element_at(counts, F.col("at")).alias("zip_count"), *names, "value"
        )
        return base, after

    def _share(self, of: str, name: str) -> DataFrame:
        return share_change(
            *self._counted(of, name), ["zip_count", name], "value", "sum", ["zip_count"]
        )

    def carrier_change(self) -> DataFrame:
        """Network share of the carriers before the proxy."""
        return self._share("carrier", "sim_carrier_code")

    def fc_charge_change(self) -> DataFrame:
        """Share of the FCs with absolute and relative change."""
        return relative_change(self._share("fc", "sim_fc_name"))

    def carrier_change_proxy(self, proxy: DataFrame) -> DataFrame:
        """Network share of the carriers after the proxy."""

        def moved(counted: DataFrame) -> DataFrame:
            day = F.col("order_placed_date").cast("date")
            counted = counted.withColumn("order_placed_date", day)
            counted = with_proxy(counted.withColumnRenamed("value", "packages"), proxy)
            return moved_by_proxy(counted, by=("zip_count",))

        sides = self._counted("day_lane", "order_placed_date", "fc", "proxy_carrier")
        return share_change(
            *map(moved, sides), ["zip_count", "carrier"], "package_count", "sum", ["zip_count"]
        )

    def _flow(self, of: str, attributes: list[str], targets: int) -> DataFrame:
        sources = [f"base_{a}" for a in attributes]
        goals = [f"sim_{a}" for a in attributes]
        _, after = self._counted(of, *sources, *goals)
        by = ["zip_count", *sources]
        flow = share_of_total(after, [*by, *goals], "value", "sum", by)
        return rank_within(flow, by, "value", goals, targets).select(
            *by, *goals, "value", "percent"
        )

    def fc_flow(self, targets: int = P.FLOW_TARGETS) -> DataFrame:
        """Where the packages of each FC go, the largest targets only."""
        return self._flow("fc_flow", ["fc_name"], targets)

    def fc_carrier_flow(self, targets: int = P.FLOW_TARGETS) -> DataFrame:
        """Where the packages of each FC and carrier go, the largest targets only."""
        return self._flow("lane_flow", list(LANE), targets)

    def cost_by_zip(self) -> DataFrame:
        """Transit cost of each zip in both results and the difference."""
        counts = F.explode(F.array(*(F.lit(c) for c in self.counts))).alias("zip_count")
        switched = F.coalesce(F.col("zip_rank") <= F.col("zip_count"), F.lit(False))
        after = F.when(switched, F.col("after")).otherwise(F.col("before"))
        return (
            self.costs.select("zip5", "zip_rank", "before", "after", counts)
            .select(
                "zip_count",
                "zip5",
                F.col("before").alias("base_value"),
                after.alias("iter_value"),
            )
            .where("base_value is not null and iter_value is not null")
            .withColumn("cost_change", F.col("iter_value") - F.col("base_value"))
        )

    def cost_saving(self) -> DataFrame:
        """Sum of the cost changes over the zips of both results."""
        counts = self.spark.createDataFrame([(c,) for c in self.counts], "zip_count int")
        sums = self.cost_by_zip().groupBy("zip_count")
        sums = sums.agg(numbers.total("cost_change").alias("cost_saving"))
        saving = numbers.zero_if_null("cost_saving").cast("double").alias("cost_saving")
        return counts.join(sums, "zip_count", "left").select("zip_count", saving)

    def spliced(self, base: DataFrame, columns: list[str]) -> DataFrame:
        """The spliced result of every count."""
        return spliced_at(base, self.scenarios, self.chosen, self.counts, columns)

    def metrics(self, proxy: DataFrame) -> dict[str, DataFrame]:
        return {
            "carrier_net_before_wms_proxy": self.carrier_change(),
            "carrier_net_after_wms_proxy": self.carrier_change_proxy(proxy),
            "cost_saving": self.cost_saving(),
            "cost_saving_by_zip": self.cost_by_zip(),
            "fc_charge_changes": self.fc_charge_change(),
            "fc_flow": self.fc_flow(),
            "fc_carrier_flow": self.fc_carrier_flow(),
        }
