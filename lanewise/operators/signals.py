"""Service, backlog, shutdown, volume and switch signals per zip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, codes, numbers
from lanewise.operators.zips import distinct_zips

MATCH = ["order_id", "tracking_number", "order_placed_date", "zip5"]


def newest(keys: list[str], stamp: str, tie: str, *payload: str):
    """The payload of the newest row of each key, by partial aggregation.

    An unknown stamp counts as newest, as the warehouse sorts it; ``tie``
    decides between equal stamps, the greater value wins.
    """
    order = F.struct(
        F.col(stamp).isNull().alias("unknown"),
        F.col(stamp).alias("stamp"),
        F.col(tie).alias("tie"),
    )
    row = F.struct(*(F.col(c) for c in payload))

    def apply(df: DataFrame) -> DataFrame:
        return (
            df.groupBy(*keys)
            .agg(F.max_by(row, order).alias("newest"))
            .select(*keys, "newest.*")
        )

    return apply


def service_rate(failures: DataFrame, start, end, fcs=P.FCS) -> DataFrame:
    """Packages and packages on time by delivery date, FC, carrier and zip."""
    return (
        failures.where(
            F.col("fc").isin(*fcs) & calendar.within_days("unpadded_edd", start, end)
        )
        .groupBy(
            "unpadded_edd",
            F.col("fc").alias("fc_name"),
            "carrier_code",
            F.col("zip").alias("zip5"),
        )
        .agg(
            (F.sum("total") - F.sum("failures")).alias("on_time_count"),
            F.sum("total").alias("package_count"),
        )
    )


def latest_backlog(backlog: DataFrame, start, end) -> DataFrame:
    """Newest row per run date, carrier and facility."""
    rows = backlog.where(
        F.col("carrier").isNotNull() & calendar.within_days("run_date", start, end)
    ).withColumn("date", F.col("run_date").cast("date"))
    keys = ["date", "run_date", "carrier", "dest_facility_num"]
    return rows.transform(
        newest(keys, "row_created_date", "days_behind", "days_behind")
    ).drop("run_date")


def incumbent_stations(station_zip_a: DataFrame) -> DataFrame:
    """Station of a zip in its newest snapshot; the lower station wins a tie."""
    stations = station_zip_a.select(
        codes.zip_pad("zipcode").alias("zip5"),
        codes.station_from_term("master_term").alias("dest_facility_num"),
        "snapshot_date",
    ).withColumn("lower_first", -F.col("dest_facility_num"))
    return stations.transform(
        newest(["zip5"], "snapshot_date", "lower_first", "dest_facility_num")
    )


def station_zips(station_zip_a: DataFrame, station_zip_b: DataFrame) -> DataFrame:
    """Zips of every station of both carriers in one table."""
    incumbent = incumbent_stations(station_zip_a).select(
        F.lit(P.INCUMBENT_NAME).alias("carrier"), "dest_facility_num", "zip5"
    )
    challenger = station_zip_b.select(
        F.lit(P.CHALLENGER_NAME).alias("carrier"),
        "dest_facility_num",
        codes.zip_pad("customer_zip").alias("zip5"),
    ).distinct()
    return incumbent.unionByName(challenger)


def zip_backlog(
    backlog: DataFrame, station_zip_a: DataFrame, station_zip_b: DataFrame, start, end
) -> DataFrame:
    """Days behind per zip and carrier; a station without zips keeps a null zip."""
    zips = station_zips(station_zip_a, station_zip_b)
    return (
        latest_backlog(backlog, start, end)
        .join(zips, ["carrier", "dest_facility_num"], "left")
        .select(
            "date",
            "dest_facility_num",
            "zip5",
            "days_behind",
            codes.carrier_from_name("carrier").alias("carrier_code"),
        )
        .distinct()
    )


def zip_daily_volume(routing: DataFrame) -> DataFrame:
    """Distinct packages per zip over the distinct days of the whole frame."""
    days = numbers.one_value(routing, F.count_distinct("order_placed_date"))
    return (
        routing.where(F.col("zip5").isNotNull())
        .groupBy("zip5")
        .agg(F.count_distinct("tracking_number").alias("packages"))
        .select(
            "zip5", numbers.ratio("packages", days).alias("daily_package_count_avg")
        )
    )


def matched(base: DataFrame, iteration: DataFrame, *more_keys: str) -> DataFrame:
    """Packages of both results side by side."""
    keys = [*MATCH, *more_keys]
    sim = [c for c in iteration.columns if c.startswith("sim_")]
    return base.join(iteration.select(*keys, *sim), keys)


def _differs(kind: int, before: str, after: str) -> Column:
    """An entry for a pair of codes that differ; none where one is unknown."""
    pair = (F.lit(kind).alias("kind"), F.col(before).alias("was"), F.col(after).alias("is"))
    return F.when(F.col(before) != F.col(after), F.struct(*pair))


def fc_carrier_switch(base: DataFrame, iteration: DataFrame) -> DataFrame:
    """Packages per zip whose FC or carrier differs between two results.

    A package has an entry of its own and one for every pair of codes that differs;
    distinct entries are counted, without a set for each package.
    """
    codes_of = ("fc_name", "carrier_code")
    nothing = F.lit(None).cast("string")
    entries = F.array(
        F.struct(F.lit(0).alias("kind"), nothing.alias("was"), nothing.alias("is")),
        *(_differs(k, f"base_{c}", f"sim_{c}") for k, c in enumerate(codes_of, 1)),
    )
    package = ["zip5", "tracking_number"]
    distinct = (
        matched(base, iteration)
        .select(*package, F.inline(entries))
        .where(F.col("kind").isNotNull())
        .groupBy(*package, "kind", "was", "is")
        .agg(F.lit(1).alias("one"))
    )
    return (
        distinct.groupBy("zip5")
        .agg(
            F.count_if(F.col("kind") == 0).alias("package_count"),
            F.count_if(F.col("kind") == 1).alias("fc_switch_package_count"),
            F.count_if(F.col("kind") == 2).alias("carrier_switch_package_count"),
        )
        .withColumn(
            "fc_switch_package_per",
            numbers.ratio("fc_switch_package_count", "package_count"),
        )
    )


def transit_by_carrier_dow(base: DataFrame, ship_map: DataFrame) -> DataFrame:
    """Transit days by weekday, zip and carrier, weighted by what the FC really shipped.

    Without any package the plain mean takes the place of the weighted one.
    """
    shipped = (
        base.groupBy(
            calendar.dow_monday0("order_placed_date").alias("day_of_week"),
            "zip5",
            F.col("act_fc_name").alias("fcname"),
        )
        .agg(F.count_distinct("tracking_number").alias("packages"))
    )
    lanes = ship_map.select(
        calendar.dow_monday0("shipdate").alias("day_of_week"),
        "zip5",
        "fcname",
        F.col("mode").alias("carrier_code"),
        "adjtnt",
    )
    keys = ["day_of_week", "zip5", "carrier_code"]
    packages = numbers.zero_if_null("packages")
    return (
        lanes.join(shipped, ["day_of_week", "zip5", "fcname"], "left")
        .groupBy(*keys)
        .agg(
            numbers.total(packages * F.col("adjtnt")).alias("weighted_adjtnt"),
            F.sum(packages).alias("package_count"),
            F.avg("adjtnt").alias("adjtnt_avg"),
        )
        .withColumn(
            "weighted_adjtnt_avg",
            F.coalesce(numbers.ratio("weighted_adjtnt", "package_count"), "adjtnt_avg"),
        )
    )


def per_carrier(
    df: DataFrame,
    values: dict[str, Column],
    carriers=P.CARRIERS,
    keys: tuple[str, ...] = ("zip5",),
) -> DataFrame:
    """One row per key with ``{carrier}_{name}`` columns, both carriers always there."""
    known = F.col("carrier_code").isin(*carriers) & F.col(keys[0]).isNotNull()
    wide = (
        df.where(known)
        .groupBy(*keys)
        .pivot("carrier_code", list(carriers))
        .agg(*(v.alias(n) for n, v in values.items()))
    )
    if len(values) == 1:
        (name,) = values
        wide = wide.withColumnsRenamed({c: f"{c}_{name}" for c in carriers})
    return wide


def rates_over_days(service: DataFrame, minimum_days: int = 3) -> DataFrame:
    """Days, on-time and all packages by zip and carrier with so many days of data."""
    return (
        service.groupBy("zip5", "carrier_code")
        .agg(
            F.count_distinct("unpadded_edd").alias("days"),
            numbers.total("on_time_count").alias("on_time"),
            numbers.total("package_count").alias("act_package_count"),
        )
        .where(F.col("days") >= minimum_days)
    )


def reason_service(
    service: DataFrame,
    threshold: float,
    minimum_days: int = 3,
    challenger=P.CHALLENGER,
    incumbent=P.INCUMBENT,
) -> DataFrame:
    """Deactivate where only the challenger is below the threshold.

    Alike carriers are ok; the reverse case and a missing carrier give no
    reason.  A carrier needs ``minimum_days`` days of data.
    """
    rates = rates_over_days(service, minimum_days).withColumn(
        "unpadded_edd_dea", numbers.ratio("on_time", "act_package_count")
    )
    wide = per_carrier(
        rates,
        {
            "unpadded_edd_dea": F.max("unpadded_edd_dea"),
            "act_package_count": F.max("act_package_count"),
        },
        (incumbent, challenger),
    )
    ours = F.col(f"{challenger}_unpadded_edd_dea") >= threshold
    theirs = F.col(f"{incumbent}_unpadded_edd_dea") >= threshold
    reason = F.when(ours == theirs, "ok").when(~ours & theirs, "deactivate")
    return wide.withColumn("reason_code_dea", reason)


def latest_date_with_all(
    df: DataFrame, date_col: str, member_col: str, members
) -> DataFrame:
    """The latest date on which every member occurs, one row, null if there is none."""
    present = F.count_distinct(
        F.when(F.col(member_col).isin(*members), F.col(member_col))
    )
    return (
        df.groupBy(date_col)
        .agg(present.alias("present"))
        .where(F.col("present") == len(members))
        .agg(F.max(date_col).alias(date_col))
    )


def reason_backlog(
    backlog: DataFrame,
    threshold: float,
    base: DataFrame | None = None,
    ship_map: DataFrame | None = None,
    default_transit: float = 2,
    challenger=P.CHALLENGER,
    incumbent=P.INCUMBENT,
) -> DataFrame:
    """Compare the carriers' backlog on the latest date that has both.

    The incumbent's backlog decides first.  Of several stations of a zip the
    lowest number speaks.  With ``base`` and ``ship_map`` the transit average
    is shown as well; it does not enter the rule.
    """
    newest_day = latest_date_with_all(
        backlog, "date", "carrier_code", (incumbent, challenger)
    ).scalar()
    rows = backlog.where(F.col("date") == newest_day)
    station = F.when(F.col("days_behind").isNotNull(), F.col("dest_facility_num"))
    values = {"days_behind": F.min_by("days_behind", station)}
    if base is not None and ship_map is not None:
        rows = rows.withColumn("day_of_week", calendar.dow_monday0("date"))
        keys = ["day_of_week", "zip5", "carrier_code"]
        average = transit_by_carrier_dow(base, ship_map).select(
            *keys, "weighted_adjtnt_avg"
        )
        rows = rows.join(average, keys, "left").fillna(
            {"weighted_adjtnt_avg": default_transit}
        )
        values["weighted_adjtnt_avg"] = F.max("weighted_adjtnt_avg")
    wide = per_carrier(rows, values, (incumbent, challenger))
    ours = F.col(f"{challenger}_days_behind") >= threshold
    theirs = F.col(f"{incumbent}_days_behind") >= threshold
    reason = (
        F.when(theirs, "activate").when(ours, "deactivate").when(~ours & ~theirs, "ok")
    )
    return wide.withColumn("reason_code_backlog", reason)


def starting_tomorrow(shutdowns: DataFrame, run_date) -> DataFrame:
    """Shutdowns that start the day after the run."""
    run = F.lit(calendar.as_date(run_date))
    return shutdowns.where(F.col("start_date") == F.date_add(run, 1))


def zips_by_carrier(zips: DataFrame, carriers=P.CARRIERS) -> DataFrame:
    """Every distinct zip with each of the carriers."""
    return distinct_zips(zips).select(
        "zip5", F.explode(F.array(*map(F.lit, carriers))).alias("carrier_code")
    )


def shutdown_clear_dates(
    run_date,
    shutdowns: DataFrame,
    base: DataFrame,
    ship_map: DataFrame,
    default_transit: float = 2,
    carriers=P.CARRIERS,
) -> DataFrame:
    """When each carrier is clear again in zips with a shutdown starting tomorrow."""
    run = F.lit(calendar.as_date(run_date))
    starting = starting_tomorrow(shutdowns, run_date)
    both = zips_by_carrier(starting, carriers)
    ends = (
        F.when(F.col("end_date").isNotNull(), F.col("end_date"))
        .when(F.col("start_date").isNull(), run)
        .otherwise(F.lit(P.OPEN_END).cast("date"))
    )
    keys = ["day_of_week", "zip5", "carrier_code"]
    average = transit_by_carrier_dow(base, ship_map).select(
        *keys, "weighted_adjtnt_avg"
    )
    transit = F.coalesce("weighted_adjtnt_avg", F.lit(float(default_transit)))
    return (
        both.join(
            starting.select("zip5", "carrier_code", "start_date", "end_date"),
            ["zip5", "carrier_code"],
            "left",
        )
        .withColumn("end_date", ends)
        .withColumn("day_of_week", calendar.dow_monday0(run))
        .join(average, keys, "left")
        .withColumn("transit", transit)
        .withColumn(
            "clear",
            F.greatest(F.col("end_date").cast("timestamp"), calendar.add_days(run, "transit")),
        )
        .select("zip5", "carrier_code", "end_date", "clear")
    )


def reason_shutdown(
    run_date,
    shutdowns: DataFrame,
    base: DataFrame,
    ship_map: DataFrame,
    threshold_days: float = 1,
    default_transit: float = 2,
    challenger=P.CHALLENGER,
    incumbent=P.INCUMBENT,
) -> DataFrame:
    """Prefer the carrier that is clear earlier by the threshold or more."""
    cleared = shutdown_clear_dates(
        run_date, shutdowns, base, ship_map, default_transit, (incumbent, challenger)
    )
    wide = per_carrier(
        cleared,
        {"end_date": F.min("end_date"), "clear": F.min("clear")},
        (incumbent, challenger),
    )
    ours, theirs = F.col(f"{challenger}_clear"), F.col(f"{incumbent}_clear")
    later = calendar.fractional_days(ours, theirs)
    reason = (
        F.when(-later >= threshold_days, "activate")
        .when(later >= threshold_days, "deactivate")
        .otherwise("ok")
    )
    return wide.withColumn("reason_code_shutdown", reason)


def full_runs(history: DataFrame, run_date, days: int = 60) -> DataFrame:
    """Full runs of the history window, the run day itself excluded."""
    first, _ = calendar.lookback_window(run_date, days, end_offset=0)
    day = F.col("run_dttm").cast("date")
    return history.where(
        (day >= F.lit(first))
        & (day < F.lit(calendar.as_date(run_date)))
        & (F.col("zip_count_tag") == "all")
    )


def last_recommendation(
    remediation_history: DataFrame,
    expansion_history: DataFrame,
    run_date,
    run_name: str = "default",
    days: int = 60,
) -> DataFrame:
    """Newest decision per zip in the history window, the run day itself excluded.

    Each history gives its newest full-run row per zip; only then the run name
    filters.  Where both histories have the zip at the same moment, the
    expansion history wins.
    """
    reasons = ("dea", "shutdown", "backlog")
    payload = ["final_recommendation", "run_name", *(f"final_reason_{r}" for r in reasons)]

    def newest_of(history: DataFrame, source: int) -> DataFrame:
        return (
            full_runs(history, run_date, days)
            .transform(newest(["zip5"], "run_dttm", "run_name", "run_dttm", *payload))
            .where(F.col("run_name") == run_name)
            .withColumn("source", F.lit(source))
        )

    both = newest_of(remediation_history, 0).unionByName(newest_of(expansion_history, 1))
    return both.transform(
        newest(["zip5"], "run_dttm", "source", "run_dttm", *payload)
    ).select(
        "zip5",
        F.col("final_recommendation").alias("last_recommendation"),
        F.date_format("run_dttm", "yyyy-MM-dd").alias("recommendation_date"),
        *(F.col(f"final_reason_{r}").alias(f"last_reason_{r}") for r in reasons),
    )


def latest_rows(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Rows at the greatest stamp of their key, ties kept.

    The greatest stamp comes from partial aggregates, so a key of any size is
    never gathered in one window.
    """
    newest = df.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    return df.join(newest, [*keys, stamp], "left_semi")
