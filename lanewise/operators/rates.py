"""What a lane would have cost a package, from interval- and band-keyed rate cards."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import params as P
from lanewise.functions import calendar, numbers, package
from lanewise.operators.skew import within_rows

UNAUTHORIZED, OVERSIZE, ADDITIONAL = (
    "unauthorized_oversize",
    "oversize",
    "additional_handling",
)

# Kinds of charge that count for each measure.
COUNTED = {
    "long": (UNAUTHORIZED, OVERSIZE, ADDITIONAL),
    "girth": (UNAUTHORIZED, OVERSIZE, ADDITIONAL),
    "second": (ADDITIONAL,),
    "heavy": (UNAUTHORIZED, ADDITIONAL),
}


CARDS = (
    "base_rates",
    "resi",
    "das",
    "weight_bands",
    "longest_bands",
    "second_bands",
    "girth_bands",
    "peak",
    "fuel",
)


@dataclass(frozen=True)
class RateCards:
    """The nine rate cards, each as a frame.

    ``small`` names the cards known to fit a broadcast.  It changes nothing but
    the hint: without it Spark decides by its own statistics.
    """

    base_rates: DataFrame
    resi: DataFrame
    das: DataFrame
    weight_bands: DataFrame
    longest_bands: DataFrame
    second_bands: DataFrame
    girth_bands: DataFrame
    peak: DataFrame
    fuel: DataFrame
    small: frozenset = frozenset()

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in CARDS}

    def checked(self) -> "RateCards":
        """The cards with their sizes checked by one bounded count.

        To be run once, when the cards are loaded; operators start no job.
        """
        fits = within_rows(self.frames())
        return replace(self, small=frozenset(n for n, fit in fits.items() if fit))

    def hinted(self, df: DataFrame, *names: str) -> DataFrame:
        """``df``, made from the named cards, with the hint if all are small."""
        return F.broadcast(df) if self.small.issuperset(names) else df

    def side(self, name: str) -> DataFrame:
        return self.hinted(getattr(self, name), name)


def package_dims(df: DataFrame) -> DataFrame:
    """Add sides, girth, volume weight, bill weight and the charged weight."""
    return (
        df.withColumns(
            {
                "longest_side": package.longest_side(),
                "second_side": package.second_side(),
                "third_side": package.third_side(),
                "dim_weight": package.dim_weight(),
                "bill_weight": package.bill_weight(),
            }
        )
        .withColumn("length_plus_girth", package.length_plus_girth())
        .withColumn("charged_weight", package.charged_weight())
    )


def _card(df: DataFrame, tag: str, **columns: str) -> DataFrame:
    """Card columns renamed by name to ``{tag}_{role}``."""
    return df.select(*(F.col(c).alias(f"{tag}_{role}") for role, c in columns.items()))


def _in_force(tag: str) -> Column:
    return F.col("ship_date").between(F.col(f"{tag}_start"), F.col(f"{tag}_end"))


def join_base_rate(lanes: DataFrame, card: DataFrame) -> DataFrame:
    rates = _card(
        card,
        "base",
        carrier="carrier_code",
        zone="zone",
        weight="bill_weight",
        rate="base_charge",
        start="start_date",
        end="end_date",
    )
    on = (
        (F.col("mode") == F.col("base_carrier"))
        & (F.col("cost_zone") == F.col("base_zone"))
        & (F.col("charged_weight") == F.col("base_weight"))
        & _in_force("base")
    )
    return lanes.join(rates, on, "left").drop(
        "base_carrier", "base_zone", "base_weight", "base_start", "base_end"
    )


def join_flat(
    lanes: DataFrame, card: DataFrame, tag: str, amount: str, start: str, end: str
) -> DataFrame:
    """Attach a per-carrier amount valid in a date interval as ``{tag}_amount``."""
    side = _card(
        card, tag, carrier="carrier_code", amount=amount, start=start, end=end
    )
    on = (F.col("mode") == F.col(f"{tag}_carrier")) & _in_force(tag)
    return lanes.join(side, on, "left").drop(
        f"{tag}_carrier", f"{tag}_start", f"{tag}_end"
    )


def join_resi(lanes: DataFrame, card: DataFrame) -> DataFrame:
    return join_flat(lanes, card, "resi", "resi_amount", "start_date", "end_date")


def join_fuel(lanes: DataFrame, card: DataFrame) -> DataFrame:
    return join_flat(lanes, card, "fuel", "fsc_per", "start_dt", "end_dt")


# Measure and card of each band, with the prefix of its bounds.
BANDS = {
    "heavy": ("weight", "weight_bands", "weight"),
    "long": ("longest_side", "longest_bands", "longest_side"),
    "second": ("second_side", "second_bands", "second_longest_side"),
    "girth": ("length_plus_girth", "girth_bands", "length_plus_girth"),
}


def _band_entries(cards: "RateCards", tag: str) -> DataFrame:
    _, card, bounds = BANDS[tag]
    return cards.frames()[card].select(
        F.col("carrier_code").alias("book_carrier"),
        F.col("zone").alias("book_zone"),
        F.col(f"{bounds}_lower").cast("double").alias("lower"),
        F.col(f"{bounds}_upper").cast("double").alias("upper"),
        "amount",
        F.col("charge_type").alias("type"),
        F.col("charge_type").isin(*COUNTED[tag]).alias("counts"),
        F.col("start_date").cast("date").alias("start"),
        F.col("end_date").cast("date").alias("end"),
    )


BAND_DAY = "band_day"
SIZE_CLASS = [BAND_DAY, *(f"{tag}_bin" for tag in BANDS)]


@dataclass(frozen=True)
class Edges:
    """Where bands begin and end: the bounds of each measure, and the days.

    As JSON texts, which become constants of a plan.
    """

    bounds: dict[str, str]
    days: str

    def of(self, tag: str) -> Column:
        return F.from_json(F.lit(self.bounds[tag]), "array<double>")

    def on_days(self) -> Column:
        return F.from_json(F.lit(self.days), "array<date>")


def band_edges(cards: "RateCards") -> Edges:
    """The edges of the band cards, by one job over the cards.

    The driver gets each distinct bound and day once: at most two of each for a
    row of the four cards.
    """
    found = []
    for tag in BANDS:
        entries = _band_entries(cards, tag)
        edges = F.array("lower", "upper").cast("array<string>")
        days = F.array("start", F.date_add("end", 1)).cast("array<string>")
        found += [
            entries.select(F.lit(tag).alias("tag"), F.explode(edges).alias("edge")),
            entries.select(F.lit("days").alias("tag"), F.explode(days).alias("edge")),
        ]
    rows = reduce(DataFrame.unionAll, found).where("edge is not null").distinct().collect()
    by_tag = {tag: sorted({float(r["edge"]) for r in rows if r["tag"] == tag}) for tag in BANDS}
    days = sorted(r["edge"] for r in rows if r["tag"] == "days")
    return Edges({tag: json.dumps(found) for tag, found in by_tag.items()}, json.dumps(sorted(set(days))))


def _place(edges: Column, value: Column) -> Column:
    """How many edges lie below a value; -1 for an unknown one.

    The value is sorted in among the edges and its place looked up, all in
    generated code.
    """
    place = F.array_position(F.sort_array(F.array_append(edges, value)), value)
    return F.coalesce(place.cast("int") - 1, F.lit(-1))


def sized(packages: DataFrame, edges: Edges) -> DataFrame:
    """Replace the four measures by the elementary intervals that hold them.

    The bounds of a band card cut its measure into intervals inside which every
    band applies or none does; the days on which an entry of the cards begins or
    ends cut time likewise.  Placed once for a package, they make every band
    lookup of its lanes an equality.
    """
    places = {BAND_DAY: _place(edges.on_days(), F.date_add("ship_date", 1))}
    for tag, (measure, _, _) in BANDS.items():
        places[f"{tag}_bin"] = _place(edges.of(tag), F.col(measure).cast("double"))
    return packages.withColumns(places).drop(*(measure for measure, _, _ in BANDS.values()))


def _binned_entries(cards: "RateCards", edges: Edges, tag: str) -> DataFrame:
    """Each band once for every elementary interval and span of days it covers."""

    def covered(places: Column, first: Column, after: Column) -> Column:
        ends = F.array_position(places, first), F.array_position(places, after) - 1
        return F.explode(F.sequence(*(p.cast("int") for p in ends)))

    return (
        _band_entries(cards, tag)
        .where("lower < upper and start <= end")
        .withColumn(f"{tag}_bin", covered(edges.of(tag), F.col("lower"), F.col("upper")))
        .withColumn(
            BAND_DAY, covered(edges.on_days(), F.col("start"), F.date_add("end", 1))
        )
        .select(
            F.col("book_carrier").alias("mode"),
            F.col("book_zone").alias("cost_zone"),
            f"{tag}_bin",
            BAND_DAY,
            *(F.col(part).alias(f"{tag}_{part}") for part in ("amount", "type", "counts")),
        )
    )


def handling_card(packages: DataFrame, cards: "RateCards", edges: Edges) -> DataFrame:
    """Handling class and amount by carrier, zone and size class.

    Only the size classes that occur among the sized ``packages`` are priced:
    at most one for each combination of elementary intervals, and for each
    carrier and zone with a band on its days.  Where bands of a card overlap
    there is a row for each; a lane that no band meets has none.
    """
    entries = {tag: _binned_entries(cards, edges, tag) for tag in BANDS}
    keys = ["mode", "cost_zone", BAND_DAY]
    in_force = reduce(DataFrame.unionAll, (df.select(*keys) for df in entries.values()))
    card = packages.select(*SIZE_CLASS).distinct()
    cards_used = [name for _, name, _ in BANDS.values()]
    card = card.join(cards.hinted(in_force.distinct(), *cards_used), BAND_DAY)
    for tag, df in entries.items():
        side = cards.hinted(df, BANDS[tag][1])
        card = card.join(side, [*keys, f"{tag}_bin"], "left")
    met = reduce(Column.__or__, (F.col(f"{tag}_type").isNotNull() for tag in BANDS))
    return (
        card.where(met)
        .select(
            "mode",
            "cost_zone",
            *SIZE_CLASS,
            handling_class().alias("handling_class"),
            handling_charge().alias("handling_amount"),
        )
        .distinct()
    )


def join_handling(lanes: DataFrame, card: DataFrame) -> DataFrame:
    """Attach class and amount of handling to lanes of sized packages."""
    on = ["mode", "cost_zone", *SIZE_CLASS]
    # Names of their own: a lane column must not be taken for one of the card.
    side = card.withColumnsRenamed({c: f"card_{c}" for c in on})
    same = reduce(Column.__and__, (F.col(c) == F.col(f"card_{c}") for c in on))
    return (
        lanes.join(side, same, "left")
        .drop(*(f"card_{c}" for c in on), *SIZE_CLASS)
        .withColumn("handling_amount", numbers.zero_if_null("handling_amount"))
    )


def flat_amounts(cards: "RateCards") -> DataFrame:
    """Residential, peak and fuel amounts of a carrier in one card.

    Days on which none of the three changes form one interval, so a lane needs
    one lookup instead of three.  Overlapping entries still give one row each.
    """

    def entries(card, carrier, amount, start, end=None) -> DataFrame:
        first = F.col(start).cast("date")
        return card.select(
            F.col(carrier).alias("carrier"),
            F.col(amount).alias("amount"),
            first.alias("first"),
            (F.col(end).cast("date") if end else F.date_add(first, 6)).alias("last"),
        )

    week = "peak_surcharge_application_week"
    parts = {
        "resi": entries(
            cards.resi, "carrier_code", "resi_amount", "start_date", "end_date"
        ),
        "peak": entries(
            cards.peak.where(F.weekday(week) == 0), "shipmode", "peak_surcharge", week
        ),
        "fuel": entries(cards.fuel, "carrier_code", "fsc_per", "start_dt", "end_dt"),
    }
    edges = reduce(
        DataFrame.unionAll,
        (
            df.select("carrier", F.explode(F.array("first", F.date_add("last", 1))))
            for df in parts.values()
        ),
    ).toDF("flat_carrier", "flat_start")
    following = Window.partitionBy("flat_carrier").orderBy("flat_start")
    merged = (
        edges.distinct()
        .withColumn("flat_end", F.date_sub(F.lead("flat_start").over(following), 1))
        .where(F.col("flat_end").isNotNull())
    )
    for name, df in parts.items():
        side = df.toDF("carrier", f"{name}_amount", "first", "last")
        inside = (F.col("flat_carrier") == F.col("carrier")) & F.col(
            "flat_start"
        ).between(F.col("first"), F.col("last"))
        merged = merged.join(cards.hinted(side, name), inside, "left").drop(
            "carrier", "first", "last"
        )
    return merged


def join_flat_amounts(lanes: DataFrame, flat: DataFrame) -> DataFrame:
    on = (F.col("mode") == F.col("flat_carrier")) & _in_force("flat")
    return lanes.join(flat, on, "left").drop("flat_carrier", "flat_start", "flat_end")


def join_das(lanes: DataFrame, card: DataFrame) -> DataFrame:
    side = _card(
        card,
        "das",
        carrier="carrier_code",
        zip="zipcode",
        amount="amount",
        start="start_date",
        end="end_date",
    )
    on = (
        (F.col("mode") == F.col("das_carrier"))
        & (F.col("zip5") == F.col("das_zip"))
        & _in_force("das")
    )
    return lanes.join(side, on, "left").drop(
        "das_carrier", "das_zip", "das_start", "das_end"
    )


def join_band(
    lanes: DataFrame, card: DataFrame, tag: str, measure: str, lower: str, upper: str
) -> DataFrame:
    """Attach the charge of the half-open band ``lower < measure <= upper``."""
    side = _card(
        card,
        tag,
        carrier="carrier_code",
        zone="zone",
        lower=lower,
        upper=upper,
        amount="amount",
        type="charge_type",
        start="start_date",
        end="end_date",
    ).withColumn(f"{tag}_counts", F.col(f"{tag}_type").isin(*COUNTED[tag]))
    on = (
        (F.col("mode") == F.col(f"{tag}_carrier"))
        & (F.col("cost_zone") == F.col(f"{tag}_zone"))
        & _in_force(tag)
        & (F.col(measure) > F.col(f"{tag}_lower"))
        & (F.col(measure) <= F.col(f"{tag}_upper"))
    )
    return lanes.join(side, on, "left").drop(
        *(f"{tag}_{role}" for role in ("carrier", "zone", "lower", "upper")),
        f"{tag}_start",
        f"{tag}_end",
    )


def join_weight_band(lanes: DataFrame, card: DataFrame) -> DataFrame:
    return join_band(lanes, card, "heavy", "weight", "weight_lower", "weight_upper")


def join_longest_band(lanes: DataFrame, card: DataFrame) -> DataFrame:
    return join_band(
        lanes, card, "long", "longest_side", "longest_side_lower", "longest_side_upper"
    )


def join_second_band(lanes: DataFrame, card: DataFrame) -> DataFrame:
    return join_band(
        lanes,
        card,
        "second",
        "second_side",
        "second_longest_side_lower",
        "second_longest_side_upper",
    )


def join_girth_band(lanes: DataFrame, card: DataFrame) -> DataFrame:
    return join_band(
        lanes,
        card,
        "girth",
        "length_plus_girth",
        "length_plus_girth_lower",
        "length_plus_girth_upper",
    )


def join_peak(lanes: DataFrame, card: DataFrame) -> DataFrame:
    side = _card(
        card,
        "peak",
        carrier="shipmode",
        week="peak_surcharge_application_week",
        amount="peak_surcharge",
    )
    on = (F.col("mode") == F.col("peak_carrier")) & (
        calendar.week_monday("ship_date") == F.col("peak_week").cast("date")
    )
    return lanes.join(side, on, "left").drop("peak_carrier", "peak_week")


def _any_type(kind: str, *tags: str) -> Column:
    """Whether one of the bands is of a kind; unknown bands do not count."""
    hits = (F.coalesce(F.col(f"{t}_type") == kind, F.lit(False)) for t in tags)
    return reduce(Column.__or__, hits)


def handling_class() -> Column:
    """Name of the handling class: unauthorized before oversize before additional.

    The second side counts for additional handling only, the weight for
    unauthorized and additional.
    """
    chain = F
    for kind in (UNAUTHORIZED, OVERSIZE, ADDITIONAL):
        tags = [tag for tag, kinds in COUNTED.items() if kind in kinds]
        chain = chain.when(_any_type(kind, *tags), kind)
    return chain


def handling_charge() -> Column:
    """Greatest of the four band amounts, charged once if any band counts."""
    greatest = F.greatest(*(numbers.zero_if_null(f"{t}_amount") for t in COUNTED))
    counts = (F.coalesce(F.col(f"{t}_counts"), F.lit(False)) for t in COUNTED)
    return F.when(reduce(Column.__or__, counts), greatest).otherwise(0.0)


def total_amount() -> Column:
    """All parts plus fuel on top; unknown without a base rate or a fuel rate."""
    parts = (
        F.col("base_rate")
        + numbers.zero_if_null("resi_amount")
        + numbers.zero_if_null("das_amount")
        + F.lit(P.ADDRESS_CORRECTION)
        + F.col("handling_amount")
        + numbers.zero_if_null("peak_amount")
    )
    return parts * (1 + F.col("fuel_amount"))


def priced(
    lanes: DataFrame, cards: RateCards, handling: DataFrame, flat: DataFrame
) -> DataFrame:
    """Attach every charge to lanes of sized packages.

    Four lookups: base rate, delivery area, handling, and the three flat amounts
    in one.  ``handling`` is the card of :func:`handling_card`, ``flat`` that of
    :func:`flat_amounts`.
    """
    return (
        lanes.transform(join_base_rate, cards.side("base_rates"))
        .transform(join_das, cards.side("das"))
        .transform(join_handling, handling)
        .transform(join_flat_amounts, flat)
        .withColumn("total_amount", total_amount())
    )


def with_charges(lanes: DataFrame, cards: RateCards) -> DataFrame:
    """Attach every charge to lanes that carry the package dimensions.

    The size classes are those of the lanes themselves, which are read twice;
    :func:`lanewise.operators.lanes.lane_stage` takes them from packages.
    """
    edges = band_edges(cards)
    lanes = sized(lanes, edges)
    flat = cards.hinted(flat_amounts(cards), "resi", "peak", "fuel")
    return priced(lanes, cards, handling_card(lanes, cards, edges), flat)
