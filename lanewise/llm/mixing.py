"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.stages import WORD, staged

#: Raking ends when a sweep moves no margin value by more than this share of it.
TOLERANCE = 1e-5
#: Sweeps after which raking ends where targets contradict each other.
SWEEPS = 30
#: Exponent of the token share in a tempered target: 1 keeps the shares, 0
#: makes them equal.
TEMPER = 0.7
MARGINS = ("source", "lang", "topic")
NONE = "(none)"


def tokens(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def form(text: Column) -> Column:
    """Topic of a text where no column names one: the form it is written in."""
    size = F.greatest(F.length(text), F.lit(1))

    def share(marks: str) -> Column:
        bare = F.translate(text, marks, "")
        return (F.length(text) - F.length(bare)) * 100 / size

    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(share("|") >= 3, "table")
        .when(share("#*$%&<>{}=") >= 3, "markup")
        .when(F.length(text) < 1000, "note")
        .otherwise("prose")
    )


def goals_of(
    cells: DataFrame, margin: str, given: DataFrame | None = None, temper: float = TEMPER
) -> DataFrame:
    """Target shares ``value, share`` of the values of a margin that have tokens.

    ``given`` has ``value, share``, a null value being ``(none)`` and repeated
    values adding up.  What it leaves of one goes to the values it does not
    name, by their tokens to the power ``temper``.  The shares of values without
    tokens fall to all others, in proportion.
    """
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"))
    sums = sums.where("tokens > 0")
    open_to = F.pow(F.col("tokens").cast("double"), F.lit(temper))
    if given is None:
        parts = sums.select("value", open_to.alias("part"), F.lit(True).alias("open"))
        rest = F.lit(1.0)
    else:
        value = F.coalesce(F.col("value").cast("string"), F.lit(NONE)).alias("value")
        share = F.greatest(F.col("share").cast("double"), F.lit(0.0))
        given = staged(given.groupBy(value).agg(F.sum(share).alias("share")), "given")
        left = F.round(1 - F.coalesce(F.sum("share"), F.lit(0.0)), 9)
        rest = given.agg(F.greatest(left, F.lit(0.0))).scalar()
        parts = sums.join(given, "value", "left").select(
            "value",
            F.coalesce("share", open_to).alias("part"),
            F.col("share").isNull().alias("open"),
        )
    parts = staged(parts, "parts")
    unnamed = parts.where("open").agg(F.sum("part")).scalar()
    shares = parts.select(
        "value",
        F.when(F.col("open"), rest * F.col("part") / unnamed).otherwise(F.col("part")).alias("share"),
    )
    total = shares.agg(F.sum("share")).scalar()
    shares = shares.select(
        "value", F.coalesce(F.try_divide("share", total), F.lit(0.0)).alias("share")
    )
    return staged(shares, "goal")


def raked(
    cells: DataFrame,
    goals: dict[str, DataFrame],
    sweeps: int = SWEEPS,
    tolerance: float = TOLERANCE,
    budget: float | None = None,
) -> DataFrame:
    """Cells with a ``weight`` whose sums by margin approach the goals.

    ``cells`` has one row per combination with its ``tokens``; ``goals`` has
    ``value, share`` for each margin.  A sweep scales the weights to one margin
    after the other; the last is the first that scales no value by more than
    ``tolerance``, or number ``sweeps``.  With a ``budget``, the share of all
    tokens that a sample shall have, no weight grows beyond the ``room`` of its
    cell, the weight at which all its tokens are drawn; the next sweeps spread
    what is cut off over the other cells of a value.  Values without a goal, or
    with none of the tokens, get no weight.
    """
    total = cells.agg(F.sum("tokens")).scalar()
    share = F.coalesce(F.try_divide("tokens", total), F.lit(0.0))
    room = F.lit(None).cast("double") if budget is None else share / budget
    weighted = cells.withColumn("weight", share).withColumn("room", room)
    for margin, goal in goals.items():
        goal = goal.select(F.col("value").alias(margin), F.col("share").alias(f"_goal_{margin}"))
        weighted = weighted.join(goal, margin, "left")
    weighted = staged(weighted, "unraked")
    for _ in range(sweeps):
        weighted = weighted.withColumn("_off", F.lit(0.0))
        for margin in goals:
            now = weighted.groupBy(margin).agg(F.sum("weight").alias("_now"))
            goal = F.coalesce(f"_goal_{margin}", F.lit(0.0))
            scale = F.coalesce(F.try_divide(goal, F.col("_now")), F.lit(0.0))
            grown = F.col("weight") * F.col("_scale")
            free = (F.col("weight") > 0) & (F.col("room").isNull() | (grown < F.col("room")))
            weighted = (
                weighted.join(now, margin)
                .withColumn("_scale", scale)
                .withColumn("_off", F.greatest("_off", F.when(free, F.abs(F.col("_scale") - 1))))
                .withColumn("weight", F.least(grown, "room"))
                .drop("_scale", "_now")
            )
        weighted = staged(weighted, "raked")
        off = weighted.agg(F.max("_off")).first()[0]
        weighted = weighted.drop("_off")
        if off is None or off <= tolerance:
            break
    return weighted.drop(*(f"_goal_{margin}" for margin in goals))


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id, or from the text of a row without id."""
    name = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(2**32)


@dataclass(frozen=True)
class Mixture:
    """What documents are drawn by.

    ``cells`` has ``source, lang, topic, tokens, weight, probability``; ``goals``
    has ``value, share`` for each margin.
    """

    cells: DataFrame
    goals: dict[str, DataFrame]

    def margins(self) -> DataFrame:
        """``margin, value, tokens, goal, reached, off``: how far the weights got.

        ``reached`` is the expected share of a value in the sample.
        """
        drawn = self.cells.withColumn("drawn", F.col("tokens") * F.col("probability"))
        total = drawn.agg(F.sum("drawn")).scalar()
        found = None
        for margin, goal in self.goals.items():
            sums = drawn.groupBy(F.col(margin).alias("value")).agg(
                F.sum("tokens").alias("tokens"), F.sum("drawn").alias("drawn")
            )
            part = sums.join(goal, "value", "left").select(
                F.lit(margin).alias("margin"),
                "value",
                "tokens",
                F.coalesce("share", F.lit(0.0)).alias("goal"),
                F.coalesce(F.try_divide("drawn", total), F.lit(0.0)).alias("reached"),
            )
            found = part if found is None else found.unionByName(part)
        return found.withColumn("off", F.col("reached") - F.col("goal"))


def measured(
    docs: DataFrame,
    topic: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    seed: int = 1,
) -> DataFrame:
    """Add a struct column ``__at``: the cell of a document, its tokens and its draw."""
    body = F.col(text)
    named = (F.col(source), F.col(lang), form(body) if topic is None else topic)
    place = [
        F.coalesce(c.cast("string"), F.lit(NONE)).alias(n)
        for n, c in zip(MARGINS, named, strict=True)
    ]
    size = tokens(body).alias("tokens")
    draw = chance(F.col(doc_id), body, seed).alias("draw")
    return docs.withColumn("__at", F.struct(*place, size, draw))


def fit(
    here: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float | None = None,
    sweeps: int = SWEEPS,
    tolerance: float = TOLERANCE,
    temper: float = TEMPER,
) -> Mixture:
    """Rake the cells of measured documents and calibrate their probabilities.

    With a budget a cell's probability is its weight over its room.  Without one,
    probabilities are as large as the weights allow with none above one.
    """
    cells = here.groupBy(*(F.col(f"__at.{n}").alias(n) for n in MARGINS))
    cells = staged(cells.agg(F.sum("__at.tokens").alias("tokens")), "cells")
    targets = targets or {}
    goals = {n: goals_of(cells, n, targets.get(n), temper) for n in MARGINS}
    weighted = raked(cells, goals, sweeps, tolerance, budget)
    if budget is None:
        weighted = weighted.withColumn("room", F.try_divide("tokens", F.lit(1.0)))
        most = weighted.agg(F.max(F.try_divide("weight", "room"))).scalar()
        part = F.try_divide(F.try_divide("weight", "room"), most)
    else:
        part = F.least(F.try_divide("weight", "room"), F.lit(1.0))
    probability = F.coalesce(part, F.lit(0.0)).alias("probability")
    # One row per cell, written first: its size is known when Spark decides
    # whether to send it to every task or to shuffle and split hot cells.
    return Mixture(staged(weighted.select(*MARGINS, "tokens", "weight", probability), "mixture"), goals)


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    sweeps: int = SWEEPS,
    temper: float = TEMPER,
    seed: int = 1,
    into: str = "mix",
    budget: float | None = None,
    tolerance: float = TOLERANCE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct column: ``topic, tokens, probability, sampled``.

    Token weights are raked to the marginals of source, language and topic.
    Every document of a cell has the same probability, so the expected tokens of
    a sample have the raked marginals and no document is drawn twice.  A draw
    depends on the id and the seed alone.  ``budget`` is the share of all tokens
    that a sample shall have; cells too small for their weight are drawn whole
    and others of the same values stand in for them.  Without one, the sample is
    the largest that needs no probability above one, so one small cell of great
    weight may make it small.  ``targets`` maps ``source``, ``lang`` and
    ``topic`` to ``value, share``; values it does not name share the rest by
    their tempered tokens.  ``topic`` defaults to the form of the text.  ``fit``
    gives the raked cells, and how far they are from the targets.

    ``keep`` names the columns to keep; these and the measures are written once,
    so that texts which are not kept are read once.

    Nulls: a null source, language or topic is a value of its own, ``(none)``; a
    null text is empty.  Documents without tokens belong to their cell like any
    other; a cell without tokens or target has probability zero.  Rows with the
    same id are drawn together, rows without id by their text.  An empty table
    gives an empty table.  Other columns pass through; only a column named as
    ``into`` is replaced.
    """
    here = measured(docs, topic, doc_id, text, source, lang, seed)
    if keep is not None:
        here = staged(here.select(*(F.col(f"`{c}`") for c in keep), "__at"), "measured")
    mixture = fit(here, targets, budget, sweeps, tolerance, temper)
    chances = mixture.cells.select(
        F.struct(*MARGINS).alias("__cell"), F.col("probability").alias("__probability")
    )
    found = here.withColumn("__cell", F.struct(*(F.col(f"__at.{n}").alias(n) for n in MARGINS)))
    return found.join(chances, "__cell").withColumn(
        into,
        F.struct(
            F.col("__at.topic").alias("topic"),
            F.col("__at.tokens").alias("tokens"),
            F.col("__probability").alias("probability"),
            (F.col("__at.draw") < F.col("__probability")).alias("sampled"),
        ),
    ).drop("__at", "__cell", "__probability")
