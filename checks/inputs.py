"""Input tables of the operators, derived by Spark from the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.recipes import RECIPES
from lanewise.sources.shared import saved_once, table_path

GIVEN = ("lineitem", "orders", "events")

# Inputs that are a projection of one written table, row by row.  A query reads them
# once, so they are worked out where they are read and not written first.
READ_THROUGH = ("order_lines", "inventory")

# Columns the recipes produce as decimals; both engines read them as doubles.
DOUBLES = {
    "shipments": ("length", "width", "height", "weight"),
    "base_rates": ("base_charge",),
    "fuel": ("fsc_per",),
    "longest_bands": ("longest_side_lower", "longest_side_upper", "amount"),
    "fc_zip_distance": ("dist_miles",),
    "wms_proxy": ("fdxhd_proxy", "ontrgd_proxy"),
    "shipments_again": ("length", "width", "height", "weight"),
    "longest_bands_two": ("longest_side_lower", "longest_side_upper", "amount"),
    "resi": ("resi_amount",),
    "resi_two": ("resi_amount",),
    "das": ("amount",),
    "weight_bands": ("weight_lower", "weight_upper", "amount"),
    "second_bands": (
        "second_longest_side_lower",
        "second_longest_side_upper",
        "amount",
    ),
    "girth_bands": ("length_plus_girth_lower", "length_plus_girth_upper", "amount"),
    "peak": ("peak_surcharge",),
}


def used(text: str, names) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [n for n in names if n in words]


def closure(text: str) -> list[str]:
    """Names of all recipes a statement needs, in dependency order."""
    needed = set()
    pending = used(text, RECIPES)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending += used(RECIPES[name], RECIPES)
    return [n for n in RECIPES if n in needed]


def key_of(sf_dir: str, name: str) -> str:
    return re.sub(r"\W+", "_", sf_dir.strip("/")) + "/" + name


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, written to the shared folder on first use unless read through."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in READ_THROUGH:
        return _derive(spark, sf_dir, name)
    return saved_once(
        spark, key_of(sf_dir, name), lambda: _derive(spark, sf_dir, name)
    )


def _derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = RECIPES[name]
    parents = used(text, RECIPES)
    for p in parents:
        table(spark, sf_dir, p)
    parts = [
        f"{p} as (select * from parquet.`{table_path(spark, key_of(sf_dir, p))}`)"
        for p in parents
    ]
    parts += [
        f"{g} as (select * from parquet.`{sf_dir}/{g}.parquet`)"
        for g in used(text, GIVEN)
    ]
    frame = spark.sql((f"with {', '.join(parts)} " if parts else "") + text)
    return frame.select(
        *(
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in frame.schema
        )
    )


class Inputs:
    """Input tables by name: ``Inputs(spark, sf_dir).shipments``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RECIPES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def prelude(text: str, extra: dict[str, str] | None = None) -> str:
    """``text`` with the recipes and the extra named statements it uses put in front."""
    extra = extra or {}
    wanted, pending = set(), used(text, extra)
    while pending:
        name = pending.pop()
        if name not in wanted:
            wanted.add(name)
            pending += used(extra[name], extra)
    steps = [n for n in extra if n in wanted]
    reach = " ".join([text, *(extra[n] for n in steps)])
    parts = []
    for name in closure(reach):
        body = RECIPES[name].strip()
        if name in DOUBLES:
            casts = ", ".join(f"cast({c} as double) as {c}" for c in DOUBLES[name])
            body = f"select * replace ({casts}) from ({body})"
        parts.append(f"{name} as materialized ({body})")
    parts += [f"{n} as ({extra[n].strip()})" for n in steps]
    return (f"with {', '.join(parts)} " if parts else "") + text
