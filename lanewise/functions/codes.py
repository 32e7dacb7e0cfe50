"""Columns over zip, station, carrier and FC codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import params as P


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zip_pad(c: str | Column) -> Column:
    """Zip code as five characters with leading zeros; longer text is cut."""
    return F.lpad(col(c).cast("string"), 5, "0")


def zip_from_number(c: str | Column) -> Column:
    """Five-character zip code from a number or from text such as ``7066.0``."""
    return zip_pad(col(c).cast("double").cast("int"))


def zip3(c: str | Column) -> Column:
    return F.substring(col(c), 1, 3)


def station_from_term(c: str | Column) -> Column:
    """Station number in the last three characters of a terminal code."""
    return F.right(col(c).cast("string"), F.lit(3)).cast("int")


def trimmed(c: str | Column) -> Column:
    return F.trim(col(c))


def joined_key(*parts: str | Column, sep: str = "-") -> Column:
    """Parts joined by ``sep``; null as soon as one part is null."""
    pieces = [col(p).cast("string") for p in parts]
    between = chain.from_iterable((F.lit(sep), p) for p in pieces[1:])
    return F.concat(pieces[0], *between)


def lookup(c: str | Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, ``default`` for everything else."""
    pairs = list(chain.from_iterable(table.items()))
    hit = F.element_at(F.create_map(*(F.lit(v) for v in pairs)), col(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def carrier_from_name(c: str | Column, names: dict = P.CARRIER_NAMES) -> Column:
    return lookup(c, names)


def fc_region(c: str | Column, regions: dict = P.FC_REGIONS) -> Column:
    by_fc = {fc: region for region, group in regions.items() for fc in group}
    return lookup(c, by_fc, P.NONE)


def fc_preference(c: str | Column, preferred=P.PREFERRED_FCS) -> Column:
    """1 for a preferred FC, 0 for any other or none."""
    return F.coalesce(col(c).isin(*preferred), F.lit(False)).cast("int")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.upper() for c in df.columns))
