"""Line dedup: lines that many sites share are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.stages import row_key, staged

#: Sites from which on a line counts as boilerplate.
MIN_SITES = 10
#: Size of the sketches: 2 ** LG_K slots, a standard error of 1.04 / 2 ** (LG_K / 2).
LG_K = 12
ERRORS = 4


def line_hash(line: Column) -> Column:
    """Hash of a line without the white space around it; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\n\u000b\f\r"))
    return F.when(bare != "", F.xxhash64(bare))


def shared_lines(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Hashes of the lines of at least ``min_sites`` distinct sites.

    ``lines`` has ``hash, site``.  One sketch per line, merged by aggregation,
    settles all lines whose estimate is further from the threshold than
    ``ERRORS`` standard errors and a rounding step; the few lines near it get an
    exact distinct count.
    """
    error = ERRORS * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")
    )
    spread = staged(spread.where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") <= high).select("hash")
    exact = lines.join(near, "hash", "left_semi").distinct()
    exact = exact.groupBy("hash").agg(F.count(F.lit(1)).alias("sites"))
    sure = spread.where(F.col("sites") > high)
    return sure.union(exact.where(F.col("sites") >= min_sites)).select("hash")


def without_shared_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    removed: str = "n_removed_lines",
) -> DataFrame:
    """Cut the lines out of ``text`` that at least ``min_sites`` sites share.

    Lines end at a newline and are compared without the white space around
    them; blank lines stay.  ``removed`` is a new column with the number of
    lines cut out.  Every row of ``docs`` stays, if only with an empty text.

    Nulls: a null text stays null with no line removed; all null sites together
    count as one site; rows with a null id are told apart by their text.
    Repeated rows get the same result and add no site.  An empty table gives an
    empty table.  Other columns pass through, except one named as ``removed``,
    which is replaced.
    """
    split = F.split(F.col(text), "\n", -1)
    hashes = F.filter(F.transform(split, line_hash), lambda h: h.isNotNull())
    own = docs.select(
        row_key(F.col(doc_id), F.col(text)).alias("row"),
        F.coalesce(F.col(site).cast("string"), F.lit("\u0000")).alias("site"),
        F.array_distinct(hashes).alias("hashes"),
    )
    own = staged(own, "lines")
    lines = own.select("site", F.explode("hashes").alias("hash"))
    shared = staged(shared_lines(lines, min_sites), "shared")
    in_docs = own.select("row", F.explode("hashes").alias("hash"))
    cut = in_docs.join(shared, "hash").groupBy("row")
    cut = cut.agg(F.collect_set("hash").alias("__cut")).withColumnRenamed("row", "__row")
    found = docs.withColumn("__row", row_key(F.col(doc_id), F.col(text)))
    found = found.join(cut, "__row", "left")
    kept = F.filter(
        split, lambda x: ~F.coalesce(F.array_contains("__cut", line_hash(x)), F.lit(False))
    )
    has = F.col("__cut").isNotNull()
    found = found.withColumn("__left", F.when(has, kept))
    fewer = F.when(has, F.size(split) - F.size("__left")).otherwise(0)
    return (
        found.withColumn(removed, fewer)
        .withColumn(text, F.when(has, F.array_join("__left", "\n")).otherwise(F.col(text)))
        .drop("__row", "__cut", "__left")
    )
