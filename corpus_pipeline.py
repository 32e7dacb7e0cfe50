"""A corpus from raw documents to a mixed sample, stage by stage.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame.  All but the last return the columns of ``documents``.  ``run``
writes each stage to the shared folder and hands what it reads back to the
next.

Every stage takes tables with nulls in any column, empty and very long texts,
repeated rows and other columns (which are dropped), and gives an empty table
for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import cascade, decontaminate, lines, mixing, queries, simhash
from lanewise.llm.stages import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens left after decontamination that the sample has.
BUDGET = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null or empty text has too few words and goes; repeated rows are judged
    alike.
    """
    queries.prepared(spark)
    judged = cascade.quality_cascade(docs)
    return judged.where("quality.kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share.

    A null source is a site of its own; a null text stays null, an empty one
    empty.  A line counts once for each site, however often it repeats there.
    """
    queries.prepared(spark)
    cut = lines.without_shared_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    The smallest id stays; of rows with one id, and of null ids, one.  Texts
    without words are near duplicates of each other.
    """
    queries.prepared(spark)
    return simhash.one_of_each(docs, shingle=4, max_bits=4).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text holds none, and an empty benchmark is held by none.
    """
    queries.prepared(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.leaks(docs, items)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample, with the probability by which each document was drawn.

    Null sources and languages are a margin value of their own; a document
    without words belongs to its cell like any other, a cell without words is not
    drawn.  The sample has ``BUDGET`` of all tokens; cells too small for their
    weight are drawn whole.  Draws come from a hash of the id (of the text without one), so
    repeated rows are drawn together.
    """
    queries.prepared(spark)
    drawn = mixing.mix(docs, budget=BUDGET).where("mix.sampled")
    probability = F.round("mix.probability", 6).alias("probability")
    return drawn.select(*COLUMNS, F.col("mix.topic").alias("topic"), probability)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
]

#: SQL has no XXH64, which the SimHash stage is defined by.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    queries.prepared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
