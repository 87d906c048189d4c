"""FASTA files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, field: int = 2, name: str = "mhc_allele", sequence: str = "mhc_seq") -> DataFrame:
    """ordinal, name, sequence of each record; the name is the header's ``field``-th word, lines of a sequence are joined.

    Records are split by the reader, so one large file is read in parallel.
    """
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''").withColumn("ordinal", F.monotonically_increasing_id())
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    word = F.try_element_at(F.split(F.trim(head), r"\s+"), F.lit(field))
    return rows.select("ordinal", word.alias(name), body.alias(sequence)).where(F.col(name).isNotNull())


def keep_first(df: DataFrame, key: str) -> DataFrame:
    """The first record of each key, by file order."""
    from ..operators.joins import first_of

    return first_of(df, [key], [F.col("ordinal")])
