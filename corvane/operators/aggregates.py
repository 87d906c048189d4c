"""Aggregations: replica statistics, weighted statistics, classifier metrics, profiles, position pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges

STATS = ("mean", "min", "max", "std")


def replica_stats(df: DataFrame, keys: list[str], features: list[str], kind: str = "float", stats: tuple[str, ...] = STATS) -> DataFrame:
    """``<feature>_<stat>`` for each feature, feature by feature; null (as the std of one row) is 0."""
    make = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    return df.groupBy(*keys).agg(*[F.coalesce(make[s](f).cast("double"), F.lit(0.0)).cast(kind).alias(f"{f}_{s}") for f in features for s in stats])


def weighted_stats(df: DataFrame, keys: list[str], value: str, weight: str, prefix: str) -> DataFrame:
    """min, weighted mean and max over the non-null values; null where the weights sum to 0."""
    has = F.col(value).isNotNull()
    total = F.sum(F.when(has, F.col(weight)))
    mean = F.sum(F.col(value) * F.col(weight)) / F.nullif(total, F.lit(0))
    return df.groupBy(*keys).agg(F.min(value).alias(f"{prefix}_min"), mean.alias(f"{prefix}_mean"), F.max(value).alias(f"{prefix}_max"))


def position_pivot(df: DataFrame, keys: list[str], position: str, value: Column, positions: int, energy: str, count: str) -> DataFrame:
    """``<energy>1``.. and ``<count>1``..: the sum of ``value`` and the row count by position; 0 where there is none.

    One conditional aggregation instead of a pivot, so partial sums are made before the shuffle.
    """
    out = []
    for i in range(1, positions + 1):
        at = F.col(position) == i
        out += [F.coalesce(F.sum(F.when(at, value)), F.lit(0.0)).alias(f"{energy}{i}"), F.count_if(at).alias(f"{count}{i}")]
    return df.groupBy(*keys).agg(*out)


def null_profile(df: DataFrame) -> DataFrame:
    """column, dtype, rows and nulls of each column, in one pass."""
    one = df.agg(F.count("*").alias("rows__"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("rows__").alias("rows"), F.col(f"`{c}`").alias("nulls")) for c, t in df.dtypes]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: roc_auc and pr_auc (trapezoid over recall and precision, from recall 0 and precision 1).

    Rows are summed by distinct score first; null without both classes. Running sums are taken within ranges of
    scores and then over the ranges, so no task orders all scores.
    """
    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    by = ranges.dealt(by, [F.desc("s")])
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    w = Window.partitionBy(ranges.PART).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.join(F.broadcast(ranges.before(by, tp0=F.sum("p"), fp0=F.sum("n"))), ranges.PART).withColumn("tp", F.col("tp0") + F.sum("p").over(w)).withColumn("fp", F.col("fp0") + F.sum("n").over(w))
    run = run.crossJoin(F.broadcast(total))  # one row
    tp1, fp1 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    precision1 = F.when(tp1 + fp1 > 0, tp1 / (tp1 + fp1)).otherwise(F.lit(1.0))
    both = (F.col("all_p") > 0) & (F.col("all_n") > 0)
    roc = F.sum(F.col("n") * (F.col("tp") + tp1) / 2.0) / (F.max("all_p") * F.max("all_n"))
    pr = F.sum(F.col("p") * (precision + precision1) / 2.0) / F.max("all_p")
    return run.where(both).agg(roc.alias("roc_auc"), pr.alias("pr_auc"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def first_non_null(col: str, ordinal: str) -> Column:
    """The aggregate of a column's first non-null value in the order of an ordinal."""
    return F.min_by(col, F.when(F.col(col).isNotNull(), F.col(ordinal)))
