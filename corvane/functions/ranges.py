"""Order over a whole table without one task that sees all rows: rows are dealt by ranges, once, and numbered within and over the ranges.

The dealing is written: a range exchange that two branches of a plan run anew may cut differently in each, as columns
are pruned, and numbers of one cut would then meet rows of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialized

PART, AT = "part__", "at__"


def dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df``, written in ranges of the given order, with ``part__`` (the range, ascending) and ``at__`` (the place in it from 0)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the id's lower bits count rows of a partition
    return materialized(rows.withColumns({PART: F.spark_partition_id(), AT: place}), "ranges")


def before(rows: DataFrame, **sums: Column) -> DataFrame:
    """``part__`` and, for each named aggregate of dealt rows, its sum over the ranges before; a row for each range."""
    per = rows.groupBy(PART).agg(*[v.alias(k) for k, v in sums.items()])
    over = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(PART, *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(k) for k in sums])


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``out``: 0, 1, 2 .. in the given order, without holes; rows that are equal in it come in any order."""
    rows = dealt(df, order)
    return rows.join(F.broadcast(before(rows, n__=F.count("*"))), PART).withColumn(out, F.col("n__") + F.col(AT)).drop(PART, AT, "n__")


def by_key(df: DataFrame, *keys: str, most: int = 4 << 20, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by keys into as many parts as shuffles have, or more, so that the planner expects at most ``most`` bytes in each.

    For rows that become many more, or larger ones, in the tasks that they are dealt to: parts merged by their own size are too large then.
    ``like`` is a table of that size, for rows of a join, whose size the planner doesn't know.
    """
    size = int(str((df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most)), *keys)
