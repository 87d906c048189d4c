"""Set steps and projections by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column order of a table of chains to be assembled, as the assembling tool reads it.
LAYOUT = ["TCR_name", "TRAV", "TRAJ", "TRA_CDR3", "TRBV", "TRBJ", "TRB_CDR3", "TRAC", "TRBC", "TRA_leader", "TRB_leader", "Linker", "Link_order", "TRA_5_prime_seq", "TRA_3_prime_seq", "TRB_5_prime_seq", "TRB_3_prime_seq"]


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).dropna().distinct()


def with_layout(df: DataFrame, columns: list[str], renames: dict[str, str] | None = None, default: str = "") -> DataFrame:
    """The columns in a fixed order, absent ones constant."""
    df = df.withColumnsRenamed(renames or {})
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) if c in df.columns else F.lit(default).alias(c) for c in columns])


def by_pattern(df: DataFrame, keys: list[str], patterns: list[str]) -> DataFrame:
    """The keys and the columns whose whole name one of the patterns matches."""
    found = [c for c in df.columns if c not in keys and any(re.fullmatch(p, c) for p in patterns)]
    return df.select(*keys, *found)


def with_default(df: DataFrame, col: str, value: Column) -> DataFrame:
    return df if col in df.columns else df.withColumn(col, value)


def appended(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def not_done(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks whose output isn't there yet."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")
