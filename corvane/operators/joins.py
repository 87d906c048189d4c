"""Joins: null-safe semi joins, cascaded lookups, last-wins rows, outer joins with attached ids, pairs within groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lookup side is broadcast if the planner expects no more bytes.
LOOKUP_BYTES = 32 << 20


def lookup_side(df: DataFrame, most: int = LOOKUP_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the planner knows it to be small; else as it is, and the size it turns out to have decides at run time."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else df


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which has to tell rows apart to be deterministic."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank__", F.row_number().over(w)).where("rank__ = 1").drop("rank__")


def last_by(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of each key, the row with the largest ordinal, by one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("row__"))
    return got.select(*keys, "row__.*")


def semi_null_safe(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``; a null matches a null."""
    right = keys.select(*[F.col(c).alias(f"{c}__") for c in on]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in on])
    return df.join(right, cond, "left_semi")


def cascade(df: DataFrame, dictionary: DataFrame, keys: list[Column], key_col: str, value_col: str, out: str, default: Column) -> DataFrame:
    """``out``: the value of the first key in the list that the dictionary has, else ``default``.

    The dictionary has to have one row a key. The keys of one row are looked up in one join: the row's best match is
    the one with the smallest place in the list.
    """
    side = lookup_side(dictionary.select(F.col(key_col).alias("key__"), F.col(value_col).alias("value__")))
    for i, key in enumerate(keys):
        df = df.join(side.toDF(f"key__{i}", f"value__{i}"), key == F.col(f"key__{i}"), "left")
    df = df.withColumn(out, F.coalesce(*[F.col(f"value__{i}") for i in range(len(keys))], default))
    return df.drop(*[f"{n}__{i}" for i in range(len(keys)) for n in ("key", "value")])


def override(df: DataFrame, own: DataFrame, on: str, col: str, default: Column) -> DataFrame:
    """``col``: the value that ``own`` has for the row's key, else the default."""
    side = lookup_side(own.select(on, F.col(col).alias("own__")))
    return df.join(side, on, "left").withColumn(col, F.coalesce("own__", default)).drop("own__")


def left_preferring(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join in which columns that both sides have come from the left."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in on]), on, how)


def outer_all(tables: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "full_outer"), tables)


def attach_missing(df: DataFrame, ids: DataFrame, on: str, fill: float = 0) -> DataFrame:
    """``df`` with a row for each id that it lacks, and nulls of number columns filled."""
    missing = ids.select(on).distinct().join(df.select(on), on, "left_anti")
    return df.unionByName(missing, allowMissingColumns=True).fillna(fill)


def pairs_within(df: DataFrame, group: list[str], member: str, values: list[str]) -> DataFrame:
    """All pairs i < j of members of a group, with both sides' values as ``<value>_i`` and ``<value>_j``.

    A group here is the replicas of one complex: a handful of rows.
    """
    i = df.select(*group, F.col(member).alias(f"{member}_i"), *[F.col(v).alias(f"{v}_i") for v in values])
    j = df.select(*group, F.col(member).alias(f"{member}_j"), *[F.col(v).alias(f"{v}_j") for v in values])
    return i.join(j, group).where(F.col(f"{member}_i") < F.col(f"{member}_j"))


def has_all_parts(df: DataFrame, keys: list[str], part: Column, parts: list[str]) -> DataFrame:
    """The keys that have every part (relational division), in one aggregation."""
    return df.where(part.isin(*parts)).groupBy(*keys).agg(F.count_distinct(part).alias("n__")).where(F.col("n__") == len(parts)).drop("n__")


def apply_distinct(df: DataFrame, cols: list[str], fn) -> DataFrame:
    """An expensive function of ``cols`` computed once for each distinct value and joined back; nulls match nulls.

    ``fn`` maps a DataFrame of the distinct values to one with further columns.
    """
    found = fn(df.select(*cols).distinct())
    extra = [c for c in found.columns if c not in cols]
    side = found.select(*[F.col(c).alias(f"{c}__") for c in cols], *extra)
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in cols])
    return df.join(side, cond, "left").drop(*[f"{c}__" for c in cols])


def mapping_report(names: DataFrame, mapping: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Of each name, whether its mapping is missing or incomplete."""
    joined = names.join(mapping.withColumn("found__", F.lit(True)), key, "left")
    missing = F.col("found__").isNull()
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    return joined.select(key, missing.alias("missing"), (~missing & lacks).alias("incomplete"))


#: How a complex' name becomes its key in a chain mapping, by the mode's name in configurations.
KEY_MODES: dict[str, Callable[[Column], Column]] = {
    "exact": lambda c: c,
    "first4": lambda c: F.substring(c, 1, 4),
    "prefix_before_underscore": lambda c: F.substring_index(c, "_", 1),
}


def mapping_key(name: Column, mode: str = "exact") -> Column:
    """The key of a name; KeyError for a mode that isn't among ``KEY_MODES``."""
    return KEY_MODES[mode](name)


def reject_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; a ValueError that names an example if a key comes twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate keys: {[tuple(r)[:-1] for r in twice]}")
    return df
