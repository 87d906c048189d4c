"""Steps with window semantics: ranks, top one, islands, renumbering, offsets, carry-forward, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges


def rank_pct(df: DataFrame, value: str, out: str, scale: Column | None = None) -> DataFrame:
    """``out``: the average rank of a value among the non-null ones over their number; null for null.

    Ranks come from counts by distinct value, summed within ranges of values and over the ranges, so no task orders
    all rows. ``scale`` maps the rank column ``out`` to the final value.
    """
    by = ranges.dealt(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v__")).agg(F.count("*").alias("c")), [F.col("v__")])
    parts = F.broadcast(ranges.before(by, before=F.sum("c")))  # a row for each range
    w = Window.partitionBy(ranges.PART).orderBy("v__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = by.join(parts, ranges.PART).crossJoin(F.broadcast(by.agg(F.sum("c").alias("all"))))  # one row
    ranks = placed.select("v__", ((F.col("before") + F.sum("c").over(w) - (F.col("c") - 1) / 2.0) / F.col("all")).alias(out))
    got = df.join(ranks, df[value] == ranks["v__"], "left").drop("v__")
    return got if scale is None else got.withColumn(out, scale)


def islands(df: DataFrame, group: list[str], number: str, out: str = "ranges") -> DataFrame:
    """Of each group, its distinct numbers as ranges such as ``25-216+223``."""
    w = Window.partitionBy(*group).orderBy(number)
    rows = df.where(F.col(number).isNotNull()).select(*group, number).distinct().withColumn("island", F.col(number) - F.row_number().over(w))
    runs = rows.groupBy(*group, "island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    runs = runs.withColumn("run", F.struct("a", text.alias("text")))
    return runs.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda r: r["text"]), "+").alias(out))


def renumber(df: DataFrame, group: list[str], order: list[str], key: list[str], out: str) -> DataFrame:
    """``out``: a number that grows by one whenever the key differs from the row before; a key that comes back gets a new one."""
    w = Window.partitionBy(*group).orderBy(*order)
    k = F.struct(*[F.col(c) for c in key])
    change = F.when(F.lag(k).over(w).eqNullSafe(k), 0).otherwise(1)
    return df.withColumn("change__", change).withColumn(out, F.sum("change__").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("change__")


def offsets(df: DataFrame, group: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """``out``: the sum of the sizes before, within the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def token_batches(df: DataFrame, group: list[str], order: list[str], length: str, budget: int, out: str = "batch") -> DataFrame:
    """``out``: batch numbers from 0 of each group's rows in ascending length: a batch ends where its longest times its rows would
    pass the budget; a row longer than that is a batch of its own. A null or negative length counts as 0.

    How many rows a batch may have when a row is its longest is ``budget div length``, and this takes at most twice the
    budget's square root different values, falling along the order. So a group is a short list of runs with one such
    number each, however many rows it has: batches are walked from run to run on that list, and in closed form within a run. Rows get their
    places by ranges (``ranges``) and no task has all rows of a group.
    """
    if budget < 1:
        raise ValueError("a batch needs a budget")
    keys = [F.col(f"`{c}`") for c in group]
    size = F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0))
    room = F.when(size == 0, F.lit(1 << 62)).otherwise(F.greatest(F.floor(F.lit(budget) / F.nullif(size, F.lit(0))).cast("long"), F.lit(1)))
    rows = ranges.numbered(df.withColumns({"size__": size, "room__": room}), [*keys, F.col("size__"), *[F.col(f"`{c}`") for c in order]], "place__")
    runs = rows.groupBy(*keys, "room__").agg(F.min("place__").alias("lo"), F.count("*").alias("n")).withColumnRenamed("room__", "room")
    runs = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "n", "room"))).alias("runs__"))
    # w: the open batch's first row s and number b at a run's first row; turn is where in or after the run the next batch begins
    walk = F.expr("""aggregate(runs__, named_struct('s', runs__[0].lo, 'b', 0L, 'out', cast(array() AS array<struct<room__: bigint, b: bigint, turn: bigint>>)), (w, r) ->
        transform(array(struct(greatest(r.lo, w.s + r.room) AS turn, r.lo + r.n - 1 AS hi)), t -> named_struct(
            's', if(t.turn > t.hi, w.s, t.turn + (t.hi - t.turn) div r.room * r.room),
            'b', if(t.turn > t.hi, w.b, w.b + 1 + (t.hi - t.turn) div r.room),
            'out', concat(w.out, array(named_struct('room__', r.room, 'b', w.b, 'turn', t.turn)))))[0]).out""")
    own = [F.col(f"`{c}`").alias(f"{c}__of") for c in group]
    walked = runs.select(*own, F.explode(walk).alias("r__")).select(*[f"`{c}__of`" for c in group], F.col("r__.room__").alias("room__of"), F.col("r__.b").alias("b__"), F.col("r__.turn").alias("turn__"))
    same = F.col("room__") == F.col("room__of")
    for c in group:
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}__of`"))
    batch = F.when(F.col("place__") < F.col("turn__"), F.col("b__")).otherwise(F.expr("b__ + 1 + (place__ - turn__) div room__"))
    return rows.join(walked, same).select(*[F.col(f"`{c}`") for c in df.columns if c != out], batch.cast("int").alias(out))


def chunked(df: DataFrame, order: list[Column], size: int, out: str = "chunk") -> DataFrame:
    """``out``: chunk numbers from 0 of ``size`` rows each in the given order."""
    return ranges.numbered(df, order, "place__").withColumn(out, F.expr(f"place__ div {size}")).drop("place__")
