"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree is root - domain - language - source. A budget of tokens goes down the tree: the children of a node share it
by weight, but none gets more than its subtree can supply (tokens times epochs), and what one can't take goes to its
siblings by weight. A node's supply is the sum of its children's, so a shortage is made up among siblings first and
among the siblings of an ancestor only where a whole subtree runs short.

At a leaf, the share is whole epochs over its documents and then a prefix of one more: documents in the order of a
seeded hash, as many as the rest of the share holds. It ends before the first document that doesn't fit, and what is left
of the share goes to no other leaf, so less than the budget is chosen (the README gives figures), and nothing of a leaf whose
first document is longer than its share. The prefix is found over 4,096 ranges of the hash by leaf, so no
task orders a whole leaf. All shares are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, sized_join, written

WORD = r"[^ \t\n\x0B\f\r]+"
LEVELS = ("domain", "lang", "source")


def _shares(nodes: DataFrame, level: int) -> DataFrame:
    """One level of the tree: ``nodes`` (names down to the level, cap, weight, budget of the parent) with ``share``.

    Children are taken by rising cap over weight. One is full if its part of what is left, by the weights left, is its
    cap or more; the rest share what the full ones leave.
    """
    names = list(LEVELS[: level + 1])
    w = Window.partitionBy("budget", *names[:-1]).orderBy("ratio", names[-1])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("budget", *names[:-1])
    n = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")))
    n = n.withColumn("ratio", F.coalesce("ratio", F.lit(float("inf"))))
    n = n.withColumn("left_budget", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    n = n.withColumn("left_weight", F.sum("weight").over(after))
    n = n.withColumn("full", (F.col("weight") > 0) & (F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_budget")))
    n = n.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    n = n.withColumn("rest_weight", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(0)))
    part = F.when(F.col("rest_weight") > 0, F.floor(F.expr("weight * rest div greatest(rest_weight, 1)"))).otherwise(F.lit(0))
    return n.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).select(*names, "cap", "share")


def _weight(weights: dict[str, int], name: str) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.col(name)), F.lit(1)).cast("long")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, int]], max_epochs: int = 1) -> DataFrame:
    """domain, lang, source, tokens, share of each leaf. ``leaves``: domain, lang, source, tokens; names no child
    of one parent has twice. Weights are whole numbers by level and name, 1 where none is given."""
    cap = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("long"))
    total = cap.agg(F.sum("cap").alias("all"), F.sum("tokens").alias("tokens"))
    up = cap.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(weights.get("domain", {}), "domain"))
    up = up.crossJoin(F.broadcast(total.select(F.least(budget.cast("long"), F.col("all")).alias("budget"))))  # one row
    got = _shares(up, 0)
    for level in (1, 2):
        names = list(LEVELS[: level + 1])
        own = cap.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(weights.get(LEVELS[level], {}), LEVELS[level]))
        got = _shares(own.join(got.select(*names[:-1], F.col("share").alias("budget")), names[:-1]), level)
    return got.select(*LEVELS, "share").join(leaves, list(LEVELS))


def select_mix(docs: DataFrame, weights: dict[str, dict[str, int]], numerator: int = 3, denominator: int = 5, max_epochs: int = 1, seed: int = 17,
               domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, text_key, domain, lang, source, n_tokens, n_rows and copies of what is chosen, at least one copy each.

    The budget is ``numerator / denominator`` of the corpus' tokens (words). Null languages and sources are a child
    named ``none``; null and wordless texts have no tokens and come with
    the whole epochs and the prefix they fall into, without cost.
    Null ids hash as the empty text; what ties in its hash is ordered by id and text. Rows equal in all that is read
    are one item of ``n_rows`` rows: n_tokens counts them all, and they are chosen together. An empty table gives no
    rows. Further columns aren't read.
    """
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("none")).alias("lang"),
                        F.coalesce(F.col(f"`{source_col}`"), F.lit("none")).alias("source"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    domain = F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as long)"), F.lit(0)) % 4) if domain is None else domain
    rows = plain.select("doc_id", F.xxhash64("text").alias("text_key"), domain.alias("domain"), "lang", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = written(rows.groupBy("doc_id", "text_key", *LEVELS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")), "sizes")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budget = F.expr(f"tokens * {numerator} div {denominator}")
    plan = budgets(leaves, budget, weights, max_epochs)
    plan = plan.withColumn("epochs", F.expr("if(tokens > 0, share div tokens, 0)")).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
    plan = written(plan.select(*LEVELS, "epochs", "rest"), "budgets")

    keyed = sized_join(rows, plan, list(LEVELS), "inner")
    keyed = keyed.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("bucket", F.substring("place", 1, 3))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("bucket_rest"))
    w = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("in_bucket").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = sums.withColumn("start", F.col("upto") - F.col("in_bucket")).select(*LEVELS, "bucket", "start", "upto")
    keyed = keyed.join(sums, [*LEVELS, "bucket"])
    whole = keyed.where("upto <= rest and rest > 0").withColumn("chosen", F.lit(1))
    out = keyed.where("start > rest or rest = 0").withColumn("chosen", F.lit(0))
    inner = Window.partitionBy(*LEVELS, "bucket").orderBy("place", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = keyed.where("start <= rest and upto > rest and rest > 0").withColumn("chosen", (F.col("start") + F.sum("n_tokens").over(inner) <= F.col("rest")).cast("int"))
    got = whole.unionByName(out).unionByName(edge).withColumn("copies", (F.col("epochs") + F.col("chosen")).cast("long"))
    return got.where("copies > 0").select("doc_id", "text_key", *LEVELS, "n_tokens", "n_rows", "copies")


#: The production weights of the query and of the pipeline.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def mixed_rows(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The chosen rows of ``docs`` with every column, each as often as it has copies. Rows of equal id and text but
    another language or source come if one of them is chosen, with the most copies that one has."""
    chosen = select_mix(docs, WEIGHTS if weights is None else weights, id_col=id_col, text_col=text_col, **options)
    chosen = written(chosen.groupBy(F.col("doc_id").alias("chosen__id"), F.col("text_key").alias("chosen__key")).agg(F.max("copies").cast("int").alias("chosen__n")), "chosen")
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("own__key"))
    rows = sized_join(keyed, chosen, F.col(f"`{id_col}`").eqNullSafe(F.col("chosen__id")) & (F.col("own__key") == F.col("chosen__key")), "inner")
    return rows.withColumn("again__n", F.explode(F.sequence(F.lit(1), F.col("chosen__n")))).select(*[F.col(f"`{c}`") for c in names])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: three fifths of the corpus' tokens by the production weights, two epochs at most."""
    return select_mix(documents(spark, sf_dir), WEIGHTS, max_epochs=2).drop("text_key")
