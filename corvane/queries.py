"""The operators on the generic test tables: one query each, and the DuckDB SQL that has to give the same rows.

Bindings: an order's lines are a complex' replicas or contacts, line numbers are positions, embeddings are points or
residues (the label their chain), part prices are scores.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays, keys, ranges, scores, sequences
from .operators import aggregates, embeddings, energies, filters, interface, joins, ml, sets, similarity, sinks, spatial, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


STATS_SQL = ", ".join(f"round(coalesce({fn}({c}), 0)::DOUBLE, 6) AS {c}_{s}" for c in ("l_quantity", "l_extendedprice") for s, fn in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp")))


@query(f"SELECT l_orderkey, {STATS_SQL} FROM lineitem GROUP BY l_orderkey")
def replica_stats(spark, sf_dir):
    got = aggregates.replica_stats(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_quantity", "l_extendedprice"], kind="double")
    return got.select("l_orderkey", *[r6(F.col(c)).alias(c) for c in got.columns[1:]])


PART = filters.Thresholds({"size": {"strong": 10, "weak": 25}, "price": {"strong": 970, "weak": 930}}, frozenset({"size"}), {"size": "p_size", "price": "p_retailprice"})


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 25 AND p_retailprice >= 930")
def preset_filter(spark, sf_dir):
    return filters.preset_filter(table(spark, sf_dir, "part"), "size_weak + price_weak", PART).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT count(*) AS step_0, count(*) FILTER (p_size <= 10) AS step_1, count(*) FILTER (p_size <= 10 AND p_retailprice >= 930) AS step_2 FROM part")
def preset_counts(spark, sf_dir):
    return filters.preset_counts(table(spark, sf_dir, "part"), "size_strong + price_weak", PART)


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10 AND p_retailprice >= 970)""")
def preset_semi(spark, sf_dir):
    passed = filters.preset_filter(table(spark, sf_dir, "part"), "size_strong + price_strong", PART).select(F.col("p_partkey").alias("l_partkey"))
    return joins.semi_null_safe(table(spark, sf_dir, "lineitem"), passed, ["l_partkey"]).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("""WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
b AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
c AS (SELECT l_partkey, l_suppkey, min(l_discount) AS low FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT l_partkey, l_suppkey, n, round(q, 6) AS q, top, low FROM a JOIN b USING (l_partkey, l_suppkey) JOIN c USING (l_partkey, l_suppkey)""")
def tri_inner_scores(spark, sf_dir):
    rows, on = table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"]
    a = rows.groupBy(*on).agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("q"))
    b = rows.where("l_returnflag = 'R'").groupBy(*on).agg(F.max("l_extendedprice").alias("top"))
    c = rows.where("l_linestatus = 'F'").groupBy(*on).agg(F.min("l_discount").alias("low"))
    return a.join(b, on).join(c, on)


LIMITS = {"F": 300000, "O": 250000, "P": 350000}


@query("WITH " + ", ".join(f"t_{s} AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS total_{s.lower()} FROM orders WHERE o_orderstatus = '{s}' AND o_totalprice > {n} GROUP BY 1)" for s, n in LIMITS.items()) + """
SELECT c.c_custkey, round(coalesce(total_f, 0), 4) AS total_f, round(coalesce(total_o, 0), 4) AS total_o, round(coalesce(total_p, 0), 4) AS total_p
FROM customer c LEFT JOIN t_F USING (c_custkey) LEFT JOIN t_O USING (c_custkey) LEFT JOIN t_P USING (c_custkey)""")
def outer3_fill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = [orders.where((F.col("o_orderstatus") == s) & (F.col("o_totalprice") > n)).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias(f"total_{s.lower()}")) for s, n in LIMITS.items()]
    got = joins.attach_missing(joins.outer_all(parts, ["c_custkey"]), table(spark, sf_dir, "customer"), "c_custkey")
    return got.select("c_custkey", *[F.round(c, 4).alias(c) for c in ("total_f", "total_o", "total_p")])


@query("""WITH d AS (SELECT p_brand || ':' || p_type AS k, min(p_partkey) AS v FROM part WHERE p_size > 45 GROUP BY 1 UNION ALL SELECT p_brand, min(p_partkey) FROM part WHERE p_size < 3 GROUP BY 1)
SELECT p_partkey, coalesce(a.v, b.v, -1) AS found FROM part LEFT JOIN d a ON a.k = p_brand || ':' || p_type LEFT JOIN d b ON b.k = p_brand""")
def cascade_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pair = F.concat_ws(":", "p_brand", "p_type")
    d = part.where("p_size > 45").groupBy(pair.alias("k")).agg(F.min("p_partkey").alias("v")).union(part.where("p_size < 3").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_partkey").alias("v")))
    return joins.cascade(part, d, [pair, F.col("p_brand")], "k", "v", "found", F.lit(-1).cast("long")).select("p_partkey", "found")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority LIKE '1%')::INT DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_match_top1(spark, sf_dir):
    urgent = F.col("o_orderpriority").startswith("1").cast("int")
    return joins.first_of(table(spark, sf_dir, "orders"), ["o_custkey"], [urgent.desc(), F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT p_partkey, round((1 - (rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / count(*) OVER ()) * 100, 6) AS pct FROM part""")
def rank_pct_avg(spark, sf_dir):
    return windows.rank_pct(table(spark, sf_dir, "part"), "p_retailprice", "pct", r6((1 - F.col("pct")) * 100)).select("p_partkey", "pct")


ORDINAL = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


@query(f"""WITH t AS (SELECT l_orderkey, l_quantity, l_extendedprice, {ORDINAL} AS m FROM lineitem)
SELECT a.l_orderkey, a.m AS model_i, b.m AS model_j, round(abs(a.l_quantity - b.l_quantity), 6) AS dq, round(abs(a.l_extendedprice - b.l_extendedprice), 6) AS dp FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.m < b.m""")
def replica_pairs(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("m", F.row_number().over(w))
    got = joins.pairs_within(rows, ["l_orderkey"], "m", ["l_quantity", "l_extendedprice"])
    return got.select("l_orderkey", F.col("m_i").alias("model_i"), F.col("m_j").alias("model_j"), r6(F.abs(F.col("l_quantity_i") - F.col("l_quantity_j"))).alias("dq"), r6(F.abs(F.col("l_extendedprice_i") - F.col("l_extendedprice_j"))).alias("dp"))


def points(spark, sf_dir) -> DataFrame:
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("chain"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"), v(3).alias("w"), v(4).alias("u"))


POINTS = "p AS (SELECT vec_id, label AS chain, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w, embedding[5]::DOUBLE AS u FROM embeddings)"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
NEAR = f"{POINTS}, n AS (SELECT a.vec_id AS a, b.vec_id AS b, a.chain AS ca, b.chain AS cb, a.w AS wa, b.w AS wb, a.u AS ua, b.u AS ub, {DIST} AS dist FROM p a JOIN p b ON a.chain < b.chain WHERE {DIST} <= 0.1)"


def near_points(spark, sf_dir) -> DataFrame:
    cols = ["vec_id", "chain", "x", "y", "z", "w", "u"]
    p = points(spark, sf_dir)
    pairs = spatial.radius_join(spatial.side(p, "from", [], cols), spatial.side(p, "to", [], cols), [], 0.1)
    return pairs.where("chain_from < chain_to")


@query(f"WITH {NEAR} SELECT a AS vec_from, b AS vec_to, ca AS chain_from, cb AS chain_to, round(dist, 9) AS dist FROM n")
def radius_contacts(spark, sf_dir):
    a, b = (spatial.side(points(spark, sf_dir), s, [], ["vec_id", "chain", "x", "y", "z"]) for s in ("from", "to"))
    pairs = spatial.radius_join_by_block(a, b, [], 0.1, (["chain_from", "vec_id_from"], ["chain_to", "vec_id_to"])).where("chain_from < chain_to")
    return pairs.select(F.col("vec_id_from").alias("vec_from"), F.col("vec_id_to").alias("vec_to"), "chain_from", "chain_to", F.round("dist", 9).alias("dist"))


@query("""WITH t AS (SELECT p_brand AS brand, 'R' AS flag, avg(p_size) AS potential FROM part WHERE p_size < 30 AND p_type LIKE '%A%' GROUP BY 1),
c AS (SELECT l_orderkey, coalesce(potential, 0) AS e FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN t ON brand = p_brand AND flag = l_returnflag)
SELECT l_orderkey, round(sum(e), 4) AS energy, count(*) AS contacts FROM c GROUP BY l_orderkey""")
def potential_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    t = part.where("p_size < 30 AND p_type LIKE '%A%'").groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_size").alias("potential")).withColumn("flag", F.lit("R"))
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).withColumnsRenamed({"p_brand": "brand", "l_returnflag": "flag"})
    got = energies.with_potential(rows, t, ("brand", "flag"))
    return got.groupBy("l_orderkey").agg(F.round(F.sum("potential"), 4).alias("energy"), F.count("*").alias("contacts"))


PIVOT_SQL = ", ".join(f"round(coalesce(sum(l_quantity) FILTER (l_linenumber = {i}), 0), 4) AS e{i}, count(*) FILTER (l_linenumber = {i}) AS c{i}" for i in range(1, 8))


@query(f"SELECT l_orderkey, {PIVOT_SQL} FROM lineitem GROUP BY l_orderkey")
def position_pivot(spark, sf_dir):
    got = aggregates.position_pivot(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_quantity"), 7, "e", "c")
    return got.select(*[F.round(c, 4).alias(c) if c.startswith("e") else c for c in got.columns])


def _align_sql(v: str, n: int) -> str:
    cells = []
    for row in arrays.alignment_weights(n):
        used = [i for i, w in enumerate(row) if w]
        cells.append("(" + " + ".join(f"{v}[{i + 1}]::DOUBLE" for i in used) + f") / {len(used)}")
    return ", ".join(f"round({c}, 9) AS a{i + 1}" for i, c in enumerate(cells))


@query(" UNION ALL ".join(f"SELECT vec_id, {_align_sql('embedding', 8 + k)} FROM embeddings WHERE vec_id % 6 = {k}" for k in range(6)))
def align_13_to_9(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.align(F.slice("embedding", 1, 13), (8 + F.col("vec_id") % 6)).alias("v"))
    return rows.select("vec_id", *[F.round(F.get("v", F.lit(i)), 9).alias(f"a{i + 1}") for i in range(9)])


RATIO = "-coalesce(sum(l_discount) FILTER (l_linenumber = {0}), 0) / (count(*) FILTER (l_linenumber = {0}) + 1e-8) + 0.0"


@query("WITH t AS (SELECT l_orderkey, " + ", ".join(f"{RATIO.format(i)} AS r{i}" for i in range(1, 8)) + " FROM lineitem GROUP BY 1) SELECT l_orderkey, " + ", ".join(f"round(r{i}, 6) + 0.0 AS ratio_{i}" for i in range(1, 8)) + ", round(" + " + ".join(f"r{i}" for i in range(1, 8)) + ", 6) + 0.0 AS ratio_sum FROM t")
def ratio_features(spark, sf_dir):
    got = aggregates.position_pivot(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_discount"), 7, "e", "c")
    r = [scores.ratio(F.col(f"e{i}"), F.col(f"c{i}")) for i in range(1, 8)]
    return got.select("l_orderkey", *[r6(c).alias(f"ratio_{i}") for i, c in enumerate(r, 1)], r6(arrays.sum_skip_null(r)).alias("ratio_sum"))


@query(f"""WITH {NEAR}, s AS (SELECT ca, cb, a AS r, wa AS p FROM n UNION SELECT ca, cb, b, wb FROM n), m AS (SELECT ca, cb, avg((p + 1) * 50) AS mean_plddt FROM s GROUP BY ALL), k AS (SELECT ca, cb, count(*) AS n_pairs FROM n GROUP BY ALL)
SELECT ca AS chain_from, cb AS chain_to, n_pairs, round(mean_plddt, 6) AS mean_plddt, round(0.724 / (1 + exp(-0.052 * (mean_plddt * log10(n_pairs) - 152.611))) + 0.018, 6) AS pdockq FROM k JOIN m USING (ca, cb)""")
def interface_score(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("b", (F.col("w") + 1) * 50)
    got = interface.interface_scores(p, [], "chain", 0.1, residue="vec_id")
    return got.select("chain_from", "chain_to", "n_pairs", r6(F.col("mean_plddt")).alias("mean_plddt"), r6(F.col("pdockq")).alias("pdockq"))


@query(f"""WITH {NEAR}, t AS (SELECT ca, cb, avg(1 / (1 + pow(abs(ua - ub) * 100 / 10, 2))) AS mean_ptm, avg((wa + 1) * 50) AS mean_plddt FROM n GROUP BY ALL)
SELECT ca AS chain_from, cb AS chain_to, round(mean_ptm, 6) AS mean_ptm, round(mean_plddt, 6) AS mean_plddt, round(1.31034849 / (1 + exp(-0.0747157696 * (mean_ptm * mean_plddt - 84.7326239))) + 0.00501886443, 6) AS pdockq2 FROM t""")
def pdockq2_like(spark, sf_dir):
    pae = F.abs(F.col("u_from") - F.col("u_to")) * 100
    got = interface.interface_pdockq2(near_points(spark, sf_dir), ["chain_from", "chain_to"], pae, (F.col("w_from") + 1) * 50)
    return got.select("chain_from", "chain_to", *[r6(F.col(c)).alias(c) for c in ("mean_ptm", "mean_plddt", "pdockq2")])


def matrix(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(ordered residue pairs with an error, chain lengths) of every order: lines are residues, return flags chains."""
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = ranges.by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), "l_orderkey")
    rows = lines.select("l_orderkey", F.col("l_returnflag").alias("chain"), F.row_number().over(w).alias("i"), F.col("l_quantity").alias("q"))
    a, b = spatial.side(rows, "1", ["l_orderkey"], ["chain", "i", "q"]), spatial.side(rows, "2", ["l_orderkey"], ["chain", "i", "q"])
    pairs = a.join(b, "l_orderkey").where("chain_1 <> chain_2").select("l_orderkey", F.col("chain_1").alias("chain1"), F.col("i_1").alias("i"), F.col("chain_2").alias("chain2"), F.col("i_2").alias("j"), F.abs(F.col("q_1") - F.col("q_2")).alias("pae"))
    return pairs, rows.groupBy("l_orderkey", "chain").agg((F.count("*") * 20).alias("length"))


MATRIX = """q AS (SELECT l_orderkey, l_returnflag AS chain, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
mx AS (SELECT a.l_orderkey, a.chain AS chain1, a.i AS i, b.chain AS chain2, b.i AS j, abs(a.q - b.q) AS pae FROM q a JOIN q b ON a.l_orderkey = b.l_orderkey AND a.chain <> b.chain), len AS (SELECT l_orderkey, chain, count(*) * 20 AS n FROM q GROUP BY ALL)"""


@query(f"WITH {MATRIX} SELECT l_orderkey, chain1, chain2, round(coalesce(avg(CASE WHEN pae < 12 THEN (12 - pae) / 12 END), 0), 6) AS lis FROM mx GROUP BY ALL")
def lis_by_pair(spark, sf_dir):
    return interface.lis(matrix(spark, sf_dir)[0], ["l_orderkey", "chain1", "chain2"]).select("l_orderkey", "chain1", "chain2", r6(F.col("LIS")).alias("lis"))


D0 = "CASE WHEN {0} > 27 THEN greatest(1.0, 1.24 * cbrt({0}::DOUBLE - 15) - 1.8) ELSE 1.0 END"


@query(f"""WITH {MATRIX}, dom AS (SELECT l_orderkey, chain1, chain2, count(DISTINCT i) FILTER (pae < 10) AS nres1, count(DISTINCT j) FILTER (pae < 10) AS nres2 FROM mx GROUP BY ALL),
d AS (SELECT dom.*, l1.n + l2.n AS n0chn, nres1 + nres2 AS n0dom FROM dom JOIN len l1 ON l1.l_orderkey = dom.l_orderkey AND l1.chain = chain1 JOIN len l2 ON l2.l_orderkey = dom.l_orderkey AND l2.chain = chain2),
e AS (SELECT *, {D0.format('n0chn')} AS d0chn, {D0.format('n0dom')} AS d0dom FROM d),
r AS (SELECT l_orderkey, chain1, chain2, i, count(*) FILTER (pae < 10) AS n0res FROM mx GROUP BY ALL),
s AS (SELECT *, greatest(1.0, 1.24 * cbrt(greatest(n0res, 26)::DOUBLE - 15) - 1.8) AS d0res FROM r),
b AS (SELECT mx.l_orderkey, mx.chain1, mx.chain2, mx.i, any_value(n0res) AS n0res, avg(1 / (1 + pow(pae / d0chn, 2))) AS iptm, coalesce(avg(1 / (1 + pow(pae / d0chn, 2))) FILTER (pae < 10), 0) AS chn,
  coalesce(avg(1 / (1 + pow(pae / d0dom, 2))) FILTER (pae < 10), 0) AS dom, coalesce(avg(1 / (1 + pow(pae / d0res, 2))) FILTER (pae < 10), 0) AS res
  FROM mx JOIN e USING (l_orderkey, chain1, chain2) JOIN s USING (l_orderkey, chain1, chain2, i) GROUP BY ALL),
m AS (SELECT l_orderkey, chain1, chain2, max(res) AS ipsae, max(chn) AS ipsae_d0chn, max(dom) AS ipsae_d0dom, max(iptm) AS iptm_d0chn FROM b GROUP BY ALL)
SELECT l_orderkey, chain1, chain2, round(ipsae, 6) AS ipsae, round(ipsae_d0chn, 6) AS ipsae_d0chn, round(ipsae_d0dom, 6) AS ipsae_d0dom, round(iptm_d0chn, 6) AS iptm_d0chn, n0chn, n0dom, nres1, nres2 FROM m JOIN d USING (l_orderkey, chain1, chain2)""")
def ipsae_by_pair(spark, sf_dir):
    pairs, lengths = matrix(spark, sf_dir)
    got = interface.ipsae(pairs, lengths, ["l_orderkey"], dealt=True)
    return got.select("l_orderkey", "chain1", "chain2", *[r6(F.col(a)).alias(a.lower()) for a in ("ipSAE", "ipSAE_d0chn", "ipSAE_d0dom", "ipTM_d0chn")], "n0chn", "n0dom", "nres1", "nres2")


@query(f"""WITH {MATRIX}, l AS (SELECT l_orderkey, chain1, chain2, round(coalesce(avg(CASE WHEN pae < 12 THEN (12 - pae) / 12 END), 0), 6) AS s, max(i) AS n FROM mx GROUP BY ALL)
SELECT a.l_orderkey, a.chain1 AS chain_a, a.chain2 AS chain_b, greatest(a.s, b.s) AS score, CASE WHEN a.s > b.s THEN a.chain1 ELSE a.chain2 END AS from_chain FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.chain1 = b.chain2 AND a.chain2 = b.chain1 WHERE a.chain1 < a.chain2""")
def symmetric_best(spark, sf_dir):
    got = interface.lis(matrix(spark, sf_dir)[0], ["l_orderkey", "chain1", "chain2"]).withColumn("score", r6(F.col("LIS"))).withColumn("from_chain", F.col("chain1"))
    return interface.symmetric_max(got, ["l_orderkey"], "score", ["from_chain"])


@query(f"WITH {POINTS}, k AS (SELECT DISTINCT a.chain AS ca, b.chain AS cb FROM p a JOIN p b ON a.chain < b.chain) SELECT ca, cb, EXISTS (SELECT 1 FROM p a JOIN p b ON a.chain = ca AND b.chain = cb AND {DIST} <= 0.02) AS has_contacts FROM k")
def min_distance_exists(spark, sf_dir):
    p = points(spark, sf_dir)
    labels = p.select("chain").distinct()
    grid = labels.select(F.col("chain").alias("ca")).join(labels.select(F.col("chain").alias("cb")), F.col("ca") < F.col("cb"))
    near = spatial.radius_join(spatial.side(p, "from", [], ["chain", "x", "y", "z"]), spatial.side(p, "to", [], ["chain", "x", "y", "z"]), [], 0.02)
    got = near.select(F.col("chain_from").alias("ca"), F.col("chain_to").alias("cb")).distinct().withColumn("has_contacts", F.lit(True))
    return grid.join(got, ["ca", "cb"], "left").withColumn("has_contacts", F.coalesce("has_contacts", F.lit(False)))


@query("""WITH r AS (SELECT n_name, count(*) AS w FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), q AS (SELECT DISTINCT p_name FROM part),
s AS (SELECT p_name, w, 1 - levenshtein(p_name, n_name) / greatest(length(p_name), length(n_name))::DOUBLE AS s FROM q, r)
SELECT p_name, round(min(s), 6) AS sim_min, round(sum(s * w) / sum(w), 6) AS sim_mean, round(max(s), 6) AS sim_max FROM s GROUP BY 1""")
def lev_similarity_stats(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    got = similarity.reference_stats(table(spark, sf_dir, "part"), refs, "p_name", "n_name", "sim")
    return got.select("p_name", *[r6(F.col(c)).alias(c) for c in ("sim_min", "sim_mean", "sim_max")])


@query()
def local_similarity_stats(spark, sf_dir):
    refs = table(spark, sf_dir, "nation")
    got = similarity.reference_stats(table(spark, sf_dir, "part"), refs, "p_name", "n_name", "sw", lambda a, b: similarity.local_similarity(a, b))
    return got.select("p_name", *[r6(F.col(c)).alias(c) for c in ("sw_min", "sw_mean", "sw_max")])


@query("""WITH d AS (SELECT DISTINCT c_nationkey, c_custkey FROM customer), i AS (SELECT *, c_custkey - row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS g FROM d),
r AS (SELECT c_nationkey, min(c_custkey) AS a, max(c_custkey) AS b FROM i GROUP BY c_nationkey, g)
SELECT c_nationkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, '+' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def islands(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey")


@query("""WITH c AS (SELECT event_id, user_id, ts, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c""")
def renumber_changes(spark, sf_dir):
    return windows.renumber(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], "run").select("event_id", "user_id", "run")


@query("SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM documents")
def cum_offsets(spark, sf_dir):
    return windows.offsets(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", "chars_before").select("doc_id", "source", "chars_before")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.carry_forward(rows, ["user_id"], ["ts", "event_id"], "bought", "last_purchase").select("event_id", "user_id", "last_purchase")


MADE = {0: ("HLA-A*{0}:{1}:01", "HLA-A*{0}:{1}:01"), 1: ("A{0}{1}", "HLA-A*{0}:{1}"), 2: ("HLA-B{0}", "HLA-B*{0}:01"), 3: ("C*{0}:{1}:07:02", "HLA-C*{0}:{1}"), 4: ("HLA-B{0}:{1}", "HLA-B*{0}:{1}"), 5: ("DRB1_{0}{1}", "DRB1_{0}{1}"), 6: ("A*{0}", "A*{0}")}


def _made_sql(which: int) -> str:
    two = lambda s: "'" + s.replace("{0}", "' || lpad((p_size % 90)::VARCHAR, 2, '0') || '").replace("{1}", "' || lpad((p_partkey % 97)::VARCHAR, 2, '0') || '") + "'"
    return "CASE " + " ".join(f"WHEN p_partkey % 7 = {k} THEN {two(v[which])}" for k, v in MADE.items()) + " END"


@query(f"SELECT p_partkey, {_made_sql(1)} AS allele, CASE WHEN p_partkey % 7 IN (2, 0, 1, 3, 4) THEN regexp_extract({_made_sql(1)}, '^([^:]+:[^:]+)', 1) END AS two_fields FROM part")
def allele_norm(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("raw", F.expr(_made_sql(0).replace("::VARCHAR", "").replace("lpad((p_size % 90)", "lpad(cast(p_size % 90 as string)").replace("lpad((p_partkey % 97)", "lpad(cast(p_partkey % 97 as string)")))
    rows = rows.withColumn("allele", sequences.normal_allele(F.col("raw")))
    return rows.select("p_partkey", "allele", sequences.two_fields(F.col("allele")).alias("two_fields"))


@query("""WITH t AS (SELECT event_id, user_id || '_' || event_type || '_' || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE (event_id % 5)::VARCHAR END AS k FROM events)
SELECT event_id, regexp_extract(k, '^(.*)_([^_]*)$', 1) AS tcr_id, coalesce(try_cast(regexp_extract(k, '^(.*)_([^_]*)$', 2) AS INT), 0) AS model_number FROM t""")
def key_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.concat_ws("_", F.col("user_id").cast("string"), "event_type", F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.col("event_id") % 5).cast("string"))))
    return keys.split_key(rows, "k").select("event_id", "tcr_id", "model_number")


@query("""SELECT p_partkey, part, trim(sequence) AS sequence FROM (SELECT p_partkey, 'p_name' AS part, p_name AS sequence FROM part UNION ALL SELECT p_partkey, 'p_brand', CASE WHEN p_size > 20 THEN p_brand ELSE ' ' END FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part) WHERE trim(sequence) <> ''""")
def unpivot_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise(" "))
    return embeddings.unpivot_sequences(rows, ["p_partkey"], ("p_name", "p_brand", "p_type"))


@query("SELECT l_suppkey, min(l_tax) AS l_tax_min, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY 1")
def colpattern_project(spark, sf_dir):
    got = aggregates.replica_stats(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "l_tax"], "double")
    return sets.by_pattern(got, ["l_suppkey"], [r"l_quantity.*max", r"l_tax.*min"])


@query("SELECT vec_id, " + ", ".join(f"round(({' + '.join(f'embedding[{s * 16 + j * 4 + i + 1}]::DOUBLE' for j in range(4))}) / 4, 9) AS x{s * 4 + i}" for s in (0, 2) for i in range(4)) + " FROM embeddings")
def pool_concat(spark, sf_dir):
    rows = lambda s: F.array(*[F.slice("embedding", s * 16 + j * 4 + 1, 4) for j in range(4)])
    got = table(spark, sf_dir, "embeddings").select("vec_id", arrays.pool(rows(0), F.lit(1), F.lit(4)).alias("a"), arrays.mean_vector(rows(2)).alias("b"))
    got = got.select("vec_id", F.concat("a", "b").alias("x"))
    return got.select("vec_id", *[F.round(F.get("x", F.lit(k)), 9).alias(f"x{n}") for k, n in enumerate([0, 1, 2, 3, 8, 9, 10, 11])])


@query("SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def complete_parts(spark, sf_dir):
    return joins.has_all_parts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag"), ["A", "N", "R"])


SHARES = {"LQ": "p_size % 7 + 1", "AQ": "p_size % 5 + 1", "MQ": "p_partkey % 6 + 1", "HQ": "p_partkey % 4 + 1"}
CUTS = {"AQ": 0.3, "MQ": 0.35, "HQ": 0.3}
_total = " + ".join(f"({v})" for v in SHARES.values())
_pass = {c: (f"(proba_{c} >= {CUTS[c]})" if c in CUTS else "TRUE") for c in SHARES}
_best = "greatest(" + ", ".join(f"CASE WHEN {_pass[c]} THEN proba_{c} ELSE -1 END" for c in SHARES) + ")"


@query("WITH t AS (SELECT p_partkey, " + ", ".join(f"({v})::DOUBLE / ({_total}) AS proba_{c}" for c, v in SHARES.items()) + "), u AS (SELECT *, " .replace("), u", " FROM part), u") + ", ".join(f"{_pass[c]}::INT AS pass_{c}" for c in CUTS) + ", CASE " + " ".join(f"WHEN {_pass[c]} AND proba_{c} = {_best} THEN '{c}'" for c in SHARES) + " ELSE 'LQ' END AS label FROM t) SELECT p_partkey, pass_AQ, pass_MQ, pass_HQ, label, (label <> 'LQ')::INT AS pass_filter FROM u")
def label_thresholds(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", *[(F.expr(v).cast("double") / F.expr(_total)).alias(f"proba_{c}") for c, v in SHARES.items()])
    return ml.label_thresholds(rows, CUTS).select("p_partkey", "pass_AQ", "pass_MQ", "pass_HQ", F.col("predicted_label_thresholded").alias("label"), "pass_filter")


@query("""WITH t AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM t GROUP BY s),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, tp / (tp + fp)::DOUBLE AS prec, CASE WHEN tp - p + fp - n > 0 THEN (tp - p) / (tp - p + fp - n)::DOUBLE ELSE 1.0 END AS prec0 FROM c)
SELECT round(sum(n * (tp + tp - p) / 2.0) / (max(pos) * max(neg)), 9) AS roc_auc, round(sum(p * (prec + prec0) / 2) / max(pos), 9) AS pr_auc FROM q""")
def roc_pr_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return aggregates.auc(rows, "quality", "n_chars").select(F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


@query(f"""WITH t AS (SELECT l_orderkey, l_quantity, {ORDINAL} AS m FROM lineitem), g AS (SELECT l_orderkey, min(m) AS a, max(m) AS b FROM t WHERE l_quantity >= 30 GROUP BY 1)
SELECT l_orderkey, m, l_quantity FROM t JOIN g USING (l_orderkey) WHERE m BETWEEN a AND b""")
def residue_trim(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("m", F.row_number().over(w)).select("l_orderkey", "m", "l_quantity")
    return filters.threshold_runs(rows, ["l_orderkey"], ["m"], "l_quantity", 30)


@query("""WITH t AS (SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT unnest([{'c': 'doc_id', 'n': count(*) FILTER (doc_id IS NULL)}, {'c': 'lang', 'n': count(*) FILTER (lang IS NULL)}, {'c': 'source', 'n': count(*) FILTER (source IS NULL)}, {'c': 'quality', 'n': count(*) FILTER (quality IS NULL)}, {'c': 'toxic', 'n': count(*) FILTER (toxic IS NULL)}]).c AS "column",
unnest([count(*) FILTER (doc_id IS NULL), count(*) FILTER (lang IS NULL), count(*) FILTER (source IS NULL), count(*) FILTER (quality IS NULL), count(*) FILTER (toxic IS NULL)]) AS nulls FROM t""")
def null_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")
    return aggregates.null_profile(rows).select("column", "nulls")


@query("""SELECT c_custkey::VARCHAR AS tcr_id, '[{"name":"' || c_custkey || '","modelSeeds":[],"sequences":[' || array_to_string([ '{"proteinChain":{"sequence":"' || s || '","count":1}}' for s in ['GILGFVFTL', 'MIQRT', 'AAA', 'CASS', 'CAV']], ',') || '],"dialect":"alphafoldserver","version":1}]' AS spec FROM customer WHERE c_custkey % 3 <> 0""")
def json_jobspec(spark, sf_dir):
    third = F.col("c_custkey") % 3 == 0
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tcr_id"), F.lit("GILG*FVFTL").alias("MHC_seq"), F.lit("AAA").alias("Epitope"), F.when(third, "CA-S").otherwise("CASS").alias("TCRA"), F.lit("CAV").alias("TCRB"))
    return sinks.job_specs(rows, "MIQRT", "hosted")


@query("""WITH RECURSIVE t AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r FROM documents),
b AS (SELECT doc_id, lang, r, 0 AS batch, 1 AS n FROM t WHERE r = 1 UNION ALL
SELECT t.doc_id, t.lang, t.r, CASE WHEN t.n_chars * (b.n + 1) > 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN t.n_chars * (b.n + 1) > 20000 THEN 1 ELSE b.n + 1 END FROM b JOIN t ON t.lang = b.lang AND t.r = b.r + 1)
SELECT doc_id, lang, batch FROM b""")
def token_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return windows.token_batches(rows, ["lang"], ["doc_id"], "n_chars", 20000).select("doc_id", "lang", "batch")


#: A small ensemble in the layout of gradient boosting models: two trees over two features.
TREES = json.dumps({"learner": {"learner_model_param": {"base_score": "5E-1"}, "objective": {"name": "binary:logistic"}, "gradient_booster": {"model": {"trees": [
    {"left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [0, 0, 1, 0, 0], "split_conditions": [25.0, -0.5, 950.0, 0.25, 0.75], "default_left": [1, 0, 0, 0, 0]},
    {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [1, 0, 0], "split_conditions": [930.0, 0.125, -0.25], "default_left": [0, 0, 0]}]}}}})


@query("""SELECT p_partkey, round(1 / (1 + exp(-(CASE WHEN p_size < 25 THEN -0.5 WHEN p_retailprice::FLOAT < 950 THEN 0.25 ELSE 0.75 END + CASE WHEN p_retailprice::FLOAT < 930 THEN 0.125 ELSE -0.25 END))), 5) AS probs FROM part""")
def tree_predict(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("float"), F.col("p_retailprice").cast("float")).alias("x"))
    return ml.tree_predict(rows, TREES, "p_partkey").select("p_partkey", F.round(F.col("probs").cast("double"), 5).alias("probs"))


@query("""WITH m AS (SELECT n_name, max(c_mktsegment) AS tcra, min(CASE WHEN c_acctbal > 9850 THEN c_mktsegment END) AS tcrb FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9700 GROUP BY 1)
SELECT n_name, m.tcra IS NULL AS missing, (m.tcra IS NOT NULL AND tcrb IS NULL) AS incomplete FROM nation LEFT JOIN m USING (n_name)""")
def mapping_check(spark, sf_dir):
    names = table(spark, sf_dir, "nation").withColumn("n_name", joins.mapping_key(F.col("n_name"), "exact"))
    own = names.join(table(spark, sf_dir, "customer").where("c_acctbal > 9700"), F.col("c_nationkey") == F.col("n_nationkey"))
    mapping = own.groupBy("n_name").agg(F.max("c_mktsegment").alias("tcra"), F.min(F.when(F.col("c_acctbal") > 9850, F.col("c_mktsegment"))).alias("tcrb"))
    return joins.mapping_report(names.select("n_name"), mapping, "n_name", ["tcra", "tcrb"])


@query("SELECT n_name, c_mktsegment, round(sum(c_acctbal), 4) AS total, max(c_custkey) AS last_key FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def distinct_then_join(spark, sf_dir):
    """A function computed on distinct keys only and joined back, then summed."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = joins.apply_distinct(table(spark, sf_dir, "customer"), ["c_nationkey"], lambda d: d.join(joins.lookup_side(nation), "c_nationkey", "left"))
    last = joins.last_by(rows.select("n_name", "c_mktsegment", "c_custkey"), ["n_name", "c_mktsegment"], "c_custkey").withColumnRenamed("c_custkey", "last_key")
    return rows.groupBy("n_name", "c_mktsegment").agg(F.round(F.sum("c_acctbal"), 4).alias("total")).join(last, ["n_name", "c_mktsegment"])


def _flagship_sql() -> str:
    one = lambda n: "SELECT l_orderkey, l_suppkey, " + ", ".join("(" + " + ".join(f"{p}{i + 1}" for i, w in enumerate(row) if w) + f") / {sum(w > 0 for w in row)} AS {a}{k + 1}" for p, a in (("e", "x"), ("c", "y")) for k, row in enumerate(arrays.alignment_weights(n))) + f" FROM t WHERE 8 + l_orderkey % 6 = {n}"
    pivot = ", ".join(f"round(coalesce(sum(pot) FILTER (pos = {i}), 0), 4) AS e{i}, count(*) FILTER (pos = {i}) AS c{i}" for i in range(1, 14))
    ratios = ", ".join(f"-x{i} / (y{i} + 1e-8) + 0.0 AS ratio_{i}" for i in range(1, 10))
    stats = ", ".join(f"round(coalesce({fn}(ratio_{i}), 0), 6) + 0.0 AS ratio_{i}_{s}" for i in range(1, 10) for s, fn in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp")))
    return f"""WITH b AS (SELECT l_orderkey, l_suppkey % 3 AS l_suppkey, (l_linenumber + l_partkey) % 13 + 1 AS pos, CASE WHEN p_size <= 25 THEN p_size / 10.0 ELSE 0 END AS pot FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT l_orderkey, l_suppkey, {pivot} FROM b WHERE pos <= 8 + l_orderkey % 6 GROUP BY ALL), a AS ({' UNION ALL '.join(one(n) for n in range(8, 14))}), r AS (SELECT l_orderkey, {ratios} FROM a) SELECT l_orderkey, {stats} FROM r GROUP BY l_orderkey"""


@query(_flagship_sql())
def structural_slice(spark, sf_dir):
    """Contacts and potentials to position sums, aligned positions, energy ratios and replica statistics."""
    part = table(spark, sf_dir, "part")
    potentials = part.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 10.0).alias("potential"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("l_suppkey"), "l_linenumber", "l_partkey")
    rows = lines.join(part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    rows = rows.withColumn("pos", (F.col("l_linenumber") + F.col("l_partkey")) % 13 + 1).where(F.col("pos") <= 8 + F.col("l_orderkey") % 6)
    rows = energies.with_potential(rows, potentials, ("l_partkey",))
    rows = ranges.by_key(rows.select("l_orderkey", "l_suppkey", "pos", "potential"), "l_orderkey", like=lines)  # a line is narrow, its 26 sums aren't
    t = aggregates.position_pivot(rows, ["l_orderkey", "l_suppkey"], "pos", F.col("potential"), 13, "e", "c")
    t = t.select("l_orderkey", (8 + F.col("l_orderkey") % 6).alias("size"), *[F.round(f"e{i}", 4).alias(f"e{i}") for i in range(1, 14)], *[f"c{i}" for i in range(1, 14)])
    e, c = (arrays.aligned_cells([f"{name}{i}" for i in range(1, 14)], "size") for name in "ec")
    t = t.select("l_orderkey", *[x.alias(f"x{i}") for i, x in enumerate(e)], *[x.alias(f"y{i}") for i, x in enumerate(c)])
    t = t.select("l_orderkey", *[scores.ratio(F.col(f"x{i}"), F.col(f"y{i}")).alias(f"ratio_{i + 1}") for i in range(9)])
    got = aggregates.replica_stats(t, ["l_orderkey"], [f"ratio_{i}" for i in range(1, 10)], kind="double")
    return got.select("l_orderkey", *[r6(F.col(x)).alias(x) for x in got.columns[1:]])
