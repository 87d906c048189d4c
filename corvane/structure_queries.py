"""More operators on the generic test tables, with their SQL: readers over made-up lines, structures, quality, preparation.

Bindings: orders are models, their lines residues or contacts, embeddings residues in space; text that readers parse is made from
the tables by the same expressions in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import arrays, keys, sequences
from .operators import embeddings, energies, filters, interface, joins, ml, sets, similarity, sinks, structure, windows
from .plans import scoring
from .queries import r6, query, table
from .schemas import JOB
from .sources import jobs, reports, structures


def both(sql: str) -> str:
    """An expression of the two engines: DuckDB's casts as Spark writes them."""
    return sql.replace("::VARCHAR", "::string").replace("::INT", "::int")


#: Scores of the production filters by column, some of them missing.
SCORES = {
    "EL_rank": "CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 50) / 10e0 END", "BA_rank": "CASE WHEN p_partkey % 8 > 0 THEN (p_partkey % 40) / 10e0 END",
    "mhcflurry_presentation_percentile": "CASE WHEN p_size % 6 > 0 THEN (p_size % 30) / 10e0 END", "mhcflurry_processing_percentile": "CASE WHEN p_size % 9 > 0 THEN (p_size % 25) / 10e0 END",
    "mhcflurry_affinity_percentile": "CASE WHEN p_size % 10 > 0 THEN (p_size % 35) / 10e0 END", "NOAH": "CASE WHEN p_partkey % 5 > 0 THEN 1e0 - (p_partkey % 9) END",
    "NetCleave": "CASE WHEN p_partkey % 4 > 0 THEN (p_size % 11) / 10e0 END", "PredIG": "CASE WHEN p_partkey % 3 > 0 THEN (p_size % 10) / 20e0 END",
}
#: What each step of the production filters asks for, as the cutoffs read.
STEPS = {
    "EL_rank_strong": "coalesce(EL_rank, 0) <= 0.5", "EL_rank_weak": "coalesce(EL_rank, 0) <= 2", "BA_rank_strong": "coalesce(BA_rank, 0) <= 0.5", "BA_rank_weak": "coalesce(BA_rank, 0) <= 2",
    "mhcflurry_pres_strong": "coalesce(mhcflurry_presentation_percentile, 0) <= 1", "mhcflurry_pres_weak": "coalesce(mhcflurry_presentation_percentile, 0) <= 2",
    "mhcflurry_proc_strong": "coalesce(mhcflurry_processing_percentile, 0) <= 1", "mhcflurry_proc_weak": "coalesce(mhcflurry_processing_percentile, 0) <= 2",
    "mhcflurry_aff_strong": "coalesce(mhcflurry_affinity_percentile, 0) <= 1", "mhcflurry_aff_weak": "coalesce(mhcflurry_affinity_percentile, 0) <= 2",
    "NOAH_strong": "coalesce(NOAH, -10) <= -5", "NOAH_weak": "coalesce(NOAH, -10) <= -1", "NetCleave_strong": "coalesce(NetCleave, 1) >= 0.6", "PredIG_strong": "coalesce(PredIG, 1) >= 0.19",
}


@query("WITH t AS (SELECT p_partkey, " + ", ".join(f"{e} AS {c}" for c, e in SCORES.items()) + " FROM part) SELECT p_partkey, " + ", ".join(f"({e})::INT AS {s}" for s, e in STEPS.items()) + " FROM t")
def preset_production(spark, sf_dir):
    """Every metric and strength of the production filters, with missing scores imputed."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(c) for c, e in SCORES.items()])
    rows = filters.impute(rows, filters.PMHC_MISSING)
    return rows.select("p_partkey", *[filters.PMHC.steps(s)[0][1].cast("int").alias(s) for s in STEPS])


RESIDUES = """r AS (SELECT vec_id % 25 AS m, label AS chain, row_number() OVER (PARTITION BY vec_id % 25 ORDER BY vec_id) - 1 AS t, vec_id % 5 > 0 AS ca, vec_id % 3 > 0 AS cb,
embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (embedding[4]::DOUBLE + 1) * 50 AS b FROM embeddings)"""


def residues(spark, sf_dir) -> DataFrame:
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    place = F.row_number().over(Window.partitionBy(F.col("vec_id") % 25).orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("m"), F.col("label").alias("chain"), place.alias("token"), (F.col("vec_id") % 5 > 0).alias("ca"), (F.col("vec_id") % 3 > 0).alias("cb"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"), ((v(3) + 1) * 50).alias("b"))
    return rows.select("m", "chain", "token", *[F.when(F.col(a), F.col(c) + (0.05 if a == "cb" and c != "b" else 0.0)).alias(f"{a}_{c}") for a in ("ca", "cb") for c in ("x", "y", "z", "b")])


def cells(rows: DataFrame) -> DataFrame:
    """The rows of one square matrix a model, of made-up errors. They are dealt before they are made, as what they are made from is small."""
    n = rows.groupBy("m").agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.select("m", "token").join(n, "m").repartition(parts, "m", "token")
    line = lambda e: F.expr(f"transform(sequence(0, cast(n - 1 as int)), j -> {e})")
    return each.select("m", "token", line("cast(abs(token - 2 * j) % 30 as double)").alias("pae"), line("((token + j) % 7) / 7e0").alias("contact_probs"))


NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.25"


@query(f"""WITH {RESIDUES}, n AS (SELECT a.m, a.chain, a.t AS i, b.t AS j, a.b, a.ca AND b.ca AS by_ca FROM r a JOIN r b ON a.m = b.m AND a.chain <> b.chain AND ((a.ca AND b.ca) OR (a.cb AND b.cb)) AND {NEAR}),
g AS (SELECT m, chain, avg(b) AS p, avg(1 / (1 + pow((abs(i - 2 * j) % 30) / 10.0, 2))) FILTER (by_ca) AS e, avg(((i + j) % 7) / 7e0) FILTER (by_ca) AS d FROM n GROUP BY ALL),
c AS (SELECT DISTINCT m, chain FROM r), o AS (SELECT m, chain, coalesce(p, 0) AS p, coalesce(e, 0) AS e, coalesce(d, 0) AS d FROM c LEFT JOIN g USING (m, chain))
SELECT m, chain, round(p, 6) AS if_plddt, round(e, 6) AS avgipae, round(d, 6) AS avgipde, round(1.31034849 / (1 + exp(-0.0747157696 * (p * e - 84.7326239))) + 0.00501886443, 6) AS pdockq2 FROM o""")
def pdockq2_by_chain(spark, sf_dir):
    """Contacts by CA, else CB; interface confidence, errors and score of every chain."""
    rows = residues(spark, sf_dir)
    got = interface.chain_confidence(rows, cells(rows), ["m"], 0.25)
    return got.select("m", "chain", *[r6(F.col(c)).alias(c) for c in ("if_plddt", "avgipae", "avgipde", "pdockq2")])


@query(f"""WITH {RESIDUES}, k AS (SELECT m, chain, t, row_number() OVER (PARTITION BY m ORDER BY t) - 1 AS at FROM r WHERE t % 4 <> 1)
SELECT a.m, a.chain AS chain1, b.chain AS chain2, sum(abs(a.t - 2 * b.t) % 30)::DOUBLE AS total, count(*) AS n FROM k a JOIN k b ON a.m = b.m AND a.chain <> b.chain GROUP BY ALL""")
def trimmed_matrix(spark, sf_dir):
    """A matrix without the rows and columns of removed residues, in its long form by chain pair."""
    rows = residues(spark, sf_dir)
    gone = rows.groupBy("m").agg(F.collect_list(F.when(F.col("token") % 4 == 1, F.col("token"))).alias("gone"))
    small = interface.rows_without(cells(rows).select("m", "token", "pae").join(F.broadcast(gone), "m"), ["m"], "gone", "pae")
    left = rows.where("token % 4 <> 1").withColumn("place", F.row_number().over(Window.partitionBy("m").orderBy("token")) - 1)
    pairs = interface.matrix_pairs(small, left.select("m", "chain", F.col("token").alias("residue"), F.col("place").alias("token")), ["m"])
    return pairs.groupBy("m", "chain1", "chain2").agg(F.sum("pae").alias("total"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN 'cdr1' ELSE 'cdr2' END AS region, round(avg(l_quantity), 6) AS plddt FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <= 4 GROUP BY ALL""")
def region_plddt(spark, sf_dir):
    atoms = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("chain"), F.col("l_linenumber").alias("res_seq"), F.col("l_linestatus").alias("aa"), F.col("l_quantity").alias("b"))
    regions = atoms.where("aa = 'F' and res_seq <= 4").withColumn("region", F.when(F.col("res_seq") <= 2, "cdr1").otherwise("cdr2"))
    return interface.region_plddt(atoms, regions, ["l_orderkey"]).select("l_orderkey", "region", r6(F.col("plddt")).alias("plddt"))


PLACE = "row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"


@query(f"""WITH p AS (SELECT l_orderkey, l_returnflag AS c, {PLACE} AS k, CASE WHEN l_linenumber <> 5 THEN l_quantity END AS b FROM lineitem),
s AS (SELECT l_orderkey, b, (c = 'A' AND k < 2) AS a, (c = 'N' AND k >= 1 AND k < 3) AS n, (c = 'R' AND k < 1) AS r FROM p),
t AS (SELECT l_orderkey, count(*) FILTER ((a OR r) AND b IS NULL) AS xa, count(*) FILTER ((n OR r) AND b IS NULL) AS xn, sum(b) FILTER (a OR r) AS sa, count(*) FILTER (a OR r) AS ca, sum(b) FILTER (n OR r) AS sn, count(*) FILTER (n OR r) AS cn FROM s WHERE a OR n OR r GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN xa = 0 AND xn = 0 AND ca > 0 AND cn > 0 THEN ((sa + 1e-6) / ca * 0.01 + (sn + 1e-6) / cn * 0.01) / 2 END, 6) AS score FROM t""")
def region_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    at = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    points = rows.select("l_orderkey", F.col("l_returnflag").alias("chain"), at.alias("at"), F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("b"))
    spans = F.explode(F.expr("array(" + ", ".join(f"named_struct('chain', '{c}', 'first', {a}, 'after', {b}, 'region', '{r}')" for c, a, b, r in (("A", 0, 2, "cdr1a"), ("N", 1, 3, "cdr1b"), ("R", 0, 1, "peptide"))) + ")"))
    regions = rows.select("l_orderkey").distinct().select("l_orderkey", spans.alias("s")).select("l_orderkey", "s.*")
    got = interface.region_score(points, regions, ["l_orderkey"], ["cdr1a", "peptide"], ["cdr1b", "peptide"])
    return got.select("l_orderkey", F.round("cdrs_peptide_plddt", 6).alias("score"))


@query("""WITH s AS (SELECT o_custkey, o_orderstatus AS a, substr(o_orderpriority, 1, 1) AS b, max(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_custkey, round(coalesce(sum(CASE WHEN (a = 'F' AND b IN ('1', '2')) OR (a = 'O' AND b = '1') THEN v END), 0) / 4, 6) AS v FROM s GROUP BY 1""")
def interface_means(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("chain_a"), F.substring("o_orderpriority", 1, 1).alias("chain_b")).agg(F.max("o_totalprice").alias("v"))
    got = interface.interface_means(scores, ["o_custkey"], ["v"], ("F_1", "F_2", "O_1", "O_9"))
    return got.select("o_custkey", r6(F.col("v")).alias("v"))


@query("""WITH f AS (SELECT p_partkey, 'A' AS c, p_name AS s, substr(p_name, 3, length(p_name) - 5) AS o, 0 AS k FROM part UNION ALL SELECT p_partkey, 'B', p_type, CASE WHEN p_partkey % 4 > 0 THEN p_type END, length(p_name) FROM part),
g AS (SELECT p_partkey, CASE WHEN o IS NULL THEN range(k, k + length(s)) ELSE list_concat(range(k, k + strpos(s, o) - 1), range(k + strpos(s, o) - 1 + length(o), k + length(s))) END AS g FROM f)
SELECT p_partkey, array_to_string(list_sort(flatten(list(g))), ',') AS removed FROM g GROUP BY 1""")
def removed_indices(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    full = part.select("p_partkey", F.lit("A").alias("chain"), F.col("p_name").alias("sequence")).union(part.select("p_partkey", F.lit("B"), "p_type"))
    seen = part.select("p_partkey", F.lit("A").alias("chain"), F.expr("substring(p_name, 3, length(p_name) - 5)").alias("sequence")).union(part.where("p_partkey % 4 > 0").select("p_partkey", F.lit("B"), "p_type"))
    got = structure.removed_indices(full, seen, ["p_partkey"])
    return got.select("p_partkey", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) // 100)::BIGINT AS chunk FROM customer")
def chunked(spark, sf_dir):
    return windows.chunked(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 100).select("c_custkey", F.col("chunk").cast("long").alias("chunk"))


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS o_orderdate, (row_number() OVER (ORDER BY o_orderdate, o_orderkey))::VARCHAR AS tcr_id FROM orders")
def sequential_ids(spark, sf_dir):
    return keys.with_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "tcr_id")


KIND = "CASE l_returnflag WHEN 'A' THEN 'tcr_p' WHEN 'N' THEN 'p_mhc' ELSE 'tcr_mhc' END"
_len = "8 + o_orderkey % 7"
_own = lambda kind, at=None: f"kind = '{kind}' AND pos BETWEEN 1 AND n" + (f" AND pos = {at}" if at else "")
_energy = lambda name, cond: f"round(coalesce(sum(v) FILTER ({cond}), 0), 4) AS e_{name}, count(*) FILTER ({cond}) AS c_{name}"


@query(f"""WITH m AS (SELECT o_orderkey, {_len} AS n FROM orders WHERE {_len} <= 13), c AS (SELECT l_orderkey, {KIND} AS kind, l_partkey % 16 AS pos, l_discount::DOUBLE AS v FROM lineitem WHERE l_quantity < 12)
SELECT o_orderkey, {_energy('tcr_p_all', _own('tcr_p'))}, {_energy('pmhc_all', _own('p_mhc'))}, {', '.join(_energy(f'tcr_p{i}', _own('tcr_p', i)) for i in (1, 9, 13))}, {', '.join(_energy(f'pmhc_p{i}', _own('p_mhc', i)) for i in (2, 8))}, {_energy('tcr_mhc', "kind = 'tcr_mhc'")}
FROM m LEFT JOIN c ON l_orderkey = o_orderkey GROUP BY 1""")
def model_energies(spark, sf_dir):
    """Energies by position of every model, zeros for those without a contact that counts."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("complex_id"))
    peptides = orders.withColumn("Epitope", F.expr("repeat('A', cast(8 + complex_id % 7 as int))"))
    c = table(spark, sf_dir, "lineitem").where("l_quantity < 12").select(F.col("l_orderkey").alias("complex_id"), F.lit(0).alias("model_number"), F.expr(KIND).alias("kind"), (F.col("l_partkey") % 16).alias("resid_to"), (F.col("l_partkey") % 16).alias("resid_from"), F.col("l_discount").cast("double").alias("potential"))
    got = energies.complex_energies(c, peptides, models=orders.withColumn("model_number", F.lit(0)))
    names = ["tcr_p_all", "pmhc_all", "tcr_p1", "tcr_p9", "tcr_p13", "pmhc_p2", "pmhc_p8", "tcr_mhc"]
    return got.select(F.col("complex_id").alias("o_orderkey"), *[f"{p}_{n}" for n in names for p in "ec"])


@query("""SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'tcr_p' WHEN l_returnflag = 'N' THEN 'tcr_mhc' ELSE 'p_mhc' END AS kind, count(*) AS n, round(sum(l_quantity / 6), 6) AS total FROM lineitem
WHERE l_quantity / 6 <= 5 AND l_linenumber <> 3 AND NOT (l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber > 5) GROUP BY ALL""")
def contact_kinds(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(flag == "R", F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") > 5), "mhc").otherwise("peptide")).when(F.col("l_linestatus") == "F", "tcra").otherwise("tcrb").alias("role_from"),
        F.when(flag == "A", "peptide").otherwise("mhc").alias("role_to"), F.lit("A").alias("residue_from"), F.when(F.col("l_linenumber") == 3, "X").otherwise("G").alias("residue_to"), (F.col("l_quantity") / 6).alias("dist"))
    return energies.contact_kinds(rows, 5.0).groupBy("l_orderkey", "kind").agg(F.count("*").alias("n"), r6(F.sum("dist")).alias("total"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS energy FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey, l_linenumber, sum(l_discount) AS ele, sum(l_tax) AS des, sum(l_extendedprice) AS vdw FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT e.l_orderkey::VARCHAR AS tcr_id, e.l_linenumber AS model_number, energy, round(ele + des + vdw, 4) AS total_w1, o_orderstatus AS status FROM e JOIN d USING (l_orderkey, l_linenumber) LEFT JOIN orders ON o_orderkey = e.l_orderkey AND e.l_linenumber = 1""")
def merged_energies(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("tcr_id"), F.col("l_linenumber").alias("model_number"), "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linestatus")
    own = rows.groupBy("tcr_id", "model_number").agg(F.sum("l_quantity").alias("energy"))
    dock = rows.where("l_linestatus = 'F'").groupBy("tcr_id", "model_number").agg(F.sum("l_discount").alias("Ele"), F.sum("l_tax").alias("Desolv"), F.sum("l_extendedprice").alias("VDW"))
    meta = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("tcr_id"), F.lit(1).cast("int").alias("model_number"), F.lit(-1).alias("energy"), F.col("o_orderstatus").alias("status"))
    return energies.merge_energies(own, dock, meta).select("tcr_id", "model_number", "energy", F.round("total_w1", 4).alias("total_w1"), "status")


@query("""SELECT 'n' || s_nationkey AS path, 'PEP' || s_suppkey AS peptide, 'HLA-A' || s_nationkey AS allele, round(s_acctbal, 2)::DOUBLE AS EL_score, (s_suppkey % 40) / 10e0 AS EL_rank FROM supplier WHERE s_suppkey % 6 > 0""")
def binding_report(spark, sf_dir):
    """A predictor's report made line by line, and its rows read back: alleles carried forward, odd lines left out."""
    s = table(spark, sf_dir, "supplier").withColumn("path", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    w = Window.partitionBy("path").orderBy("s_suppkey")
    row = F.concat_ws("  ", F.lit("1 A"), F.concat(F.lit("PEP"), F.col("s_suppkey").cast("string")), F.lit("core a b c d e icore x"), F.round("s_acctbal", 2).cast("decimal(18,2)").cast("string"), ((F.col("s_suppkey") % 40) / F.lit(10.0)).cast("string"), F.lit("0.5 1.5 y"))
    row = F.when(F.col("s_suppkey") % 6 == 0, F.lit("Pos  a line that is no row")).otherwise(row)
    lines = s.select("path", (F.row_number().over(w) + 3).alias("line"), row.alias("text"))
    heads = s.select("path", F.posexplode(F.array(F.lit("1 A PEP0 before any allele"), F.concat(F.lit("# Allele: HLA-A"), F.expr("substring(path, 2)")), F.lit("-----"))).alias("line", "text")).distinct()
    return reports.parse_binding(lines.unionByName(heads)).select("path", "peptide", "allele", "EL_score", "EL_rank")


@query("""SELECT 'c' || c_custkey AS tcr_id, c_nationkey AS model_number, 1 AS Conf, round(c_acctbal, 2)::DOUBLE AS Ele, c_custkey / 2e0 AS Total, 7 AS RANK FROM customer""")
def docking_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/x/c"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".ene"))
    first = F.concat_ws("   ", F.lit("1"), F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string"), F.lit("-2.5 3"), (F.col("c_custkey") / 2.0).cast("string"), F.lit("7"))
    lines = F.array(F.lit("Conf Ele Desolv VDW Total RANK"), F.lit("-----"), F.lit("3 4"), first, F.lit("2 9 9 9 9 9"))
    rows = c.select(path.alias("path"), F.posexplode(lines).alias("line", "text"))
    return reports.parse_docking(rows).select("tcr_id", "model_number", "Conf", "Ele", "Total", "RANK")


THREE = ["ALA", "GLY", "TRP", "MSE", "LYS", "VAL"]
ONE = ["A", "G", "W", "X", "K", "V"]
_pick = lambda names, e: f"CASE {e} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
ATOM_ORDER = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def atoms(spark, sf_dir) -> DataFrame:
    """Atoms of orders: one residue a line, its CA only."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(w).cast("long"))
    return rows.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("complex_id"), F.lit(1).alias("model_number"), F.when(F.col("l_partkey") % 11 == 0, "HETATM").otherwise("ATOM").alias("record"), F.col("ord").cast("int").alias("serial"),
        F.lit("CA").alias("atom_name"), F.expr(_pick(THREE, "l_partkey % 6")).alias("res_name"), F.col("l_returnflag").alias("chain"), F.col("ord").cast("int").alias("res_seq"), F.lit(None).cast("string").alias("icode"),
        F.round(F.col("l_quantity") / 7, 3).alias("x"), F.round(F.col("l_discount") * -10, 3).alias("y"), F.round(F.col("l_tax") * 100, 3).alias("z"), F.lit(1.0).alias("occ"), F.round("l_quantity", 2).alias("b"), "ord")


@query(f"""SELECT 'o' || l_orderkey AS complex_id, {ATOM_ORDER}::INT AS res_seq, CASE WHEN l_partkey % 11 = 0 THEN 'HETATM' ELSE 'ATOM' END AS record, {_pick(THREE, 'l_partkey % 6')} AS res_name, l_returnflag AS chain, round(l_quantity / 7, 3)::DOUBLE AS x, round(l_tax * 100, 3)::DOUBLE AS z, round(l_quantity, 2)::DOUBLE AS b FROM lineitem""")
def pdb_round_trip(spark, sf_dir):
    """Atoms written as fixed-width lines and read again."""
    lines = structures.pdb_lines(atoms(spark, sf_dir)).select(F.concat_ws("", F.lit("/d/"), "complex_id", F.lit("_1.pdb")).alias("path"), F.col("ord").alias("line"), F.col("line").alias("text"))
    return structures.parse_pdb(lines).select("complex_id", "res_seq", "record", "res_name", "chain", "x", "z", "b")


@query(f"""WITH a AS (SELECT l_orderkey, l_returnflag AS chain, {ATOM_ORDER} AS o, {_pick(ONE, 'l_partkey % 6')} AS aa, l_partkey FROM lineitem)
SELECT 'o' || l_orderkey AS complex_id, chain, string_agg(aa, '' ORDER BY o) AS sequence FROM a WHERE l_partkey % 11 > 0 GROUP BY ALL""")
def chain_sequences(spark, sf_dir):
    return structure.sequences(atoms(spark, sf_dir)).select("complex_id", "chain", "sequence")


@query(f"""WITH a AS (SELECT l_orderkey, l_returnflag AS chain, {ATOM_ORDER} AS o, CASE WHEN l_returnflag = 'R' THEN 'B' ELSE 'A' END AS side, l_partkey FROM lineitem)
SELECT 'o' || l_orderkey AS complex_id, chain AS source_chain, side AS chain, row_number() OVER (PARTITION BY l_orderkey, side ORDER BY o)::INT AS res_seq FROM a WHERE l_partkey % 11 > 0""")
def merged_sides(spark, sf_dir):
    own = atoms(spark, sf_dir)
    roles = own.select("complex_id", "chain").distinct().withColumn("role", F.when(F.col("chain") == "R", "tcra").when(F.col("chain") == "A", "mhc").otherwise("peptide"))
    return structure.merge_chains(own, roles).select("complex_id", "source_chain", "chain", "res_seq")


@query(f"""SELECT 'o' || l_orderkey AS complex_id, max(CASE WHEN chain = 'A' THEN s END) AS MHC_seq, max(CASE WHEN chain = 'R' THEN s END) AS TCRA, NULL::VARCHAR AS TCRB FROM (SELECT l_orderkey, chain, string_agg(aa, '' ORDER BY o) AS s FROM
(SELECT l_orderkey, l_returnflag AS chain, {ATOM_ORDER} AS o, {_pick(ONE, 'l_partkey % 6')} AS aa, l_partkey FROM lineitem) WHERE l_partkey % 11 > 0 GROUP BY ALL) GROUP BY 1""")
def model_metadata(spark, sf_dir):
    return structure.model_metadata(atoms(spark, sf_dir), {"A": "MHC_seq", "R": "TCRA", "Z": "TCRB"}).select(F.col("tcr_id").alias("complex_id"), "MHC_seq", "TCRA", "TCRB")


POS, AA = "l_partkey % 128", "substr('ACDEFGHIKLMNPQRSTVWY-', (l_suppkey % 21 + 1)::INT, 1)"


@query("WITH t AS (SELECT l_orderkey, " + f"{POS} AS p, {AA} AS aa, CASE WHEN l_linenumber = 2 THEN 'A' END AS ins FROM lineitem) SELECT l_orderkey, " + ", ".join(
    f"coalesce(string_agg(aa, '' ORDER BY p, ins NULLS FIRST, aa) FILTER (p BETWEEN {a} AND {b}), '') AS CDR{n}" for n, (a, b) in enumerate(((26, 39), (55, 66), (104, 118)), 1)) + " FROM t WHERE aa <> '-' AND ins IS NULL GROUP BY 1")
def loop_sequences(spark, sf_dir):
    """Loops of numbered sequences in the wide scheme, which leaves out insertions."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(POS).alias("imgt_pos"), F.expr(both(AA)).alias("aa"), F.when(F.col("l_linenumber") == 2, "A").alias("insertion"))
    return structure.loops(rows, "wide", keys=("l_orderkey",))


@query("""WITH j AS (SELECT c_custkey, [{'s': c_mktsegment, 'n': 1}, {'s': c_name, 'n': (c_custkey % 3)::INT + 1}, {'s': 'M', 'n': 2}] AS q FROM customer), e AS (SELECT c_custkey, unnest(range(1, 4)) AS k, unnest(q) AS s FROM j),
c AS (SELECT c_custkey, k, s.s AS s, unnest(range(0, s.n)) AS copy FROM e)
SELECT c_custkey::VARCHAR AS name, row_number() OVER w AS place, substr('ABCDEFGHIJ', (row_number() OVER w)::INT, 1) AS chain, s AS sequence FROM c WINDOW w AS (PARTITION BY c_custkey ORDER BY k, copy)""")
def job_chains(spark, sf_dir):
    """Job requests as text, read and expanded to chains."""
    one = lambda s, n: F.struct(F.struct(s.alias("sequence"), n.alias("count")).alias("proteinChain"))
    seqs = F.array(one(F.col("c_mktsegment"), F.lit(1)), one(F.col("c_name"), (F.col("c_custkey") % 3 + 1).cast("int")), one(F.lit("M"), F.lit(2)))
    text = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("name"), seqs.alias("sequences"))).alias("value"))
    return jobs.job_chains(text.select(F.from_json("value", JOB).alias("j")).select("j.*")).select("name", "place", "chain", "sequence")


@query("""SELECT c_nationkey || 'job' AS job, (c_custkey % 5)::INT AS model, CASE WHEN c_nationkey % 2 = 0 THEN 'hosted' ELSE 'local' END AS layout FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey % 3) = 3""")
def complete_models(spark, sf_dir):
    """Models of job folders that have all of structure, confidences and summary, by their paths' layout."""
    n, m = F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 5).cast("string")
    hosted = F.get(F.array(F.concat(F.lit("/x_model_"), m, F.lit(".cif")), F.concat(F.lit("/x_full_data_"), m, F.lit(".json")), F.concat(F.lit("/x_summary_confidences_"), m, F.lit(".json"))), (F.col("c_custkey") % 3).cast("int"))
    local = F.concat(F.lit("/seed-1_sample-"), m, F.lit("/"), F.get(F.array(F.lit("model.cif"), F.lit("confidences.json"), F.lit("summary_confidences.json")), (F.col("c_custkey") % 3).cast("int")))
    path = F.concat(F.lit("/in/"), F.when(F.col("c_nationkey") % 2 == 0, F.lit("fold_")).otherwise(F.lit("")), n, F.lit("job"), F.when(F.col("c_nationkey") % 2 == 0, hosted).otherwise(local))
    return jobs.complete_models(table(spark, sf_dir, "customer").select(path.alias("path"))).select("job", "model", "layout")


@query("""SELECT p_size AS pdb_id, max_by(p_brand, p_partkey) FILTER (p_partkey % 6 = 0) AS tcra, max_by(p_brand, p_partkey) FILTER (p_partkey % 6 = 1) AS tcrb, max_by(p_brand, p_partkey) FILTER (p_partkey % 6 = 2) AS peptide,
max_by(p_brand, p_partkey) FILTER (p_partkey % 6 = 3) AS mhc, max_by(p_brand, p_partkey) FILTER (p_partkey % 6 = 4) AS b2m FROM part GROUP BY 1""")
def chain_roles(spark, sf_dir):
    k = F.col("p_partkey") % 6
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("pdb.id"), F.col("p_brand").alias("chain.id"), F.when(k < 2, "TCR").when(k == 2, "PEPTIDE").when(k < 5, "MHC").otherwise("ION").alias("chain.component"),
        F.when(k == 0, "TRA").when(k == 1, "TRB").when(k == 3, "MHCa").otherwise("MHCb").alias("chain.type"), F.lit("MHCI").alias("chain.supertype"), F.col("p_partkey").alias("at"))
    return jobs.chain_roles(rows, "at")


PPV_SQL = "CASE " + " ".join(f"WHEN s <= {t} THEN {p}" for t, p in reversed(list(zip(interface.PPV_THRESHOLDS, interface.PPV, strict=True)))) + f" ELSE {interface.PPV[0]} END"


@query(f"WITH t AS (SELECT p_partkey, (p_partkey % 1000) / 1400e0 AS s FROM part) SELECT p_partkey, {PPV_SQL}::DOUBLE AS ppv FROM t")
def positive_share(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", interface.ppv((F.col("p_partkey") % 1000) / 1400).cast("double").alias("ppv"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 4 > 0 THEN (p_size + p_retailprice) / 2 WHEN p_size % 3 > 0 THEN p_size WHEN p_size % 4 > 0 THEN p_retailprice END AS avgipae FROM part""")
def pair_means(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("double")).alias("avgipae_a"), F.when(F.col("p_size") % 4 > 0, F.col("p_retailprice")).alias("avgipae_b"))
    return ml.quality_features(rows).select("p_partkey", "avgipae")


@query("""SELECT n_name AS TCR_name, n_nationkey::VARCHAR AS TRAV, '' AS TRBV FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') UNION ALL SELECT r_name, '', '' FROM region""")
def layout_and_append(spark, sf_dir):
    """Rows not done yet in a fixed layout, with others appended."""
    done = table(spark, sf_dir, "region").where("r_name like 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    rows = sets.not_done(table(spark, sf_dir, "nation"), done, ["n_regionkey"]).select("n_name", "n_nationkey")
    more = table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"))
    return sets.with_layout(sets.appended(rows, more), ["TCR_name", "TRAV", "TRBV"], {"n_name": "TCR_name", "n_nationkey": "TRAV"})


@query("""WITH b AS (SELECT user_id, event_type, max(value) AS v, 0 AS k FROM events WHERE event_id % 2 = 0 GROUP BY ALL UNION ALL SELECT user_id, event_type, min(value), 1 FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT user_id::VARCHAR AS tcr_id, event_type AS part, max_by(v, k) AS v FROM b GROUP BY ALL""")
def upserted(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    make = lambda df, v: df.groupBy(F.col("user_id").cast("string").alias("tcr_id"), F.col("event_type").alias("part")).agg(v.alias("v")).withColumn("region", F.lit(""))
    return embeddings.upsert(make(rows.where("event_id % 2 = 0"), F.max("value")), make(rows.where("event_id % 3 = 0"), F.min("value"))).select("tcr_id", "part", "v")


@query("""WITH s AS (SELECT vec_id // 4 AS i, vec_id % 4 AS k, embedding AS e FROM embeddings)
SELECT a.i::VARCHAR AS tcr_id, round(a.e[1]::DOUBLE, 6) AS a1, round(b.e[1]::DOUBLE, 6) AS b1, round(c.e[2]::DOUBLE, 6) AS c2, round(d.e[64]::DOUBLE, 6) AS d64 FROM s a JOIN s b ON a.i = b.i AND a.k = 0 AND b.k = 1 JOIN s c ON c.i = a.i AND c.k = 2 JOIN s d ON d.i = a.i AND d.k = 3 WHERE a.i % 10 <> 3""")
def joined_vectors(spark, sf_dir):
    """Vectors of ids that have every part, joined in order; one with a NaN is as good as none."""
    k, i = F.col("vec_id") % 4, F.expr("vec_id div 4")
    vec = F.when((k == 2) & (i % 10 == 3), F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding").cast("array<float>"))
    store = table(spark, sf_dir, "embeddings").select(i.cast("string").alias("tcr_id"), F.get(F.array(*[F.lit(p) for p in ("TCRA", "TCRB", "Epitope", "MHC_seq")]), k.cast("int")).alias("part"), F.when(k < 2, "cdr3").otherwise("").alias("region"), vec.alias("vec"))
    got = embeddings.vectors_of(store, "cdr3s")
    at = lambda n, name: F.round(F.get("x", F.lit(n)).cast("double"), 6).alias(name)
    return got.select("tcr_id", at(0, "a1"), at(64, "b1"), at(129, "c2"), at(255, "d64"))


LOOPS = {"CDR1a": ("p_brand", "n_name"), "CDR2a": ("substr(p_type, 1, 6)", "substr(n_name, 1, 3)"), "CDR3a": ("p_type", "upper(n_name)"), "CDR1b": ("substr(p_name, 1, 5)", "n_name"), "CDR2b": ("p_brand", "substr(n_name, 2, 4)"), "CDR3b": ("substr(p_name, 1, 8)", "n_name")}
_all = " + ".join(f"levenshtein({a}, {b})" for a, b in LOOPS.values())


@query("SELECT p_partkey::VARCHAR AS tcr_id, " + ", ".join(f"min(levenshtein({a}, {b}))::DOUBLE AS tcrdist_{r}_min, round(avg(levenshtein({a}, {b})), 6) AS tcrdist_{r}_mean" for r, (a, b) in list(LOOPS.items())[:3]) + f", min({_all})::DOUBLE AS tcrdist_all_min, round(avg({_all}), 6) AS tcrdist_all_mean, max({_all})::DOUBLE AS tcrdist_all_max FROM part, nation GROUP BY p_partkey")
def loop_distances(spark, sf_dir):
    """Distances by region and over all six, from every receptor to a panel."""
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("tcr_id"), *[F.expr(a).alias(r) for r, (a, _) in LOOPS.items()])
    refs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("tcr_id"), *[F.expr(b).alias(r) for r, (_, b) in LOOPS.items()])
    got = similarity.loop_distances(similarity.receptor_table(q), similarity.receptor_table(refs))
    names = [f"tcrdist_{r}_{s}" for r in list(LOOPS)[:3] for s in ("min", "mean")] + [f"tcrdist_all_{s}" for s in ("min", "mean", "max")]
    return got.select("tcr_id", *[r6(F.col(c)).alias(c) for c in names])


_letters = lambda text, n: f"substr(regexp_replace(upper({text}), '[^A-Z]', '', 'g'), 1, {n})"
SPELT = {"CDR1a": ("p_brand || p_type", "6 + p_partkey % 3", 7), "CDR2a": ("p_name", "5 + p_partkey % 4", 6), "CDR3a": ("p_type", "8 + p_partkey % 7", 12), "CDR1b": ("p_type || p_brand", "4 + p_partkey % 4", 5), "CDR2b": ("p_type", "6", 6), "CDR3b": ("p_name || p_type", "3 + p_partkey % 12", 9)}


def _weighted_sql() -> str:
    """The same distances as sums over lists of places, with classes of letters in place of a matrix."""
    classes = "".join(str(i) for i, g in enumerate(similarity.LIKE) for _ in g)
    cell = lambda i, j: f"CASE WHEN s[{i}] = l[{j}] THEN 0 WHEN translate(s[{i}], '{''.join(similarity.LIKE)}', '{classes}') = translate(l[{j}], '{''.join(similarity.LIKE)}', '{classes}') THEN 3 ELSE 4 END"
    total = lambda places, c: f"coalesce(list_sum(list_transform({places}, lambda i: {c})), 0)"

    def distance(region: str) -> str:
        t0, t1 = similarity.TRIMMED if region.startswith("CDR3") else (0, 0)
        if region.startswith("CDR3"):
            out = "greatest(ceil((10 - n) / 2.0)::INT, 0)"
            low, high = f"5 - {out}", f"n - 5 + {out}"
        else:
            low = high = "least(6, 3 + floor((n - 5) / 2.0)::INT)"
        one = total(f"range({t0} + 1, g + 1)", cell("i", "i")) + " + " + total(f"range({t1} + 1, n - g + 1)", cell("n + 1 - i", "m + 1 - i"))
        same = total(f"range({t0} + 1, n - {t1} + 1)", cell("i", "i"))
        return f"SELECT id, '{region}' AS region, CASE WHEN n = m THEN {same} ELSE list_min(list_transform(range({low}, {high} + 1), lambda g: {one})) + (m - n) * 4 END::DOUBLE AS d FROM (SELECT *, len(s) AS n, len(l) AS m FROM (SELECT id, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l, ref FROM p WHERE region = '{region}'))"

    loops = " UNION ALL ".join(f"SELECT p_partkey::VARCHAR AS id, n_nationkey AS ref, '{r}' AS region, {_letters(a, n)} AS a, {_letters('n_name || n_name', k)} AS b FROM part, nation" for r, (a, n, k) in SPELT.items())
    scored = " UNION ALL ".join(distance(r).replace("SELECT id,", "SELECT id, ref,", 1) for r in SPELT)
    stats = ", ".join(f"min(d) FILTER (region = '{r}') AS tcrdist_{r}_min, round(avg(d) FILTER (region = '{r}'), 6) AS tcrdist_{r}_mean, max(d) FILTER (region = '{r}') AS tcrdist_{r}_max" for r in SPELT)
    return f"WITH p AS ({loops}), d AS ({scored}), t AS (SELECT id, ref, sum(d) AS d FROM d GROUP BY ALL), w AS (SELECT id, min(d) AS lo, round(avg(d), 6) AS me, max(d) AS hi FROM t GROUP BY id) SELECT d.id AS tcr_id, {stats}, any_value(lo) AS tcrdist_all_min, any_value(me) AS tcrdist_all_mean, any_value(hi) AS tcrdist_all_max FROM d JOIN w USING (id) GROUP BY d.id"


@query(_weighted_sql())
def weighted_loop_distances(spark, sf_dir):
    """Substitution-weighted distances of six loops, gaps placed by region, from every receptor to a panel."""
    cut = lambda text, n: F.substring(F.regexp_replace(F.upper(F.expr(text)), "[^A-Z]", ""), F.lit(1), F.expr(str(n)))
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("tcr_id"), *[cut(a, n).alias(r) for r, (a, n, _) in SPELT.items()])
    refs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("tcr_id"), *[cut("n_name || n_name", k).alias(r) for r, (_, _, k) in SPELT.items()])
    kernels = similarity.weighted_kernels(similarity.residue_distances(similarity.grouped_scores(similarity.LIKE)))
    got = similarity.loop_distances(similarity.receptor_table(q), similarity.receptor_table(refs), kernels)
    return got.select("tcr_id", *[(r6(F.col(c)) if c.endswith("mean") else F.col(c)).alias(c) for c in got.columns if c != "tcr_id"])


@query("""SELECT c_custkey::VARCHAR AS tcr_id, 'pdb = ' || c_custkey || '.pdb|mol = ' || CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'P' || c_nationkey || ',M,B' END AS receptor FROM customer""")
def docking_specs(spark, sf_dir):
    """Chain mappings read from JSON, and each complex' docking job; those without a mapping have none."""
    chains = "'{\"peptide_chain\": \"P' || n_nationkey || '\", \"mhc_chain\": \"M\", \"b2_chain\": \"B\", \"tcra_chain\": \"D\"' || CASE WHEN n_nationkey % 2 = 0 THEN ', \"tcrb_chain\": \"E\"' ELSE ', \"tcrb_chain\": \"F\"' END || '}'"
    text = table(spark, sf_dir, "nation").where("n_nationkey % 5 > 0").select(F.expr("'{\"k' || n_nationkey || '\": ' || " + chains + " || '}'").alias("value"))
    names = table(spark, sf_dir, "customer").select(F.expr("'k' || c_nationkey || '_' || c_custkey").alias("name"), "c_custkey")
    got = jobs.docking_specs(names.select("name"), jobs.parse_mapping(text), "prefix_before_underscore")
    part = F.regexp_extract("spec", r"(?s)\[receptor\]\npdb = [^_]*_([^\n]*)\nmol = ([^\n]*)\n", 1), F.regexp_extract("spec", r"(?s)\[receptor\]\npdb = [^\n]*\nmol = ([^\n]*)\n", 1)
    return got.select(F.substring_index("name", "_", -1).alias("tcr_id"), F.concat(F.lit("pdb = "), part[0], F.lit("|mol = "), part[1]).alias("receptor"))


@query("""SELECT 'm' || n_regionkey AS path, 'b' || n_regionkey AS batch, n_name AS name, '/p/' || n_name || '.pdb' AS pdb_path, CASE WHEN n_regionkey = 2 THEN 'unexpected row: short' END AS error FROM nation WHERE n_regionkey <> 4
UNION ALL SELECT 'm2', 'short', NULL, NULL, 'unexpected row: short'""")
def manifest_rows(spark, sf_dir):
    """Manifests made line by line and read, with a short row among one's."""
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 4")
    rows = n.select(F.expr("'m' || n_regionkey").alias("path"), (F.col("n_nationkey") + 1).cast("int").alias("line"), F.expr("'b' || n_regionkey || '\\t' || n_name || '\\t/p/' || n_name || '.pdb'").alias("text"))
    heads = rows.select("path").distinct().select("path", F.lit(0).alias("line"), F.lit("batch\tname\tpdb_path").alias("text"))
    more = rows.where("path = 'm2'").limit(1).select("path", F.lit(999).alias("line"), F.lit("short").alias("text"))
    return jobs.parse_manifest(rows.unionByName(heads).unionByName(more)).select("path", "batch", "name", "pdb_path", "error")


@query("""WITH t AS (SELECT p_partkey, upper(replace(p_type, ' ', '')) AS s FROM part) SELECT p_partkey, regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]+') AS ok, position('AN' IN s) - 1 AS at, p_brand || '_' || replace('HLA-' || p_type, 'HLA-', '') AS pmhc,
'HLA-' || replace(p_type, ' ', '') AS predictor, array_to_string(list_sort(list_filter(list_distinct(string_split(s, '')), lambda c: c NOT IN ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y'))), '') AS odd FROM t JOIN part USING (p_partkey)""")
def sequence_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("s", F.upper(F.replace("p_type", F.lit(" "), F.lit(""))))
    s = F.col("s")
    return rows.select("p_partkey", sequences.is_protein(s).alias("ok"), sequences.find(s, F.lit("AN")).cast("long").alias("at"), keys.pmhc_key(F.col("p_brand"), F.concat(F.lit("HLA-"), "p_type")).alias("pmhc"),
        sequences.predictor_allele(F.col("p_type")).alias("predictor"), F.array_join(F.array_sort(F.filter(sequences.odd_letters(s), lambda c: c != "")), "").alias("odd"))


@query("""SELECT o_custkey AS complex_id, array_to_string(list_sort(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(list(o_orderstatus), x))), ',') AS missing FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) < 3""")
def missing_roles(spark, sf_dir):
    roles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("complex_id"), F.col("o_orderstatus").alias("role"))
    return structure.missing_roles(roles, ("F", "O", "P"))


@query("""SELECT c_custkey::VARCHAR AS key, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'segment' END AS error FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'""")
def failed_checks(spark, sf_dir):
    checks = {"negative": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "MACHINERY"}
    return sinks.dead_letters(table(spark, sf_dir, "customer"), "c_custkey", checks)[1]


@query("""SELECT l_orderkey::VARCHAR AS Model, l_linenumber::VARCHAR AS Chn1, printf('%-4s  %-4s  %3s  %3s  %5s  %8.6f  %8.6f  %8.6f  %5.3f  %8.6f  %8.4f  %8.4f  %8.4f  %5d  %5d  %5d  %6.2f  %6.2f  %6.2f  %5d  %5d  %5d  %5d  %s', l_linenumber::VARCHAR, 'B', '10', '10', 'asym',
min(l_quantity) / 64, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, count(*)::INT, 0, 0, 0.0, 0.0, 0.0, 0, 0, 0, 0, l_orderkey::VARCHAR) AS line FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def report_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("Model"), F.col("l_linenumber").cast("string").alias("Chn1")).agg((F.min("l_quantity") / 64).alias("ipSAE"), F.count("*").alias("n0res"))
    given = {"Chn2": "B", "PAE": "10", "Dist": "10", "Type": "asym"}
    rows = rows.withColumns({c: F.lit(v) for c, v in given.items()})
    rows = rows.withColumns({c: F.lit(None).cast("int" if f.endswith("d") else "double") for c, f in interface.REPORT if c not in rows.columns})
    return interface.report_lines(rows).select("Model", "Chn1", "line")


@query("""WITH d AS (SELECT n_name AS a, min(r_name) AS s FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1), q AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE n_name END AS a, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey::VARCHAR AS tcr_id, coalesce(d.s, '') AS MHC_seq FROM q LEFT JOIN d USING (a)""")
def allele_sequences(spark, sf_dir):
    """Sequences by allele from a dictionary with repeated alleles."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(joins.lookup_side(names), "c_nationkey").select(F.col("c_custkey").cast("string").alias("tcr_id"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("n_name")).alias("MHC_allele"))
    first = names.join(table(spark, sf_dir, "region"), "r_regionkey").select(F.col("n_name").alias("mhc_allele"), F.col("r_name").alias("mhc_seq"), F.lit(1).alias("ordinal"))
    again = first.select("mhc_allele", F.lit("zzz").alias("mhc_seq"), F.lit(2).alias("ordinal"))
    return scoring.add_mhc_sequences(rows, first.union(again)).select("tcr_id", "MHC_seq")


@query("""WITH m AS (SELECT p_name AS q, CASE WHEN p_size % 4 = 0 THEN 'sp|A' || p_partkey || '|X' ELSE 'tr|B' || p_partkey || '|X' END AS s, p_partkey AS l FROM part)
SELECT q AS Query, regexp_extract(s, '[|]([^|]*)[|]', 1) AS uniprot_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (s LIKE 'sp%')::INT DESC, l) AS r FROM m) WHERE r = 1""")
def best_proteins(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("Query"), F.expr("case when p_size % 4 = 0 then 'sp|A' || p_partkey || '|X' else 'tr|B' || p_partkey || '|X' end").alias("Subject"), F.col("p_partkey").alias("line"))
    return scoring.best_proteins(rows)
