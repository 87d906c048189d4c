"""Steps of the plans on the generic test tables, with their SQL: trimming, lookups, evaluation, listings, reports, walks.

Bindings: orders are complexes or files, their lines atoms; customers candidates, nations dictionaries; embeddings confidences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import aggregates, filters, interface, joins, ml, sets, sinks, structure
from .plans import scoring
from .queries import query, r6, table
from .sources import jobs, reports

ATOMS = """SELECT l_orderkey::VARCHAR AS complex_id, 0 AS model_number, chr((65 + l_suppkey % 4)::INT) AS chain, o // 2 AS res_seq, CASE WHEN o % 4 = 1 THEN 'A' END AS icode, 2.0 * l_quantity AS b, o AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem)"""


def atoms(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(w))
    return rows.select(F.col("l_orderkey").cast("string").alias("complex_id"), F.lit(0).alias("model_number"), F.chr((65 + F.col("l_suppkey") % 4).cast("int")).alias("chain"),
                       F.expr("cast(ord div 2 as int)").alias("res_seq"), F.when(F.col("ord") % 4 == 1, "A").alias("icode"), (2.0 * F.col("l_quantity")).alias("b"), "ord")


@query(f"""WITH a AS ({ATOMS}), r AS (SELECT complex_id, chain, res_seq, icode, min(b) AS low, min(ord) AS pos FROM a GROUP BY ALL),
g AS (SELECT complex_id, chain, min(pos) AS f, max(pos) AS l FROM r WHERE low >= 60 GROUP BY ALL),
k AS (SELECT r.* FROM r LEFT JOIN g USING (complex_id, chain) WHERE chain IN ('C', 'D') OR pos BETWEEN f AND l)
SELECT a.complex_id, a.chain, a.ord::BIGINT AS ord FROM a JOIN k ON a.complex_id = k.complex_id AND a.chain = k.chain AND a.res_seq = k.res_seq AND a.icode IS NOT DISTINCT FROM k.icode""")
def trimmed_terminals(spark, sf_dir):
    """Atoms without the uncertain residues at the ends of each chain; some chains stay whole."""
    return filters.trim_terminals(atoms(spark, sf_dir), 60.0, ("C", "D")).select("complex_id", "chain", F.col("ord").cast("long").alias("ord"))


@query(f"SELECT complex_id, chain, round(avg(b), 6) AS plddt FROM ({ATOMS}) GROUP BY ALL")
def chain_plddt(spark, sf_dir):
    return interface.mean_plddt(atoms(spark, sf_dir), ["complex_id"], "chain").select("complex_id", "chain", r6(F.col("plddt")).alias("plddt"))


@query(f"WITH c AS (SELECT DISTINCT complex_id, chain FROM ({ATOMS})) SELECT complex_id, a.chain AS chain1, b.chain AS chain2 FROM c a JOIN c b USING (complex_id) WHERE a.chain <> b.chain")
def chain_grid(spark, sf_dir):
    return interface.pair_grid(atoms(spark, sf_dir).select("complex_id", "chain").distinct(), ["complex_id"])


@query("""WITH s AS (SELECT o_custkey, max(o_orderkey) AS best, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey::VARCHAR AS tcr_id, c_nationkey::BIGINT AS n, best::BIGINT AS best FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def stitched_candidates(spark, sf_dir):
    """Candidates with assembled sequences; a column that both have is the candidates'."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tcr_id"), F.col("c_nationkey").cast("long").alias("n"))
    more = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("tcr_id")).agg(F.max("o_orderkey").cast("long").alias("best"), F.count("*").alias("n"))
    return scoring.stitched(own, more)


@query("""WITH d AS (SELECT c_custkey AS ordinal, 'HLA-A*0' || c_custkey % 7 || ':0' || c_custkey % 5 || ':01' AS a, c_mktsegment || c_nationkey AS s FROM customer WHERE c_nationkey % 3 > 0),
f AS (SELECT s, arg_min(a, ordinal) AS a FROM d GROUP BY s)
SELECT c_custkey AS tcr_id, regexp_extract(a, '^([^:]*:[^:]*)', 1) AS MHC_allele FROM (SELECT c_custkey, c_mktsegment || c_nationkey AS s FROM customer) LEFT JOIN f USING (s)""")
def alleles_of_sequences(spark, sf_dir):
    """The allele, in two fields, of the first dictionary row with the same sequence."""
    seq = F.concat("c_mktsegment", F.col("c_nationkey"))
    rows = table(spark, sf_dir, "customer")
    names = F.concat(F.lit("HLA-A*0"), F.col("c_custkey") % 7, F.lit(":0"), F.col("c_custkey") % 5, F.lit(":01"))
    dictionary = rows.where("c_nationkey % 3 > 0").select(F.col("c_custkey").alias("ordinal"), names.alias("mhc_allele"), seq.alias("mhc_seq"))
    return scoring.allele_of_sequence(rows.select(F.col("c_custkey").alias("tcr_id"), seq.alias("MHC_seq"), F.lit("old").alias("MHC_allele")), dictionary).select("tcr_id", "MHC_allele")


@query("SELECT c_custkey, coalesce(n_name, 'human') AS species FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey")
def overridden(spark, sf_dir):
    own = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("species"))
    return joins.override(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), own, "c_nationkey", "species", F.lit("human")).select("c_custkey", "species")


AUC_SQL = """g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM t GROUP BY s),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, tp / (tp + fp)::DOUBLE AS prec, CASE WHEN tp - p + fp - n > 0 THEN (tp - p) / (tp - p + fp - n)::DOUBLE ELSE 1.0 END AS prec0 FROM c)
SELECT round(sum(n * (tp + tp - p) / 2.0) / (max(pos) * max(neg)), 9) AS roc_auc, round(sum(p * (prec + prec0) / 2) / max(pos), 9) AS pr_auc FROM q"""


@query(f"""WITH l AS (SELECT l_partkey AS id, max(CASE WHEN l_quantity > 45 THEN 1 WHEN l_quantity > 3 THEN 0 END) AS y FROM lineitem GROUP BY 1),
t AS (SELECT y, p_retailprice AS s FROM l JOIN part ON p_partkey = id WHERE y IS NOT NULL AND p_size > 5), {AUC_SQL}""")
def evaluated(spark, sf_dir):
    """Predictions against labels, which come several to a complex and may be null."""
    label = F.when(F.col("l_quantity") > 45, 1).when(F.col("l_quantity") > 3, 0)
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tcr_id"), label.alias("Label"))
    got = scoring.evaluate(table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("tcr_id"), F.col("p_retailprice").alias("probs")), labels)
    return got.select(*[F.round(c, 9).alias(c) for c in ("roc_auc", "pr_auc")])


@query("""WITH a AS (SELECT p_partkey AS id, p_retailprice AS probs_str FROM part WHERE p_size < 30), b AS (SELECT p_partkey AS id, p_size / 50.0 AS probs_seq FROM part WHERE p_size > 10), j AS (SELECT coalesce(a.id, b.id) AS id, probs_str, probs_seq FROM a FULL JOIN b USING (id))
SELECT id::VARCHAR AS tcr_id, coalesce(probs_str, 0)::DOUBLE AS probs_str, coalesce(probs_seq, 0)::DOUBLE AS probs_seq FROM j UNION ALL SELECT DISTINCT (-l_suppkey)::VARCHAR, 0, 0 FROM lineitem WHERE -l_suppkey NOT IN (SELECT id FROM j)""")
def filled_predictions(spark, sf_dir):
    """Predictions of two models side by side, with zeros for what is missing and rows for complexes without any."""
    part = table(spark, sf_dir, "part").withColumn("tcr_id", F.col("p_partkey").cast("string"))
    by = {"str": part.where("p_size < 30").select("tcr_id", F.col("p_retailprice").cast("double").alias("probs")), "seq": part.where("p_size > 10").select("tcr_id", (F.col("p_size") / 50.0).cast("double").alias("probs"))}
    ids = table(spark, sf_dir, "lineitem").select((-F.col("l_suppkey")).cast("string").alias("tcr_id")).union(part.select("tcr_id").where("p_size < 30"))
    return scoring.final_tables(ids, by).predictions_filled


@query("""SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 > 0) AS first_price FROM orders GROUP BY 1""")
def first_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")))
    return rows.groupBy("o_custkey").agg(aggregates.first_non_null("price", "o_orderkey").alias("first_price"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_totals(spark, sf_dir):
    return aggregates.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status")


def _mean_sql(cells: list[int]) -> str:
    return "(" + " + ".join(f"embedding[{i}]::DOUBLE" for i in cells) + f") / {len(cells)}"


@query(f"SELECT vec_id, round({_mean_sql([1, 2, 3, 4, 5])}, 6) AS iptm_mean, round({_mean_sql([6, 7, 8, 9, 10])}, 6) AS ptm_mean, round({_mean_sql([4, 5, 14, 15])}, 6) AS iptm_tcrpmhc FROM embeddings")
def summary_confidences(spark, sf_dir):
    """Means of a model's summary confidences: by chain, and of four cells of the chain pairs' matrix."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(wide, 1, 5).alias("chain_iptm"), F.slice(wide, 6, 5).alias("chain_ptm"), F.array(*[F.slice(wide, 5 * i + 1, 5) for i in range(5)]).alias("chain_pair_iptm"))
    return interface.summary_means(rows).select("vec_id", *[r6(F.col(c)).alias(c) for c in ("iptm_mean", "ptm_mean", "iptm_tcrpmhc")])


@query("""SELECT 'c' || o_custkey || '_x' AS tcr_id, (o_orderkey % 5)::INT AS model_number, 'dir/c' || o_custkey || '_x_' || o_orderkey % 5 || '.pdb' AS path FROM orders WHERE o_orderkey % 4 > 1""")
def listed_models(spark, sf_dir):
    """Ids and model numbers of a listing; merged files and files without a number aren't models."""
    name = F.expr("'c' || o_custkey || '_x' || CASE o_orderkey % 4 WHEN 0 THEN '_merged_1' WHEN 1 THEN '_none' ELSE '_' || o_orderkey % 5 END")
    return jobs.model_paths(table(spark, sf_dir, "orders").select(F.concat(F.lit("dir/"), name, F.lit(".pdb")).alias("path")))


@query("SELECT 'd/f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.pdb' WHEN 1 THEN '.cif' ELSE '.txt' END AS path FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND (o_orderkey // 10) % 10 = 2 AND o_orderkey BETWEEN 100 AND 999")
def pattern_files(spark, sf_dir):
    path = F.expr("'d/f' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.pdb' WHEN 1 THEN '.cif' ELSE '.txt' END")
    return jobs.kept_files(table(spark, sf_dir, "orders").select(path.alias("path")), ["*.pdb", "f?2?.[c-d]if"])


@query("""WITH r AS (SELECT o_orderkey % 50 AS f, o_orderkey, o_totalprice FROM orders)
SELECT 'p' || f AS path, o_orderkey::BIGINT AS line, 'A' AS Chn1, chr((66 + o_orderkey % 3)::INT) AS Chn2, CASE WHEN o_orderkey % 2 = 0 THEN 'asym' ELSE 'max' END AS Type, (o_orderkey % 100 / 100.0)::DOUBLE AS ipSAE, (o_orderkey % 30)::INT AS n0res FROM r WHERE o_orderkey % 7 > 0""")
def pair_score_reports(spark, sf_dir):
    """Reports whose columns come in the order of their header, with rows that aren't scores."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("f"), F.col("o_orderkey").alias("line"))
    text = F.when(F.col("line") % 7 == 0, "  a note of no columns").otherwise(F.expr("format_string('%s A %.2f %s %d', IF(line % 2 = 0, 'asym', 'max'), line % 100 / 100D, chr(cast(66 + line % 3 as int)), line % 30)"))
    head = rows.select("f").distinct().select("f", F.lit(-1).cast("long").alias("line"), F.lit("Type Chn1 ipSAE Chn2 n0res").alias("text"))
    lines = rows.select("f", "line", text.alias("text")).unionByName(head).select(F.concat(F.lit("p"), F.col("f")).alias("path"), F.col("line").cast("long").alias("line"), "text")
    return reports.parse_pair_scores(lines).select("path", "line", "Chn1", "Chn2", "Type", "ipSAE", "n0res")


@query("SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderpriority NOT LIKE '1%'")
def distinct_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("a"), F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority")).alias("b"))
    return sets.distinct_values(rows, "a", "b")


@query("SELECT p_partkey::VARCHAR AS tcr_id, 'x' AS kind, p_retailprice AS probs FROM part")
def ranked_predictions(spark, sf_dir):
    """Unique predictions, best first, with a constant column that isn't there yet."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("tcr_id"), F.col("p_retailprice").alias("probs"))
    return ml.ranked(sets.with_default(joins.reject_duplicates(rows, ["tcr_id"]), "kind", F.lit("x")))


@query("""WITH f AS (SELECT 'a' || o_orderkey % 9 || '/n' || o_orderkey % 400 || '.pdb' AS path, 'n' || o_orderkey % 400 || '.pdb' AS name FROM orders) SELECT min(path) AS path, 'out/' || name AS target FROM f GROUP BY name""")
def flat_targets(spark, sf_dir):
    path = F.expr("'a' || o_orderkey % 9 || '/n' || o_orderkey % 400 || '.pdb'")
    return sinks.output_paths(table(spark, sf_dir, "orders").select(path.alias("path")), "out/")


@query("""WITH RECURSIVE b AS (SELECT p_partkey AS id, substr(p_name, 1, 12) AS n, p_type AS s FROM part),
w AS (SELECT id, n, s, 0 AS i, 0 AS pos, NULL::INT AS hit FROM b UNION ALL
SELECT id, n, s, i + 1, CASE WHEN pos < len(s) AND strpos(substr(s, pos + 1), n[i + 1]) > 0 THEN pos + strpos(substr(s, pos + 1), n[i + 1]) ELSE len(s) END,
  CASE WHEN pos < len(s) AND strpos(substr(s, pos + 1), n[i + 1]) > 0 THEN pos + strpos(substr(s, pos + 1), n[i + 1]) END FROM w WHERE i < len(n))
SELECT id, i AS "at", 'n' || i AS label, 's' || hit AS matched FROM w WHERE i > 0""")
def numbering_walk(spark, sf_dir):
    """Numbered letters matched in order to a structure's letters; after one that finds none, none does."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.substring("p_name", 1, 12).alias("n"), F.col("p_type").alias("s"))
    side = lambda c: rows.select("id", F.lit(c).alias("side"), F.explode(F.sequence(F.lit(1), F.length(c))).alias("at"), F.col(c).alias("t")).select("id", "side", "at", F.expr("substr(t, at, 1)").alias("aa"), F.concat(F.lit(c), F.col("at")).alias("label"))
    return structure.align_numbering(side("n").unionByName(side("s")), ["id"])
