"""Matrices by rows: what is asked of them needs none whole."""

from rows import plain

from corvane import structure_queries as sq
from corvane.functions import arrays
from corvane.operators import interface, spatial
from pyspark.sql import functions as F


def _whole(rows):
    """The same made-up matrices, a matrix a row."""
    each = sq.cells(rows).groupBy("m").agg(F.array_sort(F.collect_list(F.struct("token", "pae", "contact_probs"))).alias("r"))
    return each.select("m", F.col("r.pae").alias("pae"), F.col("r.contact_probs").alias("contact_probs"))


def test_confidence_by_rows_is_that_of_whole_matrices(spark, sf_dir):
    rows = sq.residues(spark, sf_dir)
    assert "token" in sq.cells(rows).columns
    got, want = (interface.chain_confidence(rows, m, ["m"], 0.25).select("m", "chain", *[F.round(c, 6).alias(c) for c in ("if_plddt", "avgipae", "avgipde", "pdockq2")]).toPandas() for m in (sq.cells(rows), _whole(rows)))
    assert len(got) and plain(got) == plain(want)


def test_trimmed_rows_are_those_of_trimmed_matrices(spark):
    matrix = [[float(10 * i + j) for j in range(7)] for i in range(7)]
    whole = spark.createDataFrame([(1, matrix, [1, 4]), (2, [[5.0]], [])], "m int, pae array<array<double>>, gone array<int>")
    want = whole.select("m", arrays.without(F.col("pae"), F.col("gone")).alias("pae"))
    assert want.where("m = 1").first().pae == [[x for j, x in enumerate(r) if j not in (1, 4)] for i, r in enumerate(matrix) if i not in (1, 4)]
    rows = interface.matrix_rows(whole, ["m"], "pae").join(whole.select("m", "gone"), "m")
    got = interface.rows_without(rows, ["m"], "gone", "pae")
    assert sorted(got.collect()) == sorted(interface.matrix_rows(want, ["m"], "pae").collect())
    tokens = spark.createDataFrame([(1, "AB"[t % 2], t, t) for t in range(6)], "m int, chain string, residue int, token int")
    pairs = {(r.i, r.j): r.pae for r in interface.matrix_pairs(got, tokens, ["m"]).collect()}
    left = [0, 2, 3, 5, 6]
    assert pairs == {(i, j): matrix[left[i]][left[j]] for i in range(5) for j in range(5) if i % 2 != j % 2}


def test_long_rows_are_cut(spark):
    n = 2 * interface.CUT + 3
    rows = spark.createDataFrame([(1, 0, [float(x) for x in range(n)])], "m int, token int, pae array<double>")
    tokens = spark.createDataFrame([(1, "A" if t == 0 else "B", t, t) for t in range(n + 5)], "m int, chain string, residue int, token int")
    got = interface.matrix_pairs(rows, tokens, ["m"]).collect()
    assert {(r.i, r.j): r.pae for r in got} == {(0, j): float(j) for j in range(1, n)} and len(got) == n - 1


def test_no_matrix_is_broadcast_and_points_are_dealt(spark, sf_dir):
    """What matrices are made from is small, and so they look to the planner; points are few, and their pairs are many."""
    for query in (sq.trimmed_matrix, sq.pdockq2_by_chain):
        df = query(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        for line in plan.splitlines():
            assert not ("BroadcastExchange" in line and "pae" in line)
    p = spark.range(50).select((F.col("id") % 2).alias("g"), (F.col("id") / 50).alias("x"), (F.col("id") % 7 / 7).alias("y"), (F.col("id") % 5 / 5).alias("z"))
    pairs = spatial.radius_join(spatial.side(p, "from", ["g"], ["x", "y", "z"]), spatial.side(p, "to", ["g"], ["x", "y", "z"]), ["g"], 0.1)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
