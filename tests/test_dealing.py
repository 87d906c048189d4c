"""How rows are dealt: what becomes more of in a task is dealt finely, and once."""

from pyspark.sql import functions as F

from corvane import queries
from corvane.functions import ranges
from corvane.operators import interface


def test_dealt_by_size(spark):
    rows = spark.range(1000).select((F.col("id") % 97).alias("k"), "id")
    assert ranges.by_key(rows, "k").rdd.getNumPartitions() == 4  # the session's
    assert ranges.by_key(rows, "k", most=1000).rdd.getNumPartitions() >= 8
    assert sorted(ranges.by_key(rows, "k", most=1000).collect()) == sorted(rows.collect())


def test_pairs_stay_where_their_lines_were_dealt(spark, sf_dir):
    for query in (queries.lis_by_pair, queries.symmetric_best, queries.ipsae_by_pair):
        df = query(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        own = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
        assert own and all("chain1" not in x and "chain2" not in x for x in own)


def test_ipsae_without_keys_is_that_of_one_model(spark):
    rows = [("A", i, "B", j, float((7 * i + 3 * j) % 17)) for i in range(6) for j in range(5)] + [("B", j, "A", i, float((5 * i + 2 * j) % 13)) for i in range(6) for j in range(5)] + [("A", 1, "C", 1, 3.0)]
    pairs = spark.createDataFrame(rows, "chain1 string, i int, chain2 string, j int, pae double")
    lengths = spark.createDataFrame([("A", 6), ("B", 5)], "chain string, length int")  # C has none
    keyed = lambda df: df.withColumn("m", F.col(df.columns[0]) == "?")
    one = sorted(interface.ipsae(pairs, lengths).collect())
    by = [interface.ipsae(keyed(pairs), keyed(lengths), ["m"], dealt=d).drop("m") for d in (False,)]
    by.append(interface.ipsae(keyed(pairs).repartition(3, "m"), keyed(lengths), ["m"], dealt=True).drop("m"))
    assert len(one) == 2 and all(sorted(x.collect()) == one for x in by)


def test_interface_scores_meet_each_pair_in_one_join(spark):
    rows = [(1, "AB"[i % 2], i, None if i == 4 else float(i), i / 10, 0.01 * (i % 3), 0.0) for i in range(12)] + [(2, "A", 0, 1.0, 0.0, 0.0, 0.0), (2, "C", 1, 3.0, 0.1, 0.0, 0.0), (3, "A", 0, 1.0, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "m int, chain string, residue int, b double, x double, y double, z double")
    got = interface.interface_scores(points, ["m"], "chain", 0.25)
    want = {}
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1] and sum((p[k] - q[k]) ** 2 for k in (4, 5, 6)) ** 0.5 <= 0.25:
                n, seen = want.setdefault((p[0], p[1], q[1]), [[0], set()])
                n[0] += 1
                seen.update({(0, p[2], p[3]), (1, q[2], q[3])})
    mean = lambda seen: sum(x[2] for x in seen if x[2] is not None) / sum(x[2] is not None for x in seen)
    found = {(r.m, r.chain_from, r.chain_to): (r.n_pairs, round(r.mean_plddt, 9)) for r in got.collect()}
    assert found == {k: (n[0], round(mean(seen), 9)) for k, (n, seen) in want.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_sums_of_positions_are_made_where_lines_were_dealt(spark, sf_dir):
    plan = queries.structural_slice(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    own = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "l_orderkey" in x.split("),")[0].split("hashpartitioning")[1]]
    assert len(own) == 1 and "l_suppkey" not in own[0].split("hashpartitioning")[1]
