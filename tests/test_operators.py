"""Operators against hand-computed answers and independent NumPy versions."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import arrays, keys, scores, sequences
from corvane.operators import aggregates, embeddings, energies, filters, interface, joins, ml, similarity, sinks, spatial, structure, windows
from corvane.plans import scoring


def test_alleles(spark):
    names = {"HLA-A*02:01:01": "HLA-A*02:01:01", "HLA-A02:01": "HLA-A*02:01", "HLA-B0702": "HLA-B*07:02", "HLA-C07": "HLA-C*07:01", "A*02:01:48": "HLA-A*02:01", "B0702": "HLA-B*07:02", "C07": "HLA-C*07:01", "A*02": "A*02", "H2-Kb": "H2-Kb", " A0201 ": "HLA-A*02:01"}
    df = spark.createDataFrame([(k,) for k in names], "a string").select("a", sequences.normal_allele(F.col("a")).alias("b"))
    assert {r.a: r.b for r in df.collect()} == names


def test_keys(spark):
    df = spark.createDataFrame([("tcr_1_4",), ("x",), ("a_b",), (None,)], "k string")
    rows = keys.split_key(df, "k").collect()
    assert [(r.tcr_id, r.model_number) for r in rows] == [("tcr_1", 4), ("x", 0), ("a", 0), (None, 0)]
    ids = keys.with_ids(spark.range(50).select((F.col("id") * 7 % 50).alias("v")), [F.col("v")]).collect()
    assert sorted((int(r.tcr_id), r.v) for r in ids) == [(i + 1, i) for i in range(50)]


def test_alignment_weights_sum_to_one():
    for n in range(8, 14):
        w = np.array(arrays.alignment_weights(n))
        assert w.shape == (9, 13) and np.allclose(w.sum(1), 1) and not w[:, n:].any()
        if n >= 9:
            assert (w.sum(0)[:n] > 0).all()
    assert [np.flatnonzero(r).tolist() for r in np.array(arrays.alignment_weights(11))] == [[0], [1], [2], [3, 4], [5, 6], [7], [8], [9], [10]]
    assert [np.flatnonzero(r).tolist() for r in np.array(arrays.alignment_weights(8))][3:8] == [[3], [4], [5], [5], [6]]


def test_presets(spark):
    rows = spark.createDataFrame([(1, 0.4, None), (2, 0.5, 0.7), (3, 0.6, 0.9)], "i int, EL_rank double, NetCleave double")
    rows = filters.impute(rows, filters.PMHC_MISSING)
    assert [r.i for r in filters.preset_filter(rows, "EL_rank_strong + NetCleave_strong", filters.PMHC).orderBy("i").collect()] == [1, 2]
    counts = filters.preset_counts(rows, "EL_rank_strong + NetCleave_strong", filters.PMHC).first()
    assert tuple(counts) == (3, 2, 2)
    with pytest.raises(ValueError, match="no 'odd'"):
        filters.preset_filter(rows, "EL_rank_odd", filters.PMHC)


def atoms_of(spark, rows):
    cols = "complex_id string, model_number int, record string, serial int, atom_name string, res_name string, chain string, res_seq int, icode string, x double, y double, z double, occ double, b double, ord long"
    return spark.createDataFrame([("c", 1, "ATOM", i, a, n, ch, rs, ic, float(x), 0.0, 0.0, 1.0, float(b), i) for i, (a, n, ch, rs, ic, x, b) in enumerate(rows)], cols)


def test_trim_terminals(spark):
    rows = [("CA", "ALA", "A", i, None, i, b) for i, b in enumerate([50, 80, 60, 90, 40])] + [("CB", "ALA", "A", 3, None, 3, 95), ("CA", "ALA", "B", 1, None, 0, 10), ("CA", "ALA", "C", 1, None, 0, 10)]
    got = filters.trim_terminals(atoms_of(spark, rows)).collect()
    assert sorted((r.chain, r.res_seq) for r in got) == [("A", 1), ("A", 2), ("A", 3), ("A", 3), ("C", 1)]


def test_joins(spark):
    d = spark.createDataFrame([("A*01:01", "x", 0), ("A*01:01", "y", 1), ("B*07:02:01", "z", 2), ("C*01:01:01:01", "w", 3)], "mhc_allele string, mhc_seq string, ordinal int")
    c = spark.createDataFrame([("1", "A*01:01"), ("2", "B*07:02"), ("3", "C*01:01"), ("4", "D"), ("5", None)], "tcr_id string, MHC_allele string")
    assert {r.tcr_id: r.MHC_seq for r in scoring.add_mhc_sequences(c, d).collect()} == {"1": "x", "2": "z", "3": "w", "4": "", "5": ""}
    a = spark.createDataFrame([(1, None), (2, "k"), (3, "q")], "i int, k string")
    assert sorted(r.i for r in joins.semi_null_safe(a, a.where("i < 3").select("k"), ["k"]).collect()) == [1, 2]
    both = joins.outer_all([a.select("i", F.lit(1.0).alias("p")), spark.createDataFrame([(9, 2.0)], "i int, q double")], ["i"])
    got = {r.i: (r.p, r.q) for r in joins.attach_missing(both, spark.createDataFrame([(7,), (9,)], "i int"), "i").collect()}
    assert got == {1: (1.0, 0.0), 2: (1.0, 0.0), 3: (1.0, 0.0), 7: (0.0, 0.0), 9: (0.0, 2.0)}
    with pytest.raises(ValueError, match="duplicate"):
        joins.reject_duplicates(a.union(a), ["i"])


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([0.3, 1.0, 2.5]))
def test_radius_join_equals_nested_loop(spark, seed, radius):
    r = np.random.default_rng(seed)
    p = np.round(r.normal(0, 2, (60, 3)), 1)
    df = spark.createDataFrame([(int(i), int(i % 2), *map(float, x)) for i, x in enumerate(p)], "i int, g int, x double, y double, z double")
    got = spatial.radius_join(spatial.side(df, "from", ["g"], ["i", "x", "y", "z"]), spatial.side(df, "to", ["g"], ["i", "x", "y", "z"]), ["g"], radius)
    pairs = sorted((a.i_from, a.i_to) for a in got.collect())
    dist = lambda a, b: math.sqrt(sum((u - v) * (u - v) for u, v in zip(p[a].tolist(), p[b].tolist(), strict=True)))
    assert pairs == sorted((a, b) for a in range(60) for b in range(60) if a % 2 == b % 2 and dist(a, b) <= radius)


@pytest.mark.parametrize("block", [1, 5, 512])
def test_radius_join_by_block_equals_nested_loop(spark, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    r = np.random.default_rng(block)
    odd = [(-1e-20, 0, 0), (1.0, 0, 0), (1e30, 0, 0), (1e30, 0, 0), (-1e30, 0, 0), (math.nan, 0, 0), (math.inf, 0, 0), (math.inf, 0, 0), (None, 0, 0)]
    p = [*np.round(r.normal(0, 1, (60, 3)), 1).tolist(), *[(0.5, 0.5, 0.5)] * 9, *odd]
    df = spark.createDataFrame([(i, i % 2 if i < 60 else 1, "ab"[i % 3 == 0] if i % 7 else None, *[x if x is None else float(x) for x in q]) for i, q in enumerate(p)], "i int, g int, chain string, x double, y double, z double")
    a, b = (spatial.side(df, s, ["g"], ["i", "chain", "x", "y", "z"]) for s in ("from", "to"))
    got = spatial.radius_join_by_block(a, b, ["g"], 1.0, (["chain_from", "i_from"], ["chain_to", "i_to"]))
    assert sorted(got.columns) == sorted(spatial.radius_join(a, b, ["g"], 1.0).columns)
    key = lambda t: (t.i_from, t.i_to)
    rows = df.collect()
    dist = lambda a, b: math.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))  # noqa: E731  sum() rounds otherwise
    want = [(a.i, b.i, a.chain, b.chain, dist(a, b)) for a in rows for b in rows if a.g == b.g and None not in (a.x, b.x) and dist(a, b) <= 1.0]
    assert [(t.i_from, t.i_to, t.chain_from, t.chain_to, t.dist) for t in sorted(got.collect(), key=key)] == want


def test_contacts_are_written_in_runs(spark, tmp_path):
    """All pairs are the result, so what a row takes in the files is what the job writes; distances take eight bytes in any order."""
    import pyarrow.parquet as pq

    from corvane import queries

    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in q], int(c)) for i, (q, c) in enumerate(zip(r.uniform(0, 0.15, (1500, 5)), r.integers(0, 10, 1500), strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    queries.radius_contacts(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    parts = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    n = sum(m.num_rows for m in parts)
    taken = sum(m.row_group(g).column(c).total_compressed_size for m in parts for g in range(m.num_row_groups) for c in range(4))
    p = np.array([q for _, q, _ in rows], "float32").astype("float64")[:, :3]
    c = np.array([c for _, _, c in rows])
    assert n == sum(int(((np.sqrt(((p[i] - p) ** 2).sum(1)) <= 0.1) & (c[i] < c)).sum()) for i in range(len(p)))
    assert taken < 1.2 * n, taken / n


def test_radius_is_inclusive_unless_strict(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3.0, 4.0, 0.0)], "i int, x double, y double, z double").withColumn("g", F.lit(1))
    a, b = spatial.side(df.where("i = 1"), "from", ["g"], ["i", "x", "y", "z"]), spatial.side(df.where("i = 2"), "to", ["g"], ["i", "x", "y", "z"])
    assert spatial.radius_join(a, b, ["g"], 5.0).count() == 1
    assert spatial.radius_join(a, b, ["g"], 5.0, strict=True).count() == 0


def test_contacts_to_energies(spark):
    rows = [("CA", "ALA", "D", 1, None, 0, 1), ("CA", "GLY", "C", 2, None, 4, 1), ("CB", "GLY", "C", 2, None, 5, 1), ("CA", "XXX", "C", 3, None, 1, 1), ("CA", "TRP", "A", 5, None, 2, 1)]
    roles = spark.createDataFrame([("c", "D", "tcra"), ("c", "C", "peptide"), ("c", "A", "mhc")], "complex_id string, chain string, role string")
    contacts = spatial.contact_map(atoms_of(spark, rows), roles, 5.0)
    pot = spark.createDataFrame([("tcr_p", "A", "G", -2.0), ("tcr_mhc", "A", "W", 0.5)], "kind string, residue_from string, residue_to string, potential double")
    kinds = energies.contact_kinds(contacts, 5.0)
    assert sorted((r.kind, r.residue_from, r.residue_to, r.atom_to) for r in kinds.collect() if r.kind != "p_mhc") == [("tcr_mhc", "A", "W", "CA"), ("tcr_p", "A", "G", "CA"), ("tcr_p", "A", "G", "CB"), ("tcr_p", "A", "XXX", "CA")]
    peptides = spark.createDataFrame([("c", "GILGFVFTL")], "complex_id string, Epitope string")
    e = energies.complex_energies(energies.with_potential(kinds, pot), peptides).first()
    assert (e.e_tcr_p_all, e.c_tcr_p_all, e.e_tcr_p2, e.c_tcr_p2, e.c_tcr_p3, e.e_tcr_mhc, e.c_tcr_mhc, e.e_tcr_p13) == (-4.0, 3, -4.0, 2, 1, 0.5, 1, 0.0)
    f = energies.structural_features(spark.createDataFrame([e])).first()
    assert f.ratio_2 == pytest.approx(2.0) and f.ratio_1 == 0.0 and f.ratio_mhc == pytest.approx(-0.5)
    assert len(energies.feature_names(["Ele", "Desolv", "VDW", "Total"])) == 24


def test_ipsae_against_numpy(spark):
    r = np.random.default_rng(5)
    sizes = {"A": 40, "B": 12, "C": 30}
    offset = {"A": 0, "B": 40, "C": 52}
    pae = r.uniform(0, 30, (82, 82))
    pae[:40, 52:] *= 0.4
    rows = [(a, i, b, j, float(pae[offset[a] + i - 1, offset[b] + j - 1])) for a in sizes for b in sizes if a != b for i in range(1, sizes[a] + 1) for j in range(1, sizes[b] + 1)]
    pairs = spark.createDataFrame(rows, "chain1 string, i int, chain2 string, j int, pae double")
    lengths = spark.createDataFrame(list(sizes.items()), "chain string, length int")
    got = {(x.chain1, x.chain2): x for x in interface.ipsae(pairs, lengths).collect()}
    d0 = lambda n: max(1.0, 1.24 * (n - 15) ** (1 / 3) - 1.8) if n > 27 else 1.0
    for a in sizes:
        for b in sizes:
            if a == b:
                continue
            m = pae[offset[a] : offset[a] + sizes[a], offset[b] : offset[b] + sizes[b]]
            ok = m < 10
            n0dom = int(ok.any(1).sum() + ok.any(0).sum())
            by = []
            for row, v in zip(m, ok, strict=True):
                d = max(1.0, 1.24 * (max(26, v.sum()) - 15) ** (1 / 3) - 1.8)
                by.append((1 / (1 + (row[v] / d) ** 2)).mean() if v.any() else 0.0)
            x = got[a, b]
            assert x.n0dom == n0dom and x.n0chn == sizes[a] + sizes[b]
            assert x.ipSAE == pytest.approx(max(by)) and x.best == int(np.argmax(by)) + 1
            assert x.ipTM_d0chn == pytest.approx((1 / (1 + (m / d0(sizes[a] + sizes[b])) ** 2)).mean(1).max())
            dom = [(1 / (1 + (row[v] / d0(n0dom)) ** 2)).mean() if v.any() else 0.0 for row, v in zip(m, ok, strict=True)]
            assert x.ipSAE_d0dom == pytest.approx(max(dom))


def test_symmetric_tie_takes_the_later_chain(spark):
    rows = spark.createDataFrame([("A", "B", 0.5, 1), ("B", "A", 0.5, 2), ("A", "C", 0.7, 3), ("C", "A", 0.6, 4)], "chain1 string, chain2 string, s double, n int")
    got = {(r.chain_a, r.chain_b): r.n for r in interface.symmetric_max(rows, [], "s", ["n"]).collect()}
    assert got == {("A", "B"): 2, ("A", "C"): 3}


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(scores.d0(F.lit(27))) == 1.0 and one(scores.d0(F.lit(100))) == pytest.approx(1.24 * 85 ** (1 / 3) - 1.8)
    assert one(scores.d0_of_residue(F.lit(3))) == pytest.approx(max(1, 1.24 * 11 ** (1 / 3) - 1.8))
    assert one(scores.pdockq(F.lit(90.0), F.lit(0))) == 0.0
    assert one(scores.pdockq(F.lit(90.0), F.lit(100))) == pytest.approx(0.724 / (1 + math.exp(-0.052 * (180 - 152.611))) + 0.018)
    assert one(scores.similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(interface.ppv(F.lit(0.9))) == interface.PPV[0] and one(interface.ppv(F.lit(0.0))) == interface.PPV[-1]
    assert str(one(scores.ratio(F.lit(0.0), F.lit(0.0)))) == "0.0"


def affine(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    best = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = 2 if a[i - 1] == b[j - 1] else -1
            up = max(h[i - k, j] - 5 - 0.5 * (k - 1) for k in range(1, i + 1))
            left = max(h[i, j - k] - 5 - 0.5 * (k - 1) for k in range(1, j + 1))
            h[i, j] = max(0, h[i - 1, j - 1] + s, up, left)
            best = max(best, h[i, j])
    return best


@settings(max_examples=60, deadline=None)
@given(st.text("ACD", max_size=14), st.text("ACD", max_size=14))
def test_local_alignment(a, b):
    assert similarity.local_score(a, b) == affine(a, b)


def test_reference_statistics_weigh_by_multiplicity(spark):
    q = spark.createDataFrame([("AAAA",), ("AAAA",), (None,)], "s string")
    r = spark.createDataFrame([("AAAA",), ("AAAC",), ("AAAC",), (None,)], "t string")
    got = similarity.with_reference_stats(q, r, "s", "t", "sim").where("s is not null").collect()
    assert len(got) == 2 and (got[0].sim_min, got[0].sim_max) == (0.75, 1.0) and got[0].sim_mean == pytest.approx(2.5 / 3)
    sw = similarity.reference_stats(q, r, "s", "t", "sw", lambda a, b: similarity.local_similarity(a, b)).first()
    assert (sw.sw_min, sw.sw_max) == (0.75, 1.0)


def test_auc_against_direct_count(spark):
    random.seed(3)
    rows = [(random.randint(0, 1), random.randint(0, 12) / 4) for _ in range(200)]
    got = aggregates.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got.roc_auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    curve = [(0.0, 1.0)]
    for cut in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(s >= cut for s in pos), sum(s >= cut for s in neg)
        curve.append((tp / len(pos), tp / (tp + fp)))
    assert got.pr_auc == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:], strict=False)))
    assert aggregates.auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first().roc_auc is None


def test_windows(spark):
    v = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 30.0), (5, None)], "i int, v double")
    assert {r.i: r.p for r in windows.rank_pct(v, "v", "p").collect()} == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}
    n = spark.createDataFrame([("g", x) for x in (30, 25, 26, 27, 27, 40)], "g string, n int")
    assert windows.islands(n, ["g"], "n").first().ranges == "25-27+30+40"
    c = spark.createDataFrame([(i, k) for i, k in enumerate("AABBA")], "i int, k string").withColumn("g", F.lit(1))
    assert [r.n for r in windows.renumber(c, ["g"], ["i"], ["k"], "n").orderBy("i").collect()] == [1, 1, 2, 2, 3]
    got = windows.chunked(spark.range(10), [F.col("id")], 4).collect()
    assert sorted((r.id, r.chunk) for r in got) == [(i, i // 4) for i in range(10)]


def test_structure(spark):
    rows = [("N", "ALA", "H", 1, None, 0, 9), ("CA", "ALA", "H", 1, None, 1, 9), ("CA", "GLY", "H", 1, "A", 2, 9), ("CA", "LYS", "P", 1, None, 3, 9), ("CA", "TRP", "D", 9, None, 4, 9), ("CA", "MSE", "D", 10, None, 5, 9)]
    roles = spark.createDataFrame([("c", "H", "mhc"), ("c", "P", "peptide"), ("c", "D", "tcra")], "complex_id string, chain string, role string")
    merged = structure.merge_chains(atoms_of(spark, rows), roles).orderBy("ord").collect()
    assert [(r.chain, r.res_seq, r.source_chain) for r in merged] == [("A", 1, "H"), ("A", 1, "H"), ("A", 2, "H"), ("A", 3, "P"), ("B", 1, "D"), ("B", 2, "D")]
    assert [tuple(r) for r in structure.missing_roles(roles).collect()] == [("c", "tcrb")]
    assert {(r.chain, r.sequence) for r in structure.sequences(atoms_of(spark, rows)).collect()} == {("H", "AG"), ("P", "K"), ("D", "WX")}
    full = spark.createDataFrame([("k", "A", "MAVG"), ("k", "B", "LLK"), ("k", "C", "PP")], "k string, chain string, sequence string")
    seen = spark.createDataFrame([("k", "A", "AV"), ("k", "B", "LLK")], "k string, chain string, sequence string")
    assert structure.removed_indices(full, seen, ["k"]).first().removed == [0, 3, 7, 8]
    assert structure.removed_indices(full, seen.withColumn("sequence", F.lit("QQ")), ["k"]).first().removed is None


def test_comparison_of_structures(spark):
    r = np.random.default_rng(1)
    base = r.normal(0, 6, (40, 3))
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved = base @ q + 3
    shifted = base.copy()
    shifted[20:] += 4
    cols = "p int, side string, chain string, res_seq int, atom_name string, x double, y double, z double"
    rows = lambda p, side, xyz: [(p, side, "A" if i < 20 else "B", i, "CA", *map(float, v)) for i, v in enumerate(xyz)]
    data = rows(1, "native", base) + rows(1, "model", moved) + rows(2, "native", base) + rows(2, "model", shifted) + rows(3, "native", base)
    got = {x.p: x for x in structure.compare_pairs(spark.createDataFrame(data, cols), ["p"]).collect()}
    assert got[1].DockQ == pytest.approx(1.0) and got[1].iRMSD == pytest.approx(0, abs=1e-5) and got[1].fnat == 1.0
    assert got[2].LRMSD == pytest.approx(math.sqrt(48)) and got[2].DockQ < 1
    assert got[3].DockQ is None


def test_numbering_alignment(spark):
    rows = [("k", "n", i, a, f"n{i}") for i, a in enumerate("ACDE")] + [("k", "s", i, a, f"s{i}") for i, a in enumerate("ACXD")]
    got = structure.align_numbering(spark.createDataFrame(rows, "k string, side string, at int, aa string, label string"), ["k"]).orderBy("at").collect()
    assert [r.matched for r in got] == ["s0", "s1", "s3", None]


def test_embeddings(spark):
    rows = [(t, p, r, [float(i), 1.0]) for t in ("1", "2") for i, (p, r) in enumerate(embeddings.KINDS["cdr3s"])]
    rows = [r for r in rows if r[:2] != ("2", "Epitope")] + [("3", p, r, [float("nan")]) for p, r in embeddings.KINDS["cdr3s"]]
    store = spark.createDataFrame(rows, schemas.EMBEDDINGS)
    got = embeddings.vectors_of(store, "cdr3s").collect()
    assert [(r.tcr_id, r.x) for r in got] == [("1", [0.0, 1.0, 1.0, 1.0, 2.0, 1.0, 3.0, 1.0])]
    new = spark.createDataFrame([("1", "TCRA", "cdr3", [9.0])], schemas.EMBEDDINGS)
    assert {tuple(r.vec) for r in embeddings.upsert(store, new).where("tcr_id = '1' and part = 'TCRA'").collect()} == {(9.0,)}
    seqs = spark.createDataFrame([("1", "TCRA", "", "CASS", None, None), ("1", "TCRA", "cdr3", "CASS", 2, 3)], "tcr_id string, part string, region string, sequence string, first int, last int")
    whole = embeddings.stub_encoder(["CASS"])[0]
    got = {r.region: r.vec for r in embeddings.embed(seqs).collect()}
    assert got[""] == pytest.approx(whole.mean(0).tolist()) and got["cdr3"] == pytest.approx(whole[1:3].mean(0).tolist())


def test_models(spark):
    model = {"learner": {"learner_model_param": {"base_score": "[2.5E-1]"}, "objective": {"name": "binary:logistic"}, "gradient_booster": {"model": {"trees": [{"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [1, 0, 0], "split_conditions": [0.5, -1.0, 1.0], "default_left": [1, 0, 0]}]}}}}
    x = np.array([[0, 0.4], [0, 0.5], [0, np.nan]], dtype=np.float32)
    base = math.log(0.25 / 0.75)
    assert ml.TreeEnsemble(json.dumps(model)).predict(x) == pytest.approx([1 / (1 + math.exp(-(base + m))) for m in (-1, 1, -1)])
    random.seed(1)
    rows = [(c, i + random.random(), random.random()) for i, c in enumerate(ml.CLASSES) for _ in range(30)]
    df = spark.createDataFrame(rows, "Quality string, a double, b double")
    forest = ml.train_forest(df, ["a", "b"], trees=10, depth=4)
    got = ml.forest_predict(df, forest, ["a", "b"])
    assert got.where("Quality = predicted_label").count() > 110
    out = ml.label_thresholds(got, {"AQ": 2.0, "MQ": 2.0, "HQ": 2.0})
    assert {r.predicted_label_thresholded for r in out.collect()} == {"LQ"} and out.agg(F.sum("pass_filter")).first()[0] == 0


def test_quality_means_skip_null(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 3.0), (None, None)], "avgipde_a double, avgipde_b double")
    assert [r.avgipde for r in ml.quality_features(df).collect()] == [1.0, 2.0, None]


def test_job_specs(spark):
    c = spark.createDataFrame([("1", "GILG*", "AAA", "CASS", "CAV"), ("2", "GI1G", "AAA", "CASS", "CAV")], "tcr_id string, MHC_seq string, Epitope string, TCRA string, TCRB string")
    hosted = sinks.job_specs(c, "MIQ", "hosted").collect()
    assert [r.tcr_id for r in hosted] == ["1"] and json.loads(hosted[0].spec)[0]["sequences"][0]["proteinChain"] == {"sequence": "GILG", "count": 1}
    assert [tuple(r) for r in sinks.rejected(c).collect()] == [("2", "not a protein sequence")]
    local = json.loads(sinks.job_specs(c, "MIQ", peptide_msa=False).orderBy("tcr_id").first().spec)
    assert [s["protein"]["id"] for s in local["sequences"]] == list("ABCDE") and local["sequences"][2]["protein"]["unpairedMsa"] == "" and 0 <= local["modelSeeds"][0] < 1 << 32


def test_candidate_preparation(spark):
    binding = spark.createDataFrame([("GILG", "HLA-A02:01", "c", "i", .9, .1, .8, .1), ("MIQR", "HLA-A02:01", "c", "i", .9, 9.0, .8, 9.0)], schemas.BINDING)
    pres = spark.createDataFrame([("GILG", "A0201", 1.0, None, .5, .5, .2), ("MIQR", "A0201", 1.0, 1.0, .9, .5, .2)], schemas.PRESENTATION)
    imm = spark.createDataFrame([("GILG", "HLA-A*02:01", "P1", None, -9.0, .9), ("MIQR", "HLA-A*02:01", "P2", .5, -9.0, .9)], schemas.IMMUNOGENICITY)
    scored = scoring.pmhc_scores(binding, pres, imm)
    cand = spark.createDataFrame([("1", "GILG", "A*02:01"), ("2", "MIQR", "HLA-A*02:01"), ("3", "ZZZ", "A*02:01")], "tcr_id string, Epitope string, MHC_allele string")
    own, kept = scoring.filter_candidates(cand, scored, "EL_rank_strong + NetCleave_strong")
    assert own.count() == 2 and [r.tcr_id for r in kept.collect()] == ["1"]
    assert {r.peptide: r.mhcflurry_processing_percentile for r in own.collect()} == {"GILG": 50.0, "MIQR": 0.0}


def test_final_tables(spark):
    p = lambda rows: spark.createDataFrame(rows, "tcr_id string, probs float")
    meta = spark.createDataFrame([("1",), ("2",), ("3",)], "tcr_id string")
    sim = spark.createDataFrame([("1", 1.0, 2.0, 3.0)], "tcr_id string, tcrdist_CDR3a_min double, sim_MHC_max double, sim_MHC_mean double")
    out = scoring.final_tables(meta, {"str": p([("1", .5)]), "seq": p([("2", .25)])}, sim_seq=sim)
    assert {(r.tcr_id, r.probs_str, r.probs_seq) for r in out.predictions.collect()} == {("1", .5, None), ("2", None, .25)}
    assert {(r.tcr_id, r.probs_str, r.probs_seq) for r in out.predictions_filled.collect()} == {("1", .5, 0), ("2", 0, .25), ("3", 0, 0)}
    assert out.more["sim_seq"].columns == ["tcr_id", "tcrdist_CDR3a_min", "sim_MHC_max"]


def test_incremental_ingestion(spark, tmp_path):
    from corvane.streaming.ingest import ingest

    src, sink, check = (str(tmp_path / x) for x in ("src", "sink", "check"))
    for n in (3, 2):
        spark.range(n).write.mode("append").parquet(src)
        ingest(spark, src, "id long", sink, check, lambda d: d.where("id > 0")).awaitTermination()
    assert spark.read.parquet(sink).count() == 3


def test_ids_of_many_rows_have_no_holes(spark):
    """Further columns are read only by one of the two branches of the plan; numbers come from one dealing all the same."""
    rows = spark.range(2_000_000).select(F.xxhash64("id").alias("v"), F.concat(F.lit("x"), F.col("id")).alias("more"))
    got = keys.with_ids(rows, [F.col("v")], "n").select(F.col("n").cast("long").alias("n"), "more", "v")
    assert tuple(got.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.count("more")).first()) == (2_000_000, 2_000_000, 1, 2_000_000, 2_000_000)
    chunks = windows.chunked(rows, [F.col("v")], 1000).groupBy("chunk").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("chunk").collect()
    assert [r.chunk for r in chunks] == list(range(2000)) and {r.n for r in chunks} == {1000}
    assert all(x.b < y.a for x, y in zip(chunks[:-1], chunks[1:], strict=True))


def plain_batches(rows, budget):
    """{id: batch} of (id, length) rows, one after the other."""
    out, batch, n = {}, 0, 0
    for i, size in sorted(rows, key=lambda r: (max(r[1] or 0, 0), r[0])):
        size = max(size or 0, 0)
        if n and size * (n + 1) > budget:
            batch, n = batch + 1, 0
        n += 1
        out[i] = batch
    return out


@pytest.mark.parametrize("budget", [1, 7, 50, 1000])
def test_token_batches_follow_the_sequential_rule(spark, budget):
    r = random.Random(budget)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, 0, -3, 1, 2, 3, r.randrange(1, 60), r.randrange(1, 2000)])) for i in range(1500)]
    got = windows.token_batches(spark.createDataFrame(rows, "i long, g string, len int").withColumn("batch", F.lit("clash")), ["g"], ["i"], "len", budget)
    want = {}
    for g in ("a", "b", None):
        want |= plain_batches([(i, n) for i, h, n in rows if h == g], budget)
    assert {x.i: x.batch for x in got.collect()} == want
    assert windows.token_batches(spark.createDataFrame([], "i long, g string, len int"), ["g"], ["i"], "len", budget).collect() == []
    with pytest.raises(ValueError):
        windows.token_batches(spark.createDataFrame(rows, "i long, g string, len int"), ["g"], ["i"], "len", 0)


def test_ipsae_of_matrices_as_they_are(spark):
    """Rows of the matrix against the same scores from one row a cell: several runs of a chain, one chain alone, nulls, ties at the cutoffs."""
    r = random.Random(2)
    orders = [[(c, i) for c, n in (("A", 30), ("B", 12), ("C", 35), ("D", 3)) for i in range(n)],
              [("B", 0), ("A", 0), ("A", 1), ("B", 1), ("B", 2), ("C", 0), *[("A", i) for i in range(2, 9)]], [("A", i) for i in range(5)]]
    tokens = [(f"m{m}", c, i, t) for m, order in enumerate([*orders, orders[0]]) for t, (c, i) in enumerate(order)]
    matrix = lambda n: [[r.choice([r.uniform(0, 30), r.uniform(0, 12), 10.0, 12.0]) for _ in range(n)] for _ in range(n)]
    holes = [[None if r.random() < 0.05 else 25.0 if i < 30 else x for x in row] for i, row in enumerate(matrix(80))]
    conf = spark.createDataFrame([*[(f"m{m}", matrix(len(o))) for m, o in enumerate(orders)], ("m3", holes), ("m4", None)], "model string, pae array<array<double>>")
    tok = spark.createDataFrame(tokens, "model string, chain string, residue long, token long")
    pairs = interface.matrix_pairs(conf, tok, ["model"]).where("pae is not null")
    want = interface.ipsae(pairs, tok.groupBy("model", "chain").agg(F.count("*").alias("length")), ["model"]).join(interface.lis(pairs, ["model", "chain1", "chain2"]), ["model", "chain1", "chain2"])
    got, want = (df.toPandas().sort_values(["model", "chain1", "chain2"]).reset_index(drop=True) for df in (interface.ipsae_blocks(conf, tok, ["model"]), want))
    import pandas as pd

    assert len(got) == 30
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, rtol=1e-9)


def plain_loop_distance(a, b, of, gap, trim, fixed):
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n == m:
        return sum(of(a[i], b[i]) for i in range(trim[0], n - trim[1]))
    if fixed:
        low = high = min(6, 3 + (n - 5) // 2)
    else:
        low, high = 5, n - 5
        while low > high:
            low, high = low - 1, high + 1
    ways = [sum(of(a[i], b[i]) for i in range(trim[0], g)) + sum(of(a[n - 1 - c], b[m - 1 - c]) for c in range(trim[1], n - g)) for g in range(low, high + 1)]
    return min(ways) + gap * (m - n)


def test_weighted_loop_kernel(spark):
    r = random.Random(5)
    scores_ = similarity.matrix_scores("# a comment\n   A C D E F\nA  4 0 -2 -1 -2\nC  0 9 -3 -4 -2\nD -2 -3 6 2 -3\nE -1 -4 2 5 -3\nF -2 -2 -3 -3 6\n")
    assert scores_["DE"] == 2 and scores_["CC"] == 9
    table = similarity.residue_distances(scores_)
    of = lambda a, b: 0 if a == b else max(0, min(4, 4 - scores_[a + b])) if {a, b} <= set("ACDEF") else 4
    word = lambda n: "".join(r.choice("ACDEF" if n % 2 else "ACDEFX*") for _ in range(n))
    pairs = [(word(r.randrange(1, 20)), word(r.randrange(1, 20))) for _ in range(300)] + [("A", "A"), ("ACD", "ACDACDACDACD")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, "A"), (-2, "", "A")], "i int, a string, b string")
    for trim, fixed in (((0, 0), True), ((3, 2), False)):
        kernel = similarity.loop_kernel(table, trim=trim, fixed=fixed)
        got = {x.i: x.d for x in df.select("i", kernel(F.col("a"), F.col("b")).alias("d")).collect()}
        assert got == {**{i: float(plain_loop_distance(a, b, of, 4, trim, fixed)) for i, (a, b) in enumerate(pairs)}, -1: None, -2: None}
    near = similarity.residue_distances(similarity.grouped_scores(("DE",), 3))
    assert near[3 * 26 + 4] == near[4 * 26 + 3] == 1 and near[0] == 0 and near[1] == 4


def test_presets_by_name(spark):
    rows = [(i, 0.1 * i, 0.2 * i, -7.0 + i, 0.4 + 0.1 * i, 0.3 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, EL_rank double, BA_rank double, NOAH double, NetCleave double, mhcflurry_presentation_percentile double")
    got = {name: {r.i for r in filters.preset_filter(df, name, filters.PMHC).collect()} for name in ("vhio", "Relaxed", "stringent", "EL_rank_strong")}
    assert got["vhio"] == got["EL_rank_strong"] == {i for i, el, *_ in rows if el <= 0.5}
    assert got["Relaxed"] == {i for i, _, ba, noah, _, pres in rows if ba <= 0.5 and noah <= -1 and pres <= 1}
    assert got["stringent"] == {i for i, _, ba, noah, net, _ in rows if net >= 0.6 and ba <= 0.5 and noah <= -1}


def test_store_changes_only_what_a_batch_touches(spark, tmp_path):
    import glob

    path = str(tmp_path / "store")
    rows = lambda ids, v: spark.createDataFrame([(str(i), "TCRA", r, [float(v), float(i)]) for i in ids for r in ("", "cdr3", None)], schemas.EMBEDDINGS)
    files = lambda: set(glob.glob(f"{path}/bucket=*/*.parquet"))
    assert embeddings.upsert_store(rows(range(200), 0), path, 1, 16)
    first = files()
    assert len({f.split("bucket=")[1].split("/")[0] for f in first}) == 16
    assert embeddings.upsert_store(rows([3], 1), path, 2, 16) and not embeddings.upsert_store(rows([4], 9), path, 2, 16)
    assert 13 <= len(first & files()) < 16 and embeddings.stored_batches(spark, path) == {1, 2}
    assert embeddings.upsert_store(rows([500], 2), path, 3, 16) and embeddings.upsert_store(rows([], 2), path, 4, 16)
    got = {(r.tcr_id, r.region): r.vec for r in embeddings.read_store(spark, path).collect()}
    assert len(got) == 603 and got[("3", None)] == [1.0, 3.0] and got[("4", "")] == [0.0, 4.0] and got[("500", "cdr3")] == [2.0, 500.0]
