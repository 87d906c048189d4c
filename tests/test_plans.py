"""Whole jobs on two small synthetic complexes of two replicas each."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.plans import scoring

LEAF = json.dumps({"learner": {"learner_model_param": {"base_score": "5E-1"}, "objective": {"name": "binary:logistic"}, "gradient_booster": {"model": {"trees": [
    {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [0.5, -1.0, 1.0], "default_left": [1, 0, 0]}]}}}})


@pytest.fixture(scope="module")
def complexes(spark):
    r = np.random.default_rng(2)
    names = ["ALA", "GLY", "LEU", "SER", "TRP"]
    size = {"A": 12, "B": 4, "C": 9, "D": 10, "E": 10}
    rows = []
    for c in ("1", "2"):
        base = {ch: r.normal(0, 4, (n, 3)) for ch, n in size.items()}
        for m in (0, 1):
            at = 0
            for ch, xyz in base.items():
                for i, p in enumerate(xyz + r.normal(0, 0.2, xyz.shape) * m, 1):
                    for atom, shift in (("N", -0.5), ("CA", 0.0), ("CB", 0.6)):
                        rows.append((c, m, "ATOM", at, atom, names[(i + len(ch)) % 5], ch, i, None, *(float(v + shift) for v in p), 1.0, 60.0 + 3 * i, at))
                        at += 1
    atoms = spark.createDataFrame(rows, schemas.ATOMS).cache()
    roles = spark.createDataFrame([(c, ch, role) for c in ("1", "2") for ch, role in zip("ABCDE", ("mhc", "b2m", "peptide", "tcra", "tcrb"), strict=True)], "complex_id string, chain string, role string")
    return atoms, roles


def test_structures_to_predictions(spark, complexes):
    atoms, roles = complexes
    potentials = spark.createDataFrame([(k, a, b, -1.0) for k in ("tcr_p", "tcr_mhc", "p_mhc") for a in "AGLSW" for b in "AGLSW" if a <= b], schemas.POTENTIALS)
    from corvane.operators.structure import model_metadata

    metadata = model_metadata(atoms)
    assert metadata.count() == 4 and len(metadata.first().Epitope) == 9
    docking = spark.createDataFrame([("1", 0, 1, -1.0, 2.0, 3.0, 4.0, 1), ("1", 1, 1, -2.0, 2.0, 3.0, 4.0, 1), ("2", 0, 1, -3.0, 2.0, 3.0, 4.0, 1)], schemas.DOCKING)
    merged = scoring.structural_table(atoms, roles, potentials, metadata, docking)
    rows = {(r.tcr_id, r.model_number): r for r in merged.collect()}
    assert set(rows) == {("1", 0), ("1", 1), ("2", 0)}
    for r in rows.values():
        assert r.c_tcr_p_all == sum(r[f"c_tcr_p{i}"] for i in range(1, 14)) > 0 and r.total_w1 == r.Ele + r.Desolv + r.VDW
    matrix = scoring.structural_matrix(merged)
    got = {r.tcr_id: r for r in matrix.collect()}
    assert len(got["1"].x) == 96 and got["1"].Ele_mean == -1.5 and got["2"].Ele_std == 0.0
    store = spark.createDataFrame([(t, p, g, [0.1 * i, 1.0]) for t in "12" for i, (p, g) in enumerate((("TCRA", "cdr3"), ("TCRB", "cdr3"), ("Epitope", ""), ("MHC_seq", "")))], schemas.EMBEDDINGS)
    out = scoring.predictions(matrix, store, {"str": LEAF, "seq": LEAF, "bi": LEAF})
    assert all(df.count() == 2 for df in out.values())
    final = scoring.final_tables(metadata.select("tcr_id").distinct(), out)
    assert set(final.named()["predictions_filled"].columns) == {"tcr_id", "probs_str", "probs_seq", "probs_bi"}
    labels = spark.createDataFrame([("1", 1), ("1", 1), ("2", 0)], "tcr_id string, Label int")
    assert scoring.evaluate(out["str"], labels).first().roc_auc is not None
    assert scoring.evaluate(out["str"], labels.withColumn("Label", F.lit(1))) is None


def test_confidence_and_consensus(spark, complexes):
    atoms, roles = complexes
    summary = spark.createDataFrame([(c, m, [0.5] * 5, [0.4] * 5, [[0.1 * i + 0.01 * j for j in range(5)] for i in range(5)], 0.9) for c in "12" for m in (0, 1)], "complex_id string, model_number int, " + schemas.SUMMARY)
    rows = scoring.confidence(atoms, summary, roles).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.has_contacts and 0 < r.pdockq < 1 and r.iptm_mean == pytest.approx(0.5) and r.iptm_tcrpmhc == pytest.approx((0.03 + 0.04 + 0.23 + 0.24) / 4)
    table = scoring.quality_metrics([scoring.confidence(atoms, summary, roles).withColumnRenamed("complex_id", "tcr_id")])
    assert table.columns == schemas.METRICS
    pairs = scoring.replica_consensus(atoms, roles).collect()
    assert [(r.complex_id, r.model_number_i, r.model_number_j) for r in sorted(pairs)] == [("1", 0, 1), ("2", 0, 1)]
    assert all(r.DockQ > 0.5 and r.LRMSD < 1 for r in pairs)


def test_candidate_inputs_and_requests(spark):
    cand = scoring.read_candidates(spark.createDataFrame([("GILG", "A*02:01", "CA*V", "CASS", "MHCSEQ"), ("GILG", "A*02:01", "CAV", "CAS1", "MHCSEQ")], "Epitope string, MHC_allele string, TCRA string, TCRB string, MHC_seq string"))
    with pytest.raises(ValueError, match="missing"):
        scoring.read_candidates(cand.drop("TCRB"))
    matches = spark.createDataFrame([("GILG", "tr|Q1|X", 0), ("GILG", "sp|P2|Y", 1)], "Query string, Subject string, line int")
    inputs = {k: [tuple(r) for r in df.collect()] for k, df in scoring.predictor_inputs(cand, matches).items()}
    assert inputs == {"peptides": [("GILG",)], "alleles": [("HLA-A02:01",)], "presentation": [("HLA-A02:01", "GILG")], "immunogenicity": [("GILG", "HLA-A02:01", "P2")]}
    specs, rejected = scoring.job_requests(cand.withColumn("MHC_seq", F.lit("GSHS")), "MIQRT", "hosted", [F.col("TCRB")])
    assert specs.count() == 1 and rejected.count() == 1


def test_quality_table_against_plain_numbers(spark, complexes):
    """All 29 metrics from atoms, roles, loops and confidences, those of this module's own against a plain version."""
    atoms, roles = complexes
    rows = sorted((r.asDict() for r in atoms.collect()), key=lambda r: (r["complex_id"], r["model_number"], r["ord"]))
    # residue 3 of chain A has no CA: it stands in contacts by CB with others, and in no cell of the matrices
    rows = [r for r in rows if not (r["chain"] == "A" and r["res_seq"] == 3 and r["atom_name"] == "CA")]
    atoms = spark.createDataFrame([tuple(r.values()) for r in rows], schemas.ATOMS)
    models = sorted({(r["complex_id"], r["model_number"]) for r in rows})
    n = 45
    pae = [[float((7 * i + 3 * j) % 25) for j in range(n)] for i in range(n)]
    pde = [[((i + j) % 10) / 10 for j in range(n)] for i in range(n)]
    conf = spark.createDataFrame([(c, m, pae, pde) for c, m in models], "complex_id string, model_number int, pae array<array<double>>, contact_probs array<array<double>>")
    summary = spark.createDataFrame([(c, m, [0.5] * 5, [0.4] * 5, [[0.1 * i + 0.01 * j for j in range(5)] for i in range(5)], 0.9) for c, m in models], "complex_id string, model_number int, " + schemas.SUMMARY)
    spans = {"cdr1": (1, 2), "cdr2": (4, 5), "cdr3": (7, 9)}
    from corvane.functions.sequences import LETTERS

    own = {(r["complex_id"], r["model_number"], r["chain"], r["res_seq"]): LETTERS[r["res_name"]] for r in rows}
    numbered = [(c, m, ch, i, own[c, m, ch, i], name + side) for c, m in models for ch, side in (("D", "a"), ("E", "b")) for name, (a, b) in spans.items() for i in range(a, b + 1)]
    loops = spark.createDataFrame(numbered, "complex_id string, model_number int, chain string, res_seq int, aa string, region string")
    got = scoring.quality_table(atoms, roles, loops, conf, summary, spark.createDataFrame([(c, m, "11") for c, m in models], "complex_id string, model_number int, seed string"))
    assert got.columns == schemas.METRICS
    found = {(r.tcr_id, r.model_number): r for r in got.collect()}
    assert set(found) == set(models)

    def plain(c, m):
        mine = [r for r in rows if (r["complex_id"], r["model_number"]) == (c, m)]
        place, residues = {}, {}
        for r in mine:
            key = r["chain"], r["res_seq"]
            place.setdefault(key, len(place))
            residues.setdefault(key, {})[r["atom_name"]] = (np.array([r["x"], r["y"], r["z"]]), r["b"])
        side = {k: "B" if k[0] in "DE" else "A" for k in residues}
        out = {}
        for s in "AB":
            b, e, d = [], [], []
            for x in residues:
                for y in residues:
                    if side[x] != s or side[y] == s:
                        continue
                    atom = next((a for a in ("CA", "CB") if a in residues[x] and a in residues[y]), None)
                    if atom and np.linalg.norm(residues[x][atom][0] - residues[y][atom][0]) <= 8:
                        b.append(residues[x][atom][1])
                        if atom == "CA":
                            e.append(1 / (1 + (pae[place[x]][place[y]] / 10) ** 2))
                            d.append(pde[place[x]][place[y]])
            out[f"avgipae_{s.lower()}"], out[f"avgipde_{s.lower()}"] = np.mean(e), np.mean(d)
            out[f"pdockq2_{s.lower()}"] = 1.31034849 / (1 + np.exp(-0.0747157696 * (np.mean(e) * np.mean(b) - 84.7326239))) + 0.00501886443
        mean = lambda ch, a, b, atoms_=None: [r["b"] for r in mine if r["chain"] == ch and a <= r["res_seq"] <= b and (atoms_ is None or r["atom_name"] in atoms_)]
        score = []
        for ch, s in (("D", "a"), ("E", "b")):
            for name, (a, b) in spans.items():
                out[f"{name}{s}_plddt"] = np.mean(mean(ch, a, b))
            ca = [x for a, b in spans.values() for x in mean(ch, a, b, ["CA"])] + mean("C", 1, 9, ["CA"])
            score.append((sum(ca) + 1e-6) / len(ca) * 0.01)
        return out | {"peptide_plddt": np.mean(mean("C", 1, 9)), "cdrs_peptide_plddt": sum(score) / 2, "plddt": np.mean([r["b"] for r in mine]), "seed": "11", "ranking_score": 0.9}

    for key, r in found.items():
        for name, value in plain(*key).items():
            assert r[name] == (value if isinstance(value, str) else pytest.approx(value, rel=1e-9)), name
        assert all(r[c] is not None for c in schemas.METRICS) and 0 <= r.lis <= 1 and r.ipsae <= 1


def test_similarity_to_panels(spark, complexes):
    """Structures and sequences of models against a panel of others."""
    atoms, roles = complexes
    one = atoms.where("complex_id = '1'")
    got = {(r.tcr_id, r.model_number): r for r in scoring.structure_similarity(atoms, roles, one, roles).collect()}
    assert len(got) == 4 and got["1", 0].DockQ_max == pytest.approx(1.0) and got["1", 0].LRMSD_min == pytest.approx(0.0, abs=1e-6) and got["1", 0].DockQ_mean < 1
    assert got["2", 0].DockQ_max < 0.9
    names = ("CDR1a", "CDR2a", "CDR3a", "CDR1b", "CDR2b", "CDR3b")
    make = lambda rows: spark.createDataFrame(rows, "tcr_id string, " + ", ".join(f"{n} string" for n in names) + ", MHC_seq string, Epitope string")
    q = make([("q", "AA", "AB", "AC", "BA", "BB", "BC", "GSHS", "GILG"), ("none", None, "A", "A", "A", "A", "A", "G", "G")])
    refs = make([("1", "AA", "AB", "AC", "BA", "BB", "BC", "GSHS", "GILG"), ("2", "CC", "AB", "AC", "BA", "BB", "CCC", "GSH", "GIL"), ("2", "ZZ", "AB", "AC", "BA", "BB", "ZZZ", "GSH", "GIL")])
    rows = scoring.sequence_similarity(q, refs).collect()
    assert [r.tcr_id for r in rows] == ["q"]
    r = rows[0]
    assert (r.tcrdist_CDR1a_min, r.tcrdist_CDR1a_max, r.tcrdist_all_min, r.tcrdist_all_max) == (0.0, 2.0, 0.0, 4.0)
    assert r.sim_MHC_max == 1.0 and r.sim_Epitope_min == pytest.approx(0.75)


def test_writers_and_reports(spark, complexes, tmp_path):
    import glob

    from corvane.operators import interface, sinks
    from corvane.sources import jobs, structures

    atoms, _ = complexes
    some = atoms.where("complex_id = '1' and chain = 'B'")
    sinks.write_structures(structures.pdb_lines(some), str(tmp_path / "pdb"))
    files = glob.glob(str(tmp_path / "pdb" / "*" / "*" / "*.txt"))
    assert len(files) == 2 and all(len(open(f).read().splitlines()) == 12 for f in files)
    values = {"Model": "m", "Chn2": "B", "PAE": "10", "Dist": "10", "ipSAE": 0.5, "n0res": 3}
    rows = spark.createDataFrame([("A", "asym"), ("A", "max"), ("B", "asym")], "Chn1 string, Type string").withColumns({c: F.lit(v) for c, v in values.items()})
    rows = rows.withColumns({c: F.lit(None).cast("int" if f.endswith("d") else "double") for c, f in interface.REPORT if c not in rows.columns})
    sinks.write_reports(interface.report_lines(rows), interface.report_header(), str(tmp_path / "reports"))
    text = open(glob.glob(str(tmp_path / "reports" / "*" / "*.txt"))[0]).read().splitlines()
    assert text[0].split()[:2] == ["Chn1", "Chn2"] and [x.split()[4] for x in text[1:]].count("max") == 1 and "0.500000" in text[1]
    (tmp_path / "ranks.csv").write_text("seed,sample,ranking_score\n1,0,0.5\n1,1,0.75\n")
    assert [(r.model_number, r.ranking_score) for r in jobs.read_rankings(spark, str(tmp_path / "ranks.csv")).orderBy("model_number").collect()] == [(0, 0.5), (1, 0.75)]
    (tmp_path / "m.tsv").write_text("batch\tname\tpdb_path\nb\tn\t/p\n\n")
    assert [tuple(r)[2:] for r in jobs.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("b", "n", "/p")]
    (tmp_path / "bad.tsv").write_text("batch\tname\n")
    with pytest.raises(ValueError, match="unexpected header"):
        jobs.read_manifest(spark, str(tmp_path / "bad.tsv"))
    files = spark.createDataFrame([("/a/x.ene",), ("/b/x.ene",), ("/b/y.pdb",)], "path string")
    assert {r.path: r.target for r in sinks.output_paths(files, "/out").collect()} == {"/a/x.ene": "/out/x.ene", "/b/y.pdb": "/out/y.pdb"}
    assert jobs.kept_files(files, ["*.ene"]).count() == 2 and jobs.listed("a, b c") == ["a", "b", "c"]
    df, seen = sinks.counted(files, "files")
    df.collect()
    assert seen.get["rows"] == 3


def test_facade(spark, complexes, tmp_path):
    """The jobs by one object, and the ids that lack parts of what it asks for."""
    from corvane.operators.structure import fragment_sequences, model_metadata
    from corvane.plans.pipeline import Options, Pipeline

    atoms, roles = complexes
    run = Pipeline(Options(models={"str": LEAF, "seq": LEAF}))
    potentials = spark.createDataFrame([(k, a, b, -1.0) for k in ("tcr_p", "tcr_mhc", "p_mhc") for a in "AGLSW" for b in "AGLSW"], schemas.POTENTIALS)
    docking = spark.createDataFrame([("1", 0, 1, -1.0, 2.0, 3.0, 4.0, 1), ("2", 0, 1, -3.0, 2.0, 3.0, 4.0, 1)], schemas.DOCKING)
    store = spark.createDataFrame([("1", p, g, [1.0]) for p, g in (("TCRA", "cdr3"), ("TCRB", "cdr3"), ("Epitope", ""), ("MHC_seq", ""))] + [("2", "TCRA", "cdr3", [1.0])], schemas.EMBEDDINGS)
    labels = spark.createDataFrame([("1", 1), ("2", 0)], "tcr_id string, Label int")
    final, more = run.downstream(atoms, roles, potentials, docking, model_metadata(atoms), store, labels)
    assert {r.tcr_id: (r.probs_str is not None, r.probs_seq is not None) for r in final.predictions.collect()} == {"1": (True, True), "2": (True, False)}
    assert set(more) == {"energies", "matrix", "metrics_str"}
    assert [tuple(r) for r in run.lacking(store).collect()] == [("2", "no TCRB:cdr3,Epitope,MHC_seq")]
    assert len(run.write(final, str(tmp_path))) == 2
    rows = [("c", 0, "ATOM", i, a, n, "A", r, None, x, 0.0, 0.0, 1.0, 1.0, i) for i, (a, n, r, x) in enumerate([("N", "GLY", 1, 0.0), ("C", "GLY", 1, 1.0), ("N", "ALA", 2, 2.3), ("C", "ALA", 2, 3.3), ("N", "TRP", 3, 9.0), ("C", "TRP", 3, 10.0)])]
    assert [r.sequence for r in fragment_sequences(spark.createDataFrame(rows, schemas.ATOMS)).collect()] == ["GA"]
