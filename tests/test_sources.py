"""Readers on small synthetic files."""

import io
import json
import tarfile

import pytest

from corvane import schemas
from corvane.sources import fasta, jobs, reports, structures, tables


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_by_name_with_missing_marks(spark, tmp_path):
    p = put(tmp_path / "c.csv", "MHC_allele,extra,tcr_id,Epitope\nA*02:01,1,007,GILG\nNA,2,008,\n")
    rows = tables.read_csv(spark, p, schemas.CANDIDATES).select("tcr_id", "MHC_allele", "Epitope", "TCRA").collect()
    assert [tuple(r) for r in rows] == [("007", "A*02:01", "GILG", None), ("008", None, None, None)]


def test_peptide_matches_skip_two_lines(spark, tmp_path):
    p = put(tmp_path / "m.tsv", "# a\n# b\nPEP\ttr|Q1|X\t10\t1\t3\tmore\nPEP\tsp|P2|Y\t20\tx\t4\n")
    rows = tables.read_peptide_matches(spark, p).orderBy("line").collect()
    assert [(r.Subject, r.SubjectLength, r.MatchStart, r.MatchEnd) for r in rows] == [("tr|Q1|X", 10, 1, 3), ("sp|P2|Y", 20, None, 4)]
    from corvane.plans.scoring import best_proteins

    assert [tuple(r) for r in best_proteins(tables.read_peptide_matches(spark, p)).collect()] == [("PEP", "P2")]


def test_fasta_second_word_and_joined_lines(spark, tmp_path):
    p = put(tmp_path / "h.fasta", ">HLA:1 A*01:01 365 bp\nMAV\nMAP\n>HLA:2 A*01:01 9\nXX\n>HLA:3 B*07:02:01\nMLV\n")
    rows = fasta.read_fasta(spark, p)
    assert [(r.mhc_allele, r.mhc_seq) for r in rows.orderBy("ordinal").collect()] == [("A*01:01", "MAVMAP"), ("A*01:01", "XX"), ("B*07:02:01", "MLV")]
    assert {(r.mhc_allele, r.mhc_seq) for r in fasta.keep_first(rows, "mhc_allele").collect()} == {("A*01:01", "MAVMAP"), ("B*07:02:01", "MLV")}


def test_binding_report(spark, tmp_path):
    row = "  {} HLA-A*02:01 {} CORE 0 0 0 0 0 ICORE id {} {} {} {} 1.0"
    text = "\n".join(["# Allele: HLA-A02:01", row.format(1, "EARLY", .1, 1, .1, 1), "-----", " Pos MHC Peptide", "-----", row.format(1, "GILG", .9, .01, .8, .02), row.format("x", "BAD", 1, 1, 1, 1), row.format(2, "NOPE", "?", 1, 1, 1), "1 2 3",
                      "# Allele: HLA-B07:02", row.format(3, "LATE", 1, 1, 1, 1), "-----", row.format(4, "MIQR", .5, 2, .4, 3)])
    p = put(tmp_path / "r.txt", text)
    rows = reports.read_binding(spark, p).orderBy("peptide").collect()
    assert [(r.peptide, r.allele, r.core, r.icore, r.EL_score, r.BA_rank) for r in rows] == [("GILG", "HLA-A02:01", "CORE", "ICORE", .9, .02), ("MIQR", "HLA-B07:02", "CORE", "ICORE", .5, 3.0)]


@pytest.mark.parametrize(("compat", "want"), [("fixed", (1, -28.35, 24.504, -71.976, -11.044, 1)), ("reference", (-28, 24.504, -71.976, -11.044, 1.0, None))])
def test_docking_energies(spark, tmp_path, compat, want):
    put(tmp_path / "tcr_24_1.ene", "   Conf  Ele Desolv VDW Total RANK\n-----\n  1  -28.350  24.504 -71.976 -11.044  1\n  2 0 0 0 0 2\n")
    r = reports.read_docking(spark, str(tmp_path), compat).first()
    assert (r.tcr_id, r.model_number) == ("tcr_24", 1)
    assert (r.Conf, r.Ele, r.Desolv, r.VDW, r.Total, r.RANK) == want


PDB = """HEADER    X
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 90.00           N
ATOM      2  CA  ALA A   1A     11.639   6.071  -5.147  1.00 80.50           C
HETATM    3  O   HOH A 201       0.000   0.000   0.000  1.00 10.00           O
ENDMDL
ATOM      9  N   GLY B   1       1.000   1.000   1.000  1.00 10.00           N
"""


def test_pdb_atoms(spark, tmp_path):
    put(tmp_path / "tcr_1_3.pdb", PDB)
    rows = structures.read_pdb(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.complex_id, r.model_number, r.record, r.atom_name, r.res_name, r.chain, r.res_seq, r.icode, r.x, r.b) for r in rows] == [
        ("tcr_1", 3, "ATOM", "N", "ALA", "A", 1, None, 11.104, 90.0), ("tcr_1", 3, "ATOM", "CA", "ALA", "A", 1, "A", 11.639, 80.5), ("tcr_1", 3, "HETATM", "O", "HOH", "A", 201, None, 0.0, 10.0)]
    assert structures.read_pdb(spark, str(tmp_path), hetatm=False).count() == 2
    line = structures.pdb_lines(structures.read_pdb(spark, str(tmp_path))).orderBy("ord").first().line
    assert line == PDB.splitlines()[1][:66]


CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.B_iso_or_equiv
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
ATOM 1 CA MET A 7 ? 88.1 1.5 2.5 3.5 1.0
HETATM 2 "O5'" LIG B . ? 1.0 0 0 0 1.0
#
"""


def test_cif_atoms_in_any_item_order(spark, tmp_path):
    put(tmp_path / "job_2.cif", CIF)
    a, b = structures.read_cif(spark, str(tmp_path / "job_2.cif")).orderBy("ord").collect()
    assert (a.complex_id, a.model_number, a.atom_name, a.chain, a.res_seq, a.icode, a.x, a.y, a.z, a.b) == ("job", 2, "CA", "A", 7, None, 1.5, 2.5, 3.5, 88.1)
    assert (b.record, b.atom_name, b.res_seq) == ("HETATM", "O5'", None)


def test_archive(spark, tmp_path):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tar:
        for name, text in (("a/t_1.ene", "1 2 3 4 5 6"), ("a/x.log", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "shard.tar").write_bytes(buf.getvalue())
    rows = structures.read_archive(spark, str(tmp_path / "shard.tar"), ".ene").collect()
    assert [(r.path.endswith("shard.tar/a/t_1.ene"), r.value) for r in rows] == [(True, "1 2 3 4 5 6")]


def test_job_layouts_and_chains(spark, tmp_path):
    for n in (0, 1):
        put(tmp_path / f"fold_a/fold_a_model_{n}.cif", "x")
        put(tmp_path / f"fold_a/fold_a_full_data_{n}.json", "{}")
    put(tmp_path / "fold_a/fold_a_summary_confidences_0.json", json.dumps({"chain_iptm": [0.1, 0.3], "ranking_score": 0.5}))
    for name in ("x_model.cif", "x_confidences.json", "x_summary_confidences.json"):
        put(tmp_path / f"b/seed-1_sample-2/{name}", "{}")
    files = jobs.list_files(spark, str(tmp_path))
    got = {(r.job, r.model, r.layout) for r in jobs.complete_models(files).collect()}
    assert got == {("a", 0, "hosted"), ("b", 2, "local")}
    p = put(tmp_path / "j.json", json.dumps([{"name": "n", "modelSeeds": [], "sequences": [{"proteinChain": {"sequence": "MA", "count": 2}}, {"proteinChain": {"sequence": "GG", "count": 1}}], "dialect": "d", "version": 1}]))
    chains = jobs.job_chains(jobs.read_jobs(spark, p)).orderBy("place").collect()
    assert [(r.chain, r.sequence) for r in chains] == [("A", "MA"), ("B", "MA"), ("C", "GG")]


def test_chain_roles_last_row_wins(spark):
    info = spark.createDataFrame([("1abc", "A", "MHC", "MHCa", "MHCI", 0), ("1abc", "B", "MHC", "MHCb", "MHCI", 1), ("1abc", "C", "PEPTIDE", None, None, 2), ("1abc", "D", "TCR", "TRA", None, 3), ("1abc", "E", "TCR", "TRB", None, 4), ("1abc", "F", "TCR", "TRB", None, 5)],
                                 "`pdb.id` string, `chain.id` string, `chain.component` string, `chain.type` string, `chain.supertype` string, at int")
    r = jobs.chain_roles(info, "at").first()
    assert (r.mhc, r.b2m, r.peptide, r.tcra, r.tcrb) == ("A", "B", "C", "D", "F")


def test_pair_scores_by_header(spark, tmp_path):
    p = put(tmp_path / "s.txt", "\nChn1 Chn2 PAE Dist Type ipSAE LIS\nA B 10 10 asym 0.5 0.25\nB A 10 10 asym 0.6 x\nA B 10 10 max 0.6 0.3\n")
    rows = reports.read_pair_scores(spark, p).orderBy("line").collect()
    assert [(r.Chn1, r.Type, r.ipSAE, r.LIS, r.pDockQ) for r in rows] == [("A", "asym", .5, .25, None), ("B", "asym", .6, None, None), ("A", "max", .6, .3, None)]


def test_cached_table_is_used_only_if_whole(spark, tmp_path):
    full = spark.range(3).withColumnRenamed("id", "a")
    full.write.parquet(str(tmp_path / "t"))
    compute = lambda: spark.range(1).withColumnRenamed("id", "b")
    assert tables.cached_or(spark, str(tmp_path / "t"), ["a"], compute).columns == ["a"]
    assert tables.cached_or(spark, str(tmp_path / "t"), ["a", "b"], compute).columns == ["b"]
    assert tables.cached_or(spark, str(tmp_path / "none"), ["a"], compute).columns == ["b"]


def tar_of(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, text in members:
            about = tarfile.TarInfo(name)
            about.size = len(text.encode())
            tar.addfile(about, io.BytesIO(text.encode()))


def test_archive_members_are_read_by_several_tasks(spark, tmp_path):
    from corvane.sources import archives

    members = [(f"d{i % 7}/{i}.ene", f"line {i} é\n" * (i % 5)) for i in range(1000)]
    tar_of(tmp_path / "a.tar", [*members, ("x/notes.txt", "no")])
    got = archives.read_members(spark, str(tmp_path / "a.tar"), ".ene", run_bytes=2000)
    assert got.rdd.getNumPartitions() > 5
    assert sorted((r.member, r.value) for r in got.collect()) == sorted(members)
    tar_of(tmp_path / "b.tar.gz", members[:50], "w:gz")
    whole = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[: len(whole) // 2 + 700])
    (tmp_path / "junk.tar").write_bytes(b"nothing of the kind" * 100)
    (tmp_path / "cut.tgz").write_bytes((tmp_path / "b.tar.gz").read_bytes()[:400])
    every = archives.read_members(spark, str(tmp_path), ".ene").cache()
    counts = {r.archive.rsplit("/", 1)[1]: r["count"] for r in every.where("error is null").groupBy("archive").count().collect()}
    assert counts["a.tar"] == 1000 and counts["b.tar.gz"] == 50 and 300 < counts["cut.tar"] < 700 and "junk.tar" not in counts
    assert {r.key.rsplit("/", 1)[1] for r in archives.broken_archives(every).collect()} == {"cut.tar", "junk.tar", "cut.tgz"}
    assert set(members) >= {(r.member, r.value) for r in every.where("error is null").collect()}  # no member is cut


def test_shards_are_whole_or_not_there(spark, tmp_path):
    import os

    from corvane.sources import archives

    rows = [(f"m{i}", f"text {i} " * (i % 40), "bad" if i % 50 == 7 else None) for i in range(400)] + [(None, "x", None)]
    df = spark.createDataFrame(rows, "name string, value string, error string").repartition(3)
    out = str(tmp_path / "out")
    assert archives.read_shards(spark, out).count() == 0 if os.path.isdir(out) else archives.read_manifest(out) is None
    archives.write_shards(df, out, error="error", shard_bytes=5000)
    good = {(n, v) for n, v, e in rows if e is None and n}
    found = archives.read_manifest(out)
    assert {(r.name, r.value) for r in archives.read_shards(spark, out).collect()} == good and found["rows"] == len(good)
    assert len(found["shards"]) > 6 and all(sum(m["bytes"] for m in s["members"]) <= 5000 for s in found["shards"])
    assert len((tmp_path / "out" / archives.FAILURES).read_text().splitlines()) == 9
    tar_of(tmp_path / "out" / "shard-of-a-lost-task.tar", [("m0", "again")])  # not in the manifest: not there
    assert archives.read_shards(spark, out).count() == len(good)

    def fail(batches):
        for b in batches:
            yield b
            raise RuntimeError("killed")

    before = sorted(os.listdir(out))
    with pytest.raises(Exception, match="killed"):
        archives.write_shards(df.mapInPandas(fail, df.schema), out, error="error", shard_bytes=5000)
    assert not [f for f in os.listdir(out) if f.startswith(".")] and json.loads((tmp_path / "out" / archives.MANIFEST).read_text()) == found
    assert {f for f in os.listdir(out) if f.startswith("shard-")} - set(before) == set()
    archives.write_shards(spark.createDataFrame([("more", "y")], "name string, value string"), out)
    assert archives.read_shards(spark, out).count() == len(good) + 1
