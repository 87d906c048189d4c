"""Whole jobs over the operators: candidate preparation, structural scoring, quality, prediction, final tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import pmhc_key
from ..functions.sequences import normal_allele, predictor_allele, two_fields
from ..operators import aggregates, embeddings, energies, filters, interface, joins, ml, sets, similarity, sinks, spatial, structure, windows
from ..schemas import METRICS, require


def read_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates, checked for the columns that one of the forms of input needs."""
    chains = (["TCRA", "TCRB"], ["TRAV", "TRAJ", "TRBV", "TRBJ", "CDR3a", "CDR3b"])
    return require(candidates, *[[*c, m, "Epitope"] for c in chains for m in ("MHC_allele", "MHC_seq")])


def add_mhc_sequences(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """MHC_seq by allele: exact, then with one and with two further fields of 01, else empty.

    The dictionary has ordinal, mhc_allele and mhc_seq; of equal alleles the first counts.
    """
    table = joins.first_of(dictionary, ["mhc_allele"], [F.col("ordinal")])
    a = F.col("MHC_allele")
    keys = [a, F.concat(a, F.lit(":01")), F.concat(a, F.lit(":01:01"))]
    own = candidates.drop("MHC_seq")
    return joins.cascade(own, table, keys, "mhc_allele", "mhc_seq", "MHC_seq", F.lit(""))


def allele_of_sequence(metadata: DataFrame, dictionary: DataFrame) -> DataFrame:
    """MHC_allele (two fields) by exact sequence; of equal sequences the first counts."""
    table = joins.first_of(dictionary, ["mhc_seq"], [F.col("ordinal")]).select(F.col("mhc_seq").alias("MHC_seq"), two_fields(F.col("mhc_allele")).alias("MHC_allele"))
    return metadata.drop("MHC_allele").join(joins.lookup_side(table), "MHC_seq", "left")


def stitched(candidates: DataFrame, sequences: DataFrame) -> DataFrame:
    return joins.left_preferring(candidates, sequences, ["tcr_id"])


def best_proteins(matches: DataFrame) -> DataFrame:
    """Of each query, the first match, reviewed proteins before others: Query, uniprot_id."""
    from ..functions.sequences import accession

    reviewed = F.col("Subject").startswith("sp|").cast("int")
    best = joins.first_of(matches, ["Query"], [reviewed.desc(), F.col("line")])
    return best.select("Query", accession(F.col("Subject")).alias("uniprot_id"))


def predictor_inputs(candidates: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """The inputs of the external predictors: peptides, alleles, pairs, and pairs with proteins."""
    pairs = sets.distinct_values(candidates, "Epitope", "MHC_allele").withColumn("allele", predictor_allele(F.col("MHC_allele")))
    with_protein = pairs.join(best_proteins(matches), pairs.Epitope == F.col("Query"), "left").drop("Query")
    return {
        "peptides": sets.distinct_values(candidates, "Epitope"),
        "alleles": pairs.select("allele").distinct(),
        "presentation": pairs.select(F.col("allele"), F.col("Epitope").alias("peptide")),
        "immunogenicity": with_protein.select(F.col("Epitope").alias("epitope"), F.col("allele").alias("HLA_allele"), "uniprot_id"),
    }


def pmhc_scores(binding: DataFrame, presentation: DataFrame, immunogenicity: DataFrame) -> DataFrame:
    """One row a peptide and allele that all three predictors scored, with imputed scores and the pmhc key.

    The processing percentile is 100 minus the average rank percentage; missing scores pass all filters.
    """
    on = ["peptide", "allele"]
    b = binding.withColumn("allele", normal_allele(F.col("allele"))).drop("core", "icore")
    p = presentation.withColumn("allele", normal_allele(F.col("allele")))
    i = immunogenicity.select(F.col("epitope").alias("peptide"), normal_allele(F.col("HLA_allele")).alias("allele"), "uniprot_id", "PredIG", "NOAH", "NetCleave")
    rows = b.join(p, on).join(i, on)
    rows = windows.rank_pct(rows, "mhcflurry_processing_score", "mhcflurry_processing_percentile", (1 - F.col("mhcflurry_processing_percentile")) * 100)
    return filters.impute(rows, filters.PMHC_MISSING).withColumn("pmhc", pmhc_key(F.col("peptide"), F.col("allele")))


def filter_candidates(candidates: DataFrame, scores: DataFrame, preset: str, thresholds: filters.Thresholds = filters.PMHC) -> tuple[DataFrame, DataFrame]:
    """(scores of the candidates' pairs, one row each; candidates whose pair passes the preset)."""
    keyed = candidates.withColumn("pmhc", pmhc_key(F.col("Epitope"), F.col("MHC_allele")))
    own = joins.semi_null_safe(scores, keyed, ["pmhc"])
    order = [F.col(c) for c in sorted(c for c in own.columns if c != "pmhc")]
    own = joins.first_of(own, ["pmhc"], order)
    passed = filters.preset_filter(own, preset, thresholds)
    return own, joins.semi_null_safe(keyed, passed, ["pmhc"]).drop("pmhc")


def structural_table(atoms: DataFrame, roles: DataFrame, potentials: DataFrame, metadata: DataFrame, docking: DataFrame, contact: float = 10.0, energy_distance: float = 5.0) -> DataFrame:
    """Contacts, energies and docking terms, one row a model with a docked pose."""
    contacts = energies.contact_kinds(spatial.contact_map(atoms, roles, contact), energy_distance)
    scored = energies.with_potential(contacts, potentials)
    peptides = metadata.select(F.col("tcr_id").alias("complex_id"), "Epitope").dropna().distinct()
    per_model = energies.complex_energies(scored, peptides, models=atoms.select("complex_id", "model_number")).withColumnRenamed("complex_id", "tcr_id")
    return energies.merge_energies(per_model, docking, metadata.drop("Epitope"))


def structural_matrix(merged: DataFrame, stats: tuple[str, ...] = aggregates.STATS) -> DataFrame:
    """One row a complex: statistics of the structural features over its replicas, and x, their vector."""
    features = energies.structural_features(merged)
    names = energies.feature_names(features.columns)
    table = aggregates.replica_stats(features, ["tcr_id"], names, stats=stats)
    return table.withColumn("x", F.array(*[F.col(f"{f}_{s}") for f in names for s in stats]))


def predictions(matrix: DataFrame | None, store: DataFrame | None, models: dict[str, str], kind: str = "cdr3s") -> dict[str, DataFrame]:
    """Predictions by model name (``str``, ``seq``, ``bi``), as far as models and inputs are given."""
    out = {}
    vectors = embeddings.vectors_of(store, kind) if store is not None else None
    if "str" in models and matrix is not None:
        out["str"] = ml.tree_predict(matrix, models["str"])
    if "seq" in models and vectors is not None:
        out["seq"] = ml.tree_predict(vectors, models["seq"])
    if "bi" in models and vectors is not None and matrix is not None:
        both = vectors.join(matrix.select("tcr_id", F.col("x").alias("y")), "tcr_id").select("tcr_id", F.concat("x", F.col("y").cast("array<float>")).alias("x"))
        out["bi"] = ml.tree_predict(both, models["bi"])
    return out


def evaluate(predicted: DataFrame, labels: DataFrame, compat: str = "fixed") -> DataFrame | None:
    """AUCs of predictions; None without both classes. ``reference`` counts each labelled row, ``fixed`` each complex."""
    labels = labels if compat == "reference" else labels.groupBy("tcr_id").agg(F.max("Label").alias("Label"))
    rows = labels.where("Label is not null").join(predicted, "tcr_id")
    return aggregates.auc(rows, "Label", "probs") if filters.both_classes(rows, "Label") else None


@dataclass
class FinalTables:
    predictions: DataFrame
    predictions_filled: DataFrame
    more: dict[str, DataFrame] = field(default_factory=dict)

    def named(self) -> dict[str, DataFrame]:
        return {"predictions_all": self.predictions, "predictions_filled": self.predictions_filled, **self.more}


def final_tables(metadata: DataFrame, by_model: dict[str, DataFrame], sim_seq: DataFrame | None = None, sim_str: DataFrame | None = None, **more: DataFrame) -> FinalTables:
    """Predictions of all models side by side, with nulls and with every complex and zeros, and the report tables.

    Similarities are narrowed to their best statistics; tables that aren't given aren't made.
    """
    renamed = [df.select("tcr_id", F.col("probs").alias(f"probs_{name}")) for name, df in by_model.items()]
    both = joins.outer_all(renamed, ["tcr_id"])
    out = {k: v for k, v in more.items() if v is not None}
    if sim_seq is not None:
        out["sim_seq"] = sets.by_pattern(sim_seq, ["tcr_id"], [r"tcrdist.*min", r"sim.*max"])
    if sim_str is not None:
        out["sim_str"] = sets.by_pattern(sim_str, ["tcr_id", "model_number"], [r"DockQ.*max", r"iRMSD.*min", r"LRMSD.*min", r"Fnat.*max", r"clashes.*min"])
    return FinalTables(both, joins.attach_missing(both, metadata, "tcr_id"), out)


def quality_metrics(parts: list[DataFrame]) -> DataFrame:
    """The metrics table in its fixed column order, from parts keyed by complex and model; absent metrics are null."""
    rows = joins.outer_all(parts, ["tcr_id", "model_number"])
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in METRICS])


def confidence(atoms: DataFrame, summaries: DataFrame, roles: DataFrame) -> DataFrame:
    """Global pLDDT, chain means, pDockQ of the merged sides and contact flags of every model."""
    keys = structure.MODEL
    plddt = interface.mean_plddt(atoms, keys)
    merged = structure.merge_chains(atoms, roles)
    points = structure.representative(merged).withColumn("residue", F.col("res_seq"))
    dock = interface.interface_scores(points, keys, "chain").select(*keys, "pdockq")
    means = interface.summary_means(summaries).select(*keys, "iptm_mean", "ptm_mean", "iptm_tcrpmhc", "ranking_score")
    own = atoms.join(roles, ["complex_id", "chain"])
    tcr = own.where("role in ('tcra', 'tcrb')").select(*keys, *[F.col(c).alias(f"{c}_from") for c in spatial.XYZ])
    pep = own.where("role = 'peptide'").select(*keys, *[F.col(c).alias(f"{c}_to") for c in spatial.XYZ])
    touch = spatial.any_within(tcr, pep, keys, 10.0, plddt.select(*keys), "has_contacts")
    return plddt.join(dock, keys, "left").withColumn("pdockq", F.coalesce("pdockq", F.lit(0.0))).join(means, keys, "left").join(touch, keys, "left")


def quality_table(atoms: DataFrame, roles: DataFrame, loop_residues: DataFrame, confidences: DataFrame, summaries: DataFrame, seeds: DataFrame | None = None, cutoff: float = 10.0) -> DataFrame:
    """All quality metrics of every model, from its atoms, roles, numbered loops and confidences.

    ``atoms``: the (trimmed) atoms; ``loop_residues``: keys, chain, res_seq, aa, region (``cdr1a`` to ``cdr3b``) as numbering and
    its alignment to the structure give them; ``confidences``: keys, pae, contact_probs, matrices over the residues of
    the atoms in their order; ``summaries``: keys and the summary confidences; ``seeds``: keys, seed.
    """
    keys = structure.MODEL
    res = structure.residues(atoms)
    lettered = atoms.where("record = 'ATOM'").join(res.select(*keys, "chain", "res_seq", "icode", "aa").withColumnRenamed("icode", "ic__"), [*keys, "chain", "res_seq"]).where(F.col("icode").eqNullSafe(F.col("ic__")))
    by_region = interface.region_plddt(lettered, loop_residues, keys)
    names = [f"cdr{n}{side}" for n in (1, 2, 3) for side in "ab"]
    loops_ = by_region.groupBy(*keys).agg(*[F.max(F.when(F.col("region") == n, F.col("plddt"))).alias(f"{n}_plddt") for n in names])
    peptide = atoms.join(roles.where("role = 'peptide'"), ["complex_id", "chain"]).groupBy(*keys).agg(F.avg("b").alias("peptide_plddt"))

    # places in chains from 0, and in the matrix in the order of the file
    order = Window.partitionBy(*keys, "chain").orderBy("ord")
    ca = lettered.groupBy(*keys, "chain", "res_seq", "icode").agg(F.min("ord").alias("ord"), F.first("aa").alias("aa"), F.max(F.when(F.col("atom_name") == "CA", F.col("b"))).alias("b"))
    places = ca.withColumn("at", F.row_number().over(order) - 1).withColumn("token", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1)
    spans = places.join(loop_residues.select(*keys, "chain", "res_seq", "aa", "region").distinct(), [*keys, "chain", "res_seq", "aa"]).groupBy(*keys, "chain", "region").agg(F.min("at").alias("first"), (F.max("at") + 1).alias("after"))
    whole = places.join(roles.where("role = 'peptide'").select("complex_id", "chain"), ["complex_id", "chain"]).groupBy(*keys, "chain").agg(F.lit(0).alias("first"), F.count("*").alias("after")).withColumn("region", F.lit("peptide"))
    score = interface.region_score(places, spans.unionByName(whole), keys, [*names[0::2], "peptide"], [*names[1::2], "peptide"])

    tokens = places.select(*keys, "chain", F.col("at").alias("residue"), "token")
    sides = _sides(atoms, roles, places, keys)
    chains = interface.chain_confidence(sides, confidences, keys)
    per_side = chains.groupBy(*keys).agg(*[F.max(F.when(F.col("chain") == side, F.col(c))).alias(f"{c}_{side.lower()}") for c in ("avgipde", "avgipae", "pdockq2") for side in "AB"])

    own = interface.ipsae_blocks(confidences, tokens, keys, cutoff=cutoff)
    pair_scores = None
    for c in ("ipSAE", "ipSAE_d0chn", "ipSAE_d0dom", "ipTM_d0chn"):
        one = interface.symmetric_max(own, keys, c, [])
        pair_scores = one if pair_scores is None else pair_scores.join(one, [*keys, "chain_a", "chain_b"])
    low, high = F.least("chain1", "chain2").alias("chain_a"), F.greatest("chain1", "chain2").alias("chain_b")
    lis = own.select(*keys, low, high, "LIS").groupBy(*keys, "chain_a", "chain_b").agg(F.avg("LIS").alias("LIS"))
    means = interface.interface_means(pair_scores.join(lis, [*keys, "chain_a", "chain_b"]), keys, ["ipSAE", "ipSAE_d0chn", "ipSAE_d0dom", "ipTM_d0chn", "LIS"])
    means = means.toDF(*keys, "ipsae", "ipsae_d0chn", "ipsae_d0dom", "iptm_d0chn", "lis")

    parts = [confidence(atoms, summaries, roles), loops_, peptide, score, per_side, means, *([seeds] if seeds is not None else [])]
    return quality_metrics([p.withColumnRenamed("complex_id", "tcr_id") for p in parts])


def _sides(atoms: DataFrame, roles: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """One row a residue of the two merged sides: chain (A or B), token, and the place and b of its CA and CB."""
    table = F.create_map(*[F.lit(x) for kv in structure.SIDES.items() for x in kv])
    rows = atoms.where("record = 'ATOM' and atom_name in ('CA', 'CB')").join(roles, ["complex_id", "chain"]).withColumn("side", F.try_element_at(table, F.col("role"))).where("side is not null")
    at = places.select(*keys, "chain", "res_seq", F.col("icode").alias("ic__"), "token")
    rows = rows.join(at, [*keys, "chain", "res_seq"]).where(F.col("icode").eqNullSafe(F.col("ic__")))
    own = [F.max(F.when(F.col("atom_name") == a.upper(), F.col(c).cast("double"))).alias(f"{a}_{c}") for a in ("ca", "cb") for c in (*spatial.XYZ, "b")]
    return rows.groupBy(*keys, F.col("side").alias("chain"), "token").agg(*own)


def structure_similarity(models: DataFrame, model_roles: DataFrame, natives: DataFrame, native_roles: DataFrame) -> DataFrame:
    """Best and mean similarity of every model's merged structure to a panel of reference structures."""
    packed = lambda atoms, roles: similarity.packed_structures(structure.merge_chains(atoms, roles))
    return similarity.structure_stats(packed(models, model_roles), packed(natives, native_roles)).withColumnRenamed("complex_id", "tcr_id")


def sequence_similarity(queries: DataFrame, references: DataFrame, kernel=similarity.region_distance) -> DataFrame:
    """tcr_id, the loops' distances, and the similarity of MHC sequence (local alignment) and peptide (edits) to a panel of receptors."""
    own, panel = similarity.receptor_table(queries), similarity.receptor_table(references)
    out = similarity.loop_distances(own, panel, kernel)
    whole = queries.join(own.select("tcr_id"), "tcr_id", "left_semi").groupBy("tcr_id").agg(F.min("MHC_seq").alias("MHC_seq"), F.min("Epitope").alias("Epitope"))
    refs = references.join(panel.select("tcr_id"), "tcr_id", "left_semi")
    for col, name, score in (("MHC_seq", "MHC", similarity.local_similarity), ("Epitope", "Epitope", similarity.edit_similarity)):
        whole = similarity.with_reference_stats(whole, refs, col, col, f"sim_{name}", score)
    return out.join(whole.drop("MHC_seq", "Epitope"), "tcr_id")


def replica_consensus(atoms: DataFrame, roles: DataFrame) -> DataFrame:
    """DockQ and its terms of every pair of replicas of a complex."""
    merged = structure.merge_chains(atoms, roles).select("complex_id", "model_number", "chain", "res_seq", "atom_name", *spatial.XYZ)
    models = merged.select("complex_id", "model_number").distinct()
    pairs = joins.pairs_within(models.withColumn("one", F.lit(1)), ["complex_id"], "model_number", ["one"]).select("complex_id", "model_number_i", "model_number_j")
    side = lambda col, name: pairs.join(merged.withColumnRenamed("model_number", col), ["complex_id", col]).withColumn("side", F.lit(name))
    cols = ["complex_id", "model_number_i", "model_number_j", "side", "chain", "res_seq", "atom_name", *spatial.XYZ]
    both = side("model_number_i", "model").select(*cols).unionByName(side("model_number_j", "native").select(*cols))
    return structure.compare_pairs(both, ["complex_id", "model_number_i", "model_number_j"])


def job_requests(candidates: DataFrame, b2m: str, dialect: str = "local", order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(specs, dead letters) of candidates, with ids made where there are none."""
    from ..functions.keys import with_ids

    rows = with_ids(candidates, order or [F.col("Epitope"), F.col("TCRA")])
    return sinks.job_specs(rows, b2m, dialect), sinks.rejected(rows) if dialect == "hosted" else sinks.rejected(rows.limit(0))
