"""Explicit schemas of the tables that the engine reads and writes. Ids are strings; doubles are null, never NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

CANDIDATES = "tcr_id string, TCRA string, TCRB string, TRAV string, TRAJ string, TRBV string, TRBJ string, CDR3a string, CDR3b string, MHC_allele string, MHC_seq string, Epitope string"
HLA = "mhc_allele string, mhc_seq string"
BINDING = "peptide string, allele string, core string, icore string, EL_score double, EL_rank double, BA_score double, BA_rank double"
PRESENTATION = "peptide string, allele string, mhcflurry_affinity double, mhcflurry_affinity_percentile double, mhcflurry_processing_score double, mhcflurry_presentation_score double, mhcflurry_presentation_percentile double"
IMMUNOGENICITY = "epitope string, HLA_allele string, uniprot_id string, PredIG double, NOAH double, NetCleave double"
PEPTIDE_MATCHES = "Query string, Subject string, SubjectLength int, MatchStart int, MatchEnd int"
ATOMS = "complex_id string, model_number int, record string, serial int, atom_name string, res_name string, chain string, res_seq int, icode string, x double, y double, z double, occ double, b double, ord long"
CHAIN_INFO = "`pdb.id` string, `chain.id` string, `chain.component` string, `chain.type` string, `chain.supertype` string"
CONTACTS = "pdb_id string, chain_from string, chain_to string, residue_from string, residue_to string, resid_from int, resid_to int, atom_from string, atom_to string, dist double"
POTENTIALS = "kind string, residue_from string, residue_to string, potential double"
DOCKING = "tcr_id string, model_number int, Conf int, Ele double, Desolv double, VDW double, Total double, RANK int"
CONFIDENCES = "pae array<array<double>>, contact_probs array<array<double>>, atom_plddts array<double>"
SUMMARY = "chain_iptm array<double>, chain_ptm array<double>, chain_pair_iptm array<array<double>>, ranking_score double"
RANKING = "seed string, sample int, ranking_score double"
JOB = "name string, modelSeeds array<string>, sequences array<struct<protein:struct<id:string,sequence:string,unpairedMsa:string,pairedMsa:string,templates:array<string>>,proteinChain:struct<sequence:string,count:int>>>, dialect string, version int"
EMBEDDINGS = "tcr_id string, part string, region string, vec array<float>"
PREDICTIONS = "tcr_id string, probs float"
MANIFEST = "batch string, name string, pdb_path string"

#: The order of the quality metrics columns.
METRICS = [
    "tcr_id", "model_number", "seed", "plddt", "cdr1a_plddt", "cdr1b_plddt", "cdr2a_plddt", "cdr2b_plddt", "cdr3a_plddt", "cdr3b_plddt", "peptide_plddt", "cdrs_peptide_plddt",
    "iptm_mean", "ptm_mean", "iptm_tcrpmhc", "pdockq", "avgipde_b", "avgipde_a", "avgipae_b", "avgipae_a", "pdockq2_b", "pdockq2_a", "has_contacts", "ipsae", "ipsae_d0chn", "ipsae_d0dom", "iptm_d0chn", "lis", "ranking_score",
]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a double or float column as null, as the engine's tables never hold NaN."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def require(df: DataFrame, *alternatives: list[str]) -> DataFrame:
    """``df``, if it has all columns of one of the alternatives; else a ValueError that names what is missing."""
    for names in alternatives:
        if set(names) <= set(df.columns):
            return df
    missing = " or ".join(str(sorted(set(a) - set(df.columns))) for a in alternatives)
    raise ValueError(f"missing columns: {missing}")


def has_schema(df: DataFrame, ddl: str) -> bool:
    """Whether ``df`` has every column of the schema by name and type."""
    own = {f.name: f.dataType for f in df.schema}
    return all(own.get(f.name) == f.dataType for f in StructType.fromDDL(ddl))
