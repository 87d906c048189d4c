"""Residue-pair energies from contacts: kinds, potentials, sums by peptide position, feature ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import POSITIONS, aligned_cells, sum_skip_null
from ..functions.scores import ratio
from .joins import last_by, lookup_side

KINDS = ("tcr_p", "tcr_mhc", "p_mhc")


def contact_kinds(contacts: DataFrame, max_distance: float = 5.0) -> DataFrame:
    """The contacts up to and including the distance with known residues, each with its ``kind``, in one pass."""
    tcr = F.col("role_from").isin("tcra", "tcrb")
    kind = (F.when(tcr & (F.col("role_to") == "peptide"), "tcr_p").when(tcr & (F.col("role_to") == "mhc"), "tcr_mhc")
            .when((F.col("role_from") == "peptide") & (F.col("role_to") == "mhc"), "p_mhc"))
    known = (F.col("residue_from") != "X") & (F.col("residue_to") != "X") & (F.col("dist") <= max_distance)
    return contacts.where(known).withColumn("kind", kind).where("kind is not null")


def with_potential(contacts: DataFrame, potentials: DataFrame, keys: tuple[str, ...] = ("kind", "residue_from", "residue_to"), ordinal: str | None = None) -> DataFrame:
    """The contacts with ``potential``, 0 for pairs that the table lacks; of repeated table rows the last counts."""
    table = potentials if ordinal is None else last_by(potentials.select(*keys, "potential", ordinal), list(keys), ordinal)
    side = lookup_side(table.select(*keys, F.col("potential").alias("potential__")))
    return contacts.join(side, list(keys), "left").withColumn("potential", F.coalesce("potential__", F.lit(0.0))).drop("potential__")


def complex_energies(contacts: DataFrame, peptides: DataFrame, keys: tuple[str, ...] = ("complex_id", "model_number"), round_to: int = 4, models: DataFrame | None = None) -> DataFrame:
    """One row a model: sums and counts by peptide position and in total, positions 1 to 13.

    ``models`` has the keys of all models: those without a contact that counts get a row of zeros; where it isn't given, models
    without any contact have no row.

    ``contacts`` have kind, potential and residue numbers; ``peptides``: complex_id, Epitope of 8 to 13 residues
    (others are left out). A contact counts if the peptide residue's number is at most the peptide's length. Energies
    are rounded only at the end.
    """
    length = peptides.select("complex_id", "Epitope", F.length("Epitope").alias("length")).where(F.col("length").between(8, POSITIONS))
    rows = contacts.join(lookup_side(length), "complex_id")
    position = F.when(F.col("kind") == "tcr_p", F.col("resid_to")).when(F.col("kind") == "p_mhc", F.col("resid_from"))
    rows = rows.withColumn("position", F.when(position.between(1, F.col("length")), position))
    out = []
    for kind, short, total in (("tcr_p", "tcr_p", "tcr_p"), ("p_mhc", "pmhc_p", "pmhc")):
        own = (F.col("kind") == kind) & F.col("position").isNotNull()
        out += [F.sum(F.when(own, F.col("potential"))).alias(f"e_{total}_all"), F.count_if(own).alias(f"c_{total}_all")]
        for i in range(1, POSITIONS + 1):
            at = own & (F.col("position") == i)
            out += [F.sum(F.when(at, F.col("potential"))).alias(f"e_{short}{i}"), F.count_if(at).alias(f"c_{short}{i}")]
    mhc = F.col("kind") == "tcr_mhc"
    out += [F.sum(F.when(mhc, F.col("potential"))).alias("e_tcr_mhc"), F.count_if(mhc).alias("c_tcr_mhc")]
    got = rows.groupBy(*keys, "Epitope").agg(*out)
    if models is not None:
        every = models.select(*keys).distinct().join(lookup_side(length.drop("length")), "complex_id")
        got = every.join(got, [*keys, "Epitope"], "left").fillna(0, [c for c in got.columns if c.startswith("c_")])
    return got.select(*[F.round(F.coalesce(F.col(c), F.lit(0.0)), round_to).alias(c) if c.startswith("e_") else F.col(c) for c in got.columns])


def structural_features(energies: DataFrame, length_col: str = "Epitope") -> DataFrame:
    """Per model: counts and energy ratios over nine aligned positions, totals and the ratio to the MHC."""
    df = energies
    for pattern in ("c_tcr_p{}", "e_tcr_p{}", "c_pmhc_p{}", "e_pmhc_p{}"):
        cells = aligned_cells([pattern.format(i) for i in range(1, POSITIONS + 1)], f"length(`{length_col}`)")
        df = df.select("*", *[c.alias(pattern.format(i + 1) + "_aln") for i, c in enumerate(cells)])
    df = df.select("*", *[ratio(F.col(f"e_tcr_p{i}_aln"), F.col(f"c_tcr_p{i}_aln")).alias(f"ratio_{i}") for i in range(1, 10)],
                   *[ratio(F.col(f"e_pmhc_p{i}_aln"), F.col(f"c_pmhc_p{i}_aln")).alias(f"ratio_pmhc_{i}") for i in range(1, 10)], ratio(F.col("e_tcr_mhc"), F.col("c_tcr_mhc")).alias("ratio_mhc"))
    total = lambda p: sum_skip_null([F.col(f"{p}{i}_aln") for i in range(1, 10)])
    df = df.withColumn("e_pmhc_p_all", total("e_pmhc_p")).withColumn("c_pmhc_p_all", total("c_pmhc_p"))
    df = df.withColumn("ratio_pmhc_total", ratio(F.col("e_pmhc_p_all"), F.col("c_pmhc_p_all")))
    if {"e_tcr_p_all", "c_tcr_p_all"} <= set(df.columns):
        df = df.withColumn("ratio_tcrp_total", ratio(F.col("e_tcr_p_all"), F.col("c_tcr_p_all")))
    return df.withColumn("e_total", sum_skip_null([F.col(f"e_tcr_p{i}_aln") for i in range(1, 10)])).withColumn("c_total", sum_skip_null([F.col(f"c_tcr_p{i}_aln") for i in range(1, 10)]))


def feature_names(columns: list[str]) -> list[str]:
    """The structural model's features, in order, as far as docking columns are there."""
    fixed = [*[f"c_tcr_p{i}_aln" for i in range(1, 10)], "c_tcr_mhc", *[f"ratio_{i}" for i in range(1, 10)], "ratio_mhc"]
    return [*fixed, *[c for c in ("Ele", "Desolv", "VDW", "Total") if c in columns]]


def merge_energies(energies: DataFrame, docking: DataFrame, metadata: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Energies with docking terms (models without them go), and metadata and metrics where given."""
    from .joins import left_preferring

    on = ["tcr_id", "model_number"]
    out = energies.join(docking.withColumn("total_w1", F.col("Ele") + F.col("Desolv") + F.col("VDW")), on)
    for more in (metadata, metrics):
        if more is not None:
            out = left_preferring(out, more, on)
    return out
