"""One facade over the jobs, with the options that their callers set: preparation, quality, and everything downstream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embeddings, filters, ml, sinks, spatial
from . import scoring


@dataclass(frozen=True)
class Options:
    """What a run can set. Distances are in the unit of the coordinates."""

    preset: str = "EL_rank_weak"
    thresholds: filters.Thresholds = filters.PMHC
    b2m: str = ""
    dialect: str = "local"
    contact_distance: float = 10.0
    energy_distance: float = 5.0
    plddt: float = 70.0
    untrimmed_chains: tuple[str, ...] = ("C", "D", "E")
    pae_cutoff: float = 10.0
    kind: str = "cdr3s"
    models: dict[str, str] = field(default_factory=dict)


class Pipeline:
    """The whole engine for a caller of its jobs. Every method makes lazy tables; inputs that aren't given make no table."""

    def __init__(self, options: Options | None = None):
        self.options = options or Options()

    def prepare(self, candidates: DataFrame, dictionary: DataFrame, binding: DataFrame, presentation: DataFrame, immunogenicity: DataFrame, sequences: DataFrame | None = None) -> dict[str, DataFrame]:
        """scores, candidates (those that pass the preset), specs of their jobs and rejected ones."""
        o = self.options
        rows = scoring.read_candidates(candidates)
        rows = scoring.stitched(rows, sequences) if sequences is not None else rows
        rows = scoring.add_mhc_sequences(rows, dictionary)
        scores, passed = scoring.filter_candidates(rows, scoring.pmhc_scores(binding, presentation, immunogenicity), o.preset, o.thresholds)
        specs, rejected = scoring.job_requests(passed, o.b2m, o.dialect)
        return {"scores": scores, "candidates": passed, "specs": specs, "rejected": rejected}

    def quality(self, atoms: DataFrame, roles: DataFrame, loop_residues: DataFrame, confidences: DataFrame, summaries: DataFrame, seeds: DataFrame | None = None, forest=None, thresholds: dict[str, float] | None = None) -> DataFrame:
        """The quality metrics of every model after its ends are trimmed, with classes if a forest is given.

        ``confidences`` has the matrices of the trimmed models (``arrays.without`` makes them).
        """
        o = self.options
        kept = filters.trim_terminals(atoms, o.plddt, o.untrimmed_chains)
        table = scoring.quality_table(kept, roles, loop_residues, confidences, summaries, seeds, o.pae_cutoff)
        if forest is None:
            return table
        graded = ml.forest_predict(ml.quality_features(table), forest, list(ml.FEATURES))
        return ml.label_thresholds(graded, thresholds or {})

    def downstream(self, atoms: DataFrame, roles: DataFrame, potentials: DataFrame, docking: DataFrame, metadata: DataFrame, store: DataFrame | None = None, labels: DataFrame | None = None, **reports: DataFrame) -> tuple[scoring.FinalTables, dict[str, DataFrame]]:
        """(final tables, more: energies, matrix, and metrics of each prediction where labels are given).

        ``reports`` are similarity tables (``sim_seq``, ``sim_str``) and others that go into the output as they are.
        """
        o = self.options
        merged = scoring.structural_table(atoms, roles, potentials, metadata, docking, o.contact_distance, o.energy_distance)
        matrix = scoring.structural_matrix(merged)
        found = scoring.predictions(matrix, store, o.models, o.kind)
        more = {"energies": merged, "matrix": matrix}
        if labels is not None:
            scored = {name: scoring.evaluate(df, labels) for name, df in found.items()}
            more |= {f"metrics_{name}": df for name, df in scored.items() if df is not None}
        return scoring.final_tables(metadata.select("tcr_id").distinct(), found, **reports), more

    def similarity(self, atoms: DataFrame, roles: DataFrame, natives: DataFrame, native_roles: DataFrame, queries: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
        """sim_str and sim_seq: models and receptors against reference panels."""
        return {"sim_str": scoring.structure_similarity(atoms, roles, natives, native_roles), "sim_seq": scoring.sequence_similarity(queries, references)}

    def contacts(self, atoms: DataFrame, roles: DataFrame) -> DataFrame:
        return spatial.contact_map(atoms, roles, self.options.contact_distance)

    def lacking(self, store: DataFrame) -> DataFrame:
        """The ids that lack a part of the kind of vectors this run asks for, for the dead letters."""
        return embeddings.lacking_parts(store, self.options.kind).select(F.col("tcr_id").alias("key"), F.concat(F.lit("no "), "missing").alias("error"))

    def write(self, tables: scoring.FinalTables, folder: str) -> list[str]:
        return sinks.export_csv(tables.named(), folder)
