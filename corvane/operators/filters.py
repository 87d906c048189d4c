"""Filters: thresholds, presets compiled to one predicate, guards, terminal trims."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Cutoffs by metric and strength. ``aliases`` map a metric's short name to its column."""

    cutoffs: dict[str, dict[str, float]]
    lower_is_better: frozenset[str] = frozenset()
    aliases: dict[str, str] | None = None

    def predicate(self, metric: str, strength: str) -> Column:
        if metric not in self.cutoffs or strength not in self.cutoffs[metric]:
            raise ValueError(f"no {strength!r} cutoff for {metric!r}")
        col = F.col(f"`{(self.aliases or {}).get(metric, metric)}`")
        cut = F.lit(float(self.cutoffs[metric][strength]))
        return col <= cut if metric in self.lower_is_better else col >= cut

    def steps(self, preset: str) -> list[tuple[str, Column]]:
        """The steps of a preset, given by its name in ``PRESETS`` or as text such as ``A_strong + B_weak``."""
        out = []
        for token in PRESETS.get(preset.strip().lower(), preset).split("+"):
            metric, _, strength = token.strip().rpartition("_")
            out.append((token.strip(), self.predicate(metric, strength)))
        return out


#: The production cutoffs of candidate filtering. Ranks, percentiles and binding energies are better when low.
PMHC = Thresholds(
    {"NetCleave": {"strong": 0.6}, "mhcflurry_pres": {"strong": 1.0, "weak": 2.0}, "mhcflurry_proc": {"strong": 1.0, "weak": 2.0}, "NOAH": {"strong": -5.0, "weak": -1.0},
     "PredIG": {"strong": 0.19}, "EL_rank": {"strong": 0.5, "weak": 2.0}, "mhcflurry_aff": {"strong": 1.0, "weak": 2.0}, "BA_rank": {"strong": 0.5, "weak": 2.0}},
    frozenset({"mhcflurry_pres", "mhcflurry_proc", "NOAH", "EL_rank", "mhcflurry_aff", "BA_rank"}),
    {"mhcflurry_pres": "mhcflurry_presentation_percentile", "mhcflurry_proc": "mhcflurry_processing_percentile", "mhcflurry_aff": "mhcflurry_affinity_percentile"},
)
#: The presets that users know by name.
PRESETS = {"vhio": "EL_rank_strong", "relaxed": "BA_rank_strong + NOAH_weak + mhcflurry_pres_strong", "stringent": "NetCleave_strong + BA_rank_strong + NOAH_weak"}
#: What a missing score counts as, so that it passes.
PMHC_MISSING = {"EL_rank": 0.0, "BA_rank": 0.0, "mhcflurry_affinity_percentile": 0.0, "mhcflurry_presentation_percentile": 0.0, "mhcflurry_processing_percentile": 0.0, "NOAH": -10.0, "NetCleave": 1.0, "PredIG": 1.0}


def preset_filter(df: DataFrame, preset: str, thresholds: Thresholds) -> DataFrame:
    """The rows that pass all steps; a null score doesn't pass, so impute before."""
    for _, step in thresholds.steps(preset):
        df = df.where(step)
    return df


def preset_counts(df: DataFrame, preset: str, thresholds: Thresholds) -> DataFrame:
    """One row: how many rows are left after each step (``step_1`` ...), in one pass."""
    out, both = [F.count("*").alias("step_0")], F.lit(True)
    for i, (_, step) in enumerate(thresholds.steps(preset), 1):
        both = both & step
        out.append(F.count_if(both).alias(f"step_{i}"))
    return df.agg(*out)


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.fillna({k: v for k, v in values.items() if k in df.columns})


def trim_terminals(atoms: DataFrame, threshold: float = 70.0, keep_chains: tuple[str, ...] = ("C", "D", "E"), value: str = "b", order: str = "ord",
                   model: tuple[str, ...] = ("complex_id", "model_number"), chain: str = "chain", residue: tuple[str, ...] = ("res_seq", "icode")) -> DataFrame:
    """The atoms without low-confidence residues at the two ends of each chain.

    A residue is good if none of its atoms is below the threshold; what lies between a chain's first and last good
    residue stays. A chain without a good residue goes; chains in ``keep_chains`` stay whole.
    """
    per = [*model, chain, *residue]
    res = atoms.groupBy(*per).agg(F.min(value).alias("low"), F.min(order).alias("at"))
    good = res.where(F.col("low") >= threshold).groupBy(*model, chain).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ends = atoms.groupBy(*per).agg(F.min(order).alias("at"))
    kept = ends.join(good, [*model, chain], "left").where(F.col(chain).isin(*keep_chains) | F.col("at").between(F.col("first"), F.col("last")))
    # null insertion codes are a value like any other
    same = [atoms[c].eqNullSafe(kept[c]) for c in per]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return atoms.join(kept, cond, "left_semi")


def threshold_runs(df: DataFrame, group: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """The rows of each group from its first to its last row with ``value`` of ``threshold`` or more."""
    w = Window.partitionBy(*group).orderBy(*order)
    ok = F.when(F.col(value) >= threshold, 1)
    before = F.max(ok).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.max(ok).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.withColumn("before__", before).withColumn("after__", after).where("before__ = 1 and after__ = 1").drop("before__", "after__")


def peptide_lengths(df: DataFrame, col: str = "Epitope", low: int = 8, high: int = 13) -> DataFrame:
    return df.where(F.length(col).between(low, high))


def both_classes(df: DataFrame, label: str) -> bool:
    """Whether both label classes are there, as metrics need."""
    return df.agg(F.count_distinct(label).alias("n")).first().n == 2
