"""Text reports of predictors as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_id, key_model
from .tables import numbered_lines


def parse_binding(lines: DataFrame) -> DataFrame:
    """Binding predictions from report lines (path, line, text).

    ``# Allele:`` lines set the allele for what follows; rows of data come after a line of dashes that follows it. Only
    rows of 16 or more fields with a whole number first and readable scores count. The carry-forward is by file.
    """
    from ..operators.windows import carry_forward

    text = F.trim("text")
    mark = F.when(text.startswith("# Allele:"), F.trim(F.regexp_replace(text, "^# Allele:", "")))
    rows = lines.withColumn("allele_at", F.when(mark.isNotNull(), F.col("line"))).withColumn("dash_at", F.when(text.startswith("---"), F.col("line"))).withColumn("mark", mark)
    for c, out in (("mark", "allele"), ("allele_at", "since"), ("dash_at", "dashes")):
        rows = carry_forward(rows, ["path"], ["line"], c, out)
    f = F.split(text, r"\s+")
    part = lambda i: F.try_element_at(f, F.lit(i + 1))
    rows = rows.where((F.size(f) >= 16) & part(0).rlike("^[0-9]+$") & (F.col("dashes") > F.col("since")))
    out = rows.select("path", "line", part(2).alias("peptide"), "allele", part(3).alias("core"), part(9).alias("icore"), *[part(i).try_cast("double").alias(n) for i, n in ((11, "EL_score"), (12, "EL_rank"), (13, "BA_score"), (14, "BA_rank"))])
    return out.dropna(subset=["EL_score", "EL_rank", "BA_score", "BA_rank"])


def read_binding(spark: SparkSession, path: str) -> DataFrame:
    return parse_binding(numbered_lines(spark, path)).drop("path", "line")


def parse_docking(lines: DataFrame, compat: str = "fixed") -> DataFrame:
    """Docking energies: the first line of each file that starts with a number and has six or more fields.

    ``fixed`` names the fields as the files' header does (Conf, Ele, Desolv, VDW, Total, RANK); ``reference`` takes
    the names one field later, as models trained on such tables expect. Files are ``<complex>_<model>.ene``.
    """
    from ..operators.joins import first_of

    f = F.split(F.trim("text"), r"\s+")
    rows = lines.where(F.get(f, F.lit(0)).try_cast("double").isNotNull() & (F.size(f) >= 6))
    rows = first_of(rows, ["path"], [F.col("line")])
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    shift = {"fixed": 0, "reference": 1}[compat]
    names = [("Conf", "int"), ("Ele", "double"), ("Desolv", "double"), ("VDW", "double"), ("Total", "double"), ("RANK", "int")]
    value = lambda i, kind: F.get(f, F.lit(i + shift)).try_cast("double").cast(kind)
    return rows.select(key_id(name).alias("tcr_id"), key_model(name).alias("model_number"), *[value(i, k).alias(n) for i, (n, k) in enumerate(names)])


def read_docking(spark: SparkSession, path: str, compat: str = "fixed") -> DataFrame:
    return parse_docking(numbered_lines(spark, path), compat)


def parse_pair_scores(lines: DataFrame) -> DataFrame:
    """Chain-pair score reports: columns by the names of each file's header line, in any order."""
    f = F.split(F.trim("text"), r"\s+")
    rows = lines.where("trim(text) <> ''").withColumn("f", f)
    head = rows.where(F.array_contains("f", "Chn1")).groupBy("path").agg(F.min_by("f", "line").alias("head"), F.min("line").alias("head_at"))
    rows = rows.join(head, "path").where((F.col("line") > F.col("head_at")) & (F.size("f") == F.size("head")))
    names = [("Chn1", "string"), ("Chn2", "string"), ("Type", "string"), *[(n, "double") for n in ("PAE", "Dist", "ipSAE", "ipSAE_d0chn", "ipSAE_d0dom", "ipTM_af", "ipTM_d0chn", "pDockQ", "pDockQ2", "LIS")], *[(n, "int") for n in ("n0res", "n0chn", "n0dom")], *[(n, "double") for n in ("d0res", "d0chn", "d0dom")], *[(n, "int") for n in ("nres1", "nres2", "dist1", "dist2")]]
    at = lambda n: F.get("f", F.array_position("head", n).cast("int") - 1)
    return rows.select("path", "line", *[F.when(F.array_contains("head", n), at(n)).try_cast(k).alias(n) for n, k in names]).where("Type in ('asym', 'max')")


def read_pair_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_pair_scores(numbered_lines(spark, path))
