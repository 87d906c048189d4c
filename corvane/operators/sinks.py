"""Outputs: exports, job specifications, dead letters, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import clean_sequence, is_protein


def export_csv(tables: dict[str, DataFrame], folder: str, single: bool = True) -> list[str]:
    """Each table as a CSV folder with a header; one file each if ``single``, for final reports."""
    out = []
    for name, df in tables.items():
        (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        out.append(f"{folder}/{name}")
    return out


def append_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def seed(ident: Column) -> Column:
    """A 32-bit seed that is the same for the same id."""
    return F.pmod(F.xxhash64(ident), F.lit(1 << 32))


def job_specs(candidates: DataFrame, b2m: str, dialect: str = "local", peptide_msa: bool = True) -> DataFrame:
    """tcr_id, spec: a JSON job request of five chains for each candidate.

    ``local``: explicit chain ids A to E (MHC, β2m, peptide, TCRα, TCRβ) and one seed; without ``peptide_msa`` the
    peptide's alignments are empty. ``hosted``: a list of one job without seeds; candidates with other letters than
    the amino acids' are left out (see ``rejected``).
    """
    chains = [("A", clean_sequence(F.col("MHC_seq"))), ("B", F.lit(b2m)), ("C", clean_sequence(F.col("Epitope"))), ("D", clean_sequence(F.col("TCRA"))), ("E", clean_sequence(F.col("TCRB")))]
    if dialect == "hosted":
        rows = candidates.where(accepted())
        seqs = F.array(*[F.struct(F.struct(s.alias("sequence"), F.lit(1).alias("count")).alias("proteinChain")) for _, s in chains])
        spec = F.to_json(F.array(F.struct(F.col("tcr_id").alias("name"), F.array().cast("array<string>").alias("modelSeeds"), seqs.alias("sequences"), F.lit("alphafoldserver").alias("dialect"), F.lit(1).alias("version"))))
        return rows.select("tcr_id", spec.alias("spec"))
    none = F.lit(None).cast("string")

    def chain(name: str, s: Column) -> Column:
        empty = F.lit("") if name == "C" and not peptide_msa else none
        templates = F.array().cast("array<string>") if name == "C" and not peptide_msa else F.lit(None).cast("array<string>")
        return F.struct(F.struct(F.lit(name).alias("id"), s.alias("sequence"), empty.alias("unpairedMsa"), empty.alias("pairedMsa"), templates.alias("templates")).alias("protein"))

    spec = F.to_json(F.struct(F.col("tcr_id").alias("name"), F.array(seed(F.col("tcr_id"))).alias("modelSeeds"), F.array(*[chain(n, s) for n, s in chains]).alias("sequences"), F.lit("alphafold3").alias("dialect"), F.lit(2).alias("version")))
    return candidates.select("tcr_id", spec.alias("spec"))


def accepted() -> Column:
    cols = ["MHC_seq", "Epitope", "TCRA", "TCRB"]
    out = is_protein(clean_sequence(F.col(cols[0])))
    for c in cols[1:]:
        out = out & is_protein(clean_sequence(F.col(c)))
    return out


def rejected(candidates: DataFrame) -> DataFrame:
    return candidates.where(~accepted()).select(F.col("tcr_id").alias("key"), F.lit("not a protein sequence").alias("error"))


def write_specs(specs: DataFrame, path: str) -> None:
    """One JSON text a line, in a folder for each job."""
    specs.select("tcr_id", F.col("spec").alias("value")).write.mode("overwrite").partitionBy("tcr_id").text(path)


def list_text(df: DataFrame, col: str, sep: str = "\n") -> str:
    """The distinct non-null values of a small column, sorted, as one text without a newline at its end."""
    return sep.join(r[0] for r in df.select(col).dropna().distinct().orderBy(col).toLocalIterator())


def dead_letters(df: DataFrame, key: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, (key, error) of those that don't, with the first check that they fail)."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    rows = df.withColumn("error__", error)
    return rows.where("error__ is null").drop("error__"), rows.where("error__ is not null").select(F.col(key).cast("string").alias("key"), F.col("error__").alias("error"))


def write_structures(lines: DataFrame, path: str) -> None:
    """Structures as text, from (complex_id, model_number, ord, line): one folder a model, its lines in order.

    Models are dealt whole to tasks and sorted there. Spark's commit makes a model's file visible when it is whole.
    """
    rows = lines.repartition("complex_id", "model_number").sortWithinPartitions("complex_id", "model_number", "ord")
    rows.select("complex_id", "model_number", F.col("line").alias("value")).write.mode("overwrite").partitionBy("complex_id", "model_number").text(path)


def write_reports(lines: DataFrame, header: str, path: str) -> None:
    """Chain-pair reports as text, from (Model, Chn1, Chn2, Type, line): one folder a model, a header first, the larger of two
    directions after both."""
    low, high = F.least("Chn1", "Chn2"), F.greatest("Chn1", "Chn2")
    rows = lines.select("Model", low.alias("a"), high.alias("b"), (F.col("Type") == "max").cast("int").alias("k"), "Chn1", "line")
    heads = lines.select("Model").distinct().select("Model", F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).alias("k"), F.lit("").alias("Chn1"), F.lit(header).alias("line"))
    both = heads.unionByName(rows).repartition("Model").sortWithinPartitions("Model", "a", "b", "k", "Chn1")
    both.select("Model", F.col("line").alias("value")).write.mode("overwrite").partitionBy("Model").text(path)


def output_paths(files: DataFrame, folder: str) -> DataFrame:
    """path, target: where each file goes in one flat folder, under its own name; of equal names the first path counts."""
    from .joins import first_of

    rows = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).where("name <> ''")
    return first_of(rows, ["name"], [F.col("path")]).select("path", F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("target"))


def counted(df: DataFrame, name: str):
    """(``df``, observation): the number of its rows is known as ``rows`` once any action has run over it, without a pass of its own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def sorted_export(df: DataFrame, by: list[str], folder: str) -> None:
    """One CSV table sorted by columns, for reports whose rows are read in order."""
    df.repartitionByRange(1, *by).sortWithinPartitions(*by).write.mode("overwrite").option("header", True).csv(folder)
