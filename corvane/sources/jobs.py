"""Prediction jobs: layouts of job folders, confidences, summaries, rankings, job requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CONFIDENCES, JOB, MANIFEST, SUMMARY

#: File kinds of one model by layout: hosted jobs number their files, local ones have a folder a sample.
HOSTED = {"model": r"/([^/]+)/[^/]*_model_([0-9]+)\.cif$", "confidences": r"/([^/]+)/[^/]*_full_data_([0-9]+)\.json$", "summary": r"/([^/]+)/[^/]*_summary_confidences_([0-9]+)\.json$"}
LOCAL = {"model": r"/([^/]+)/seed-[0-9]+_sample-([0-9]+)/[^/]*model\.cif$", "confidences": r"/([^/]+)/seed-[0-9]+_sample-([0-9]+)/(?:[^/]*_)?confidences\.json$", "summary": r"/([^/]+)/seed-[0-9]+_sample-([0-9]+)/[^/]*summary_confidences\.json$"}


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path of every file below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path")


def classify(files: DataFrame) -> DataFrame:
    """path, layout, kind, job, model of the files that belong to a model; hosted names lose ``fold_``."""
    summary_first = sorted([(lay, k, p) for lay, table in (("hosted", HOSTED), ("local", LOCAL)) for k, p in table.items()], key=lambda x: x[1] != "summary")
    out = F.lit(None).cast("struct<layout:string,kind:string,job:string,model:int>")
    for lay, kind, pattern in reversed(summary_first):
        job = F.regexp_replace(F.regexp_extract("path", pattern, 1), "^fold_", "")
        own = F.struct(F.lit(lay).alias("layout"), F.lit(kind).alias("kind"), job.alias("job"), F.regexp_extract("path", pattern, 2).try_cast("int").alias("model"))
        out = F.when(F.col("path").rlike(pattern), own).otherwise(out)
    return files.withColumn("c", out).where("c is not null").select("path", "c.*")


def job_layouts(files: DataFrame) -> DataFrame:
    """job, layout, models: one row a job folder and layout."""
    return classify(files).groupBy("job", "layout").agg(F.count_distinct("model").alias("models"))


def complete_models(files: DataFrame) -> DataFrame:
    """job, model, layout and the paths model_path, confidences_path and summary_path; models that lack one are left out. Where
    both layouts have a model, the local one counts."""
    rows = classify(files).groupBy("job", "model", "layout").agg(*[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(f"{k}_path") for k in HOSTED])
    rows = rows.dropna(subset=[f"{k}_path" for k in HOSTED])
    w = Window.partitionBy("job", "model").orderBy(F.desc("layout"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def first_writer(tasks: DataFrame, name: str, precedence: list[str]) -> DataFrame:
    """Of files with one output name, the first by precedence."""
    w = Window.partitionBy(name).orderBy(*precedence)
    return tasks.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def model_paths(files: DataFrame) -> DataFrame:
    """id, model, path of files named ``<id>_<model>.<suffix>``, merged ones left out."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    rows = files.withColumn("name", name).where(~F.col("name").contains("_merged"))
    from ..functions.keys import key_id, key_model

    return rows.select(key_id(F.col("name")).alias("tcr_id"), key_model(F.col("name"), None).alias("model_number"), "path").where("model_number is not null")


def read_confidences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(CONFIDENCES).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def read_summaries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(SUMMARY).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def rankings(summaries: DataFrame) -> DataFrame:
    """The ranking table that hosted jobs don't have: path, ranking_score."""
    return summaries.select("path", "ranking_score")


def read_jobs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Job requests, single or in a list."""
    return spark.read.schema(JOB).option("multiLine", True).json(path)


def job_chains(jobs: DataFrame) -> DataFrame:
    """name, chain, sequence: the request's sequences in order, each ``count`` times, named A, B, C, ..."""
    each = jobs.select("name", F.posexplode("sequences").alias("at", "s"))
    own = F.coalesce("s.proteinChain.sequence", "s.protein.sequence")
    times = F.coalesce("s.proteinChain.count", F.lit(1))
    rows = each.select("name", "at", own.alias("sequence"), F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("copy"))
    place = F.row_number().over(Window.partitionBy("name").orderBy("at", "copy"))
    return rows.withColumn("place", place).select("name", "place", F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1, 26).substr(F.col("place"), F.lit(1)).alias("chain"), "sequence")


def chain_roles(info: DataFrame, ordinal: str, prefix_only: bool = False) -> DataFrame:
    """pdb_id and the chains of the roles tcra, tcrb, peptide, mhc and b2m, from chain descriptions; the last row wins.

    ``prefix_only`` takes what stands before the first dot of the id.
    """
    part = F.col("`chain.component`")
    kind, group = F.col("`chain.type`"), F.col("`chain.supertype`")
    role = (F.when((part == "TCR") & (kind == "TRA"), "tcra").when((part == "TCR") & (kind == "TRB"), "tcrb").when(part == "PEPTIDE", "peptide")
            .when((part == "MHC") & (group == "MHCI") & (kind == "MHCa"), "mhc").when((part == "MHC") & (group == "MHCI") & (kind == "MHCb"), "b2m"))
    ident = F.col("`pdb.id`")
    ident = F.substring_index(ident, ".", 1) if prefix_only else ident
    rows = info.select(ident.alias("pdb_id"), role.alias("role"), F.col("`chain.id`").alias("chain"), F.col(ordinal).alias("at"))
    return rows.groupBy("pdb_id").agg(*[F.max_by("chain", F.when(F.col("role") == r, F.col("at"))).alias(r) for r in ("tcra", "tcrb", "peptide", "mhc", "b2m")])


def read_rankings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, seed, model_number, ranking_score of ranking tables, whose column ``sample`` is the model's number."""
    rows = spark.read.option("header", True).csv(path).withColumn("path", F.col("_metadata.file_path"))
    kinds = {"seed": "string", "sample": "int", "ranking_score": "double"}
    return rows.select("path", *[F.trim(c).try_cast(k).alias("model_number" if c == "sample" else c) for c, k in kinds.items()])


def kind_counts(files: DataFrame) -> DataFrame:
    """layout, kind, files: how many files of each kind belong to models, for a listing's report."""
    return classify(files).groupBy("layout", "kind").agg(F.count("*").alias("files"))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """batch, name, pdb_path of tab-separated manifests or chunks of them, from lines (path, line, text).

    A first line that isn't the header, or a row without three fields, is an error of the whole file: it is a row too, and all
    rows of its path say so in ``error``.
    """
    names = [f.split(" ")[0] for f in MANIFEST.split(", ")]
    f = F.split("text", "\t", -1)
    rows = lines.where("trim(text) <> '' or line = 0").withColumn("f", f)
    bad = F.when((F.col("line") == 0) & (F.col("text") != "\t".join(names)), F.concat(F.lit("unexpected header: "), "text")).when(F.size("f") != len(names), F.concat(F.lit("unexpected row: "), "text"))
    rows = rows.withColumn("own", bad).withColumn("error", F.min("own").over(Window.partitionBy("path")))
    return rows.where("line > 0 or own is not null").select("path", "line", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)], "error")


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The manifest's rows in order of path and line; a ValueError that names an example if a file isn't one."""
    from .tables import numbered_lines

    rows = parse_manifest(numbered_lines(spark, path))
    wrong = rows.where("error is not null").select("path", "error").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].path}: {wrong[0].error}")
    return rows.drop("error")


#: The columns of a chain mapping, by role.
MAPPED = {"peptide_chain": "peptide", "mhc_chain": "mhc", "b2_chain": "b2m", "tcra_chain": "tcra", "tcrb_chain": "tcrb"}


def parse_mapping(text: DataFrame, col: str = "value") -> DataFrame:
    """key and the chain of each role (null where it isn't given) of chain mappings: JSON objects of objects by key."""
    kind = "map<string,struct<" + ",".join(f"{c}:string" for c in MAPPED) + ">>"
    each = text.select(F.explode(F.from_json(F.col(col), kind)).alias("key", "chains"))
    return each.select("key", *[F.col(f"chains.{c}").alias(r) for c, r in MAPPED.items()])


def docking_specs(names: DataFrame, mapping: DataFrame | None = None, mode: str = "exact") -> DataFrame:
    """name, spec: the docking job of each complex, receptor and ligand by their chains.

    Without a mapping the chains are A, B, C and D, E. With one (key and the chains by role), names whose key it lacks, or
    lacks a chain of, have a null spec, for the dead letters.
    """
    from ..operators.joins import lookup_side, mapping_key

    receptor, ligand = F.lit("A,B,C"), F.lit("D,E")
    if mapping is not None:
        names = names.withColumn("key__", mapping_key(F.col("name"), mode)).join(lookup_side(mapping.withColumnRenamed("key", "key__")), "key__", "left")
        every = lambda roles: F.when(sum(F.col(r).isNull().cast("int") for r in roles) == 0, F.concat_ws(",", *roles))
        receptor, ligand = every(["peptide", "mhc", "b2m"]), every(["tcra", "tcrb"])
    part = lambda title, mol, new: F.concat(F.lit(f"[{title}]\npdb = "), "name", F.lit(".pdb\nmol = "), mol, F.lit(f"\nnewmol = {new}\n"))
    return names.select("name", F.concat(part("receptor", receptor, "A"), F.lit("\n"), part("ligand", ligand, "D")).alias("spec"))


def kept_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The files whose name one of the shell patterns (``*``, ``?``, ``[...]``) matches."""
    import fnmatch

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.where(name.rlike("|".join("^" + fnmatch.translate(p).replace("(?s:", "(?:").replace("\\Z", "$").replace("\\z", "$") for p in patterns)))


def listed(value: str | list[str]) -> list[str]:
    """A configuration's list, given as one or as text set apart by commas or spaces; ValueError if it is empty."""
    found = value.replace(",", " ").split() if isinstance(value, str) else [str(v).strip() for v in value]
    if not found or not all(found):
        raise ValueError("a list must not be empty")
    return found
