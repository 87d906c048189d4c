"""Delimited tables with explicit schemas and one rule for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..schemas import PEPTIDE_MATCHES, nan_to_null

MISSING = ("", "NA", "NaN", "nan", "null", "None", "N/A")


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """A table with a header, read by column name into the schema: missing columns are null, further ones are left out.

    The names of the header come from the files; the values of a column are text until cast, and the usual marks of a
    missing value are null in every type.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", False).csv(path)
    out = []
    for f in StructType.fromDDL(schema):
        if f.name not in raw.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        col = F.trim(F.col(f"`{f.name}`"))
        col = F.when(~col.isin(*MISSING), col)
        out.append((col if isinstance(f.dataType, StringType) else col.try_cast(f.dataType)).alias(f.name))
    return nan_to_null(raw.select(*out))


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return read_delimited(spark, path, schema)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return read_delimited(spark, path, schema, sep="\t")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line, text: the lines of whole small text files, numbered from 0 within each file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def read_peptide_matches(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated matches without a header: the first two lines are skipped, the first five columns read."""
    parts = F.split("text", "\t")
    rows = numbered_lines(spark, path).where("line >= 2 and trim(text) <> ''")
    fields = StructType.fromDDL(PEPTIDE_MATCHES)
    return rows.select("line", *[F.try_element_at(parts, F.lit(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cached_or(spark: SparkSession, path: str, required: list[str], compute) -> DataFrame:
    """The table at ``path`` if it is there with all required columns, else what ``compute`` gives."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return compute()
    return found if set(required) <= set(found.columns) else compute()
