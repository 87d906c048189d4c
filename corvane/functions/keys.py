"""Keys: ids that carry a model number, composite keys, synthetic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered

LAST_PART = r"^(.*)_([^_]*)$"


def key_id(col: Column) -> Column:
    """What stands before the last underscore; the whole string where there is none."""
    return F.when(col.contains("_"), F.regexp_extract(col, LAST_PART, 1)).otherwise(col)


def key_model(col: Column, default: int | None = 0) -> Column:
    """The number after the last underscore; ``default`` where it is none."""
    number = F.regexp_extract(col, LAST_PART, 2).try_cast("int")
    return number if default is None else F.coalesce(number, F.lit(default))


def split_key(df: DataFrame, col: str, id_col: str = "tcr_id", model_col: str = "model_number") -> DataFrame:
    return df.withColumn(id_col, key_id(F.col(col))).withColumn(model_col, key_model(F.col(col)))


def pmhc_key(epitope: Column, allele: Column) -> Column:
    """Peptide and allele as one key; null if either is, and no HLA prefix."""
    return F.concat(epitope, F.lit("_"), F.replace(allele, F.lit("HLA-"), F.lit("")))


def with_ids(df: DataFrame, order: list[Column], id_col: str = "tcr_id") -> DataFrame:
    """Ids 1..n in the given order, if the column is absent; no task orders all rows."""
    if id_col in df.columns:
        return df
    return numbered(df, order, "place__").select((F.col("place__") + 1).cast("string").alias(id_col), *[F.col(f"`{c}`") for c in df.columns])
