"""Embedding tables: unpivoted inputs, pooling, complete parts, feature vectors, last-wins upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import has_nan
from ..schemas import EMBEDDINGS
from ..storage import materialized
from .joins import last_by

PARTS = ("TCRA", "TCRB", "MHC_seq", "Epitope")
#: The (part, region) pairs of each kind of input, in the order in which vectors are joined.
KINDS = {
    "var": [("TCRA", "var"), ("TCRB", "var"), ("Epitope", ""), ("MHC_seq", "")],
    "cdrs": [*[("TCRA", f"cdr{i}") for i in (1, 2, 3)], *[("TCRB", f"cdr{i}") for i in (1, 2, 3)], ("Epitope", ""), ("MHC_seq", "")],
    "cdr3s": [("TCRA", "cdr3"), ("TCRB", "cdr3"), ("Epitope", ""), ("MHC_seq", "")],
    "cdr3a": [("TCRA", "cdr3"), ("Epitope", ""), ("MHC_seq", "")],
    "cdr3b": [("TCRB", "cdr3"), ("Epitope", ""), ("MHC_seq", "")],
}


def unpivot_sequences(df: DataFrame, keys: list[str], parts: tuple[str, ...] = PARTS) -> DataFrame:
    """keys, part, sequence: a row for each part that isn't null or blank, trimmed."""
    long = df.select(*keys, *parts).unpivot(keys, list(parts), "part", "sequence")
    return long.withColumn("sequence", F.trim("sequence")).where("sequence <> ''")


def vectors_of(store: DataFrame, kind: str, extra: list[str] | None = None) -> DataFrame:
    """tcr_id, x: the joined vectors of ids that have every part of the kind, none with NaN.

    The filter on part and region reaches the scan. One aggregation finds, checks and orders the parts.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    want = KINDS[kind]
    key = F.concat_ws(":", "part", F.coalesce("region", F.lit("")))
    rows = store.where(F.col("part").isin(*sorted({p for p, _ in want})) & F.coalesce("region", F.lit("")).isin(*sorted({r for _, r in want}))).where(~has_nan(F.col("vec")))
    own = [F.max(F.when(key == f"{p}:{r}", F.col("vec"))).alias(f"v{i}") for i, (p, r) in enumerate(want)]
    got = rows.groupBy("tcr_id").agg(*own).dropna()
    return got.select("tcr_id", F.concat(*[F.col(f"v{i}") for i in range(len(want))]).alias("x"))


def lacking_parts(store: DataFrame, kind: str) -> DataFrame:
    """tcr_id, missing: the ids of the store that lack parts of the kind, and which, in order."""
    names = [f"{p}:{r}".rstrip(":") for p, r in KINDS[kind]]
    key = F.regexp_replace(F.concat_ws(":", "part", F.coalesce("region", F.lit(""))), ":$", "")
    own = store.groupBy("tcr_id").agg(F.collect_set(F.when(key.isin(*names), key)).alias("has"))
    lacks = F.array_except(F.array(*[F.lit(n) for n in names]), F.col("has"))
    return own.select("tcr_id", F.array_join(lacks, ",").alias("missing")).where("missing <> ''")


def bimodal(vectors: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """tcr_id, x: sequence vectors followed by structural features."""
    own = features.select("tcr_id", F.array(*[F.col(n).cast("float") for n in names]).alias("more"))
    return vectors.join(own, "tcr_id").select("tcr_id", F.concat("x", "more").alias("x"))


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the new rows in place of those of equal key."""
    keys = ["tcr_id", "part", "region"]
    both = store.withColumn("at__", F.lit(0)).unionByName(new.withColumn("at__", F.lit(1)))
    return last_by(both, keys, "at__").drop("at__")


#: Buckets of a stored table of embeddings, and how its files carry them and the batches that are in it.
STORE_BUCKETS, BUCKET, BATCHES = 64, "bucket", "_batches"


def _bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64("tcr_id", "part", "region"), F.lit(buckets)).cast("int"))


def stored_batches(spark: SparkSession, path: str) -> set[int]:
    """The numbers of the batches that are in a store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCHES}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return set()
    return {r.batch for r in spark.read.schema("batch long").parquet(f"{path}/{BATCHES}").collect()}  # a row a batch


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store, without its buckets."""
    return spark.read.schema(f"{EMBEDDINGS}, {BUCKET} int").parquet(path).drop(BUCKET)


def upsert_store(new: DataFrame, path: str, batch: int, buckets: int = STORE_BUCKETS) -> bool:
    """Put a batch of rows into the store at ``path``, in place of those of equal key; False for a batch that is there already.

    Keys are dealt to buckets, which are the store's partitions. Only those that the batch touches are read, joined with it
    and overwritten; all other files stay as they are. The batch's number is written after its rows, so a run that
    ends between the two is repeated and gives the same rows. ``buckets`` may not change over a store's life.
    """
    spark = new.sparkSession
    if batch in stored_batches(spark, path):
        return False
    rows = materialized(_bucket(new.select("tcr_id", "part", "region", "vec"), buckets), "new-embeddings")
    touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if touched and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        old = spark.read.schema(f"{EMBEDDINGS}, {BUCKET} int").parquet(path).where(F.col(BUCKET).isin(touched))
        rows = materialized(_bucket(upsert(old.drop(BUCKET), rows.drop(BUCKET)), buckets), "merged-embeddings")
    rows.repartition(len(touched) or 1, BUCKET).write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{path}/{BATCHES}")
    return True


def stub_encoder(sequences: list[str], size: int = 16) -> list[np.ndarray]:
    """Deterministic vectors by residue, a stand-in for a language model in tests: sines of letter and place."""
    steps = np.arange(1, size + 1)
    return [np.sin(np.outer(np.frombuffer(s.encode("ascii", "replace"), np.uint8).astype(float) + np.arange(len(s)) / 7, steps)).astype(np.float32) for s in sequences]


def embed(sequences: DataFrame, encoder: Callable[[list[str]], list[np.ndarray]] = stub_encoder, normalise: bool = False) -> DataFrame:
    """tcr_id, part, region, vec: mean vectors of the regions of each sequence.

    ``sequences``: tcr_id, part, region, sequence, first, last (places from 1 in the sequence, null for the whole).
    The encoder maps sequences to residue vectors; it runs on Arrow batches sorted by length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df = df.sort_values("sequence", key=lambda s: s.str.len(), kind="stable")
            vec = []
            for v, a, b in zip(encoder(list(df["sequence"])), df["first"], df["last"], strict=True):
                if normalise:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                part = v if pd.isna(a) else v[int(a) - 1 : int(b)]
                vec.append(part.mean(0).astype(np.float32).tolist() if len(part) else None)
            yield pd.DataFrame({"tcr_id": df["tcr_id"], "part": df["part"], "region": df["region"], "vec": vec})

    return sequences.select("tcr_id", "part", "region", "sequence", "first", "last").mapInPandas(run, "tcr_id string, part string, region string, vec array<float>").where("vec is not null")
