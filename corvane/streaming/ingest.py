"""Incremental ingestion, an extension of the engine: what a skip-if-done run does by listing, a stream does by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet", by: list[str] | None = None) -> StreamingQuery:
    """Run ``transform`` over the files that are new since the last call and append the result; each file counts once."""
    stream = transform(spark.readStream.schema(schema).format(fmt).load(source))
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*by) if by else writer).start()


def upserts(spark: SparkSession, source: str, schema: str, checkpoint: str, merge: Callable[[DataFrame, int], None], fmt: str = "parquet") -> StreamingQuery:
    """Hand each batch of new rows to ``merge`` with its number, which a sink uses to apply a batch once."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
