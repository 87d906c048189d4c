"""What the operators of this subpackage share: the shared folder, written intermediate tables, batch rows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import shared_dir

_OPEN: list[list[tuple[SparkSession, str]]] = []
_PLACE = "corvane_place"


@contextmanager
def scratch() -> Iterator[None]:
    """Tables ``written`` inside are deleted at the end, but for those that ``keep`` names, which the caller's scratch owns then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path in _OPEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keep(df: DataFrame) -> DataFrame:
    """The written table ``df``, which outlives the innermost ``scratch``."""
    path = getattr(df, _PLACE)
    entry = next(x for x in _OPEN[-1] if x[1] == path)
    _OPEN[-1].remove(entry)
    if len(_OPEN) > 1:
        _OPEN[-2].append(entry)
    return df


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and lost executors do no harm."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    setattr(back, _PLACE, path)
    if _OPEN:
        _OPEN[-1].append((spark, path))
    return back


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch that holds texts, so that batches stay small on both sides whatever the session has set.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def give_back() -> None:
    """Return what Arrow and the C library hold but don't use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker holds no memory that it doesn't use: it waits for its next task beside other stages' joins."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker have had
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return task


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """``mapInArrow`` of a function of a batch that ``make`` builds once in each task.

    With ``rows`` it gets so many rows of a batch at a time, and what they took is returned after the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for k in range(0, batch.num_rows, rows or batch.num_rows or 1):
                yield step(batch.slice(k, rows) if rows else batch)
            if rows:
                give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, kept for later tasks of this Python worker; the worker keeps one such object at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column as Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def kind(df: DataFrame, col: str) -> str:
    """The type of a column, for schemas that carry it on."""
    return df.schema[col].dataType.simpleString()


def as_text(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Only the named columns, so that further columns of any name can't clash; null texts are empty."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: A side of a join is broadcast only if it is a written table whose files have at most so many bytes.
BROADCAST_BYTES = 16 << 20


def sized_join(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a written table: broadcast behind a check of its files' size, else a shuffled join. Results are the same."""
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= most else right, on, how)
