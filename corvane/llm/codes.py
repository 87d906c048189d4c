"""Vector code compression: integer Lloyd rounds by Hamerly's bounds, one codebook a part.

A vector's components become integers floor(scale * x) and are cut into equal consecutive parts. Each part position has
a codebook, which starts as that part of the vectors of the smallest ids. A round assigns every part to the nearest
entry (squared Euclidean distance over integers, ties to the lower index) and replaces each entry by the componentwise
floor of its parts' mean. What a round has to look at is bounded as Hamerly does it: with each part an upper bound on the
distance to its entry and a lower one on the distance to the second nearest are kept in the written table. When entries move,
the bounds move by as much; a part whose upper bound is *strictly* less than its lower one, or than half the
distance from its entry to the next, has no other entry as near as its own, not even at a tie, and keeps it. Else its
exact distance takes the upper bound's place, and only if that fails too, all entries are compared, in integers.

Bounds are 32-bit floats rounded outwards, so rounding never lets a part pass that could change. The driver holds the
codebooks (parts x entries x width integers) and nothing that grows with the table.

Rows: a vector that is null or holds null or non-finite components takes no part; neither does one with a component
beyond 2^62 in size after scaling, nor one of another length than the vector of the smallest id that can be cut into the
parts. Rows may repeat; among equal ids the smaller vector comes first, null ids come last. With fewer vectors than entries
there are as many entries as vectors. An error beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, kind, map_rows, scratch, sized_join, written

#: Up to this size of integers squared distances of parts are summed in 64 bits, else in Python's integers.
NARROW = 1 << 26
#: Parts whose distances to all entries are in memory at a time.
CELLS = 1 << 21


@dataclass
class Codebooks:
    """``entries``: parts x entries x width integers, of Python's kind where they are large."""

    entries: np.ndarray
    #: how far each entry has moved in the last round, rounded up (parts x entries)
    moved: np.ndarray | None = None

    def wide(self) -> bool:
        return bool(self.entries.size) and max(abs(int(self.entries.max())), abs(int(self.entries.min()))) > NARROW

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, not less; also covers the errors of a few operations on 64-bit floats."""
    return np.nextafter((np.asarray(x, np.float64) * (1 + 2.0**-48)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((np.asarray(x, np.float64) * (1 - 2.0**-48)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def scan(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part (rows x width) its nearest entry's index, the squared distance to it and to the second nearest entry."""
    best, first, second = [], [], []
    for at in range(0, len(parts), max(1, CELLS // entries.size)):
        some = parts[at : at + max(1, CELLS // entries.size)]
        far = ((some[:, None, :] - entries[None]) ** 2).sum(axis=2)
        near = far.argmin(axis=1)  # the first of equal ones
        rows = np.arange(len(some))
        best.append(near)
        first.append(far[rows, near])
        if far.shape[1] > 1:
            far[rows, near] = far.max() + 1
            second.append(far.min(axis=1))
        else:
            second.append(np.full(len(some), -1, dtype=far.dtype))  # no other entry
    return np.concatenate(best), np.concatenate(first), np.concatenate(second)


def gaps(entries: np.ndarray) -> np.ndarray:
    """Half the distance from each entry of a part's codebook to the nearest other, rounded down."""
    if len(entries) < 2:
        return np.full(len(entries), np.inf, np.float32)
    far = ((entries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    far[np.arange(len(entries)), np.arange(len(entries))] = far.max() + 1
    return down(root(far.min(axis=1)) / 2)


def reassign(parts: np.ndarray, books: Codebooks, p: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds of the parts at position p after the entries moved, and how many parts were compared with all entries."""
    entries, moved = books.entries[p], books.moved[p]
    code, upper, lower = code.copy(), up(upper.astype(np.float64) + moved[code]), lower.astype(np.float64)
    most = int(moved.argmax())
    rest = np.delete(moved, most).max() if len(moved) > 1 else 0.0
    lower = down(lower - np.where(code == most, rest, moved[most]))  # by the largest move of an entry that isn't its own
    bound = np.maximum(lower, gaps(entries)[code])
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = up(root(((parts[open_] - entries[code[open_]]) ** 2).sum(axis=1)))
    open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        code[open_], first, second = scan(parts[open_], entries)
        upper[open_], lower[open_] = up(root(first)), _second(second)
    return code, upper, lower, len(open_)


def _second(squares: np.ndarray) -> np.ndarray:
    return np.where(squares.astype(np.float64) < 0, np.float32(np.inf), down(root(np.maximum(squares, 0))))


def integers(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """``df`` with ``ints``: the components as longs, of the vectors that take part."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    good = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(1 << 62) / scale))
    return df.where(good).withColumn("ints", F.transform(vec, lambda x: F.floor(x * scale).cast("long")))


def _matrix(batch: pa.RecordBatch, wide: bool) -> np.ndarray:
    ints = batch.column("ints")
    flat = ints.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    wide = wide or bool(flat.size) and max(abs(int(flat.max())), abs(int(flat.min()))) > NARROW
    return flat.astype(object) if wide else flat


def _assigned(state: DataFrame, books: Codebooks, parts: int, last: bool) -> DataFrame:
    """``state`` with codes and bounds for these codebooks; the last time with the error of each row."""
    first = "codes" not in state.columns

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            full = _matrix(batch, books.wide())
            n, width = len(full), full.shape[1] // parts
            entries = books.entries.astype(full.dtype)
            own = Codebooks(entries, books.moved)
            codes, upper, lower = np.empty((parts, n), np.uint8), np.empty((parts, n), np.float32), np.empty((parts, n), np.float32)
            scanned, errors = 0, np.zeros(n, dtype=full.dtype)
            if not first:
                was = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, parts).T
                was_up, was_low = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, parts).T for c in ("upper", "lower"))
            for p in range(parts):
                part = full[:, p * width : (p + 1) * width]
                if first:
                    codes[p], near, second = scan(part, entries[p])
                    upper[p], lower[p] = up(root(near)), _second(second)
                    scanned += n
                else:
                    codes[p], upper[p], lower[p], k = reassign(part, own, p, was[p].astype(np.int64), was_up[p], was_low[p])
                    scanned += k
                if last:
                    errors = errors + ((part - entries[p][codes[p]]) ** 2).sum(axis=1)
            lists = [pa.ListArray.from_arrays(np.arange(0, (n + 1) * parts, parts, dtype=np.int32), pa.array(x.T.ravel())) for x in (upper, lower)]
            rows = np.ascontiguousarray(codes.T)
            code = pa.array([r.tobytes() for r in rows], pa.binary())
            fits = [int(e) if int(e) < 1 << 63 else None for e in errors] if last else [None] * n
            counts = np.zeros(n, np.int64)
            counts[0] = scanned
            return pa.RecordBatch.from_arrays([batch.column("own_id"), batch.column("own_label"), batch.column("ints"), code, *lists, pa.array(fits, pa.int64()), pa.array(counts)],
                                              ["own_id", "own_label", "ints", "codes", "upper", "lower", "error", "scanned"])

        return step

    schema = f"own_id {kind(state, 'own_id')}, own_label {kind(state, 'own_label')}, ints array<long>, codes binary, upper array<float>, lower array<float>, error long, scanned long"
    return map_rows(state, make, schema)


def _moved(state: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """The codebooks after a round: floors of means, added up in each task and then by part and entry."""
    entries, width = books.entries.shape[1], books.entries.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            full = _matrix(batch, False)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(full), parts)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                some = np.zeros((entries, width), full.dtype)
                np.add.at(some, codes[:, p], full[:, p * width : (p + 1) * width])
                total[p] += some.astype(object)
        at = np.argwhere(count > 0)
        if len(at):
            sums = [[Decimal(x) for x in total[p, e]] for p, e in at]
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[count > 0]), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "total"])

    made = state.select("ints", "codes").mapInArrow(sums, "part int, entry int, n long, total array<decimal(38,0)>")
    spread = made.select("part", "entry", "n", F.posexplode("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    new = books.entries.astype(object)
    for r in spread.collect():  # parts x entries x width rows at most
        new[r.part, r.entry, r.place] = int(r.x) // int(r.n)
    moved = up(root(((new - books.entries.astype(object)) ** 2).sum(axis=2))).astype(np.float64)
    return Codebooks(new if Codebooks(new).wide() else new.astype(np.int64), moved)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """(own_id, own_label, codes, error, scanned) of the rows that take part, and the final codebooks.

    ``codes`` has a byte for each part; the sum of ``scanned`` is how often the last assignment compared a part with all entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("string")
    with scratch():
        rows = integers(df.select(F.col(f"`{id_col}`").alias("own_id"), label.alias("own_label"), F.col(f"`{vec_col}`").alias("own_vec")), "own_vec", scale).drop("own_vec")
        rows = rows.where((F.size("ints") > 0) & (F.size("ints") % parts == 0))
        order = [F.col("own_id").asc_nulls_last(), F.size("ints"), F.col("ints")]
        shape = rows.orderBy(*order).select(F.size("ints")).first()
        if shape is None:
            return _assigned(rows, Codebooks(np.zeros((parts, 0, 0), np.int64)), parts, True), Codebooks(np.zeros((parts, 0, 0), np.int64))
        rows = rows.where(F.size("ints") == shape[0])
        seeds = np.array([r.ints for r in rows.orderBy(*order).select("ints").limit(entries).collect()], dtype=object)
        seeds = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2)
        books = Codebooks(seeds if Codebooks(seeds).wide() else seeds.astype(np.int64))
        state = rows
        for n in range(rounds + 1):
            state = written(_assigned(state, books, parts, n == rounds), f"codes-{n}")
            if n < rounds:
                books = _moved(state, books, parts)
        return keep(state), books


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: each vector's code and error, its label's error, and the digest of the codebooks."""
    found, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    if not books.entries.size:
        labels = found.groupBy("own_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("own_label", "label")
    else:
        labels = written(found.groupBy(F.col("own_label").alias("label")).agg(F.sum("error").alias("label_error")), "label-errors")
    rows = sized_join(found, labels, F.col("own_label").eqNullSafe(F.col("label")), "inner")
    return rows.select(F.col("own_id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
