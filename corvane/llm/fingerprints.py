"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit codes.

The words of a text, A-Z in lower case, make shingles of ``k`` words (with fewer words, the whole sequence is one). Each
shingle is hashed once: the hash's upper bits name its bin, and a bin keeps its least hash. An empty bin copies a bin that
isn't empty, which a hash of (bin, attempt) picks, the same for all documents; as each bin draws for itself, copies are
spread evenly over the bins that have a value, however few they are. Of each bin ``bits`` low-order bits are stored, packed, as hex digits.

Two codes agree by chance with probability c = 2^-bits, so the estimate of the Jaccard similarity is (m - c) / (1 - c)
with m the share of bins that agree, and at least 0.

Rows: null texts are empty. A text without words has the empty fingerprint, is like another such text (1) and
unlike all others (0). Ids keep their type, and rows may repeat; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_text, documents, kind, map_rows, partitions, written
from .words import U, Words, chunks, mix

EMPTY = U(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Plan:
    """Words of a shingle, bins (a power of two) and stored bits of a bin."""

    k: int = 5
    bins: int = 512
    bits: int = 4

    def __post_init__(self):
        if self.k < 1 or self.bins < 2 or self.bins & (self.bins - 1) or not 1 <= self.bits <= 32:
            raise ValueError("a fingerprint has shingles of a word or more, a power of two of bins, and 1 to 32 bits of each")

    def minima(self, column: pa.Array) -> np.ndarray:
        """texts x bins: the least hash of each bin, EMPTY where there is none."""
        out, shift = [], U(64 - (self.bins.bit_length() - 1))
        for _, _, data, offsets in chunks(column):
            w = Words(data, offsets, lower=True)
            n = np.diff(w.first)
            doc = np.repeat(np.arange(len(n)), n)
            rolled = w.windows(self.k)
            inside = np.flatnonzero(np.arange(len(rolled)) + self.k <= w.first[1:][doc[: len(rolled)]])
            owner, hashes = [doc[inside]], [rolled[inside]]
            for m in range(1, self.k):
                short = np.flatnonzero(n == m)
                owner.append(short)
                hashes.append(w.windows(m)[w.first[short]] if len(short) else rolled[:0])
            h = np.concatenate(hashes)
            least = np.full(len(n) * self.bins, EMPTY, dtype=U)
            np.minimum.at(least, np.concatenate(owner) * self.bins + (h >> shift).astype(np.int64), h)
            out.append(least.reshape(len(n), self.bins))
        return np.concatenate(out) if out else np.zeros((0, self.bins), dtype=U)

    def densified(self, least: np.ndarray) -> np.ndarray:
        """Every bin with a value, but for texts without shingles."""
        filled, full = least.copy(), least != EMPTY
        doc, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
        attempt = 0
        while len(doc):
            # a draw for each bin and attempt, known to all documents
            draw = (mix(np.arange(self.bins, dtype=U) + U(attempt * self.bins)) >> U(33)).astype(np.int64) % self.bins
            source = draw[bin_]
            hit = full[doc, source]
            filled[doc[hit], bin_[hit]] = least[doc[hit], source[hit]]
            doc, bin_ = doc[~hit], bin_[~hit]
            attempt += 1
        return filled

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bins) codes, and which texts have any."""
        least = self.minima(column)
        return (self.densified(least) & U((1 << self.bits) - 1)).astype(np.uint32), (least != EMPTY).any(axis=1)

    def packed(self, codes: np.ndarray, some: np.ndarray) -> list[bytes]:
        """Codes, the highest bit of each first; empty for texts without shingles."""
        split = ((codes[:, :, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint32)) & 1).astype(np.uint8)
        rows = np.packbits(split.reshape(len(codes), -1), axis=1)
        return [r.tobytes() if s else b"" for r, s in zip(rows, some.tolist(), strict=True)]

    def likeness(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Estimated similarities of rows of codes."""
        chance = 2.0**-self.bits
        found = np.maximum(((a[0] == b[0]).mean(axis=1) - chance) / (1 - chance), 0.0)
        return np.where(a[1] & b[1], found, np.where(a[1] == b[1], 1.0, 0.0))


def fingerprints(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fingerprint`` of every whole text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(plan.packed(*plan.codes(batch.column(1))), pa.binary())], [id_col, "fingerprint"])

        return step

    return _hex(map_rows(as_text(docs, text_col, id_col), make, f"`{id_col}` {kind(docs, id_col)}, fingerprint binary"), "fingerprint")


def _hex(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.select(*[F.lower(F.hex(F.col(f"`{c}`"))).alias(c) if c in cols else F.col(f"`{c}`") for c in rows.columns])


def likeness(a: Column, b: Column, plan: Plan = Plan()) -> Column:
    """The estimated similarity of two fingerprints of whole hex digits a bin, as an expression."""
    if plan.bits % 4:
        raise ValueError("bins of this many bits don't end with hex digits")
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(.{{{plan.bits // 4}}})"), F.lit(1))
    same = F.size(F.filter(F.zip_with(cut(a), cut(b), lambda x, y: x == y), lambda x: x))
    chance = 2.0**-plan.bits
    found = F.greatest((same / plan.bins - chance) / (1 - chance), F.lit(0.0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(found)


def edited(text: str, following: str) -> str:
    """The text with the last fourth of its characters replaced by the first as many of the following one, or all it has."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


_FOUND = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(plan: Plan, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of ``_FOUND`` for texts and those that follow them."""
    shared = texts[1:] == following[:-1]
    own = plan.codes(pa.array([*texts, following[-1]] if shared else texts, pa.large_string()))
    then = (own[0][1:], own[1][1:]) if shared else plan.codes(pa.array(following, pa.large_string()))
    own = (own[0][: len(texts)], own[1][: len(texts)])
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new = plan.codes(pa.array(changed, pa.large_string()))
    digests = [hashlib.sha256(t.encode()).digest() for t in changed]
    return [pa.array(list(map(len, texts)), pa.int64()), pa.array(digests), pa.array(plan.packed(*own)), pa.array(plan.packed(*new)), pa.array(plan.likeness(own, new)), pa.array(plan.likeness(own, then))]


def edited_likeness(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """own_id and the columns of ``_FOUND``: each text against its edited form and the next document's text.

    Documents are in ascending order of id, null ids first, equal ids by text; the first follows the last. One exchange
    deals texts by ranges of that order. What follows the last row of a range is the first of the next one that has rows: the
    ends of ranges are kept with their texts, two rows a range, and meet by a join.
    """
    schema = f"own_id {kind(docs, id_col)}, {_FOUND}, part int, edge string, text string"
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, id_, text = TaskContext.get().partitionId(), None, None

        def end(ids: pa.Array, value: str, edge: str) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([ids, *none, pa.array([part], pa.int32()), pa.array([edge]), pa.array([value])], ["own_id", *names, "part", "edge", "text"])

        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            if text is None:
                yield end(ids.slice(0, 1), texts[0], "first")
            else:
                texts, ids = [text, *texts], pa.concat_arrays([id_, ids])
            if len(texts) > 1:
                n = len(texts) - 1
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *_compared(plan, texts[:-1], texts[1:]), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], ["own_id", *names, "part", "edge", "text"])
            id_, text = ids.slice(len(texts) - 1, 1), texts[-1]
        if text is not None:
            yield end(id_, text, "last")

    def last_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_compared(plan, batch.column(1).to_pylist(), batch.column(2).to_pylist())], ["own_id", *names])

    rows = as_text(docs, text_col, id_col).toDF("own_id", "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), F.col("own_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("own_id").asc_nulls_first(), "tie", "text")
    made = written(dealt.select("own_id", "text").mapInArrow(run, schema), "fingerprints")
    first = made.where("edge = 'first'").select("part", "text")
    order = first.select("part").groupBy("part").count()  # a row for each range that has rows
    after = order.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("then"))
    ends = made.where("edge = 'last'").select("own_id", F.col("part"), F.col("text").alias("own_text")).join(after, "part").join(first.select(F.col("part").alias("then"), "text"), "then")
    digests = ["edited_sha256", "fingerprint", "edited_fingerprint"]  # bytes until here, as they are half as large
    return _hex(made.where("edge is null").select("own_id", *names).union(ends.select("own_id", "own_text", "text").mapInArrow(last_ones, f"own_id {kind(docs, id_col)}, {_FOUND}")), *digests)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document's fingerprint against those of its edited text and of the next document."""
    return edited_likeness(documents(spark, sf_dir)).withColumnRenamed("own_id", "doc_id")
