"""Exact substring dedup over word windows.

Rabin-Karp hashes of every window of ``k`` words are counted over the corpus; a word goes if any window over it
occurs more than once. Runs of such windows merge into maximal removal intervals.

Plan: one scan hashes all windows. Each task sorts the hashes of about a million windows (a *split*): a hash that is
repeated inside the split is settled there and sent on once, as a mark, so that a passage that fills a third of the
corpus costs one entry a split. Hashes go, packed by hash range, to buckets, whose tasks count them and send back
the ordinals of repeated windows; a split's ordinals then become word intervals by document. Intervals are keyed by
the text's MD5, not by id: equal texts have equal intervals, ids may be null or repeated. A last pass joins them to
the texts. Hashes have 64 bits; of n windows about n^2 / 2^65 pairs that differ share one, and their words go too: fewer than one
such pair is expected up to six billion windows (30 GB or so), and one window in two million at 10^13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, documents, kind, partitions
from .words import Words, chunks

SPLIT_WINDOWS = 1 << 20
#: A bucket of hashes for so many bytes of input, about eight million windows, so that a bucket fits a task at any size.
BUCKET_BYTES = 32 << 20
PACKED = "bucket int, split string, kind int, hashes binary, places binary"
FLAGGED = "split string, kind int, places binary, keys binary"


def _deltas(places: np.ndarray) -> bytes:
    """Ascending ordinals as differences: 16 bits each, or 32 where one is too large (the first byte tells)."""
    d = np.diff(places, prepend=0)
    wide = bool(len(d)) and int(d.max()) > 0xFFFF
    return bytes([wide]) + d.astype("<u4" if wide else "<u2").tobytes()


def _places(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u4" if blob[0] else "<u2", offset=1).astype(np.int64))


def _pack(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        hashes: list[np.ndarray] = []
        keys: list[bytes] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal hashes, keys, counts, held, number
            h, split = np.concatenate(hashes), f"{part}-{number}"
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = np.zeros(len(s), dtype=bool)
            same[1:] = s[1:] == s[:-1]
            repeated = same.copy()
            repeated[:-1] |= same[1:]
            marks = s[repeated & ~same]
            edges = np.array([((b << 64) + buckets - 1) // buckets for b in range(1, buckets)], dtype=np.uint64)
            alone, at = s[~repeated], order[~repeated]
            cut, mark_cut = ([0, *np.searchsorted(x, edges), len(x)] for x in (alone, marks))
            home = buckets + int(hashlib.md5(split.encode()).hexdigest()[:8], 16) % buckets
            rows = [(home, split, 2, b"".join(keys), np.concatenate(counts).astype("<i4").tobytes()), (home, split, 3, b"", _deltas(np.sort(order[repeated])))]
            for b in range(buckets):
                a, e = cut[b], cut[b + 1]
                if e > a:
                    by = np.argsort(at[a:e])
                    rows.append((b, split, 0, alone[a:e][by].tobytes(), _deltas(at[a:e][by])))
                if mark_cut[b + 1] > mark_cut[b]:
                    rows.append((b, split, 1, marks[mark_cut[b] : mark_cut[b + 1]].tobytes(), b""))
            hashes, keys, counts, held, number = [], [], [], 0, number + 1
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], ["bucket", "split", "kind", "hashes", "places"])

        for batch in batches:
            md5 = batch.column(1)
            for first, end, data, offsets in chunks(batch.column(0)):
                w = Words(data, offsets)
                rolled = w.windows(k)
                n = np.maximum(np.diff(w.first) - k + 1, 0)
                has = np.flatnonzero(n)
                if len(has):
                    start = np.repeat(w.first[:-1][has] - (np.cumsum(n[has]) - n[has]), n[has])
                    hashes.append(rolled[start + np.arange(len(start))])
                    keys += [bytes.fromhex(md5[first + int(i)].as_py()) for i in has]
                    counts.append(n[has])
                    held += len(start)
                if held >= SPLIT_WINDOWS:
                    yield flush()
        if held:
            yield flush()

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: the ordinals, by split, of windows whose hash it has more than once."""
    split, kind, hashes, places = (table.column(c).to_pylist() for c in ("split", "kind", "hashes", "places"))
    out = [(split[i], kind[i], places[i], hashes[i]) for i in range(len(kind)) if kind[i] >= 2]
    own = [i for i in range(len(kind)) if kind[i] == 0]
    if own:
        parts = [np.frombuffer(hashes[i], np.uint64) for i in own]
        marked = np.unique(np.concatenate([np.frombuffer(hashes[i], np.uint64) for i in range(len(kind)) if kind[i] == 1] or [np.zeros(0, np.uint64)]))
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s), dtype=bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:].copy()
        if len(marked):
            near = np.minimum(np.searchsorted(marked, s), len(marked) - 1)
            same |= marked[near] == s
        flag = np.zeros(len(h), dtype=bool)
        flag[order[same]] = True
        at = 0
        for i, p in zip(own, parts, strict=True):
            f = flag[at : at + len(p)]
            at += len(p)
            if f.any():
                out.append((split[i], 3, _deltas(_places(places[i])[f]), b""))
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds, strict=True)], ["split", "kind", "places", "keys"])


def _intervals(k: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one split: each document's removal intervals, as pairs (first word, word after the last)."""
        kind, places, keys = (table.column(c).to_pylist() for c in ("kind", "places", "keys"))
        out: list[tuple[bytes, bytes]] = []
        hit = [_places(p) for p, t in zip(places, kind, strict=True) if t == 3]
        at = np.sort(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
        for key, counts in [(keys[i], places[i]) for i in range(len(kind)) if kind[i] == 2] if len(at) else []:
            n = np.frombuffer(counts, "<i4").astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            bounds = np.searchsorted(at, first)
            for d in np.flatnonzero(np.diff(bounds)):
                s = at[bounds[d] : bounds[d + 1]] - first[d]
                new = np.flatnonzero(np.diff(s) > k)
                begin, end = s[np.concatenate([[0], new + 1])], s[np.concatenate([new, [len(s) - 1]])] + k
                out.append((key[16 * d : 16 * d + 16], np.stack([begin, end], 1).astype("<i4").tobytes()))
        return pa.table([pa.array(c, pa.binary()) for c in (list(zip(*out)) or [[]] * 2)], ["key", "spans"])

    return run


def input_bytes(docs: DataFrame, text_col: str) -> int:
    """The size of the input's files by the plan, or where that doesn't say, of its texts."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else docs.agg(F.sum(F.length(f"`{text_col}`"))).first()[0] or 0


def repeat_spans(docs: DataFrame, k: int = 35, text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """key (binary MD5 of the text) and spans (pairs of 32-bit word indices) of texts that hold a repeated window."""
    n = buckets or max(4 * partitions(docs.sparkSession), -(-input_bytes(docs, text_col) // BUCKET_BYTES))
    rows = as_text(docs, text_col).select("text", F.md5("text").alias("key"))
    flagged = rows.mapInArrow(_pack(k, n), PACKED).groupBy("bucket").applyInArrow(_count, FLAGGED)
    return flagged.groupBy("split").applyInArrow(_intervals(k), "key binary, spans binary").groupBy("key").agg(F.min("spans").alias("spans"))


def remove_repeats(docs: DataFrame, k: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, spans removed (as ``first:after`` word indices) and, if asked for, kept_text.

    Every input row gives one row. Null and empty texts have no words; a text of fewer than ``k`` words has no window
    and stays whole; a repeated row repeats all its windows, so both rows lose them. Ids may be null or repeated and
    further columns are not read. Kept words are joined by one space.
    """
    schema = f"`{id_col}` {kind(docs, id_col)}, n_words long, n_removed long, kept_sha256 string, spans string" + ", kept_text string" * with_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n, said = len(words), ""
                if spans:
                    cut = np.frombuffer(spans, "<i4").reshape(-1, 2).tolist()
                    said = ",".join(f"{a}:{b}" for a, b in cut)
                    for a, b in reversed(cut):
                        del words[a:b]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), said, *[kept.decode("utf-8", "surrogatepass")] * with_text))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [[]] * (4 + with_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]], [id_col, "n_words", "n_removed", "kept_sha256", "spans", "kept_text"][: 5 + with_text])

    rows = as_text(docs, text_col, id_col).withColumn("key", F.unhex(F.md5("text")))
    spans = repeat_spans(docs, k, text_col)
    return rows.join(spans, "key", "left").select(id_col, "text", "spans").mapInArrow(finish, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: what each document loses to repeated windows of 35 words."""
    return remove_repeats(documents(spark, sf_dir), with_text=False).drop("spans")
