"""Token-ID output as Parquet list columns, and the reading back of tokens or of metadata only.

Each document is one row: ``doc_id``, ``part`` (its file's rank in the order of documents), ``n_tokens`` and the list
``ids``. Rows are dealt by ranges of doc_id and sorted, so that the files, taken by ``part``, hold the corpus in
ascending doc_id order. Row groups and pages have a set size; ids are dictionary encoded (few distinct ids a row
group) or delta encoded; the writer adds page indexes, so a reader that asks for some doc_id reads those pages only,
and one that asks for metadata reads no ids at all.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_text, documents, held, kind, partitions, shared_dir
from .units import cut_units, strings

#: Units that are joined to one text for the library; an executor took 2,546 MB in the check with 2,000 of them and 2,064 MB with 200.
JOINED = 200
TOKEN_FILE_SCHEMA = "part int, seq int, doc_id {id}, n_tokens int, ids array<int>"


class Encoder:
    """The ids that the ``tokenizers`` library gives for a byte-level BPE file.

    Texts are cut into ``units``, which the library encodes on their own. A batch's units are gathered in Arrow; the
    library encodes each distinct one once, many to a call, and its ids are held while at most ``limit`` units are. Texts
    with an added token's string go to the library whole, as do all texts if the file normalises, has another pattern
    or sets a space before texts. With ``plain`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, limit: int = 800_000, plain: bool = False):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        self.by_word = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec["normalizer"] is None
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values() if not (plain and t.special)]
        vocab = self.lib.get_vocab()
        self.after_space = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.after_space[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # the fixed character of a space
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<i4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Have the library encode units. Those of one space and a word are joined to one text, in which each space begins one."""
        spaced = [w for w in pieces if w[0] == " " and len(w) > 1 and w.count(" ") == 1 and not w[1].isspace() and not w[-1].isspace()]
        for at in range(0, len(spaced), JOINED):
            part = spaced[at : at + JOINED]
            ids = np.array(self.lib.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<i4")
            cut = np.flatnonzero(self.after_space[ids])
            if len(cut) != len(part):
                self.known.update(zip(part, self._whole(part), strict=True))
                continue
            blob, cut = ids.tobytes(), [*(4 * cut).tolist(), 4 * len(ids)]
            self.known.update({w: blob[a:b] for w, a, b in zip(part, cut[:-1], cut[1:], strict=True)})
        rest = list(set(pieces).difference(spaced))
        self.known.update(zip(rest, self._whole(rest), strict=True))

    def encode_batch(self, texts: pa.Array | list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, each followed by the id ``end`` if there is one."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).fill_null("")
        whole = np.zeros(len(texts), dtype=bool) if self.by_word else np.ones(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(whole).tolist()
        ends, units = cut_units(pc.if_else(pa.array(whole), "", texts) if apart else texts)
        coded = units.dictionary_encode()
        words = strings(coded.dictionary)
        if len(self.known) > self.limit:
            self.known.clear()
        blobs = list(map(self.known.get, words))
        new = [i for i, blob in enumerate(blobs) if blob is None]
        if new:
            self.learn([words[i] for i in new])
            for i in new:
                blobs[i] = self.known[words[i]]
        # an entry more for each text that the library encodes whole, and one for the end
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if apart:
            more = np.arange(len(blobs), len(blobs) + len(apart))
            blobs += self._whole([texts[i].as_py() for i in apart])
            index = np.insert(index, ends[apart], more)
            ends = ends + np.cumsum(whole)
        if end is not None:
            index = np.insert(index, ends, len(blobs))
            ends = ends + np.arange(1, len(texts) + 1)
            blobs.append(np.array([end], dtype="<i4").tobytes())
        flat = np.frombuffer(b"".join(blobs), dtype="<i4")
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        after, ids = spread(flat, sizes, index)
        return np.concatenate([[0], np.concatenate([[0], after])[ends]]).astype(np.int32), ids


def spread(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``flat`` holds one after the other, with these sizes, in the order of ``index``; and their ends."""
    starts = np.cumsum(sizes) - sizes
    own = sizes[index]
    after = np.cumsum(own)
    return after, flat[np.repeat(starts[index] - (after - own), own) + np.arange(int(after[-1]) if len(after) else 0)]


def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("encoder", path, plain), lambda: Encoder(path, plain=plain))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                      row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, encoding: str = "dictionary", codec: str = "zstd") -> None:
    """Encode every whole text, append ``end_id`` and write the token files at ``path``.

    Null text is the empty text: its row holds ``end_id`` only. Ids of any type that sorts; null ones first. Repeated rows are repeated
    documents, equal ids are ordered by a hash of their texts. ``encoding`` is ``dictionary`` or ``delta``.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                sub = batch.slice(first, 512)
                at, ids = coder.encode_batch(sub.column(1), end_id)
                sizes = np.diff(at)
                lists = pa.ListArray.from_arrays(at, pa.array(ids))
                place = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(np.arange(seq, seq + len(sizes), dtype=np.int32))]
                seq += len(sizes)
                yield pa.RecordBatch.from_arrays([*place, sub.column(0), pa.array(sizes), lists], ["part", "seq", "doc_id", "n_tokens", "ids"])

    spark = docs.sparkSession
    rows = as_text(docs, text_col, id_col).toDF("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")  # one id may be that of many rows
    (dealt.select("doc_id", "text").mapInArrow(encode, TOKEN_FILE_SCHEMA.format(id=kind(rows, "doc_id"))).write
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
     .option("parquet.column.index.truncate.length", 64).option("compression", codec).parquet(path))


def with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """``rows`` (part, seq, n_tokens, more) with ``start``, the ids of all documents before.

    The running sum is taken within each file and added to the sum of the files before it, so the only single task
    sees one row a file.
    """
    files = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.sum("in_part").over(before).alias("before"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.sum("n_tokens").over(inner)).join(files, "part")
    start = F.coalesce("before", F.lit(0)) + F.coalesce("inner", F.lit(0))
    return rows.withColumn("start", start.cast("long")).withColumn("n_tokens", F.col("n_tokens").cast("long")).drop("before", "inner")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, n_tokens and start of each document; no page of ids is read."""
    meta = spark.read.parquet(path).select("part", "seq", "doc_id", "n_tokens")
    return with_start(meta, spark, path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The documents' ids; with ``doc_ids``, only pages whose index admits one of them."""
    rows = spark.read.parquet(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the token files."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    tokens = read_tokens(spark, path).select("part", "seq", "doc_id", "ids")
    rows = tokens.mapInArrow(sums, f"part int, seq int, doc_id {kind(tokens, 'doc_id')}, n_tokens long, ids_crc32 long")
    return with_start(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The query: every document's place, count and checksum, read from its token files."""
    from .vocab import tokenizer_path

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, tokenizer or tokenizer_path("byte_bpe_50k.json"))
    return digests(spark, path)
