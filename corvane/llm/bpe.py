"""BPE encoding and decoding of document tables with the merge automaton."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .automaton import WordBpe
from .common import as_text, documents, kind, map_rows, texts_of
from .vocab import tokenizer_path

#: Texts that are encoded together. Fewer take less memory beside the tables of words, more share the look-up of equal words.
ROWS = 250


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of int) of every whole text; null and empty texts have no ids. Each row is encoded on its
    own, so repeated rows and ids give repeated rows; further columns are not read."""

    def make():
        bpe = WordBpe(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, values = bpe.encode_batch(texts_of(batch.column(1)))
            ids = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values.view(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

        return step

    return map_rows(as_text(docs, text_col, id_col), make, f"`{id_col}` {kind(docs, id_col)}, ids array<int>", rows=ROWS)


def decode_documents(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` of every list of ids; a null list decodes to null."""

    def make():
        bpe = WordBpe(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

        return step

    return map_rows(rows.select(id_col, ids_col), make, f"`{id_col}` {kind(rows, id_col)}, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: encoded, and the ids decoded.

    Ids keep their type and may be null or repeated; null and empty texts have no tokens; further columns are not read.
    """

    def make():
        bpe = WordBpe(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, back = [], []
            at, values = bpe.encode_batch(texts_of(batch.column(1)))
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = values[a:b]
                ids.append(hashlib.sha256(own.tobytes()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(own.tolist()).encode("utf-8")).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(ids), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_rows(as_text(docs, text_col, id_col), make, f"`{id_col}` {kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=ROWS)


def op7(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The query: every document encoded and decoded."""
    return round_trip_digests(documents(spark, sf_dir), tokenizer or tokenizer_path("word_bpe_49k.json"))
