"""Cross-tokenizer alignment: which tokens of two tokenizers lie over the same bytes, and how common each pair of ids is.

Python only tokenises. Texts are taken in blocks of some megabytes; a block is one row with its distinct units (see
``units``; both tokenizers cut there), each with the ids and the byte ends of its tokens by either tokenizer, and its
documents, each as the list of its units. From there on all is Spark's higher-order functions: the ends of both sides of
a unit are merged in one sorted array, where a token's place, less its own index, is the index of the other side's token
over the same bytes; ends in ``array_intersect`` of both close groups. A unit is aligned once a block however often it
occurs; documents' groups and links are those of their units, one after the other.

Links of two tokens whose byte ranges overlap are written as longs (A's id in the upper half). The documents that hold a
pair are counted with partial sums. Counts go back to documents' links by a broadcast of the pairs, if all of them
are few bytes, or else of those ``MOST_PAIRS`` at most that are most frequent; the others are joined by a shuffle.

Rows: repeated ids and rows are documents of their own. Texts that are null or empty, and texts whose tokens' bytes aren't
a space and the text (a piece vocabulary writes some characters as others), have no tokens: zeros and an empty digest.
Texts of any length are taken whole. Other columns are left alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, as_text, documents, held, keep, kind, lean, scratch, sized_join, written
from .tokens_out import Encoder, spread
from .units import buffers, cut_units, strings
from .vocab import tokenizer_path

#: Bytes of text of a block, more only if one text has more.
BLOCK_BYTES = 4 << 20
#: Units that are learnt at a time.
LEARNT = 20_000
#: Pairs of ids that are broadcast at most.
MOST_PAIRS = 1_000_000


def byte_values() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Sides:
    """Both tokenizers: ids of distinct units, which are held while there are at most ``limit``."""

    def __init__(self, path_a: str, path_b: str, limit: int = 400_000):
        import sentencepiece

        self.a = Encoder(path_a, limit=limit, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        value = byte_values()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in value for c in token):
                self.bytes_a[i] = bytes(value[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: whether texts may be cut into units: both tokenizers have to allow it
        self.by_unit = self.a.by_word and not any("▁" in p.lstrip("▁") for p in pieces)
        self.sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b)]
        self.bytes = [np.frombuffer(b"".join(side), dtype=np.uint8) for side in (self.bytes_a, self.bytes_b)]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.limit = limit

    def learn(self, words: list[str]) -> None:
        self.a.learn(words)
        for first in range(0, len(words), LEARNT):
            part = words[first : first + LEARNT]
            a, b = [self.a.known[w] for w in part], self.b.encode([w[1:] for w in part], num_threads=1)
            sizes = [np.fromiter(map(len, x), np.int64, len(part)) // n for x, n in ((a, 4), (b, 1))]
            ids = [np.frombuffer(b"".join(a), dtype="<i4"), np.fromiter(chain.from_iterable(b), dtype="<i4", count=int(sizes[1].sum()))]
            raw = [w.encode() for w in part]
            same = self._spelt(0, ids[0], sizes[0], raw) & self._spelt(1, ids[1], sizes[1], raw)
            blob, ends = ids[1].tobytes(), np.cumsum(4 * sizes[1])
            for w, x, start, end, ok in zip(part, a, (ends - 4 * sizes[1]).tolist(), ends.tolist(), same.tolist(), strict=True):
                self.known[w] = (x, blob[start:end]) if ok else None
        self.a.known.clear()

    def _spelt(self, side: int, ids: np.ndarray, sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each word's tokens, of which ``sizes`` says how many there are, have just the word's bytes."""
        long = np.fromiter(map(len, raw), np.int64, len(raw))
        after, made = spread(self.bytes[side], self.sizes[side], ids)
        ends = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(sizes)])]
        same = np.diff(ends) == long
        differ = made[np.repeat(same, np.diff(ends))] != np.frombuffer(b"".join(raw), np.uint8)[np.repeat(same, long)]
        same[np.repeat(np.flatnonzero(same), long[same])[differ]] = False
        return same

    def block(self, texts: pa.Array) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray]:
        """The distinct units' lists (ids and ends of either side), and each text's ends among them and unit indexes."""
        if self.by_unit:
            ends, units = cut_units(texts, alone=True)
        else:
            units, ends = texts, np.arange(1, len(texts) + 1)
        coded = units.dictionary_encode()
        words = strings(coded.dictionary)
        if len(self.known) > self.limit:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        return list(map(self.known.__getitem__, words)), ends, coded.indices.to_numpy(zero_copy_only=False)


def sides(path_a: str, path_b: str) -> Sides:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("sides", path_a, path_b), lambda: Sides(path_a, path_b))


def _lists(blobs: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, ids, byte ends within the unit) of one side of units."""
    ids = np.frombuffer(b"".join(blobs), dtype="<i4")
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4)])
    ends = np.cumsum(sizes[ids]) if len(ids) else np.zeros(0, np.int64)
    before = np.concatenate([[0], ends])[at[:-1]]
    return at.astype(np.int32), ids, (ends - np.repeat(before, np.diff(at))).astype(np.int32)


def token_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each block: units (ids a and their ends ea, ids b and eb) and docs (own_id, n_a, n_b, seq; seq null without tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            size = np.cumsum(np.diff(buffers(texts)[0]))
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
                yield _block(both, batch.column(0).slice(at, end - at), texts.slice(at, end - at))
                at = end

    rows = as_text(docs, text_col, id_col).toDF("own_id", "text").select("own_id", F.when(F.col("text") == "", "").otherwise(F.concat(F.lit(" "), "text")).alias("text"))
    units = "array<struct<a: array<int>, ea: array<int>, b: array<int>, eb: array<int>>>"
    return rows.mapInArrow(lean(run), f"units {units}, docs array<struct<own_id: {kind(rows, 'own_id')}, n_a: long, n_b: long, seq: array<int>>>")


def _block(both: Sides, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    known, ends, index = both.block(texts)
    bad = np.array([k is None for k in known], dtype=bool)
    lists, counts = [], []
    for side in (0, 1):
        offsets, flat, byte_ends = _lists([b"" if k is None else k[side] for k in known], both.sizes[side])
        lists += [pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(byte_ends))]
        counts.append(np.diff(offsets))
    units = pa.StructArray.from_arrays(lists, ["a", "ea", "b", "eb"])
    from_ = np.concatenate([[0], ends]).astype(np.int32)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[index])])[from_])
    none = (total(bad) > 0) | (ends == from_[:-1])
    n_a, n_b = (np.where(none, 0, total(c)).astype(np.int64) for c in counts)
    seq = pa.ListArray.from_arrays(pa.array(from_), pa.array(index.astype(np.int32)), mask=pa.array(none))
    docs = pa.StructArray.from_arrays([ids, pa.array(n_a), pa.array(n_b), seq], ["own_id", "n_a", "n_b", "seq"])
    one = lambda x: pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x)
    return pa.RecordBatch.from_arrays([one(units), one(docs)], ["units", "docs"])


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, though lambdas inside use it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


SIDE_B = 1 << 31
#: Tokens of a side up to which searching for each is quicker than merging both sides' ends.
FEW = 16


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32) + b


def _texts(ids: Column) -> Column:
    return ids.cast("array<string>")


def _ids(ids: Column) -> Column:
    return F.array_join(_texts(ids), ",")


def _few_links(unit: Column, common: Column) -> Column:
    """A token of A meets the token of B over its last byte, whose index is how many ends of B come before; so do those of B that end alone."""
    before = lambda ends, e: F.size(F.filter(ends, lambda y: y < e))
    place = lambda e: F.array_position(unit["eb"], e).cast("int") - 1
    over = F.zip_with(unit["a"], unit["ea"], lambda x, e: _pair(x, unit["b"][before(unit["eb"], e)]))
    return F.concat(over, F.transform(F.array_except(unit["eb"], common), lambda e: _pair(unit["a"][before(unit["ea"], e)], unit["b"][place(e)])))


def _few_groups(unit: Column, common: Column) -> Column:
    """Each side's ids with ``;`` after those that close a group; then the sides' groups side by side."""
    side = lambda ids, ends: F.split(F.array_join(F.zip_with(_texts(ids), ends, lambda x, e: F.concat(x, F.when(F.array_contains(common, e), ";").otherwise(","))), ""), ";")
    both = F.zip_with(side(unit["a"], unit["ea"]), side(unit["b"], unit["eb"]), lambda x, y: F.concat(x, F.lit("|"), y))
    return F.array_join(F.slice(both, 1, F.size(common)), ";")


def _merged(unit: Column) -> Column:
    """text and links of a unit of any size, from the sorted array of both sides' ends."""
    mark = lambda ends, side: F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), 32) + i + side)
    merged = F.sort_array(F.concat(mark(unit["ea"], 0), mark(unit["eb"], SIDE_B)))
    own = lambda x: x.bitwiseAND(F.lit(SIDE_B - 1)).cast("int")  # noqa: E731  the token's index on its side
    of_b = lambda x: x.bitwiseAND(F.lit(SIDE_B)) != 0
    closes = lambda s, x, p: (p > 0) & (F.shiftright(s[F.greatest(p - 1, F.lit(0))], 32) == F.shiftright(x, 32))  # noqa: E731  the end of both sides

    def parts(s: Column) -> Column:
        # at place p, a token's other side is p less its own index, as that many of the other side's ends are smaller
        links = F.filter(F.transform(s, lambda x, p: F.when(~of_b(x), _pair(unit["a"][own(x)], unit["b"][p - own(x)])).when(~closes(s, x, p), _pair(unit["a"][p - own(x)], unit["b"][own(x)]))), lambda x: x.isNotNull())
        cuts = F.filter(F.transform(s, lambda x, p: F.when(of_b(x) & closes(s, x, p), F.struct((p - own(x)).alias("a"), (own(x) + 1).alias("b")))), lambda x: x.isNotNull())

        def text(c: Column) -> Column:
            before = lambda k, side: F.when(k == 0, 0).otherwise(c[F.greatest(k - 1, F.lit(0))][side])
            cut = lambda ids, k, side: _ids(F.slice(ids, before(k, side) + 1, c[k][side] - before(k, side)))
            return F.array_join(F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda k: F.concat(cut(unit["a"], k, "a"), F.lit("|"), cut(unit["b"], k, "b"))), ";")

        return F.struct(bound(cuts, text).alias("text"), links.alias("links"))

    return bound(merged, parts)


def aligned(unit: Column) -> Column:
    """text (groups as ``a1,a2|b1;...``), links (longs, one for each two tokens that overlap) and groups (their count) of a unit."""
    n_a, n_b = F.size(unit["a"]), F.size(unit["b"])
    one = F.concat(_ids(unit["a"]), F.lit("|"), _ids(unit["b"]))
    row = lambda got, n: F.struct(got.alias("got"), n.alias("groups"))
    found = lambda text, links: F.struct(text.alias("text"), links.alias("links"))

    def parts(common: Column) -> Column:
        n = F.size(common)
        few = found(F.when(n == 1, one).otherwise(_few_groups(unit, common)), _few_links(unit, common))
        return row(F.when((n_a <= FEW) & (n_b <= FEW), few).otherwise(_merged(unit)), n)

    none = found(F.lit(""), F.array().cast("array<long>"))
    each = found(F.array_join(F.zip_with(_texts(unit["a"]), _texts(unit["b"]), lambda x, y: F.concat(x, F.lit("|"), y)), ";"), F.zip_with(unit["a"], unit["b"], _pair))
    whole = found(one, F.when(n_a == 1, F.transform(unit["b"], lambda y: _pair(unit["a"][0], y))).otherwise(F.transform(unit["a"], lambda x: _pair(x, unit["b"][0]))))
    # units whose ends are the same on both sides, most of them, and those of one token on a side need no search for common ends
    same = F.when(n_a == 0, row(none, F.lit(0))).when(unit["ea"] == unit["eb"], row(each, n_a)).when((n_a == 1) | (n_b == 1), row(whole, F.lit(1)))
    return same.otherwise(bound(F.array_intersect(unit["ea"], unit["eb"]), parts))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """own_id, n_a, n_b, n_groups, n_links, groups_sha256 and links of each document."""
    blocks = token_blocks(docs, path_a, path_b, id_col, text_col)

    def rows(units: Column) -> Column:
        return F.transform("docs", lambda d: F.struct(
            d["own_id"].alias("own_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"),
            F.coalesce(F.aggregate(d["seq"], F.lit(0).cast("long"), lambda n, i: n + units[i]["groups"]), F.lit(0)).alias("n_groups"),
            F.coalesce(F.sha2(F.array_join(F.transform(d["seq"], lambda i: units[i]["got"]["text"]), ";"), 256), F.lit("")).alias("groups_sha256"),
            F.coalesce(F.flatten(F.transform(d["seq"], lambda i: units[i]["got"]["links"])), F.array().cast("array<long>")).alias("links")))

    made = blocks.select(F.inline(bound(F.transform("units", aligned), rows)))
    return made.withColumn("n_links", F.size("links").cast("long"))


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (the documents that hold it) and best (whether no pair of its A id has more), written."""
    counts = written(links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return written(counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-counts")


def link_sums(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, n_best and count_sum of rows (key, links) that have links."""
    each = links.select("key", F.explode("links").alias("pair"))
    sums = lambda rows: rows.groupBy("key").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    if int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES:
        return sums(each.join(F.broadcast(pairs), "pair"))
    least = pairs.agg((F.sum("n") / MOST_PAIRS).alias("least"))  # no more than MOST_PAIRS pairs have a larger share
    least = least.first()[0]
    known = each.join(F.broadcast(pairs.where(F.col("n") > least)), "pair", "left")
    rest = known.where("n is null").select("key", "pair").join(pairs.where(F.col("n") <= least), "pair")
    return sums(known.where("n is not null").select("key", "n", "best").union(rest.select("key", "n", "best")))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """own_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    with scratch():
        made = written(alignments(docs, path_a, path_b, id_col, text_col).withColumn("key", F.monotonically_increasing_id()), "links")
        links = made.where("n_links > 0").select("key", "links")
        sums = written(link_sums(links, pair_counts(links)), "link-sums")
        found = written(made.drop("links"), "aligned")
        keep(sums), keep(found)
    rows = sized_join(found, sums, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("own_id", "n_a", "n_b", F.col("n_groups").cast("long").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The query: counts of tokens, groups and links, and the digest of the groups, of each document."""
    found = align_documents(documents(spark, sf_dir), path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"))
    return found.withColumnRenamed("own_id", "doc_id")
