"""Exact n-gram Jaccard join with vertical partitioning.

A document is the set of its distinct word n-grams, as 64-bit hashes in one global order: rare ones first (n-grams that
are frequent by a bounded, counted list come last, by their count), then by hash. Two documents link when their
Jaccard similarity reaches a fraction.

1. One scan finds each document's set size and fingerprint; documents with equal sets become one node.
2. A second scan takes each node's prefix in the global order: sets as similar as asked share an n-gram of their
   prefixes. N-grams of one prefix only are dropped, and so are those that stand too late in a prefix for any partner:
   all before the first shared one are differences, so its place bounds the overlap and with it the partner's size.
3. Each set has an odd sketch: the parities of its counts in 256 cells. Sets differ in at least as many n-grams as
   their sketches differ in cells. The order is cut into fragments (ranges of hashes). A pair can't share more n-grams than the smaller of its two
   segments in each fragment, summed over a fine cut; pairs that can't reach the fraction go. For the others, each
   fragment's overlap of a coarse cut is counted apart and the counts are summed by pair.
4. Candidates come in two steps, so that a large group of copies doesn't give all its pairs. First each node pairs
   with one node of each prefix n-gram that it has, the one in whose order it stands first: what a copy has changed
   stands before, so this is the least changed one. The links give components. Then all pairs that share a
   prefix n-gram and lie in different components are counted. No link between different components is missed.

The frequent list only shapes the order; with or without an n-gram in it results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, documents, lean, sized_join, written
from .components import components
from .words import Words, chunks

FRAGMENTS, FINE = 4, (32, 4096)
#: Nodes of a block of a frequent n-gram.
BLOCK = 256
#: An n-gram is reported as frequent by a task from so many documents of a batch of sets on; so many are kept at most.
FREQUENT_IN_TASK, FREQUENT_KEPT, BATCH_GRAMS = 8, 100_000, 1 << 21


def gram_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each text, the ascending distinct hashes of its ``k``-word n-grams; with fewer words, of the whole sequence."""
    for _, _, data, offsets in chunks(column):
        w = Words(data, offsets, lower=True)
        rolled = [w.windows(m) for m in range(1, k + 1)]
        first = w.first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a < k:
                yield rolled[b - a - 1][a : a + 1] if b > a else rolled[0][:0]
                continue
            s = np.sort(rolled[k - 1][a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield s


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _edges(fragments: int) -> np.ndarray:
    """Where the fragments but the first begin."""
    return np.array([((f << 64) + fragments - 1) // fragments for f in range(1, fragments)], dtype=np.uint64)


def _sizes(s: np.ndarray) -> bytes:
    """How many hashes lie in each of a power of two of ranges, about two in each: a byte each, or four after a byte of 4."""
    bits = min(max(int(len(s)).bit_length() - 1, FINE[0].bit_length() - 1), FINE[1].bit_length() - 1)
    n = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    wide = int(n.max(initial=0)) > 255
    return bytes([4 if wide else 1]) + n.astype("<u4" if wide else "u1").tobytes()


def _sketch(s: np.ndarray) -> list[int]:
    """The parities of the set's counts in 256 cells, as four 64-bit integers."""
    odd = (np.bincount((s & np.uint64(0xFF)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def _most(x: bytes, y: bytes) -> int:
    """The most hashes that two sets of these sizes can share; the finer cut is summed up to the coarser."""
    a, b = (np.frombuffer(v, "<u4" if v[0] == 4 else "u1", offset=1).astype(np.int64) for v in (x, y))
    if len(a) < len(b):
        a, b = b, a
    return int(np.minimum(a.reshape(len(b), -1).sum(1), b).sum())


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            at = c >= FREQUENT_IN_TASK
            m = int(at.sum())
            none = lambda t: pa.nulls(m, t)
            return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.string()), pa.array(c[at].astype(np.int64)), none(pa.binary()), pa.array(u[at].view(np.int64))], ["doc_id", "text_key", "n", "fp", "gram"])

        for batch in batches:
            n, fp = [], []
            for s in gram_sets(batch.column(2), k):
                n.append(len(s))
                fp.append(_fingerprint(s) if len(s) else None)
                held.append(s)
                size += len(s)
                if size >= BATCH_GRAMS:
                    yield frequent()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.nulls(len(n), pa.int64())], ["doc_id", "text_key", "n", "fp", "gram"])
        if held:
            yield frequent()

    return run


def _prefixes(k: int, num: int, den: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = frequent.value
        for batch in batches:
            fp, out, sizes, cells = [], [], [], []
            for s in gram_sets(batch.column(1), k):
                sizes.append(_sizes(s))
                cells.append(_sketch(s))
                if not len(s):
                    fp.append(None)
                    out.append(s.view(np.int64))
                    continue
                fp.append(_fingerprint(s))
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    often = np.where(grams[at] == s, counts[at], 0)
                    if often.any():
                        s = s[np.argsort(often, kind="stable")]
                out.append(s[: len(s) + (-num * len(s)) // den + 1].view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary()), pa.array(sizes, pa.binary()), pa.array(cells, pa.list_(pa.int64())), lists], ["doc_id", "fp", "sizes", "cells", "prefix"])

    return run


def _segments(k: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(fragments)
        for batch in batches:
            rows = []
            for node, s in zip(batch.column(0).to_pylist(), gram_sets(batch.column(1), k), strict=True):
                cut = [0, *np.searchsorted(s, edges).tolist(), len(s)]
                rows += [(node, f, s[cut[f] : cut[f + 1]].tobytes()) for f in range(fragments) if cut[f + 1] > cut[f]]
            kinds = [pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, kinds, strict=True)], ["node", "fragment", "grams"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            counts.append(int((y[at] == x).sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), pa.array(counts, pa.int64())], ["a", "b", "fragment", "overlap"])


def _linked(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the fraction: partial overlaps by fragment, summed by pair."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("x"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("y"))
    each = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "x", "y", "fragment").mapInArrow(lean(_overlaps), "a long, b long, fragment int, overlap long")
    each = each.groupBy("a", "b", "fragment").agg(F.max("overlap").alias("overlap"))  # a repeated row has its segments twice
    total = each.groupBy("a", "b").agg(F.sum("overlap").alias("inter")).join(pairs, ["a", "b"])
    return total.where(den * F.col("inter") >= num * (F.col("na") + F.col("nb") - F.col("inter"))).select("a", "b")


def _possible(pairs: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose segment sizes admit the fraction."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            most = (_most(p, q) for p, q in zip(x, y, strict=True))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array([den * m >= num * (p + q - m) for m, p, q in zip(most, na, nb, strict=True)], pa.bool_()))

    both = pairs.join(sizes.toDF("a", "x"), "a").join(sizes.toDF("b", "y"), "b").select("a", "b", "na", "nb", "x", "y")
    return both.mapInArrow(lean(bound), "a long, b long, na long, nb long").distinct()


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", fragments: int = FRAGMENTS) -> DataFrame:
    """id, n_shingles and component_id of every row: the groups that links of similarity >= num / den make.

    Words are runs outside 0x20 and 0x09-0x0D of the text with A-Z lower-cased. component_id is the smallest id
    reachable, the row's own included. Null and wordless texts have n_shingles 0 and their own id. Repeated rows and
    equal texts are one node; equal ids of different texts are different nodes. Null ids take part; they are smallest
    nowhere, so a group of null ids only has a null component_id. Further columns are not read.
    """
    out = _grouped(docs, k, num, den, id_col, text_col, fragments)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, fragments: int) -> DataFrame:
    """doc_id, text_key, n, least_id (the smallest id) and best (the smallest id and text key) of every row's group; the last two are null without words."""
    spark = docs.sparkSession
    rows = as_text(docs, text_col, id_col).toDF("doc_id", "text").select("doc_id", F.md5("text").alias("text_key"), "text")
    found = written(rows.mapInArrow(lean(_sets(k)), "doc_id long, text_key string, n long, fp binary, gram long"), "sets")
    sets = found.where("gram is null")
    often = found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "gram").limit(FREQUENT_KEPT).collect()
    grams, counts = np.array([r.gram for r in often], dtype=np.int64).view(np.uint64), np.array([r.c for r in often], dtype=np.int64)
    order = np.argsort(grams)
    frequent = spark.sparkContext.broadcast((grams[order], counts[order]))

    firsts = sets.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least_id"),
                                                   F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"), F.first("n").alias("n"))
    nodes = written(firsts.select(F.monotonically_increasing_id().alias("node"), "fp", F.col("rep.text_key").alias("text_key"), F.col("rep.doc_id").alias("rep_id"), "least_id", "best", "n"), "nodes")

    prefix = rows.select("doc_id", "text").mapInArrow(lean(_prefixes(k, num, den, frequent)), "doc_id long, fp binary, sizes binary, cells array<long>, prefix array<long>")
    own = nodes.select(F.col("fp").alias("node_fp"), "rep_id", "node", "n")
    prefix = prefix.join(own, (F.col("fp") == F.col("node_fp")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("node", "n", "sizes", "cells", "prefix")
    prefix = written(prefix, "prefixes")
    posts, sizes = prefix.select("node", "n", F.posexplode("prefix").alias("pos", "gram")), prefix.select("node", "sizes")
    cells = prefix.select("node", *[F.col("cells")[i].alias(f"k{i}") for i in range(4)])

    shared = posts.groupBy("gram").agg(F.min(F.struct("pos", "node", "n")).alias("hub"), F.min("n").alias("low"), F.count("*").alias("members")).where("members > 1")
    largest = F.expr(f"(({num} + {den}) * (n - pos) - {num} * n) div {num}")  # the largest set that can be a partner if this is the first shared n-gram
    shared = posts.join(shared, "gram").where(largest >= F.col("low"))
    shared = written(shared.select("gram", "node", "n", "pos", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"), "members"), "shared")

    def fits(n, pos, m, at):
        """Whether sets of n and m can be partners whose first shared n-gram stands at these places."""
        n, pos, m, at = (F.col(c) for c in (n, pos, m, at))
        return (den * F.least(n, m) >= num * F.greatest(n, m)) & (num * (n + m) <= (num + den) * F.least(n - pos, m - at))

    stars = shared.where((F.col("node") != F.col("hub")) & fits("n", "pos", "hub_n", "hub_pos"))
    stars = stars.select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb")).distinct()

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that link; only the texts of their nodes are read again."""
        pairs = written(_possible(pairs, sizes, num, den), "pairs")
        active = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node")
        active = written(active.select("node", F.col("text_key").alias("own_key"), "rep_id"), "active")
        texts = sized_join(rows, active, (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("rep_id")), "inner").select("node", "text")
        segments = written(texts.mapInArrow(lean(_segments(k, fragments)), "node long, fragment int, grams binary"), "segments")
        return written(_linked(pairs, segments, num, den), "links")

    found = links(stars)
    groups = components(found)  # of an n-gram of two nodes, the star was the only pair
    home = shared.where("members > 2").select("gram", "node", "n", "pos", "members").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = home.groupBy("gram").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("gram")
    home = home.join(mixed, "gram", "left_semi").join(cells, "node")
    home = written(home.select("gram", "node", "n", "pos", "component", "k0", "k1", "k2", "k3", "members"), "mixed")
    # the nodes of a frequent n-gram are dealt to blocks: a task has one block and meets all the others of the n-gram
    blocks = F.ceil(F.col("members") / BLOCK)
    x = home.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).drop("members")
    y = home.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("members")
    x, y = (df.select("gram", "block", *[F.col(c).alias(f"{o}_{side}") for c, o in (("node", "node"), ("n", "n"), ("pos", "pos"), ("component", "c"), *[(f"k{i}", f"k{i}") for i in range(4)])]) for side, df in (("x", x), ("y", y)))
    apart = sum((F.bit_count(F.col(f"k{i}_x").bitwiseXOR(F.col(f"k{i}_y"))) for i in range(1, 4)), F.bit_count(F.col("k0_x").bitwiseXOR(F.col("k0_y"))))
    near = (num + den) * apart <= (den - num) * (F.col("n_x") + F.col("n_y"))
    rest = x.join(y, ["gram", "block"]).where((F.col("node_x") < F.col("node_y")) & (F.col("c_x") != F.col("c_y")) & fits("n_x", "pos_x", "n_y", "pos_y") & near)
    rest = rest.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"), F.col("n_x").alias("na"), F.col("n_y").alias("nb")).distinct()
    more = links(rest)
    if not more.isEmpty():
        groups = components(found.union(more))

    # the smallest id and text of a node stand for it; null ids come last, in a node and in a group
    home = nodes.select("fp", "node", "least_id", "best").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = home.groupBy("component").agg(F.min("least_id").alias("least_id"), F.min("best").alias("best"))
    home = home.drop("least_id", "best").join(least, "component").select("fp", "least_id", "best")
    return sets.select("doc_id", "text_key", "n", "fp").join(home, "fp", "left").drop("fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, fragments: int = FRAGMENTS) -> DataFrame:
    """One row of each group of ``docs``, every column kept: that of the smallest id, and of the smallest text hash under it.

    Rows of one id but different texts are different documents, null ids among them; null ids come last. Wordless texts
    are groups of their own. Of rows equal in id and text one stays; a null text is the empty text.
    """
    found = _grouped(docs, k, num, den, id_col, text_col, fragments)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    keep = found.where(F.col("best").isNull() | own.eqNullSafe(F.col("best"))).select(F.col("doc_id").alias("kept__id"), F.col("text_key").alias("kept__key")).distinct()
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("own__key"))
    rows = rows.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col("kept__id")) & (F.col("own__key") == F.col("kept__key")), "left_semi")
    return rows.dropDuplicates([id_col, "own__key"]).drop("own__key")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: groups of documents whose sets of 3-word shingles reach 90 of 100."""
    return jaccard_groups(documents(spark, sf_dir), k=3, num=90, den=100)
