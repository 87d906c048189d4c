"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability; a word's probability is the sum, over all
ways to cut it into pieces, of the product of its pieces' probabilities, and a text's is the product of its words'.
The forward algorithm sums all segmentations in one pass. Training is expectation maximisation over the same
segmentations: the forward-backward counts of pieces in the training words of a language become its probabilities.

Words are runs of letters of the lower-cased text, with the vocabulary's word mark before each. A character that the
vocabulary lacks is a piece of its own with a small probability, the same for all languages.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, texts_of
from .vocab import tokenizer_path

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-7


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece file that can occur in a marked lower-case word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    word = re.compile(f"{MARK}?[^\\W\\d_]*")
    return sorted({p for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if p and word.fullmatch(p) and p == p.lower()})


#: Base of the rolling hash of substrings, spread of its table's slots, and the slots' bits.
_BASE, _SPREAD, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), 18


class Lattice:
    """All cuts of words into pieces, for many words of one length at a time.

    A substring is looked up by its rolling hash (64 bits) in an open table of the pieces' hashes, for all words at once.
    """

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        self.keys = np.zeros(1 << _BITS, dtype=np.uint64)
        self.place = np.full(1 << _BITS, -1, dtype=np.int64)
        if 4 * len(pieces) > len(self.keys):
            raise ValueError("too many pieces for the table")
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for n, own in by.items():
            hashes = self._prefixes([pieces[i] for i in own], n)[n]
            for i, h, slot in zip(own, hashes.tolist(), self._slots(hashes).tolist(), strict=True):
                while self.place[slot] >= 0:
                    slot = (slot + 1) & ((1 << _BITS) - 1)
                self.keys[slot], self.place[slot] = h, i

    @staticmethod
    def _prefixes(words: list[str], n: int) -> list[np.ndarray]:
        """The hashes of each length of prefix of words of n characters."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        out = [np.zeros(len(words), dtype=np.uint64)]
        for k in range(n):
            out.append(out[-1] * _BASE + chars[:, k])
        return out

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where there is none."""
        slot = self._slots(hashes)
        found = np.where(self.keys[slot] == hashes, self.place[slot], -1)
        left = np.flatnonzero((found < 0) & (self.place[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << _BITS) - 1)
            here = self.place[slot[left]]
            hit = (here >= 0) & (self.keys[slot[left]] == hashes[left])
            found[left[hit]] = here[hit]
            left = left[(here >= 0) & ~hit]
        return found

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(begin, end, piece) of each piece in a word; a character without one is the unknown piece."""
        get, out, n = self.index.get, [], len(word)
        for a in range(n):
            for b in range(a + 1, min(n, a + self.longest) + 1):
                i = get(word[a:b])
                if i is not None:
                    out.append((a, b, i))
                elif b == a + 1:
                    out.append((a, b, self.unknown))
        return out

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log P(word) by language (rows: words). ``prob``: pieces x languages, the unknown piece last."""
        out = np.zeros((len(words), prob.shape[1]))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, own in by.items():
            some = [words[i] for i in own]
            alpha, scale = [np.ones((len(own), prob.shape[1]))], np.zeros((len(own), prob.shape[1]))
            heads, power = self._prefixes(some, n), np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
            for b in range(1, n + 1):
                total = np.zeros_like(alpha[0])
                for a in range(max(0, b - self.longest), b):
                    ids = self.find(heads[b] - heads[a] * power[b - a])
                    if b == a + 1:
                        ids[ids < 0] = self.unknown
                    at = np.flatnonzero(ids >= 0)
                    if len(at):
                        total[at] += alpha[a][at] * prob[ids[at]]
                alpha.append(total)
                if b % 8 == 0:  # keep numbers in range in long words: earlier columns that can still be used shrink alike
                    top = total.max(1, keepdims=True)
                    top[top <= 0] = 1.0
                    for a in range(max(0, b - self.longest), b + 1):
                        alpha[a] = alpha[a] / top
                    scale += np.log(top)
            out[own] = np.log(np.maximum(alpha[n], 1e-300)) + scale
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    prob: np.ndarray
    prior: np.ndarray
    pieces: list[str]


def train(words: dict[str, Counter], pieces: list[str], rounds: int = 2, smooth: float = 0.1, shares: dict[str, float] | None = None) -> LanguageModel:
    """Fit piece probabilities by forward-backward counts. ``words``: by language, words (marked) and their counts."""
    lattice, languages = Lattice(pieces), sorted(words)
    table = sorted({w for c in words.values() for w in c})
    graphs = [lattice.edges(w) for w in table]
    place = {w: i for i, w in enumerate(table)}
    prob = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    prob[-1] = UNKNOWN
    for _ in range(rounds):
        new = np.full_like(prob, smooth)
        for k, lang in enumerate(languages):
            p, c = prob[:, k].tolist(), new[:, k].tolist()
            for w, n in words[lang].items():
                edges, size = graphs[place[w]], len(w)
                fore, back = [0.0] * (size + 1), [0.0] * (size + 1)
                fore[0] = back[size] = 1.0
                for a, b, i in edges:
                    fore[b] += fore[a] * p[i]
                total = fore[size]
                if total <= 0.0:
                    continue
                for a, b, i in reversed(edges):
                    back[a] += p[i] * back[b]
                for a, b, i in edges:
                    c[i] += n * fore[a] * p[i] * back[b] / total
            new[:, k] = c
        new[-1] = 0
        prob = new / new.sum(0)
        prob[-1] = UNKNOWN
    prior = np.log(np.array([(shares or {}).get(x, 1.0) for x in languages], dtype=float))
    return LanguageModel(languages, prob, prior - np.log(np.exp(prior).sum()), pieces)


def sample_words(labelled: DataFrame, per_language: int = 300, most_chars: int = 20_000_000) -> dict[str, Counter]:
    """Counts of marked words in a bounded, deterministic sample of labelled rows (lang, text).

    Of each language, the ``per_language`` distinct texts with the smallest hash, whole, as far as their lengths come to
    ``most_chars``; a text that passes that with those before it is left out. The bounds only concern what is fitted.
    """
    from pyspark.sql import Window

    keyed = labelled.where("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("size")).distinct()
    w = Window.partitionBy("lang").orderBy("h")
    chosen = keyed.where(F.col("size") <= most_chars).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language)
    chosen = chosen.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("upto") <= most_chars).select("lang", "h")
    rows = labelled.select("lang", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text").collect()
    out: dict[str, Counter] = {}
    for r in sorted(rows):
        out.setdefault(r.lang, Counter()).update(MARK + x for x in LETTERS.findall(r.text.lower()))
    return {k: v for k, v in out.items() if v}


class Scorer:
    """Sums of word scores by text; at most ``limit`` distinct words are kept."""

    def __init__(self, model: LanguageModel, limit: int = 300_000):
        self.model, self.lattice, self.limit = model, Lattice(model.pieces), limit
        self.row: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(model.languages)), dtype=np.float64)

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and its posterior probability; ``und`` and 0 for a text without a letter."""
        words = [LETTERS.findall(t.lower()) for t in texts]
        row = self.row
        new = list({w for own in words for w in own if w not in row})
        if len(row) + len(new) > self.limit and row:
            row.clear()
            new = list({w for own in words for w in own})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            n = len(row)
            while n + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(part)] = self.lattice.forward([MARK + w for w in part], self.model.prob)
            row.update(zip(part, range(n, n + len(part)), strict=True))
        langs, scores = [], []
        for own in words:
            if not own or not self.model.languages:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(row.__getitem__, own), np.int64, len(own))].sum(0) + self.model.prior
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id (or the columns ``keep``), lang_pred and score of every whole text.

    Null, empty and letterless texts are ``und`` with score 0; ties go to the language that sorts first. Each row is
    scored on its own, so repeated rows and ids give repeated rows; further columns are not read. A model without
    languages gives ``und``.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = keep or [id_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("scored__text"))
    schema = StructType([*[docs.schema[c] for c in names], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def make():
        score = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = [], []
            for at in range(0, batch.num_rows, 128):
                a, b = score(texts_of(batch.column(len(names)).slice(at, 128)))
                langs += a
                scores += b
            return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

        return step

    return map_rows(rows, make, schema)


def fitted(docs: DataFrame, pieces_path: str | None = None) -> LanguageModel:
    """The model of a documents table: learnt from rows that aren't held out and have a lang."""
    seen = docs.where((F.crc32(F.col("doc_id").cast("string")) % 4) != 2)
    shares = {r["lang"]: float(r["count"]) for r in seen.where("lang is not null").groupBy("lang").count().collect()}
    return train(sample_words(seen), pieces_of(pieces_path or tokenizer_path("piece_bpe_32k.model")), shares=shares)


def op9(spark: SparkSession, sf_dir: str, pieces_path: str | None = None) -> DataFrame:
    """The query: every document's language; learnt from the three folds that aren't held out."""
    docs = documents(spark, sf_dir)
    found = identify(docs, fitted(docs, pieces_path))
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
