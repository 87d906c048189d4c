"""BPE as a deterministic automaton over tokens, built merge by merge.

The automaton starts with one state that loops on every base symbol and accepts all sequences of base symbols. The
gadget of a merge (u, v) -> uv changes it so that it accepts just the sequences with that merge done: the state after
u is cloned without its v arc, all u arcs lead to the clone, and every state that has a u arc gets an uv arc to where
v led. After the last merge it accepts, for each string, exactly one token sequence, the one BPE makes.

All arcs of one label lead to one state at any time, so the automaton is kept as: the state that each label leads to;
and of each state its parent, the label the clone lost and the rule that made it. Rows of arcs are shared between
clones; a state's lost labels are gathered once, when the state is first entered. A label that a rule made is an arc
of every state that had its left part then, so an arc exists unless its state lost the label, or a left part of it
before the next part was made.

Words are encoded by two tables. One goes from symbol to symbol: a node for each prefix of a label, which knows the
labels that end there. The other goes from state to state: a row a state, whose entry for a label is the row of the state
that the arc leads to, or none; an entry is worked out from the gadgets when it is first asked for. One pass over a word's symbols finds the state
after each prefix (that of the prefix's only sequence), by the one label that ends there with an arc. Decoding
emits the labels of the arcs.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: The entry of a row that says which state it is of; labels are never negative.
STATE = -1
#: Entries that the table of arcs holds at most; a full one is begun anew.
MOST_ARCS = 1_000_000
#: New pieces of a batch are split and encoded so many at a time, so that little is held beside the tables.
RUN = 20_000


class MergeAutomaton:
    """Raises ValueError where two merges make one label, or a merge's part has no arc: the list isn't proper.

    A label's symbols are its characters, the last one with the word end ``end`` where the label has it.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.labels = {i: t for t, i in vocab.items()}
        self.made: dict[int, tuple[int, int, int]] = {}  # label: left part, right part, rule
        self.target: dict[int, int] = {}
        self.parent, self.lost, self.rule = [-1], [-1], [0]
        self._rows: list[dict[int, int] | None] = [{}]
        self._spines: dict[int, list[tuple[int, int, int]]] = {}
        for k, (a, b) in enumerate(merges, 1):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if uv in self.made:
                raise ValueError(f"two merges make {a + b!r}")
            self._gadget(u, v, uv, k)
        self.arcs: dict[int, dict] = {}
        self.filled = 0
        self._nodes()

    def symbols(self, label: str) -> list[str]:
        """The symbols that a label spells."""
        if self.end and label.endswith(self.end) and label != self.end:
            bare = label[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end]
        return list(label)

    def _nodes(self) -> None:
        """The table of symbols: each node's next ones, its longest proper suffix that is a node, and the labels ending there."""
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for text, label in self.vocab.items():
            spelt, node = self.symbols(text), 0
            if len(spelt) > 1 and label not in self.made:
                continue
            for s in spelt:
                to = self.next[node].get(s)
                if to is None:
                    to = self.next[node][s] = len(self.next)
                    self.next.append({})
                    own.append(None)
                node = to
            own[node] = (len(spelt), label)
        self.suffix = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        level = [0]
        while level:
            below = []
            for node in level:
                for s, to in self.next[node].items():
                    at = self.suffix[node]
                    while at and s not in self.next[at]:
                        at = self.suffix[at]
                    self.suffix[to] = self.next[at].get(s, 0) if node else 0
                    self.ends[to] = ((own[to],) if own[to] else ()) + self.ends[self.suffix[to]]
                    below.append(to)
            level = below

    def _gadget(self, u: int, v: int, uv: int, k: int) -> None:
        after_u = self.target.get(u, 0)
        self.target[uv] = self.target.get(v, 0)
        self.parent.append(after_u)
        self.lost.append(v)
        self.rule.append(k)
        self._rows.append(None)
        self.target[u] = len(self.parent) - 1
        self.made[uv] = (u, v, k)

    def row(self, state: int) -> dict[int, int]:
        """The labels that a state has lost, each with the rule that took it."""
        row = self._rows[state]
        if row is None:
            row, s = {}, state
            while s > 0:
                row[self.lost[s]] = self.rule[s]
                s = self.parent[s]
            self._rows[state] = row
        return row

    def spine(self, label: int) -> list[tuple[int, int, int]]:
        """(part, rule that made it, rule that made the next part of it) down the left parts of a label."""
        found = self._spines.get(label)
        if found is None:
            found, x, until = [], label, 1 << 60
            while True:
                made = self.made.get(x)
                found.append((x, made[2] if made else 0, until))
                if not made:
                    break
                x, until = made[0], made[2]
            self._spines[label] = found
        return found

    def has_arc(self, state: int, label: int) -> bool:
        row = self.row(state)
        return not row or not any((at := row.get(part)) is not None and since < at <= until for part, since, until in self.spine(label))

    def arc(self, row: dict, label: int) -> dict | None:
        """The row of the state that the arc of a label leads to, None where there is no such arc; kept in the table."""
        if self.filled > MOST_ARCS:
            for state, other in self.arcs.items():
                other.clear()
                other[STATE] = state
            self.filled = 0
        to = None
        if self.has_arc(row[STATE], label):
            state = self.target.get(label, 0)
            to = self.arcs.setdefault(state, {STATE: state})
        row[label] = to
        self.filled += 1
        return to

    def encode(self, symbols: list[str]) -> list[int]:
        """The labels of the only accepted sequence that spells the symbols; KeyError for a symbol without a label."""
        return self.encode_all([symbols])[0] if symbols else []

    def encode_all(self, words: Iterable[Sequence[str]]) -> list[list[int]]:
        """``encode`` of each word, a sequence of one or more symbols.

        What a prefix comes to doesn't depend on what follows, so a word begins where it first differs from the one
        before; words in sorted order share most.
        """
        after, ends, suffix, missing = self.next, self.ends, self.suffix, STATE
        out, before = [], ()
        rows, back, nodes = [self.arcs.setdefault(0, {STATE: 0})], [], [0]
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del rows[same + 1 :], back[same:], nodes[same + 1 :]
            node, end = nodes[-1], same
            for symbol in word[same:]:
                end += 1
                to = after[node].get(symbol)
                while to is None and node:
                    node = suffix[node]
                    to = after[node].get(symbol)
                node = to or 0
                for size, label in ends[node]:
                    row = rows[end - size]
                    to = row.get(label, missing)
                    if to is missing:
                        to = self.arc(row, label)
                    if to is not None:
                        rows.append(to)
                        back.append((size, label))
                        nodes.append(node)
                        break
                else:
                    raise KeyError(f"no token ends with {symbol!r}")
            at, labels, before = end, [], word
            while at:
                size, label = back[at - 1]
                labels.append(label)
                at -= size
            labels.reverse()
            out.append(labels)
        return out


class WordBpe:
    """The word-end BPE of a ``tokenizers`` file, with the merge automaton in place of the library's merges.

    Normalising (NFC, lower case) and splitting follow the file; texts outside the Latin ranges, where Python's tables
    might differ from the library's, are normalised and split by the library. Distinct words are encoded once, while
    at most ``limit`` are kept. When half as many are new, those not met since the last such time go, so that frequent words stay.
    """

    def __init__(self, path: str, limit: int = 100_000):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], self.end)
        self.path, self._lib = path, None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {**self.automaton.labels, **{i: t for t, i in self.added.items()}}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.plain = regex.compile(r"[\x09-\x0d\x20-\x7e\xa0-ɏ]*")
        self.limit, self.known, self.pieces = limit, {}, {}
        self.old_known, self.old_pieces = {}, {}
        # The fixed, reversible map of bytes to printable characters: bytes that print stand for themselves.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        self.chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.odd = regex.compile(r"[\x00-\x20\x7f]").search

    @property
    def lib(self):
        """The library's tokenizer, read when a text first needs it."""
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        return self._lib

    def symbols(self, word: str) -> list[str]:
        spelt = word if word.isascii() and not self.odd(word) else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars)
        return [*spelt[:-1], spelt[-1] + self.end]

    def words(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.split.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        clean = self.lib.normalizer.normalize_str(text)
        back = {c: b for b, c in self.chars.items()}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(clean)]

    def _learn(self, words: Iterable[str]) -> None:
        """Encode the words that aren't known yet, in sorted order."""
        met = {w for w in words if w not in self.known}
        self._meet(met, self.known, self.old_known)
        new = sorted(w for w in met if w not in self.known)
        for w, ids in zip(new, self.automaton.encode_all(map(self.symbols, new)), strict=True):
            self.known[w] = array("I", ids).tobytes()

    @staticmethod
    def _meet(met: Iterable[str], young: dict[str, bytes], old: dict[str, bytes]) -> None:
        """Keep those of the older entries that are met again."""
        if old:
            young.update((w, old[w]) for w in met if w in old)

    def _age(self) -> None:
        """Begin new tables where they are full; what was in the older ones only goes."""
        if 2 * len(self.known) > self.limit:
            self.old_known, self.known = self.known, {}
        if 2 * len(self.pieces) > self.limit:
            self.old_pieces, self.pieces = self.pieces, {}

    def _learn_pieces(self, new: list[str]) -> None:
        """Split and encode pieces that aren't known yet."""
        found = [self.split.findall((p if p.isascii() else unicodedata.normalize("NFC", p)).lower()) for p in new]
        self._learn(w for words in found for w in words)
        known = self.known
        self.pieces.update({p: b"".join([known[w] for w in words]) for p, words in zip(new, found, strict=True)})

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers in this machine's order, which is little-endian."""
        out: list[bytes] = []
        for i, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            if i % 2:
                out.append(array("I", [self.added[part]]).tobytes())
                continue
            words = self.words(part)
            self._learn(words)
            out += [self.known[w] for w in words]
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts.

        White space separates words and is dropped, so a text's ids are those of its pieces between spaces. The pieces of a batch
        are gathered in Arrow and each distinct one is split and encoded once. Texts whose characters the library has to
        class, and those with an added token, are encoded one by one.
        """
        alone = {i for i, t in enumerate(texts) if not self.plain.fullmatch(t) or (self.cut and "<|" in t and self.cut.search(t))}
        self._age()
        blobs = [self.encode(texts[i]) for i in sorted(alone)]
        cut = pc.split_pattern(pa.array(["" if i in alone else t for i, t in enumerate(texts)], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._meet([p for p in distinct if p not in self.pieces], self.pieces, self.old_pieces)
        new = [p for p in distinct if p not in self.pieces]
        for k in range(0, len(new), RUN):
            self._learn_pieces(new[k : k + RUN])
        # a text that is encoded alone has one empty piece, which its own entry takes the place of
        index, bounds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), cut.offsets.to_numpy()
        for k, i in enumerate(sorted(alone)):
            index[bounds[i]] = len(distinct) + k
        blobs = [*map(self.pieces.__getitem__, distinct), *blobs]
        flat = np.frombuffer(b"".join(blobs), dtype="<u4")
        sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        own = sizes[index]
        after = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - after[:-1], own) + np.arange(after[-1])]
        return after[bounds], ids

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, joined as the library does where a file names no decoder; ids without one are left out."""
        try:
            return " ".join(map(self.label.__getitem__, ids))
        except KeyError:
            return " ".join([self.label[i] for i in ids if i in self.label])
