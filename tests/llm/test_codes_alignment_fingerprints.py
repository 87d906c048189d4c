"""Vector codes, cross-tokenizer alignment and document fingerprints against plain versions, on small and on odd tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import shingles
from pyspark.sql import functions as F
from rows import plain

from corvane.llm import align, codes, fingerprints, jaccard, queries, units, vocab

VEC = "vec_id long, embedding array<double>, label int, codes string, error string, own_id long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", None, 5) for i, v, l in rows], VEC)


def plain_codes(rows, parts, entries, rounds, scale):
    """{(id, vector): (code, error)} and the codebooks, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[cut[r][p] for r in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [pick(p, c[p]) for c in cut]
            for e in range(len(books[p])):
                some = [c[p] for c, o in zip(cut, own, strict=True) if o == e]
                if some:
                    books[p][e] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    out = []
    for (i, _), c in zip(kept, cut, strict=True):
        own = [pick(p, c[p]) for p in range(parts)]
        error = sum(far(c[p], books[p][own[p]]) for p in range(parts))
        out.append((i, bytes(own), error if error < 1 << 63 else None))
    return out, books


def seeded_vectors(n, dims, scale=1.0, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(dims)] for _ in range(9)]
    return [(i * 3, [x + r.gauss(0, scale / 8) for x in r.choice(centres)], [1, 2, None][i % 3]) for i in range(n)]


@pytest.mark.parametrize(("n", "entries", "rounds", "scale"), [(150, 12, 2, 256), (150, 12, 6, 256), (40, 64, 2, 256), (1, 64, 2, 256), (120, 5, 4, 2), (150, 1, 2, 256)])
def test_codes_equal_plain_rounds(spark, n, entries, rounds, scale):
    rows = seeded_vectors(n, 8)
    found, books = codes.vector_codes(vectors(spark, rows), parts=4, entries=entries, rounds=rounds, scale=scale)
    want, plain_books = plain_codes(rows, 4, entries, rounds, scale)
    got = [(r.own_id, bytes(r.codes), r.error) for r in found.select("own_id", "codes", "error").collect()]
    assert sorted(got) == sorted(want)
    assert books.entries.tolist() == plain_books


def test_codes_of_odd_vectors(spark):
    rows = seeded_vectors(30, 8)
    rows += [rows[4], rows[4], (rows[5][0], rows[6][1], None), (None, rows[7][1], 7), (None, [0.0] * 8, 7)]
    rows += [(900, None, 1), (901, [], 1), (902, [float("nan")] * 8, 1), (903, [*[0.1] * 7, None], 1), (904, [*[0.1] * 7, float("-inf")], None), (-5, [*[0.1] * 7, float("inf")], None)]
    want, _ = plain_codes(rows, 4, 16, 2, 256)
    found, _ = codes.vector_codes(vectors(spark, rows), parts=4, entries=16)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.own_id, bytes(r.codes), r.error) for r in found.collect()], key=key) == sorted(want, key=key)
    short = vectors(spark, [*rows[:10], (1, [0.5] * 12, 1)])  # another length than the smallest id's: no part
    assert codes.vector_codes(short, parts=4)[0].count() == 10


def test_codes_of_ties_and_large_components(spark):
    grid = [(i, [float(i % 3), float(i % 2), 0.5, -0.5], None) for i in range(40)]  # many at equal distance
    far = [(i, [x * 1e12 for x in v], l) for i, v, l in seeded_vectors(60, 4)]
    beyond = [(999, [1e19, 0.0, 0.0, 0.0], None)]
    for rows in (grid, far):
        found, _ = codes.vector_codes(vectors(spark, rows + (beyond if rows is far else [])), parts=2, entries=7, rounds=3, scale=2)
        want, _ = plain_codes(rows, 2, 7, 3, 2)
        assert sorted((r.own_id, bytes(r.codes), r.error) for r in found.collect()) == sorted(want)


def test_bounds_save_scans_and_change_no_code():
    r = np.random.default_rng(5)
    parts = np.floor(256 * r.normal(size=(4000, 4)) * 0.3).astype(np.int64)
    books = codes.Codebooks(parts[None, :32].copy())
    code, first, second = codes.scan(parts, books.entries[0])
    upper, lower, compared = codes.up(codes.root(first)), codes._second(second), []
    for _ in range(6):
        new = books.entries.copy()
        for e in range(32):
            if (code == e).any():
                new[0, e] = parts[code == e].sum(axis=0) // (code == e).sum()
        books = codes.Codebooks(new, codes.up(codes.root(((new - books.entries) ** 2).sum(axis=2))).astype(float))
        code, upper, lower, n = codes.reassign(parts, books, 0, code, upper, lower)
        assert (code == codes.scan(parts, new[0])[0]).all()
        compared.append(n)
    assert compared[-1] < 0.6 * 4000


def test_codes_of_an_empty_table_and_the_query(spark, tmp_path):
    empty = vectors(spark, [])
    found, books = codes.vector_codes(empty)
    assert found.count() == 0 and books.text() == ""
    for name, rows in (("empty", []), ("some", [(i, [float(x % 5) / 7 for x in range(i, i + 64)], [1, None][i % 2]) for i in range(90)])):
        vectors(spark, rows).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = queries.QUERIES["op11_hamerly_codes"](spark, f"{tmp_path}/{name}").toPandas()
        assert list(got.columns) == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and len(got) == len(rows)
    want, plain_books = plain_codes(rows, 16, 64, 2, 256)
    assert sorted(zip(got.vec_id, got.code, got.error, strict=True)) == sorted((i, c.hex(), e) for i, c, e in want)
    sums = Counter()
    for i, _, e in want:
        sums[[1, None][i % 2]] += e
    assert all(row.label_error == sums[[1, None][row.vec_id % 2]] for row in got.itertuples())
    assert set(got.codebooks_sha256) == {hashlib.sha256(",".join(str(x) for b in plain_books for e in b for x in e).encode()).hexdigest()}


ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b   c", "\ta\n\nb\r\n c", "it's we'll  'S", "x\x00y\x1cz", "<|endoftext|> <s></s><unk> <0x41>", "▁x a▁b", "日本語 テキスト　です", "é" * 300, "ﬁ ＡＢ ²³ ½", "😀😀 👨‍👩‍👧 a", "a b  c\u0085 d", "word " * 400, "nospace" * 300, "12345 6789 1,000.5", "the cat the cat the cat", "the cat the cat the cat"]


def made_texts():
    r = random.Random(11)
    al = [" ", "  ", "\n", "\t", "a", "b'", "s", "'s", " 's", "é", "日", "　", " ", "1", "2", "_", "😀", "'ll", "ing", "the ", " of "]
    return ["".join(r.choice(al) for _ in range(r.randrange(60))) for _ in range(150)]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(vocab.tokenizer_path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=vocab.tokenizer_path("piece_bpe_32k.model"))
    value = align.byte_values()
    of_a = {i: bytes(value[c] for c in t) for t, i in a_side.get_vocab().items() if all(c in value for c in t)}
    of_b = [bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_side.id_to_piece(i)) for i in range(b_side.get_piece_size()))]
    rows, all_links, count = [], [], Counter()
    for t in texts:
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        if not t or not b"".join(of_a[i] for i in a) == b"".join(of_b[i] for i in b) == (" " + t).encode():
            a = b = []
        spans = []
        for ids, table in ((a, of_a), (b, of_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at = own[-1][1]
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else None
        shared = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, before = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for s, f, i in side if before < f <= e) for side in spans))
            before = e
        all_links.append(links)
        count.update(set(links))
        rows.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(*r[:4], sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), r[4]) for r, links in zip(rows, all_links, strict=True)]


@pytest.fixture(scope="module")
def aligned_odd():
    texts = ODD + made_texts()
    return texts, plain_alignment(texts)


@pytest.mark.parametrize("way", ["as it is", "small blocks", "pairs by a shuffle", "ends merged"])
def test_alignment_equals_plain(spark, aligned_odd, monkeypatch, way):
    texts, want = aligned_odd
    if way == "small blocks":
        monkeypatch.setattr(align, "BLOCK_BYTES", 64)
    if way == "ends merged":
        monkeypatch.setattr(align, "FEW", 0)
    if way == "pairs by a shuffle":
        monkeypatch.setattr(align, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(align, "MOST_PAIRS", 5)
    rows = spark.createDataFrame([(f"d{i}", t, "x", 1) for i, t in enumerate(texts)], "doc_id string, text string, links string, key long")
    got = align.align_documents(rows, vocab.tokenizer_path("byte_bpe_50k.json"), vocab.tokenizer_path("piece_bpe_32k.model")).collect()
    assert {r.own_id: tuple(r)[1:] for r in got} == {f"d{i}": w for i, w in enumerate(want)} and len(got) == len(texts)


def test_alignment_of_repeated_rows_and_of_none(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the"), (2, None)], schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = queries.QUERIES["op12_token_alignment"](spark, f"{tmp_path}/some").collect()
    want = plain_alignment(["the cat", "the cat", "the", None])
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for i, w in zip([1, 1, None, 2], want, strict=True))
    assert queries.QUERIES["op12_token_alignment"](spark, f"{tmp_path}/none").collect() == []


def test_units_join_to_the_texts():
    texts = [t or "" for t in ODD + made_texts()]
    for alone in (False, True):
        ends, cut = units.cut_units(pa.array(texts), alone)
        words, starts = cut.to_pylist(), [0, *ends[:-1].tolist()]
        assert ["".join(words[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)] == texts
        assert max(len(w) for w in words) < 5000
    ends, cut = units.cut_units(pa.array(["", "ab cd  e", ""])[1:], False)
    assert cut.to_pylist() == ["ab", " cd ", " e"] and ends.tolist() == [3, 3]


def varied(seed, n):
    """Pairs of texts with a known share of equal shingles."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(n)]
    out = []
    for i in range(8):
        other = base[:]
        for _ in range(i * n // 60):
            other[r.randrange(n)] = f"x{r.randrange(5000)}"
        out.append((" ".join(base), " ".join(other)))
    return out


def test_units_become_strings():
    """All at once, and the same as one by one, from the middle of a column too."""
    texts = ["", " a", "É\n", "\x00", "😀 é", "日本"]
    for column in (pa.array(texts, pa.large_string()), pa.array(texts, pa.large_string()).slice(2, 3), pa.array([], pa.large_string())):
        assert units.strings(column) == column.to_pylist()


def test_units_spelt_by_their_tokens():
    """Learnt in one go, only units whose tokens lack or change bytes have none, wherever they stand."""
    both = align.Sides(vocab.tokenizer_path("byte_bpe_50k.json"), vocab.tokenizer_path("piece_bpe_32k.model"))
    words = [" plain", " \uff46ull", " words", " \u2460", " caf\u00e9"]
    both.learn(words)
    for w in words:
        a, b = both.a.lib.encode(w, add_special_tokens=False).ids, both.b.encode(w[1:])
        same = b"".join(both.bytes_a[i] for i in a) == b"".join(both.bytes_b[i] for i in b) == w.encode()
        assert both.known[w] == ((np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if same else None)
    ok = both._spelt(1, np.array(both.b.encode("ab ab"), "<i4"), np.array([len(both.b.encode("ab ab"))]), [b" ab ac"])
    assert not ok.any()  # as many bytes, but not the same


def test_minima_are_those_of_all_shingles():
    plan = fingerprints.Plan(k=3, bins=16, bits=8)
    texts = [*made_texts(), *[t for t in ODD if t], "A b C", "a B c", "a b", ""]
    least = plan.minima(pa.array(texts))
    for row, grams in zip(least, jaccard.gram_sets(pa.array(texts), 3), strict=True):
        want = [2**64 - 1] * 16
        for g in map(int, grams):
            want[g >> 60] = min(want[g >> 60], g)
        assert row.tolist() == want


def test_empty_bins_copy_full_ones_evenly():
    plan = fingerprints.Plan(bins=64)
    least = np.full((3, 64), fingerprints.EMPTY, dtype=np.uint64)
    least[0, [3, 40]], least[1, 7] = [5, 9], 11
    dense = plan.densified(least)
    assert dense[0, 3] == 5 and dense[0, 40] == 9 and set(dense[0].tolist()) == {5, 9}
    assert set(dense[1].tolist()) == {11} and (dense[2] == fingerprints.EMPTY).all()
    assert 16 <= (dense[0] == 5).sum() <= 48
    alike = plan.densified(least[:1])  # the same draws whatever other texts are there
    assert (alike[0] == dense[0]).all()


@pytest.mark.parametrize(("bits", "bins", "error"), [(4, 512, 0.08), (8, 512, 0.08), (1, 2048, 0.08), (12, 256, 0.12)])
def test_estimates_are_near_and_unbiased(spark, bits, bins, error):
    plan = fingerprints.Plan(bits=bits, bins=bins)
    off = []
    for n in (40, 400, 3000):
        for x, y in varied(n, n):
            a, b = shingles(x, 5), shingles(y, 5)
            both = plan.codes(pa.array([x, y]))
            got = plan.likeness((both[0][:1], both[1][:1]), (both[0][1:], both[1][1:]))[0]
            off.append(got - len(a & b) / len(a | b))
            assert abs(off[-1]) < error * (2 if n == 40 else 1)
            if x == y:
                assert got == 1.0
            if bits % 4 == 0 and n == 400:
                p = [x.hex() for x in plan.packed(*both)]
                assert len(p[0]) == bins * bits // 4
                assert spark.range(1).select(fingerprints.likeness(F.lit(p[0]), F.lit(p[1]), plan)).first()[0] == pytest.approx(got)
    assert abs(np.mean(off)) < 0.02


def test_fingerprints_of_odd_texts(spark):
    texts = ODD + ["The CAT sat on the mat", "the cat SAT  on\nthe mat"]
    df = spark.createDataFrame([(f"k{i}", t, "x") for i, t in enumerate(texts)], "doc_id string, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()}
    assert got["k0"] == got["k1"] == got["k2"] == got["k3"] == "" and len(got["k4"]) == 512
    assert got[f"k{len(texts) - 1}"] == got[f"k{len(texts) - 2}"]  # letters' case and kinds of white space don't count
    assert fingerprints.fingerprints(df.where("false")).collect() == []
    empty, full = fingerprints.likeness(F.lit(""), F.lit("")), fingerprints.likeness(F.lit(""), F.lit(got["k4"]))
    assert tuple(spark.range(1).select(empty, full).first()) == (1.0, 0.0)
    for bad in ({"k": 0}, {"bins": 3}, {"bits": 0}):
        with pytest.raises(ValueError):
            fingerprints.Plan(**bad)


def plain_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for n, (i, t) in enumerate(rows):
        then, m = rows[(n + 1) % len(rows)][1], len(t) // 4
        out.append((i, t, t[: len(t) - m] + then[:m], then))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_edited_likeness_follows_the_order_of_ids(spark, partitions):
    r = random.Random(4)
    texts = [*ODD, *made_texts()[:20], *[x for pair in varied(1, 60) for x in pair]]
    ids = r.sample(range(-500, 500), len(texts))
    rows = [*zip(ids, texts, strict=True), (None, "only one null id here")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, edge string, part long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.own_id: r for r in fingerprints.edited_likeness(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = fingerprints.Plan()
    assert len(got) == len(rows)
    for i, t, changed, then in plain_edits(rows):
        code = plan.codes(pa.array([t, changed, then]))
        own, new, nxt = [(code[0][k : k + 1], code[1][k : k + 1]) for k in range(3)]
        names = [x.hex() for x in plan.packed(*code)]
        want = (i, len(t), hashlib.sha256(changed.encode()).hexdigest(), names[0], names[1], plan.likeness(own, new)[0], plan.likeness(own, nxt)[0])
        assert tuple(got[i]) == want


def test_edited_likeness_of_one_row_of_repeated_rows_and_of_none(spark):
    schema = "doc_id long, text string"
    one = fingerprints.edited_likeness(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    same = fingerprints.edited_likeness(spark.createDataFrame([(1, "a b c d")] * 5 + [(None, None)] * 3, schema)).collect()
    assert len(same) == 8 and sum(r.n_chars == 0 for r in same) == 3
    assert fingerprints.edited_likeness(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("name", ["op11_hamerly_codes"])
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert plain(got) == plain(duck.execute(queries.ORACLES[name]).df())


def test_queries_equal_plain_on_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_token_alignment"](spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    short = [d for d in docs if len(d[1] or "") < 1500]
    assert set(got) == {d for d, _ in docs}
    # counts are those of the whole corpus, so only what a document says of itself is compared for the short ones
    for (d, _), w in zip(short, plain_alignment([t for _, t in short]), strict=True):
        assert (*got[d][:4], got[d][6]) == (*w[:4], w[6])
    found = {r.doc_id: r for r in queries.QUERIES["op13_minhash_fingerprints"](spark, sf_dir).collect()}
    off = []
    for i, t, changed, then in plain_edits(docs):
        a, b, c = shingles(t, 5), shingles(changed, 5), shingles(then, 5)
        off += [found[i].near_edited - len(a & b) / max(len(a | b), 1), found[i].near_next - len(a & c) / max(len(a | c), 1)]
    assert len(found) == len(docs) and np.abs(off).max() < 0.15 and abs(np.mean(off)) < 0.01
