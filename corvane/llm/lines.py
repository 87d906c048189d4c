"""Fuzzy line dedup with DataFrame functions only: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are normalised to their words: lower-case runs of letters, marks and digits; of scripts that set no spaces, each
character is a word. Equal normalised lines are one class. Two classes are near copies if

* the SimHashes of their distinct words differ in at most ``apart`` of 64 bits, and
* their edit similarity reaches ``percent``: the least number of words to replace, insert or delete is at most the rest of
  the percentage of the longer line.

Of each connected group of classes the first occurrence, by document and line, stays and all other occurrences go.
A line takes part if it has ``min_words`` words or ``min_chars`` letters, marks and digits, with characters of scripts
without spaces counted as letters only; shorter lines, such as blank ones, always stay. Lines of any length take part; those too
short for an edit to leave them similar enough have no near copies but equal ones.

The bits are cut into m blocks. SimHashes within m - r bits of each other agree in r blocks at least, so an index by all
choices of r blocks misses none, whatever m and r with m - r = ``apart`` are. They are set by the number of classes: more blocks give
more rows and fewer lines a key (``blocks``). Results don't depend on them. An edit changes two cells of a line's parities
(``line_table``) at most, so classes that few edits may link meet at blocks of these instead, of which fewer are needed; their
SimHashes are held against each other as all others are.

Candidates come in two steps, so that a large group doesn't give all its pairs. First each class is held against the
one of most lines among those whose SimHash begins alike at one of four places; most copies of a line meet it there. Then all pairs that share
a key and lie in different groups so far are held against each other. Each pair within ``apart`` bits that word counts and the
parity of word hashes don't rule out is verified on its words.

Documents are known by two 64-bit hashes of id and text: rows equal in both are one document and get one result. A line goes only
if two independent 64-bit hashes of it agree with those of its class.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep, scratch, sized_join, written
from .components import components

#: The query's edit similarity and bits: of the pairs of that similarity on sf0.01, 91% are within the bits.
PERCENT, APART = 95, 7
#: Scripts that set no spaces between words.
UNSPACED = r"[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\x{20000}-\x{3FFFF}]"
#: Lines of more words are compared without their equal ends.
LONG = 1000
#: Words that the byte-wide counters of one chunk can count; the upper one must not reach the sign.
CHUNK = 127
#: A number holds four counters of so many bits, of which one is kept free; MOST is how many words they count.
WIDTH = 16
LANES, MOST = sum(1 << WIDTH * i for i in range(4)), (1 << WIDTH - 2) - 1
SUMS = [f"s{k}" for k in range(WIDTH)]
#: Lines of more distinct words than this are counted by chunks.
MANY = MOST


#: A range around them: texts without such a character, most of them, needn't be looked at more closely.
AROUND = r"[\x{0E00}-\x{3FFFF}]"


def normal(text: Column) -> Column:
    """The text with its words in lower case and spaces between them; line breaks stay."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\n]++", " ")
    apart = F.regexp_replace(F.regexp_replace(words, f"({UNSPACED})", " $1 "), "  +", " ")
    return F.when(text.rlike(AROUND), apart).otherwise(words)


def _long_simhash(words: str) -> Column:
    """The bits that most of the hashes in the array ``words`` have set, for lines of any number of words."""
    lanes = ", ".join(f"aggregate(c, 0L, (s, x) -> s + (shiftrightunsigned(x, {k}) & {sum(1 << 8 * i for i in range(8))}L))" for k in range(8))
    chunks = f"transform(sequence(0, (size({words}) - 1) div {CHUNK}), i -> slice({words}, i * {CHUNK} + 1, {CHUNK}))"
    counts = f"transform({chunks}, c -> transform(array(array({lanes})), l -> transform(sequence(0, 63), i -> cast(shiftrightunsigned(l[i % 8], i div 8 * 8) & 255 as int)))[0])"
    total = "aggregate(slice(n, 2, size(n)), n[0], (s, c) -> zip_with(s, c, (x, y) -> x + y))"
    bits = f"aggregate(transform({total}, (x, i) -> if(2 * x > size({words}), shiftleft(1L, i), 0L)), 0L, (s, x) -> s | x)"
    return F.expr(f"transform(array({counts}), n -> {bits})[0]")


def _majorities(m: str) -> Column:
    """The SimHash of a line's sums over ``m`` words: a counter's upper bit tells whether its count passes half of m."""
    half = (F.lit(MOST) - F.expr(f"{m} div 2")) * F.lit(LANES)
    place = lambda x, k: F.shiftrightunsigned(x, WIDTH - 2 - k) if k < WIDTH - 1 else F.shiftleft(x, 1)
    return reduce(lambda a, b: a.bitwiseOR(b), [place((F.col(s) + half).bitwiseAND(F.lit(LANES << WIDTH - 2)), k) for k, s in enumerate(SUMS)])


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, min_chars: int = 25, percent: int = 97) -> DataFrame:
    """A row of each line that takes part.

    doc_id, doc_key, doc_check, pos, line_key, check (another hash), n (its words), simhash and parity (which of 64 cells hold
    an odd number of its distinct words); the last two are null for lines that can't have near copies.

    Words are rows for a moment: a SimHash bit is the majority of that bit over the words' hashes, and each of a line's
    sums counts four bits at once.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("row", "doc_id", *_document("doc_id"), F.col("text").rlike(AROUND).alias("odd"), normal(F.col("text")).alias("text"))
    lines = rows.select("row", "doc_id", "doc_key", "doc_check", "odd", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", F.trim("raw")).drop("raw").where("line <> ''").withColumn("n", F.size(F.split("line", " ")))
    unspaced = F.when(F.col("odd"), F.length("line") - F.length(F.regexp_replace("line", UNSPACED, ""))).otherwise(0)
    lines = lines.where((F.length("line") - F.col("n") + 1 >= min_chars) | ((F.col("n") >= min_words) & (F.col("n") - unspaced >= min_words)))
    words = F.when(F.expr(f"(100 - {percent}) * (n + 1) div 100 > 0"), F.array_distinct(F.split("line", " ")))  # a partner may be one word longer
    own = ["row", "pos", "doc_id", "doc_key", "doc_check", "line_key", "check", "n"]
    lines = lines.select("row", "doc_id", "doc_key", "doc_check", "pos", F.xxhash64("line").alias("line_key"), F.xxhash64(F.lit(1), "line").alias("check"), "n", words.alias("words"))
    hashes = F.when(F.size("words") > MANY, F.transform("words", lambda w: F.xxhash64(w)))
    lines = lines.select(*own, F.size("words").alias("m"), "words", hashes.alias("h")).select(*own, "m", "words", F.when(F.col("h").isNotNull(), _long_simhash("h")).alias("long"))
    each = lines.select(*own, "m", "long", F.explode(F.coalesce("words", F.array(F.lit("")))).alias("word")).select(*own, "m", "long", F.xxhash64("word").alias("h"))
    sums = [F.sum(F.when(F.col("m") <= MANY, F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANES)))).alias(s) for k, s in enumerate(SUMS)]
    per = each.groupBy(*own, "m", "long").agg(*sums, F.bit_xor(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("parity"))
    known = F.col("m") > 0
    return per.select(*own[1:], F.when(known, F.coalesce("long", _majorities("m"))).alias("simhash"), F.when(known, F.col("parity")).alias("parity"))


def _document(id_: str, text: str = "text") -> list[Column]:
    """The two hashes that a document is known by."""
    return [F.xxhash64(id_, text).alias("doc_key"), F.xxhash64(F.lit(1), id_, text).alias("doc_check")]


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """line_key, line and code of the classes ``wanted`` (line_key, first), read at their first occurrences.

    The code writes each word as one character by 20 bits of its hash.
    """
    places = written(wanted.groupBy(F.col("first.doc_key").alias("own_key")).agg(F.collect_set("first.pos").alias("places")), "wanted")
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("doc_key"))
    rows = sized_join(rows, places, F.col("doc_key") == F.col("own_key"), "inner")
    lines = F.filter(F.transform(F.split(normal(F.col("text")), "\n"), lambda x, i: F.when(F.array_contains("places", i), F.trim(x))), lambda x: x.isNotNull())
    point = "(65536 + (xxhash64(w) & 1048575))"  # a character past the surrogates, as the four bytes of UTF-8
    utf8 = f"4034953344 + ({point} & 63) + shiftleft(shiftrightunsigned({point}, 6) & 63, 8) + shiftleft(shiftrightunsigned({point}, 12) & 63, 16) + shiftleft(shiftrightunsigned({point}, 18), 24)"
    code = F.expr(f"cast(unhex(array_join(transform(split(line, ' '), w -> hex({utf8})), '')) as string)")
    lines = rows.select(F.explode(lines).alias("line")).select(F.xxhash64("line").alias("line_key"), "line", code.alias("code"))
    return lines.groupBy("line_key").agg(F.min("line").alias("line"), F.min("code").alias("code"))  # equal rows of docs


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs (a, b) of line keys whose lines have edit similarity of ``percent`` or more.

    The edit distance of codes can't be more than that of words, and is the same if no two words of the pair share a
    character. Pairs in which some do, and pairs of lines of over ``LONG`` words, are held against their words: what
    both begin and end with is left out, words are numbered within the pair, and the distance is looked for only if
    replacing words in place takes too many edits.
    """
    with scratch():
        ends = written(pairs.select(F.col("a").alias("line_key")).union(pairs.select(F.col("b").alias("line_key"))).distinct(), "line-ends")
        texts = written(_texts(docs, sized_join(classes.select("line_key", "first"), ends, "line_key", "inner"), id_col, text_col), "line-texts")
        codes, lines = texts.select("line_key", "code"), texts.select("line_key", "line")
        both = pairs.join(codes.toDF("a", "x"), "a").join(codes.toDF("b", "y"), "b")
        both = both.withColumn("most", F.expr(f"cast((100 - {percent}) * greatest(length(x), length(y)) div 100 as int)"))
        both = both.withColumn("long", F.expr(f"greatest(length(x), length(y)) > {LONG}")).where("long or levenshtein(x, y, most) >= 0")
        close = written(both.select("a", "b", "most", "long"), "line-near")
        close = close.join(lines.toDF("a", "line_a"), "a").join(lines.toDF("b", "line_b"), "b").withColumn("words", F.split(F.concat_ws(" ", "line_a", "line_b"), " "))
        plain = ~F.col("long") & (F.size(F.array_distinct("words")) == F.size(F.array_distinct(F.expr("transform(words, w -> xxhash64(w) & 1048575)"))))
        doubt = F.when(~plain, F.struct(F.split("line_a", " ").alias("x"), F.split("line_b", " ").alias("y"), "most"))
        close = written(close.select("a", "b", doubt.alias("doubt")), "line-close")
        rest = close.where("doubt is not null").select("a", "b", "doubt.*")
        for _ in range(2):  # words that both begin with don't change the distance; then the same from the other end
            same = F.array_position(F.zip_with("x", "y", lambda u, v: u.eqNullSafe(v)), False)
            rest = rest.withColumn("same", F.when(same == 0, F.least(F.size("x"), F.size("y"))).otherwise(same - 1).cast("int"))
            rest = rest.select("a", "b", "most", *[F.reverse(F.slice(c, F.col("same") + 1, F.size(c))).alias(c) for c in ("x", "y")])
        # replacing words in place is one way to edit: if it is short enough, no shorter one is looked for
        in_place = F.size(F.filter(F.zip_with("x", "y", lambda u, v: u.eqNullSafe(v)), lambda same: ~same))
        rest = written(rest.withColumn("quick", in_place <= F.col("most")).withColumn("known", F.array_distinct(F.concat("x", "y"))), "line-doubt")
        number = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position("known", w) + 0xFFFF), 8, "0")), "UTF-32")
        exact = [F.array_join(F.transform(c, number), "").alias(c) for c in ("x", "y")]
        slow = rest.where("not quick").select("a", "b", "most", *exact).where("levenshtein(x, y, most) >= 0")
        return keep(written(close.where("doubt is null").select("a", "b").union(rest.where("quick").select("a", "b")).union(slow.select("a", "b")), "line-links"))


BITS = 64
#: Bits of a number of blocks, above which it has the level of edits.
LEVEL = 48


def blocks(lines: int, apart: int) -> tuple[int, int]:
    """(m, r) of the index: how many blocks, and how many of them make a key.

    A row of a key costs about as much as holding twenty pairs of SimHashes against each other.
    """
    cost = lambda r: comb(apart + r, r) * (20 + 2 * lines / 2 ** (BITS * r / (apart + r)))
    r = min(range(1, 8), key=cost)
    return apart + r, r


def block_masks(m: int) -> list[int]:
    """The bits of each of ``m`` blocks, as signed longs."""
    return [x - (x >> 63 << 64) for x in (sum(1 << i for i in range(BITS * k // m, BITS * (k + 1) // m)) for k in range(m))]


def choices(m: int, r: int) -> list[tuple[int, int]]:
    """Of each choice of ``r`` of ``m`` blocks its bits, and which blocks before its last one aren't in it."""
    block = block_masks(m)
    return [(sum(block[i] for i in c), sum(1 << i for i in range(c[-1]) if i not in c)) for c in combinations(range(m), r)]


def _apart(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _possible(percent: int) -> Column:
    """Whether classes x and y can be near copies by their words' number (nx, ny) and parity (px, py), of which an edit changes two cells at most."""
    most = F.expr(f"(100 - {percent}) * greatest(nx, ny) div 100")
    return (F.abs(F.col("nx") - F.col("ny")) <= most) & (_apart(F.col("px"), F.col("py")) <= 2 * most)


def _stars(nodes: DataFrame, lines: int, percent: int, apart: int) -> DataFrame:
    """(a, b) of each class with that repeated one of most lines whose SimHash agrees from one of four places on."""
    width = min(max(lines.bit_length() - 4, 8), 32)
    turned = F.array(*[F.expr(f"(shiftrightunsigned(simhash, {16 * q}) | shiftleft(simhash, {64 - 16 * q})) & {(1 << width) - 1} | {q << 33}L") for q in range(4)])
    hubs = nodes.where("times > 1").select("times", "line_key", "simhash", F.explode(turned).alias("bits"))
    hubs = hubs.groupBy("bits").agg(F.max(F.struct("times", "line_key", "simhash")).alias("y")).select("bits", F.col("y.line_key").alias("hub"), F.col("y.simhash").alias("s"))
    near = nodes.select("line_key", "simhash", F.explode(turned).alias("bits")).join(hubs, "bits").where((F.col("line_key") != F.col("hub")) & (_apart(F.col("simhash"), F.col("s")) <= apart))
    near = written(near.select(F.least("line_key", "hub").alias("a"), F.greatest("line_key", "hub").alias("b")).distinct(), "line-near-rows")
    one = nodes.select("line_key", "n", "parity")
    near = written(sized_join(one.toDF("a", "nx", "px"), near, "a", "inner"), "line-near-rows")
    return sized_join(one.toDF("b", "ny", "py"), near, "b", "inner").where(_possible(percent)).select("a", "b")


def levels(percent: int, apart: int) -> Column:
    """The numbers of edits that a pair of a line of ``n`` words and a line as long or longer may be allowed; those of SimHash blocks are one."""
    most = lambda n: F.least(F.expr(f"(100 - {percent}) * {n} div 100"), F.lit(_few(apart) + 1)).cast("int")
    return F.sequence(F.greatest(most("n"), F.lit(1)), most(f"(100 * n div {percent})"))


def _few(apart: int) -> int:
    """The most edits for which parities, two cells an edit, are closer than SimHashes need be."""
    return max((apart - 1) // 2, 0)


def _agree(x: str, y: str, m: int) -> Column:
    """The blocks of ``m`` in which x and y agree, as bits."""
    return reduce(lambda a, b: a + b, [F.when(F.col(x).bitwiseXOR(F.col(y)).bitwiseAND(F.lit(bits)) == 0, F.lit(1 << i).cast("long")).otherwise(0) for i, bits in enumerate(block_masks(m))])


def _pairs(nodes: DataFrame, shapes: dict[int, tuple[int, int]], percent: int, apart: int) -> DataFrame:
    """(a, b) of all classes of different groups within ``apart`` bits. ``nodes`` have a column ``home``, their group so far.

    The index's rows are group, SimHash, parity and number of words, by key. ``shapes`` has the blocks of each level of edits:
    blocks of the parity for few edits, of the SimHash for more. Two rows meet at each choice of blocks that they agree
    in, and pair at the first of them only: no block before its last one agrees but its own. Classes are looked up for the few rows that pair.
    """
    own = ["home", "simhash", "parity", "n"]
    nodes = nodes.withColumns({c: F.coalesce(c, F.lit(0)) for c in own})  # none is null, and pairs needn't be asked
    code = {e: "parity" if e <= _few(apart) else "simhash" for e in shapes}
    keys = lambda e: F.array(*[F.struct(F.col(code[e]).bitwiseAND(F.lit(bits)).alias("key"), F.lit(e << LEVEL | others).cast("long").alias("others")) for bits, others in choices(*shapes[e])])
    each = reduce(lambda k, e: k.when(F.col("level") == e, keys(e)), shapes, F)
    index = nodes.select(*own).distinct().select(*own, F.explode(levels(percent, apart)).alias("level")).select(*own, F.explode(each).alias("k")).select(*own, "k.key", "k.others")
    x, y = index.toDF("hx", "sx", "px", "nx", "kx", "ox"), index.toDF("hy", "sy", "py", "ny", "ky", "oy")
    agree = reduce(lambda k, e: k.when(F.shiftright("ox", LEVEL) == e, _agree(code[e][0] + "x", code[e][0] + "y", shapes[e][0])), shapes, F)
    first = agree.bitwiseAND(F.col("ox")).bitwiseAND(F.lit((1 << LEVEL) - 1)) == 0
    near = x.join(y, (F.col("kx") == F.col("ky")) & (F.col("ox") == F.col("oy")) & (F.col("hx") < F.col("hy")) & (_apart(F.col("sx"), F.col("sy")) <= apart) & _possible(percent) & first)
    near = written(near.drop("kx", "ky", "ox", "oy").distinct(), "line-near-rows")
    one = nodes.select(*own, "line_key")
    for side, key in (("x", "a"), ("y", "b")):
        cols = [f"h{side}", f"s{side}", f"p{side}", f"n{side}"]
        near = written(sized_join(one.toDF(*cols, key), near, cols, "inner"), "line-near-rows")
    return near.select("a", "b")


def near_copies(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, percent: int, apart: int, shape: tuple[int, int] | None = None) -> DataFrame | None:
    """(node, component) of the classes that near copies link; None if there are no links."""
    nodes = classes.where("simhash is not null")
    sizes = dict(nodes.select(F.explode(levels(percent, apart)).alias("level")).groupBy("level").count().collect())
    shapes = {e: shape or blocks(k, apart) if e > _few(apart) else blocks(k, 2 * e) for e, k in sorted(sizes.items())}
    n = sum(sizes.values())
    if not shapes:
        return None
    found, groups, home = None, None, nodes.withColumn("home", F.col("line_key"))
    for step in (0, 1):
        pairs = written(_stars(nodes, n, percent, apart) if step == 0 else _pairs(home, shapes, percent, apart), "line-pairs")
        more = None if pairs.isEmpty() else _verified(pairs, classes, docs, id_col, text_col, percent)
        if more is not None and not more.isEmpty():
            found = more if found is None else found.union(more)
            groups = components(found)
            if step == 0:
                home = written(sized_join(nodes, groups.withColumnRenamed("node", "line_key"), "line_key", "left").withColumn("home", F.coalesce("component", "line_key")).drop("component"), "line-homes")
    return groups


def _classes(lines: DataFrame) -> DataFrame:
    """line_key, first (occurrence), n, simhash, parity and times of each class of equal normalised lines."""
    got = lines.groupBy("line_key").agg(F.min(F.struct("doc_id", "doc_key", "doc_check", "pos", "check")).alias("first"), *[F.max(c).alias(c) for c in ("n", "simhash", "parity")], F.count("*").alias("times"))
    return written(got, "classes")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, min_chars: int = 25, percent: int = 97, apart: int = 6, shape: tuple[int, int] | None = None) -> DataFrame:
    """doc_key, doc_check and ``places``, the line numbers (from 0) that go, of each document that loses a line.

    ``shape`` sets the index's blocks, (m, r) with m - r = ``apart``; results are the same with all.
    """
    if not 1 <= percent <= 100 or not 0 <= apart <= 31 or shape and shape[0] - shape[1] != apart:
        raise ValueError("percent is 1 to 100, apart 0 to 31, and the blocks that may differ are as many as apart says")
    with scratch():
        lines = written(line_table(docs, id_col, text_col, min_words, min_chars, percent), "lines")
        classes = _classes(lines)
        groups = near_copies(docs, classes, id_col, text_col, percent, apart, shape)
        home = classes.select("line_key", "first", "times")
        if groups is None:
            home = home.withColumn("component", F.col("line_key"))
        else:
            home = sized_join(home, groups.withColumnRenamed("node", "line_key"), "line_key", "left").withColumn("component", F.coalesce("component", "line_key"))
        best = home.groupBy("component").agg(F.min("first").alias("best"), F.sum("times").alias("all")).where("all > 1")
        best = sized_join(home, written(best, "line-groups"), "component", "inner").select("line_key", F.col("first.check").alias("own_check"), F.struct("best.doc_key", "best.doc_check", "best.pos").alias("best"))
        gone = sized_join(lines, written(best, "line-best"), "line_key", "inner").where((F.col("check") == F.col("own_check")) & (F.struct("doc_key", "doc_check", "pos") != F.col("best")))
        return keep(written(gone.groupBy("doc_key", "doc_check").agg(F.collect_set("pos").alias("places")), "line-gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with duplicate lines taken out of the text, and ``n_lines`` and ``n_removed``.

    Every row stays, with all its columns; a text that loses all its lines is empty. Null texts stay null (no lines),
    an empty text is one blank line. Of lines in one group, the one in the smallest (id, position) stays; null ids
    come first. Columns named as the added ones are replaced.
    """
    gone = duplicate_lines(docs, id_col, text_col, **options)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.col(f"`{text_col}`")
    own = [F.xxhash64(*more, F.col(f"`{id_col}`"), F.coalesce(text, F.lit(""))).alias(name) for name, more in (("own__key", []), ("own__check", [F.lit(1)]))]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], *own)
    rows = sized_join(keyed, gone.toDF("gone__key", "gone__check", "gone__places"), (F.col("own__key") == F.col("gone__key")) & (F.col("own__check") == F.col("gone__check")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("gone__places"), i)), "\n")
    new = F.when(F.col("gone__places").isNull(), text).otherwise(kept)
    counts = [F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"), F.coalesce(F.size("gone__places"), F.lit(0)).alias("n_removed")]
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], *counts)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: how many lines each document has and loses, and the digest of the text that stays."""
    rows = dedup_lines(documents(spark, sf_dir), percent=PERCENT, apart=APART)
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
