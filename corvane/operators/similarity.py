"""Sequence similarity against a reference set: edit similarity, local alignment, weighted statistics.

Both sides are reduced to distinct values with their multiplicity, each pair of distinct values is scored once, and
statistics weigh by multiplicity. The reference set is a fixed panel, so each query value meets all of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scores import similarity
from ..storage import materialized
from .aggregates import weighted_stats
from .joins import lookup_side

#: Alignment scores (match, mismatch, gap opening, gap extension).
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2.0, -1.0, -5.0, -0.5


def local_score(a: str, b: str) -> float:
    """The Smith-Waterman score with affine gaps. A gap of n costs opening plus n - 1 extensions.

    The cells of one diagonal don't depend on each other, so each is one numpy step.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    low = -1e9
    # by i (place in a) on each diagonal: best score, ending in a gap in a, ending in a gap in b
    h1, h2 = np.zeros(n + 1), np.zeros(n + 1)
    e1, f1 = np.full(n + 1, low), np.full(n + 1, low)
    best = 0.0
    for d in range(2, n + m + 1):
        first, last = max(1, d - m), min(n, d - 1)
        i = np.arange(first, last + 1)
        e, f, h = np.full(n + 1, low), np.full(n + 1, low), np.zeros(n + 1)
        e[i] = np.maximum(h1[i] + GAP_OPEN, e1[i] + GAP_EXTEND)
        f[i] = np.maximum(h1[i - 1] + GAP_OPEN, f1[i - 1] + GAP_EXTEND)
        s = np.where(x[i - 1] == y[d - i - 1], MATCH, MISMATCH)
        h[i] = np.maximum.reduce([np.zeros(len(i)), h2[i - 1] + s, e[i], f[i]])
        best = max(best, float(h[i].max()))
        h2, h1, e1, f1 = h1, h, e, f
    return best


@F.pandas_udf(DoubleType())
def local_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The local alignment score over twice the shorter length; null if either is empty or null."""
    def one(p, q):
        return None if not p or not q else local_score(p, q) / (2.0 * min(len(p), len(q)))

    return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")


def edit_similarity(a: Column, b: Column) -> Column:
    return similarity(a, b)


#: Blocks that a panel is cut into where it is too large to be broadcast.
BLOCKS = 64


def with_panel(queries: DataFrame, panel: DataFrame, blocks: int = BLOCKS, on: tuple[str, ...] = ()) -> DataFrame:
    """Each query with each row of a reference panel that is equal in ``on``, as statistics over a whole panel need.

    The panel is written first, so that its size is known. One of small size is broadcast. Another one is cut into blocks by a hash of
    its rows and each query goes to every block by an equi-join, so that no task has more than its share of the panel.
    """
    panel = materialized(panel, "panel")
    small = lookup_side(panel)
    if small is not panel:
        return queries.join(small, list(on)) if on else queries.crossJoin(small)
    x = queries.withColumn("block__", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return x.join(panel.withColumn("block__", F.pmod(F.xxhash64(*panel.columns), F.lit(blocks)).cast("int")), [*on, "block__"]).drop("block__")


def reference_stats(queries: DataFrame, references: DataFrame, value: str, ref_value: str, prefix: str, score=edit_similarity) -> DataFrame:
    """``value``, and min, weighted mean and max of its score over all reference rows (``prefix``_min ...)."""
    q = queries.where(F.col(value).isNotNull()).select(F.col(value).alias("q__")).distinct()
    r = references.where(F.col(ref_value).isNotNull()).groupBy(F.col(ref_value).alias("r__")).agg(F.count("*").alias("w__"))
    pairs = with_panel(q, r).withColumn("s__", score(F.col("q__"), F.col("r__")))
    return weighted_stats(pairs, ["q__"], "s__", "w__", prefix).withColumnRenamed("q__", value)


def with_reference_stats(queries: DataFrame, references: DataFrame, value: str, ref_value: str, prefix: str, score=edit_similarity) -> DataFrame:
    return queries.join(reference_stats(queries, references, value, ref_value, prefix, score), value, "left")


def blocked_stats(queries: DataFrame, references: DataFrame, keys: list[str], score, metrics: dict[str, str], ref_key: str = "ref_id", block: int = 32) -> DataFrame:
    """Statistics of a pair kernel over all references, by query. ``score`` maps a DataFrame of (query, reference) pairs to one with
    the metric columns; ``metrics``: column and its best (``min`` or ``max``). Queries are cut into blocks that meet the
    fixed panel of references; partial statistics are made before the shuffle."""
    pairs = with_panel(queries.withColumn("block__", F.pmod(F.xxhash64(*keys), F.lit(block))).repartition("block__").drop("block__"), references)
    scored = score(pairs)
    out = []
    for m, best in metrics.items():
        out += [(F.min if best == "min" else F.max)(m).alias(f"{m}_{best}"), F.avg(m).alias(f"{m}_mean")]
    return scored.groupBy(*keys).agg(*out)


#: The six loops whose distances are summed, and the constants that a distance table's kernel wants beside them.
REGIONS = ("CDR1a", "CDR2a", "CDR3a", "CDR1b", "CDR2b", "CDR3b")
CONSTANTS = {"count": 1, "pmhc_a_aa": "AAAAA", "pmhc_b_aa": "AAAAA"}


def receptor_table(df: DataFrame, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """tcr_id and the loops of receptors that have them all, one row an id (the smallest of several), with the constants."""
    own = df.dropna(subset=list(regions)).groupBy("tcr_id").agg(F.min(F.struct(*regions)).alias("r")).select("tcr_id", "r.*")
    return own.select("*", *[F.lit(v).alias(c) for c, v in CONSTANTS.items()])


def region_distance(a: Column, b: Column) -> Column:
    """A plain kernel: the number of edits between two loops."""
    return F.levenshtein(a, b).cast("double")


#: The largest distance of two residues, what each residue of difference in length costs, and the ends of a third loop that don't count.
FARTHEST, GAP, TRIMMED = 4, 4, (3, 2)


def residue_distances(scores: dict[str, int], default: int = 0) -> list[int]:
    """The distances of all pairs of letters, row by row: 0 for equal ones, else ``FARTHEST`` less a positive score, at least 0.

    ``scores``: a substitution matrix by pairs of letters, in either order; pairs that it lacks score ``default``.
    """
    of = lambda a, b: 0 if a == b else max(0, min(FARTHEST, FARTHEST - scores.get(a + b, scores.get(b + a, default))))
    letters = [chr(65 + i) for i in range(26)]
    return [of(a, b) for a in letters for b in letters]


def grouped_scores(groups: tuple[str, ...], inside: int = 1) -> dict[str, int]:
    """A substitution matrix by rule: ``inside`` for two letters of one group."""
    return {a + b: inside for g in groups for a in g for b in g if a != b}


def matrix_scores(text: str) -> dict[str, int]:
    """A substitution matrix from its usual text: ``#`` comments, a line of letters, then a letter and its scores a line."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return {r[0] + c: int(v) for r in rows[1:] for c, v in zip(rows[0], r[1:], strict=True)}


#: Classes of residues of like size and charge, for users without a matrix at hand.
LIKE = ("ILMV", "FWY", "KRH", "DE", "NQ", "ST", "AG")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once, though lambdas inside refer to it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def loop_kernel(distances: list[int], gap: int = GAP, trim: tuple[int, int] = (0, 0), fixed: bool = True):
    """The substitution-weighted distance of two loops, as an expression; null where a loop is null or empty.

    Residues are held against each other from both ends up to a gap, whose place is a rule of the shorter length if ``fixed``, or else
    that of several near the middle which gives the least. Ends of ``trim`` residues don't count. Each residue of difference costs ``gap``.
    """
    table = F.lit(distances)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    part = lambda x, first, after: total(F.slice(x, F.lit(first + 1), F.greatest(after - first, F.lit(0))))
    codes = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.ascii(F.substr(x, i, F.lit(1))))
    known = lambda c: c.between(65, 90)
    cell = lambda a, b: F.when(a == b, 0).when(known(a) & known(b), F.get(table, (a - 65) * 26 + (b - 65))).otherwise(FARTHEST)

    def ends(s: Column) -> Column:
        n, m = F.size(s["a"]), F.size(s["b"])
        places = F.sequence(F.lit(0), n - 1)
        left = F.transform(places, lambda i: cell(s["a"][i], s["b"][i]))
        right = F.transform(places, lambda i: cell(s["a"][n - 1 - i], s["b"][m - 1 - i]))

        def best(x: Column) -> Column:
            if fixed:
                low = high = F.least(F.lit(6), 3 + F.floor((n - 5) / 2).cast("int"))
            else:
                low, high = F.lit(5), n - 5
                out = F.greatest(F.ceil((low - high) / 2).cast("int"), F.lit(0))  # both ends move apart until they meet
                low, high = low - out, high + out
            at = lambda g: part(x["left"], trim[0], g) + part(x["right"], trim[1], n - g)
            return F.when(n == m, part(x["left"], trim[0], n - trim[1])).otherwise(F.array_min(F.transform(F.sequence(low, high), at)) + (m - n) * gap)

        return _let(F.struct(left.alias("left"), right.alias("right")), best)

    def kernel(a: Column, b: Column) -> Column:
        shorter = F.length(a) <= F.length(b)
        pair = F.struct(codes(F.when(shorter, a).otherwise(b)).alias("a"), codes(F.when(shorter, b).otherwise(a)).alias("b"))
        return F.when((F.length(a) > 0) & (F.length(b) > 0), _let(pair, ends)).cast("double")

    return kernel


def weighted_kernels(distances: list[int], regions: tuple[str, ...] = REGIONS) -> dict:
    """A kernel for each region: third loops are trimmed and seek their gap, the others have theirs at a fixed place."""
    third, other = loop_kernel(distances, trim=TRIMMED, fixed=False), loop_kernel(distances)
    return {r: third if r.startswith("CDR3") else other for r in regions}


def loop_distances(queries: DataFrame, references: DataFrame, kernel=region_distance, regions: tuple[str, ...] = REGIONS, prefix: str = "tcrdist") -> DataFrame:
    """tcr_id, and min, mean and max over all references of each region's distance and of their sum (``all``).

    ``kernel`` maps two loop columns to a distance, null where there is none; or one for each region. All regions go
    through one pass: a row for each region and distinct loop, which meets the panel's distinct loops of the region with their
    multiplicity. The sum needs whole receptors.
    """
    kernels = kernel if isinstance(kernel, dict) else dict.fromkeys(regions, kernel)
    loops = lambda df, name, *keep: df.select(*keep, F.explode(F.array(*[F.struct(F.lit(r).alias("region__"), F.col(r).alias(name)) for r in regions])).alias("x")).select(*keep, "x.*")
    own = loops(queries, "loop__", "tcr_id")
    panel = loops(references, "ref__").where("ref__ is not null").groupBy("region__", "ref__").agg(F.count("*").alias("w__"))
    pairs = with_panel(own.where("loop__ is not null").select("region__", "loop__").distinct(), panel, on=("region__",))
    score = F.lit(None).cast("double")
    for r, k in kernels.items():
        score = F.when(F.col("region__") == r, k(F.col("loop__"), F.col("ref__"))).otherwise(score)
    stats = weighted_stats(pairs.withColumn("s__", score), ["region__", "loop__"], "s__", "w__", "x")
    at = lambda r, s: F.max(F.when(F.col("region__") == r, F.col(f"x_{s}"))).alias(f"{prefix}_{r}_{s}")
    out = own.join(stats, ["region__", "loop__"], "left").groupBy("tcr_id").agg(*[at(r, s) for r in regions for s in ("min", "mean", "max")])
    total = None
    for r, k in kernels.items():
        d = F.coalesce(k(F.col(r), F.col(f"ref_{r}")), F.lit(0.0))
        total = d if total is None else total + d
    whole = references.groupBy(*[F.col(r).alias(f"ref_{r}") for r in regions]).agg(F.count("*").alias("w__"))
    sums = with_panel(queries.select("tcr_id", *regions), whole).withColumn("s__", total)
    return out.join(weighted_stats(sums, ["tcr_id"], "s__", "w__", f"{prefix}_all"), "tcr_id", "left")


def structure_stats(models: DataFrame, natives: DataFrame, metrics: dict[str, str] | None = None) -> DataFrame:
    """The similarity of every model to a panel of reference structures: best and mean of DockQ, iRMSD, LRMSD, fnat and clashes.

    ``models`` and ``natives``: complex_id, model_number, and atoms, an array of (chain, res_seq, atom_name, x, y, z) of the merged
    structure, so that a pair is one row. Pairs are scored in Arrow batches as they are made; pairs that can't be
    compared have no scores and don't count.
    """
    import pandas as pd

    from .structure import compare

    metrics = metrics or {"DockQ": "max", "iRMSD": "min", "LRMSD": "min", "Fnat": "max", "clashes": "min"}
    kind = "complex_id string, model_number int, DockQ double, iRMSD double, LRMSD double, Fnat double, clashes double"

    def score(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for df in batches:
                rows = []
                for cid, number, a, b in zip(df["complex_id"], df["model_number"], df["atoms"], df["ref_atoms"], strict=True):
                    found = compare(pd.DataFrame(list(a)), pd.DataFrame(list(b))) if len(a) and len(b) else (None,) * 5
                    rows.append((cid, number, *[None if v is None or v != v else float(v) for v in found]))
                yield pd.DataFrame(rows, columns=["complex_id", "model_number", "DockQ", "iRMSD", "LRMSD", "Fnat", "clashes"])

        return pairs.select("complex_id", "model_number", "atoms", "ref_atoms").mapInPandas(run, kind)

    refs = natives.select(F.concat_ws("_", "complex_id", "model_number").alias("ref_id"), F.col("atoms").alias("ref_atoms"))
    return blocked_stats(models.select("complex_id", "model_number", "atoms"), refs, ["complex_id", "model_number"], score, metrics)


def packed_structures(atoms: DataFrame) -> DataFrame:
    """complex_id, model_number, atoms: one row a merged structure, as ``structure_stats`` takes it."""
    one = F.struct("chain", "res_seq", "atom_name", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")])
    return atoms.groupBy("complex_id", "model_number").agg(F.array_sort(F.collect_list(one)).alias("atoms"))
