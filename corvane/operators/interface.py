"""Interface confidence: pDockQ, pDockQ2, ipSAE and its relatives, LIS, pLDDT means, complex-level averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.scores import d0, d0_of_residue, pdockq, pdockq2, ptm
from .spatial import XYZ, radius_join, side

#: Descending thresholds of the score, and the share of right models at each.
PPV_THRESHOLDS = [0.67333079, 0.65666073, 0.63254566, 0.62604391, 0.60150931, 0.58313803, 0.5647381, 0.54122438, 0.52314392, 0.49659878, 0.4774676, 0.44661346, 0.42628389, 0.39990988, 0.38479715, 0.3649393, 0.34526004, 0.3262589, 0.31475668, 0.29750023, 0.26673725, 0.24561247, 0.21882689, 0.19651314, 0.17606258, 0.15398168, 0.13927677, 0.12024131, 0.09996019, 0.06968505, 0.02946438]
PPV = [0.98128027, 0.96322524, 0.95333044, 0.9400192, 0.93172991, 0.92420274, 0.91629946, 0.90952562, 0.90043139, 0.8919553, 0.88570037, 0.87822061, 0.87116417, 0.86040801, 0.85453785, 0.84294946, 0.83367787, 0.82238224, 0.81190228, 0.80223507, 0.78549007, 0.77766077, 0.75941223, 0.74006263, 0.73044282, 0.71391784, 0.70615739, 0.68635536, 0.66728511, 0.63555449, 0.55890174]


def ppv(score: Column) -> Column:
    """The share at the smallest threshold not below the score; that of the largest threshold for scores above all."""
    out = F.lit(PPV[0])
    for t, p in zip(PPV_THRESHOLDS, PPV, strict=True):
        out = F.when(score <= t, p).otherwise(out)
    return out


def interface_scores(residues: DataFrame, keys: list[str], chain: str, radius: float = 8.0, coords: tuple[str, ...] = XYZ, plddt: str = "b", residue: str = "residue") -> DataFrame:
    """pDockQ of each pair of chains (first < second) in contact: ``n_pairs``, ``mean_plddt``, ``pdockq``.

    ``residues`` has one row a residue, at its representative atom. The mean is over the distinct residues of both
    sides that are in contact.
    """
    columns = [chain, residue, plddt, *coords]
    a, b = side(residues, "from", keys, columns), side(residues, "to", keys, columns)
    first, second = F.col(f"{chain}_from"), F.col(f"{chain}_to")
    near = radius_join(a, b, keys, radius, coords).where(first != second)
    # one pass over the pairs in both directions: a row for each residue and other chain tells who is in contact, and how often
    each = near.groupBy(*keys, first, second, F.col(f"{residue}_from"), F.col(f"{plddt}_from").cast("double").alias("p__")).agg(F.count("*").alias("n__"))
    pair = [*keys, F.least(first, second).alias("low__"), F.greatest(first, second).alias("high__")]
    got = each.groupBy(*pair).agg(F.sum(F.when(first < second, F.col("n__"))).alias("n_pairs"), F.avg("p__").alias("mean_plddt"))
    got = got.withColumnsRenamed({"low__": f"{chain}_from", "high__": f"{chain}_to"})
    return got.withColumn("pdockq", pdockq(F.col("mean_plddt"), F.col("n_pairs")))


def interface_pdockq2(pairs: DataFrame, keys: list[str], pae: Column, plddt: Column, scale: float = 10.0, rounded: bool = False) -> DataFrame:
    """Per key: ``mean_ptm`` of 1 / (1 + (pae / scale)^2), ``mean_plddt`` of the source residue once a pair, ``pdockq2``."""
    got = pairs.groupBy(*keys).agg(F.coalesce(F.avg(ptm(pae, F.lit(scale))), F.lit(0.0)).alias("mean_ptm"), F.coalesce(F.avg(plddt), F.lit(0.0)).alias("mean_plddt"))
    return got.withColumn("pdockq2", pdockq2(F.col("mean_ptm"), F.col("mean_plddt"), rounded))


def lis(pairs: DataFrame, keys: list[str], pae: str = "pae", cutoff: float = 12.0) -> DataFrame:
    """The mean of (cutoff - pae) / cutoff over errors below the cutoff; 0 where there are none."""
    below = F.when(F.col(pae) < cutoff, (cutoff - F.col(pae)) / cutoff)
    return pairs.groupBy(*keys).agg(F.coalesce(F.avg(below), F.lit(0.0)).alias("LIS"))


def ipsae(pairs: DataFrame, lengths: DataFrame, keys: list[str] | None = None, cutoff: float = 10.0, distance: float = 10.0, dealt: bool = False) -> DataFrame:
    """ipSAE, its two variants and ipTM of every ordered chain pair.

    ``pairs`` has a row for each ordered pair of residues of two chains: keys, chain1, i, chain2, j, pae, and dist if
    interface residues are wanted. ``lengths``: keys, chain, length. Per residue i, four means over j; a score is the
    largest mean, and ``n0res``, ``d0res``, ``best`` are those of the first residue that has it.

    Residue pairs are shuffled once, by model, or by chain pair if there are no keys; not at all if they are ``dealt``, with rows of a
    model in one partition. What is counted by residue and by pair are windows over that dealing, and a model's lengths come to it as a
    map, so nothing is joined back. A residue counts once by the row of its first partner that passes.
    """
    keys = keys or []
    pair = [*keys, "chain1", "chain2"]
    by_pair, by_i, by_j = Window.partitionBy(*pair), Window.partitionBy(*pair, "i"), Window.partitionBy(*pair, "j")
    marks = {"nres": F.col("pae") < cutoff}
    if "dist" in pairs.columns:
        marks["dist"] = marks["nres"] & (F.col("dist") < distance)
    rows = pairs if dealt else pairs.repartition(*(keys or pair))
    once = lambda ok, other, own: (ok & (F.col(other) == F.min(F.when(ok, F.col(other))).over(own))).cast("int")
    rows = rows.withColumns({"n0res": F.sum(F.when(marks["nres"], 1).otherwise(0)).over(by_i), **{f"{name}_i": once(ok, "j", by_i) for name, ok in marks.items()}})
    rows = rows.withColumns({f"{name}_j": once(ok, "i", by_j) for name, ok in marks.items()})
    valid = marks["nres"]
    counted = [F.coalesce(F.sum(f"{name}_{side}").over(by_pair), F.lit(0)).alias(f"{name}{n}") for name in marks for n, side in ((1, "i"), (2, "j"))]
    sizes = lengths.where("chain is not null").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("chain", "length"))).alias("sizes__"))
    rows = rows.select(*pair, "i", "pae", "n0res", *counted)
    rows = rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))
    rows = rows.select("*", *[F.try_element_at("sizes__", F.col(f"chain{n}")).alias(f"len{n}") for n in (1, 2)]).drop("sizes__").where("len1 is not null and len2 is not null")
    rows = rows.withColumn("n0chn", F.col("len1") + F.col("len2")).withColumn("n0dom", F.col("nres1") + F.col("nres2"))
    scales = {"d0chn": d0(F.col("n0chn")), "d0dom": d0(F.col("n0dom")), "d0res": d0_of_residue(F.col("n0res"))}
    own = ["n0chn", "n0dom", "d0chn", "d0dom", *[f"{name}{n}" for name in marks for n in (1, 2)]]
    rows = rows.withColumns(scales)
    mean = lambda scale, ok: F.coalesce(F.avg(F.when(ok, ptm(F.col("pae"), F.col(scale)))), F.lit(0.0))
    by = rows.groupBy(*pair, "i").agg(F.first("n0res").alias("n0res"), F.first("d0res").alias("d0res"), *[F.first(c).alias(c) for c in own], mean("d0chn", F.lit(True)).alias("iptm"), mean("d0chn", valid).alias("chn"), mean("d0dom", valid).alias("dom"), mean("d0res", valid).alias("res"))
    first = F.max_by(F.struct("i", "n0res", "d0res"), F.struct("res", -F.col("i")))
    best = by.groupBy(*pair).agg(F.max("res").alias("ipSAE"), F.max("chn").alias("ipSAE_d0chn"), F.max("dom").alias("ipSAE_d0dom"), F.max("iptm").alias("ipTM_d0chn"), first.alias("first"), *[F.first(c).alias(c) for c in own])
    return best.select(*pair, "ipSAE", "ipSAE_d0chn", "ipSAE_d0dom", "ipTM_d0chn", F.col("first.i").alias("best"), F.col("first.n0res").alias("n0res"), F.col("first.d0res").alias("d0res"), *own)


def chain_runs(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``chains``: of each model the chains with their runs of places that follow each other in the matrix.

    ``tokens``: keys, chain, residue (the place in the chain), token (the place in the matrix from 0).
    """
    runs = tokens.groupBy(*keys, "chain", (F.col("token") - F.col("residue")).alias("shift")).agg(F.min("token").alias("first"), F.min("residue").alias("residue"), F.count("*").alias("n"))
    chains = runs.groupBy(*keys, "chain").agg(F.array_sort(F.collect_list(F.struct("residue", "first", "n"))).alias("runs"), F.sum("n").alias("length"))
    return chains.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chain", "runs", "length"))).alias("chains"))


def ipsae_blocks(confidences: DataFrame, tokens: DataFrame, keys: list[str], matrix: str = "pae", cutoff: float = 10.0, near: float = 12.0) -> DataFrame:
    """What ``ipsae`` gives, and ``LIS``, of matrices as they are: a row for each residue and other chain, none for a cell.

    A matrix row is cut into the parts of the other chains, and the four means of a residue are folded inside its
    part. How many residues of the second chain have a partner is asked of the whole matrix before it is taken
    apart. What is shuffled is one row of scores for each residue and chain.
    """
    joined = confidences.select(*keys, F.col(matrix).alias("m__")).join(chain_runs(tokens, keys), keys)
    part = lambda row, runs: F.flatten(F.transform(runs, lambda r: F.slice(row, (r["first"] + 1).cast("int"), r["n"].cast("int"))))
    below = lambda x: x < cutoff
    rows_of = lambda c: part(F.col("m__"), c["runs"])
    places = lambda runs: F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))
    met = lambda a, b: F.size(F.filter(places(b["runs"]), lambda j: F.exists(rows_of(a), lambda row: below(F.get(row, j.cast("int"))))))
    start = lambda a, b: F.size(F.filter(rows_of(a), lambda row: F.exists(part(row, b["runs"]), below)))
    others = lambda a: F.filter("chains", lambda b: b["chain"] != a["chain"])
    pairs = F.flatten(F.transform("chains", lambda a: F.transform(others(a), lambda b: F.struct(a.alias("a"), b.alias("b"), start(a, b).alias("nres1"), met(a, b).alias("nres2")))))
    models = joined.withColumn("pairs__", pairs)
    place = lambda a: F.filter(a["runs"], lambda r: (F.col("t__") >= r["first"]) & (F.col("t__") < r["first"] + r["n"]))
    row = models.select(*keys, "pairs__", F.posexplode("m__").alias("t__", "row__"))
    cells = row.select(*keys, "t__", "row__", F.explode(F.filter("pairs__", lambda p: F.size(place(p["a"])) > 0)).alias("p"))
    cells = cells.select(*keys, F.col("p.a.chain").alias("chain1"), F.col("p.b.chain").alias("chain2"), (F.col("t__") - place(F.col("p.a"))[0]["first"] + place(F.col("p.a"))[0]["residue"]).alias("i"),
                         F.col("p.nres1").cast("long").alias("nres1"), F.col("p.nres2").cast("long").alias("nres2"), (F.col("p.a.length") + F.col("p.b.length")).alias("n0chn"), F.filter(part(F.col("row__"), F.col("p.b.runs")), lambda x: x.isNotNull()).alias("all__"))
    cells = cells.withColumn("ok__", F.filter("all__", below)).withColumn("n0res", F.size("ok__").cast("long")).withColumn("n0dom", F.col("nres1") + F.col("nres2"))
    cells = cells.withColumns({"d0chn": d0(F.col("n0chn")), "d0dom": d0(F.col("n0dom")), "d0res": d0_of_residue(F.col("n0res"))})
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))
    mean = lambda x, scale: F.coalesce(total(x, lambda v: ptm(v, F.col(scale))) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0))
    close = F.filter("all__", lambda x: x < near)
    by = cells.select(*keys, "chain1", "chain2", "i", "nres1", "nres2", "n0chn", "n0dom", "n0res", "d0chn", "d0dom", "d0res", mean("all__", "d0chn").alias("iptm"), mean("ok__", "d0chn").alias("chn"), mean("ok__", "d0dom").alias("dom"), mean("ok__", "d0res").alias("res"),
                      total(close, lambda v: (near - v) / near).alias("lis__"), F.size(close).alias("close__"))
    own = ["n0chn", "n0dom", "d0chn", "d0dom", "nres1", "nres2"]
    first = F.max_by(F.struct("i", "n0res", "d0res"), F.struct("res", -F.col("i")))
    lis_ = F.coalesce(F.sum("lis__") / F.nullif(F.sum("close__"), F.lit(0)), F.lit(0.0)).alias("LIS")
    best = by.groupBy(*keys, "chain1", "chain2").agg(F.max("res").alias("ipSAE"), F.max("chn").alias("ipSAE_d0chn"), F.max("dom").alias("ipSAE_d0dom"), F.max("iptm").alias("ipTM_d0chn"), first.alias("first"), lis_, *[F.first(c).alias(c) for c in own])
    return best.select(*keys, "chain1", "chain2", "ipSAE", "ipSAE_d0chn", "ipSAE_d0dom", "ipTM_d0chn", F.col("first.i").alias("best"), F.col("first.n0res").alias("n0res"), F.col("first.d0res").alias("d0res"), *own, "LIS")


def symmetric_max(scores: DataFrame, keys: list[str], score: str, carry: list[str]) -> DataFrame:
    """Per unordered chain pair, the larger of its two directions, with the winner's columns; a tie goes to the
    direction whose first chain sorts last."""
    order = F.struct(F.col(score), (F.col("chain1") > F.col("chain2")).cast("int"))
    low, high = F.least("chain1", "chain2").alias("chain_a"), F.greatest("chain1", "chain2").alias("chain_b")
    got = scores.select(*keys, low, high, score, "chain1", "chain2", *carry).groupBy(*keys, "chain_a", "chain_b").agg(F.max_by(F.struct(score, *carry), order).alias("w"))
    return got.select(*keys, "chain_a", "chain_b", "w.*")


def fixed_mean(values: list[Column], divisor: int = 4) -> Column:
    """The sum of what is there over a fixed divisor."""
    return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values]) / divisor


def pair_grid(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Every ordered pair of different chains of a model, for scores that are 0 where nothing is found."""
    a, b = chains.select(*keys, F.col("chain").alias("chain1")), chains.select(*keys, F.col("chain").alias("chain2"))
    return a.join(b, keys).where("chain1 <> chain2")


def matrix_rows(matrices: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """keys, token (the place from 0) and each named matrix' row there. A table with a column ``token`` has such rows already.

    A matrix may be too large for one row; its rows aren't. What a plan makes rows from is small, so they look small to the planner and
    would be broadcast: joins with them are hinted.
    """
    if "token" in matrices.columns:
        return matrices.select(*keys, "token", *names)
    return matrices.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("token", "row__")).select(*keys, "token", *[F.col(f"row__.{n}").alias(n) for n in names])


def rows_without(rows: DataFrame, keys: list[str], gone: str, *names: str) -> DataFrame:
    """Matrix rows without the rows and columns of the places listed in the column ``gone``; the places left count anew from 0."""
    lost = F.size(F.filter(gone, lambda g: g < F.col("token")))
    left = rows.where(~F.array_contains(gone, F.col("token")))
    return left.select(*keys, (F.col("token") - lost).alias("token"), *[arrays.without_places(F.col(n), F.col(gone)).alias(n) for n in names])


#: Cells of a matrix row that are joined at once with the residues of their places.
CUT = 256


def matrix_pairs(confidences: DataFrame, tokens: DataFrame, keys: list[str], matrix: str = "pae") -> DataFrame:
    """The long form of a residue matrix: keys, chain1, i, chain2, j, pae, for pairs of different chains.

    ``tokens``: keys, chain, residue, token (the place in the matrix from 0). ``confidences``: a matrix a row, or its rows by ``token``.
    Rows are cut into runs of cells that meet the residues of their places: no cell is shuffled on its own.
    """
    own = tokens.select(*keys, "token", F.col("chain").alias("chain1"), F.col("residue").alias("i"))
    rows = matrix_rows(confidences, keys, matrix).hint("merge").join(own, [*keys, "token"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matrix) - 1) / CUT).cast("int")), lambda b: F.slice(matrix, b * CUT + 1, CUT))
    cut = rows.where(F.size(matrix) > 0).select(*keys, "chain1", "i", F.posexplode(runs).alias("cut__", "run__"))
    place = F.struct((F.col("token") % CUT).cast("int").alias("at"), F.col("chain").alias("chain2"), F.col("residue").alias("j"))
    places = tokens.groupBy(*keys, F.floor(F.col("token") / CUT).cast("int").alias("cut__")).agg(F.collect_list(place).alias("places__"))
    met = F.filter("places__", lambda p: (p["chain2"] != F.col("chain1")) & (p["at"] < F.size("run__")))
    cells = F.transform(met, lambda p: F.struct(p["chain2"].alias("chain2"), p["j"].alias("j"), F.get("run__", p["at"]).alias("pae")))
    return cut.hint("merge").join(places, [*keys, "cut__"]).select(*keys, "chain1", "i", F.inline(cells))


def mean_plddt(atoms: DataFrame, keys: list[str], by: str | None = None, out: str = "plddt") -> DataFrame:
    return atoms.groupBy(*keys, *([by] if by else [])).agg(F.avg("b").alias(out))


def combined_plddt(alpha: list[str], beta: list[str], part: str, value: str) -> Column:
    """The mean of two combined means: of the parts of one set and of the other, (sum + 1e-6) / n / 100 each."""
    one = lambda parts: (F.sum(F.when(F.col(part).isin(*parts), F.col(value))) + 1e-6) / F.count_if(F.col(part).isin(*parts)) * 0.01
    return (one(alpha) + one(beta)) / 2


def summary_means(summary: DataFrame, chains: int = 5) -> DataFrame:
    """iptm_mean, ptm_mean and iptm_tcrpmhc of the summary confidences: means over chains, and over four cells."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(c), F.lit(0))
    cells = ((0, 3), (0, 4), (2, 3), (2, 4)) if chains == 5 else ((0, 2), (0, 3), (2, 2), (2, 3))
    cell = [F.get(F.get("chain_pair_iptm", F.lit(i)), F.lit(j)) for i, j in cells]
    return summary.withColumn("iptm_mean", mean(F.col("chain_iptm"))).withColumn("ptm_mean", mean(F.col("chain_ptm"))).withColumn("iptm_tcrpmhc", reduce(lambda a, b: a + b, cell) / 4)


def residue_contacts(residues: DataFrame, keys: list[str], radius: float = 8.0, coords: tuple[str, ...] = XYZ) -> DataFrame:
    """Ordered pairs of residues of different chains in contact: by CA where both have one, else by CB where both do.

    ``residues``: keys, chain, token, and ``<atom>_x``, ``_y``, ``_z``, ``_b`` of the atoms ca and cb, null where there is none.
    Gives keys, chain_from, token_from, b_from (of the atom that counts), chain_to, token_to, atom.
    """
    has = lambda atom: F.col(f"{atom}_{coords[0]}").isNotNull()
    out = []
    for atom in ("ca", "cb"):
        own = residues.where(has(atom)).select(*keys, "chain", "token", has("ca").alias("has_ca"), F.col(f"{atom}_b").alias("b"), *[F.col(f"{atom}_{c}").alias(c) for c in coords])
        columns = ["chain", "token", "has_ca", "b", *coords]
        near = radius_join(side(own, "from", keys, columns), side(own, "to", keys, columns), keys, radius, coords).where("chain_from <> chain_to")
        near = near if atom == "ca" else near.where("not (has_ca_from and has_ca_to)")
        out.append(near.select(*keys, "chain_from", "token_from", "b_from", "chain_to", "token_to", F.lit(atom).alias("atom")))
    return out[0].unionByName(out[1])


def chain_confidence(residues: DataFrame, matrices: DataFrame, keys: list[str], radius: float = 8.0, coords: tuple[str, ...] = XYZ, pae: str = "pae", pde: str = "contact_probs") -> DataFrame:
    """Per chain: if_plddt, avgipae, avgipde and pdockq2 of its contacts with the other chains; 0 without contacts.

    The pLDDT counts the source residue once a pair. The matrices' cells are those of the pairs in contact by CA. ``matrices`` have a row a
    model, or one for each ``token``, its place in the matrix from 0. Cells aren't expanded: the places that a residue is in contact with
    are gathered and looked up in its own row of the matrix.
    """
    near = residue_contacts(residues, keys, radius, coords)
    cells = F.collect_list(F.when(F.col("atom") == "ca", F.col("token_to").cast("int")))
    # a token lies in one chain
    by = near.groupBy(*keys, F.col("token_from").alias("token")).agg(F.min("chain_from").alias("chain"), F.sum("b_from").alias("b__"), F.count("b_from").alias("n_b__"), cells.alias("cells"))
    by = by.join(matrix_rows(matrices, keys, pae, pde).hint("merge"), [*keys, "token"], "left")
    total = lambda m, f: F.aggregate("cells", F.lit(0.0), lambda s, j: s + f(F.get(m, j)))
    by = by.select(*keys, "chain", "b__", "n_b__", F.size("cells").alias("n__"), total(pae, lambda x: ptm(x, F.lit(10.0))).alias("pae__"), total(pde, lambda x: x.cast("double")).alias("pde__"))
    mean = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c) / F.nullif(F.sum("n__"), F.lit(0)))
    got = by.groupBy(*keys, "chain").agg((F.sum("b__") / F.nullif(F.sum("n_b__"), F.lit(0))).alias("if_plddt"), mean("pae__").alias("avgipae"), mean("pde__").alias("avgipde"))
    every = residues.select(*keys, "chain").distinct().join(got, [*keys, "chain"], "left").fillna(0.0, ["if_plddt", "avgipae", "avgipde"])
    return every.withColumn("pdockq2", pdockq2(F.col("avgipae"), F.col("if_plddt")))


def region_plddt(atoms: DataFrame, regions: DataFrame, keys: list[str], out: str = "plddt") -> DataFrame:
    """keys, region and the mean b of the atoms of its residues. ``regions``: keys, chain, res_seq, aa, region; atoms have these but
    the region. A residue is known by number and letter; a region none of whose residues is there has no row."""
    own = [*keys, "chain", "res_seq", "aa"]
    return atoms.join(regions.select(*own, "region").distinct(), own).groupBy(*keys, "region").agg(F.avg("b").alias(out))


def region_score(points: DataFrame, regions: DataFrame, keys: list[str], alpha: list[str], beta: list[str]) -> DataFrame:
    """keys and cdrs_peptide_plddt: the mean over two chains' loops, each with the peptide, from CA alone.

    ``points``: keys, chain, at (place in the chain from 0) and b of CA, null where a residue has none; ``regions``: keys, chain, first,
    after, region. A residue without CA makes the score null, a region that isn't found counts for nothing.
    """
    rows = points.join(regions, [*keys, "chain"]).where("at >= first and at < after")
    whole = rows.withColumn("b", F.col("b").cast("double"))
    one = lambda parts: F.when(F.count_if(F.col("region").isin(*parts) & F.col("b").isNull()) == 0, (F.sum(F.when(F.col("region").isin(*parts), F.col("b"))) + 1e-6) / F.count_if(F.col("region").isin(*parts)) * 0.01)
    return whole.groupBy(*keys).agg(((one(alpha) + one(beta)) / 2).alias("cdrs_peptide_plddt"))


def interface_means(scores: DataFrame, keys: list[str], columns: list[str], interfaces: tuple[str, ...] = ("A_D", "A_E", "C_D", "C_E")) -> DataFrame:
    """Per model, the sum of each column over the listed chain pairs (``chain_a``_``chain_b``) by their number, absent ones counting 0."""
    own = F.concat_ws("_", "chain_a", "chain_b").isin(*interfaces)
    return scores.groupBy(*keys).agg(*[(F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0.0)) / len(interfaces)).alias(c) for c in columns])


#: The columns of the chain-pair report, with the format of each.
REPORT = [("Chn1", "%-4s"), ("Chn2", "%-4s"), ("PAE", "%3s"), ("Dist", "%3s"), ("Type", "%5s"), ("ipSAE", "%8.6f"), ("ipSAE_d0chn", "%8.6f"), ("ipSAE_d0dom", "%8.6f"), ("ipTM_af", "%5.3f"), ("ipTM_d0chn", "%8.6f"), ("pDockQ", "%8.4f"),
          ("pDockQ2", "%8.4f"), ("LIS", "%8.4f"), ("n0res", "%5d"), ("n0chn", "%5d"), ("n0dom", "%5d"), ("d0res", "%6.2f"), ("d0chn", "%6.2f"), ("d0dom", "%6.2f"), ("nres1", "%5d"), ("nres2", "%5d"), ("dist1", "%5d"), ("dist2", "%5d"), ("Model", "%s")]


def report_lines(scores: DataFrame) -> DataFrame:
    """Model, line: the chain-pair report's rows as text, with the columns of ``REPORT``, set apart by spaces; nulls are empty counts of 0."""
    filled = [F.coalesce(F.col(c), F.lit("" if f.endswith("s") else 0)) for c, f in REPORT]
    filled = [v.cast("int") if f.endswith("d") else v.cast("double") if f.endswith("f") else v.cast("string") for v, (_, f) in zip(filled, REPORT, strict=True)]
    return scores.select("Model", "Chn1", "Chn2", "Type", F.format_string("  ".join(f for _, f in REPORT), *filled).alias("line"))


def report_header() -> str:
    return "  ".join(c for c, _ in REPORT)
