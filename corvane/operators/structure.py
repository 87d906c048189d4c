"""Structure tables: residues, sequences, chain merges, loop selection, structure comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import euclid
from ..functions.sequences import LETTERS, letter, loop
from .windows import renumber

MODEL = ["complex_id", "model_number"]
RESIDUE = ["chain", "res_seq", "icode"]
#: The side of a merged complex that each role lies on.
SIDES = {"mhc": "A", "b2m": "A", "peptide": "A", "tcra": "B", "tcrb": "B"}


def residues(atoms: DataFrame, unknown: str | None = "X", standard_only: bool = True) -> DataFrame:
    """One row a residue: keys, name, letter and its first atom's place."""
    rows = atoms.where("record = 'ATOM'") if standard_only else atoms
    return rows.groupBy(*MODEL, *RESIDUE, "res_name").agg(F.min("ord").alias("ord"), F.avg("b").alias("b")).withColumn("aa", letter(F.col("res_name"), unknown))


def sequences(atoms: DataFrame, unknown: str | None = "X") -> DataFrame:
    """complex_id, model_number, chain, sequence; residues in file order."""
    res = residues(atoms, unknown)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "aa")))
    return res.groupBy(*MODEL, "chain").agg(F.array_join(F.transform(ordered, lambda r: r["aa"]), "").alias("sequence"))


def fragment_sequences(atoms: DataFrame, bond: float = 1.8) -> DataFrame:
    """complex_id, model_number, chain, sequence of the residues that are bonded to one beside them.

    Two standard residues next to each other in a chain are bonded if the first one's C and the second one's N are
    less than ``bond`` apart; a residue with neither bond is left out.
    """
    at = lambda atom, c: F.max(F.when(F.col("atom_name") == atom, F.col(c))).alias(f"{atom}{c}")
    res = atoms.where("record = 'ATOM'").where(F.col("res_name").isin(*LETTERS)).groupBy(*MODEL, *RESIDUE, "res_name").agg(F.min("ord").alias("ord"), *[at(a, c) for a in "CN" for c in "xyz"])
    w = Window.partitionBy(*MODEL, "chain").orderBy("ord")
    gap = euclid([F.lag(f"C{c}").over(w) for c in "xyz"], [F.col(f"N{c}") for c in "xyz"])
    res = res.withColumn("bonded", F.coalesce(gap < bond, F.lit(False)))
    res = res.withColumn("kept", F.col("bonded") | F.coalesce(F.lead("bonded").over(w), F.lit(False))).where("kept")
    ordered = F.array_sort(F.collect_list(F.struct("ord", letter(F.col("res_name")).alias("aa"))))
    return res.groupBy(*MODEL, "chain").agg(F.array_join(F.transform(ordered, lambda r: r["aa"]), "").alias("sequence"))


def model_metadata(atoms: DataFrame, chains: dict[str, str] | None = None) -> DataFrame:
    """One row a model with its chains' sequences by role; an absent or empty chain is null."""
    chains = chains or {"A": "MHC_seq", "B": "B2M_seq", "C": "Epitope", "D": "TCRA", "E": "TCRB"}
    seq = sequences(atoms)
    return seq.groupBy(F.col("complex_id").alias("tcr_id"), "model_number").agg(*[F.max(F.when((F.col("chain") == c) & (F.col("sequence") != ""), F.col("sequence"))).alias(n) for c, n in chains.items()])


def representative(atoms: DataFrame, glycine: str = "CA", other: str = "CB") -> DataFrame:
    """One atom a residue: CB, and CA for glycine."""
    return atoms.where(F.when(F.col("res_name") == "GLY", F.col("atom_name") == glycine).otherwise(F.col("atom_name") == other))


def merge_chains(atoms: DataFrame, roles: DataFrame) -> DataFrame:
    """The complex as two chains, receptor A and ligand B, in file order, with residues renumbered from 1.

    ``roles``: complex_id, chain, role. ATOM rows of known roles only. A number changes whenever the residue's key
    differs from the row before. Insertion codes stay in their own column.
    """
    table = F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv])
    rows = atoms.where("record = 'ATOM'").join(roles, ["complex_id", "chain"]).withColumn("side", F.try_element_at(table, F.col("role"))).where("side is not null")
    rows = renumber(rows, [*MODEL, "side"], ["ord"], RESIDUE, "new_seq")
    return rows.select(*[F.col("side").alias("chain") if c == "chain" else F.col("new_seq").cast("int").alias("res_seq") if c == "res_seq" else F.col(c) for c in atoms.columns], F.col("chain").alias("source_chain"))


def missing_roles(roles: DataFrame, needed: tuple[str, ...] = ("mhc", "peptide", "tcra", "tcrb")) -> DataFrame:
    """Complexes that lack a needed role, for the dead letters."""
    own = roles.groupBy("complex_id").agg(F.collect_set("role").alias("has"))
    lacks = F.array_except(F.array(*[F.lit(r) for r in needed]), F.col("has"))
    return own.select("complex_id", F.array_join(F.array_sort(lacks), ",").alias("missing")).where("missing <> ''")


def loops(numbering: DataFrame, scheme: str = "imgt", position: str = "imgt_pos", keys: tuple[str, ...] = ("sequence",), prefix: str = "CDR") -> DataFrame:
    """``CDR1``..``CDR3`` of numbered sequences: rows keys, position, insertion, aa. Gaps and, in the wide scheme,
    insertions are left out."""
    rows = numbering.where(F.col("aa") != "-")
    if scheme == "wide":
        rows = rows.where("insertion is null or trim(insertion) = ''")
    out = []
    for n in (1, 2, 3):
        own = F.collect_list(F.when(loop(F.col(position), n, scheme), F.struct(position, "insertion", "aa")))
        out.append(F.array_join(F.transform(F.array_sort(own), lambda r: r["aa"]), "").alias(f"{prefix}{n}"))
    return rows.groupBy(*keys).agg(*out)


def removed_indices(full: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Token indices (from 0) of residues that a trimmed model lacks, by key.

    ``full``: keys, chain, sequence; ``observed``: keys, chain, sequence. A chain's offset is the length of the chains
    before it by name. What stands before and after the observed part is missing; a chain that isn't there is missing
    whole. An observed sequence that isn't part of the full one gives a null list, for the dead letters.
    """
    from .windows import offsets

    rows = offsets(full.withColumn("size", F.length("sequence")), keys, ["chain"], "size", "offset")
    rows = rows.join(observed.select(*keys, "chain", F.col("sequence").alias("seen")), [*keys, "chain"], "left")
    at = F.position(F.col("seen"), F.col("sequence")) - 1
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    start, size = F.col("offset").cast("long"), F.col("size").cast("long")
    parts = F.when(F.col("seen").isNull() | (F.col("seen") == ""), span(start, start + size)).when(at >= 0, F.concat(span(start, start + at), span(start + at + F.length("seen"), start + size)))
    rows = rows.withColumn("gone", parts)
    bad = F.count_if(F.col("gone").isNull()) > 0
    return rows.groupBy(*keys).agg(F.when(~bad, F.array_sort(F.flatten(F.collect_list("gone")))).alias("removed"))


def align_numbering(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered residues matched in order to a structure's residues: keys, at, label, matched.

    ``rows``: keys, side (``n`` numbered or ``s`` structure), at (place), aa, label. Each numbered residue takes the
    next structure residue of its letter; after one that finds none, all the others are null too. A fold over a
    chain's numbered residues with the place in the structure as its state; a chain is one row.
    """
    part = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "aa", "label"))))
    chains = rows.groupBy(*keys).agg(part("n").alias("n__"), part("s").alias("s__")).withColumn("letters__", F.transform("s__", lambda x: x["aa"]))
    walk = F.expr("""aggregate(n__, named_struct('at', 0L, 'hits', cast(array() AS array<bigint>)), (w, x) ->
        transform(array(array_position(slice(letters__, cast(w.at + 1 as int), greatest(size(letters__) - cast(w.at as int), 0)), x.aa)), p ->
            named_struct('at', if(p > 0, w.at + p, cast(size(letters__) as bigint)), 'hits', concat(w.hits, array(if(p > 0, w.at + p, 0L)))))[0]).hits""")
    each = chains.withColumn("hits__", walk).select(*keys, "s__", F.explode(F.arrays_zip("n__", "hits__")).alias("r__"))
    found = F.when(F.col("r__.hits__") > 0, F.get("s__", F.col("r__.hits__").cast("int") - 1)["label"])
    return each.select(*keys, F.col("r__.n__.at").cast("int").alias("at"), F.col("r__.n__.label").alias("label"), found.alias("matched"))


def superpose(mobile: np.ndarray, target: np.ndarray) -> float:
    """Root mean square distance after the best rotation and translation."""
    if not len(mobile):
        return float("nan")
    a, b = mobile - mobile.mean(0), target - target.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(np.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))))


def _fit(mobile: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ca, cb = mobile.mean(0), target.mean(0)
    u, _, vt = np.linalg.svd((mobile - ca).T @ (target - cb))
    d = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    r = u @ d @ vt
    return r, cb - ca @ r


def compare(model: pd.DataFrame, native: pd.DataFrame, contact: float = 5.0, interface: float = 10.0, clash: float = 2.0) -> tuple[float, float, float, float, int]:
    """(DockQ, iRMSD, LRMSD, fnat, clashes) of two merged complexes, atoms matched by chain, number and name."""
    keys = ["chain", "res_seq", "atom_name"]
    native = native.drop_duplicates(keys)
    model = model.drop_duplicates(keys)

    def near(df: pd.DataFrame, cut: float) -> set[tuple[int, int]]:
        a, b = df[df.chain == "A"], df[df.chain == "B"]
        if a.empty or b.empty:
            return set()
        out = set()
        xb, rb = b[["x", "y", "z"]].to_numpy(), b.res_seq.to_numpy()
        ra = a.res_seq.to_numpy()
        for at in range(0, len(a), 512):
            xa = a[["x", "y", "z"]].to_numpy()[at : at + 512]
            i, j = np.nonzero(((xa[:, None, :] - xb[None, :, :]) ** 2).sum(2) < cut * cut)
            out |= set(zip(ra[at + i].tolist(), rb[j].tolist(), strict=True))
        return out

    real, made = near(native, contact), near(model, contact)
    fnat = len(real & made) / len(real) if real else 0.0
    wide = near(native, interface)
    sides = {("A", i) for i, _ in wide} | {("B", j) for _, j in wide}
    both = native.merge(model, on=keys, suffixes=("_n", "_m"))
    both = both[both.atom_name.isin(["N", "CA", "C", "O"])]
    xn, xm = both[["x_n", "y_n", "z_n"]].to_numpy(), both[["x_m", "y_m", "z_m"]].to_numpy()
    at = np.array([(c, r) in sides for c, r in zip(both.chain, both.res_seq, strict=True)], dtype=bool)
    irmsd = superpose(xm[at], xn[at]) if at.any() else float("nan")
    receptor = (both.chain == "A").to_numpy()
    lrmsd = float("nan")
    if receptor.any() and (~receptor).any():
        r, t = _fit(xm[receptor], xn[receptor])
        lrmsd = float(np.sqrt((((xm[~receptor] @ r + t) - xn[~receptor]) ** 2).sum(1).mean()))
    scaled = lambda x, d: 0.0 if np.isnan(x) else 1 / (1 + (x / d) ** 2)
    return (fnat + scaled(irmsd, 1.5) + scaled(lrmsd, 8.5)) / 3, irmsd, lrmsd, fnat, len(near(model, clash))


def compare_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """DockQ, iRMSD, LRMSD, fnat and clashes of each pair of structures.

    ``pairs``: keys, side (``model`` or ``native``), chain (A or B), res_seq, atom_name, x, y, z. One Arrow group a
    pair, which has the atoms of two complexes. A pair that can't be compared has null scores.
    """
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema], "DockQ double, iRMSD double, LRMSD double, fnat double, clashes int"])

    def score(df: pd.DataFrame) -> pd.DataFrame:
        out = df[keys].iloc[:1].copy()
        model, native = df[df.side == "model"], df[df.side == "native"]
        found = compare(model, native) if len(model) and len(native) else (None,) * 5
        for name, value in zip(("DockQ", "iRMSD", "LRMSD", "fnat", "clashes"), found, strict=True):
            out[name] = None if value is None or value != value else value
        return out

    return pairs.groupBy(*keys).applyInPandas(score, schema)


def chain_kind(atoms: DataFrame) -> DataFrame:
    """complex_id, chain, kind: ``nucleic`` if any residue is a nucleotide, else ``protein``."""
    # Residue names of nucleotides.
    nucleotides = ["DA", "DC", "DT", "DG", "A", "C", "U", "G"]
    return atoms.groupBy("complex_id", "chain").agg(F.when(F.bool_or(F.col("res_name").isin(nucleotides)), "nucleic").otherwise("protein").alias("kind"))


def token_atoms(atoms: DataFrame, modified: Column | None = None) -> DataFrame:
    """The atoms that stand for a token: CA, or C1' of nucleotides; ``modified`` marks atoms of residues that don't."""
    rows = atoms.where(F.col("atom_name").isin("CA", "C1'"))
    return rows if modified is None else rows.where(~modified)
