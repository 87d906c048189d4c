"""Structure files as one table of atoms: fixed-width and loop formats, single files, folders and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import model_file
from .archives import read_members

#: The columns (first, length) of the fixed-width atom line.
PDB_FIELDS = {"serial": (7, 5), "atom_name": (13, 4), "res_name": (18, 3), "chain": (22, 1), "res_seq": (23, 4), "icode": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "occ": (55, 6), "b": (61, 6)}
INTS, DOUBLES = ("serial", "res_seq"), ("x", "y", "z", "occ", "b")
#: The loop's items that a column comes from, the first that a file has.
CIF_ITEMS = {
    "record": ("group_PDB",), "serial": ("id",), "atom_name": ("auth_atom_id", "label_atom_id"), "res_name": ("auth_comp_id", "label_comp_id"), "chain": ("auth_asym_id", "label_asym_id"),
    "res_seq": ("auth_seq_id", "label_seq_id"), "icode": ("pdbx_PDB_ins_code",), "x": ("Cartn_x",), "y": ("Cartn_y",), "z": ("Cartn_z",), "occ": ("occupancy",), "b": ("B_iso_or_equiv",), "label_seq": ("label_seq_id",), "model": ("pdbx_PDB_model_num",),
}


def _typed(name: str, col: Column) -> Column:
    return col.try_cast("int") if name in INTS else col.try_cast("double") if name in DOUBLES else col


def parse_pdb(lines: DataFrame, hetatm: bool = True) -> DataFrame:
    """Atoms of fixed-width files, from lines (path, line, text). ATOM and, if asked for, HETATM lines of the first
    model that are long enough to name a chain."""
    records = ["ATOM", "HETATM"] if hetatm else ["ATOM"]
    record = F.trim(F.substring("text", 1, 6))
    ends = lines.where(F.col("text").startswith("ENDMDL")).groupBy("path").agg(F.min("line").alias("end__"))
    rows = lines.where(record.isin(*records) & (F.length("text") > 21)).join(ends, "path", "left").where("end__ is null or line < end__")
    fields = [_typed(n, F.trim(F.substring("text", a, k))).alias(n) for n, (a, k) in PDB_FIELDS.items()]
    return _finish(rows.select("path", F.col("line").cast("long").alias("ord"), record.alias("record"), *fields))


def parse_cif(files: DataFrame) -> DataFrame:
    """Atoms of loop files, from whole files (path, value). Items may come in any order; ligands have no residue number
    in the loop and are kept as HETATM rows only; the first model counts."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    names = lines.where(F.col("text").startswith("_atom_site.")).select("path", "line", F.trim(F.substring("text", 12, 100)).alias("item"))
    heads = names.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "item"))), lambda s: s["item"]).alias("items"))
    rows = lines.where(F.col("text").startswith("ATOM ") | F.col("text").startswith("HETATM ")).join(heads, "path").withColumn("f", F.split(F.trim("text"), r"\s+"))

    def item(options: tuple[str, ...]) -> Column:
        found = [F.when(F.array_contains("items", o), F.get("f", F.array_position("items", o).cast("int") - 1)) for o in options]
        return F.coalesce(*found)

    cols = {n: item(o) for n, o in CIF_ITEMS.items()}
    rows = rows.select("path", F.col("line").cast("long").alias("ord"), *[c.alias(n) for n, c in cols.items()])
    first = rows.groupBy("path").agg(F.min(F.col("model").try_cast("int")).alias("model_1"))
    rows = rows.join(first, "path").where("model is null or try_cast(model as int) = model_1")
    quotes = lambda c: F.regexp_replace(c, '^"(.*)"$', "$1")
    return _finish(rows.select("path", "ord", "record", *[_typed(n, quotes(F.col(n)) if n == "atom_name" else F.when(~F.col(n).isin("?", "."), F.col(n)) if n in ("icode", "res_seq") else F.col(n)).alias(n) for n in PDB_FIELDS]))


def _finish(rows: DataFrame) -> DataFrame:
    key = model_file(F.col("path"))
    icode = F.when(F.trim("icode") != "", F.trim("icode"))
    return rows.withColumn("key", key).select("path", F.col("key.complex_id").alias("complex_id"), F.col("key.model_number").alias("model_number"), "record", "serial", "atom_name", "res_name", "chain", "res_seq", icode.alias("icode"), "x", "y", "z", "occ", "b", "ord")


def read_pdb(spark: SparkSession, path: str | list[str], hetatm: bool = True) -> DataFrame:
    from .tables import numbered_lines

    return parse_pdb(numbered_lines(spark, path), hetatm)


def read_cif(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_cif(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def read_structures(spark: SparkSession, folder: str) -> DataFrame:
    """All structure files below a folder, by suffix. A file that can't be read gives no rows."""
    read = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    cif = read.text(folder, wholetext=True, pathGlobFilter="*.cif").select(F.col("_metadata.file_path").alias("path"), "value")
    pdb = read.text(folder, wholetext=True, pathGlobFilter="*.pdb").select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return parse_cif(cif).unionByName(parse_pdb(pdb))


def unread_structures(files: DataFrame, atoms: DataFrame) -> DataFrame:
    """key, error: the files (path) that gave no atoms, for the dead letters."""
    return files.select("path").join(atoms.select("path").distinct(), "path", "left_anti").select(F.col("path").alias("key"), F.lit("no atoms").alias("error"))


def read_archive(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path, value: the text files inside tar archives, as if they lay in a folder named like the archive.

    Members are read in parallel (``archives``); what a broken archive still has is read, and ``archives.broken_archives`` tells of it.
    """
    members = read_members(spark, path, suffix).where("error is null")
    return members.select(F.concat_ws("/", "archive", "member").alias("path"), "value")


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """complex_id, model_number, ord, line: the atoms as fixed-width lines."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.substring("atom_name", 1, 4))
    line = F.format_string("%-6s%5d %4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f", "record", (F.col("serial") % 100000).cast("int"), name, "res_name", F.substring("chain", 1, 1), "res_seq", F.coalesce("icode", F.lit(" ")), "x", "y", "z", "occ", "b")
    return atoms.select("complex_id", "model_number", "ord", line.alias("line"))
