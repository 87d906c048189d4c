"""Alleles, residues and sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Residue names and their letters.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: Numbering ranges (first, last) of the three loops in two conventions.
CDR_SCHEMES = {"imgt": ((27, 38), (56, 65), (104, 118)), "wide": ((26, 39), (55, 66), (104, 118))}


def normal_allele(allele: Column) -> Column:
    """Alleles as ``HLA-X*NN:NN``, by what a name begins with (spaces around it don't count).

    A name that begins in this form stays as it is, even if longer. One without a star gets one, and 01 for a missing
    second field; one with a star and both fields but no ``HLA-`` gets that and loses what follows. Others stay.
    """
    name = F.trim(allele)
    bare, starred = r"^(?:HLA-)?([A-Z])([0-9]{2}):?([0-9]{2})?", r"^([A-Z])\*([0-9]{2}):([0-9]{2})"
    part = lambda pattern, n: F.regexp_extract(name, pattern, n)
    second = F.when(part(bare, 3) == "", F.lit("01")).otherwise(part(bare, 3))
    return (F.when(name.rlike(bare), F.concat(F.lit("HLA-"), part(bare, 1), F.lit("*"), part(bare, 2), F.lit(":"), second))
            .when(name.rlike(starred), F.concat(F.lit("HLA-"), part(starred, 1), F.lit("*"), part(starred, 2), F.lit(":"), part(starred, 3)))
            .otherwise(name))


def predictor_allele(allele: Column) -> Column:
    """An allele as predictors take it: no stars or spaces, HLA- before."""
    return F.concat(F.lit("HLA-"), F.regexp_replace(allele, r"[* ]", ""))


def two_fields(allele: Column) -> Column:
    """The first two fields, null without a second."""
    return F.nullif(F.regexp_extract(allele, "^([^:]+:[^:]+)", 1), F.lit(""))


def clean_sequence(sequence: Column) -> Column:
    return F.replace(sequence, F.lit("*"), F.lit(""))


def is_protein(sequence: Column) -> Column:
    """Non-empty and of the twenty letters only; false for null."""
    return F.coalesce(sequence.rlike(f"^[{AMINO_ACIDS}]+$"), F.lit(False))


def odd_letters(sequence: Column) -> Column:
    """The distinct letters that are no amino acid."""
    return F.array_except(F.split(sequence, ""), F.array(*[F.lit(c) for c in AMINO_ACIDS]))


def letter(res_name: Column, unknown: str | None = "X") -> Column:
    """A residue's letter; ``unknown``, or the name itself where that is None."""
    table = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, res_name), res_name if unknown is None else F.lit(unknown))


def accession(subject: Column) -> Column:
    """The second part of a piped name."""
    return F.try_element_at(F.split(subject, r"\|"), F.lit(2))


def loop(position: Column, number: int, scheme: str = "imgt") -> Column:
    """Whether a numbering position lies in loop 1, 2 or 3."""
    return position.between(*CDR_SCHEMES[scheme][number - 1])


def find(sequence: Column, part: Column) -> Column:
    """The place of a substring from 0, -1 where there is none."""
    return F.position(part, sequence) - 1


def model_file(path: Column) -> Column:
    """complex and model of a file name ``<complex>_<model>.<suffix>`` or ``..._sample-<n>_model.cif``, as a struct."""
    name = F.regexp_extract(path, r"([^/]+)\.[A-Za-z0-9]+$", 1)
    sample = F.regexp_extract(name, r"^(.*?)_(?:seed-[0-9]+_)?sample-([0-9]+)_model$", 2)
    return F.when(sample != "", F.struct(F.regexp_extract(name, r"^(.*?)_(?:seed-[0-9]+_)?sample-([0-9]+)_model$", 1).alias("complex_id"), sample.try_cast("int").alias("model_number"))).otherwise(
        F.struct(F.regexp_extract(name, r"^(.*)_([0-9]+)$", 1).alias("complex_id"), F.regexp_extract(name, r"^(.*)_([0-9]+)$", 2).try_cast("int").alias("model_number")))
