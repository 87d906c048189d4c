"""Secret scans over a blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its text). The ledger says which (blob, rule
version) pairs have been scanned and what was found; a scan takes only the pairs that it lacks, one copy of each new
blob, and the findings are joined back to every path and version that holds the blob.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, documents, map_rows, texts_of, written

RULE_VERSION = 1
KINDS = ("assign", "access", "hex", "pem", "forge")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind, pattern, group whose length counts, least length. The first three are the contract's; the others are added.
RULES = (
    ("assign", re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}"), 0, 32),
    ("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), 0, 1),
    ("forge", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of each finding, by start, then kind; code points, end exclusive."""
    found = []
    for k, (_, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


LEDGER = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanned(blobs: DataFrame, rule_version: int) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch.column(1)):
                found = scan(text)
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found if k < 3)
                kinds = [k for _, k, _ in found]
                rows.append((rule_version, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)]], [x.split()[0] for x in LEDGER.split(", ")])

        return step

    return map_rows(blobs.select("blob", "text"), make, LEDGER)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of ``versions``, new ledger rows to append).

    ``versions`` has a row for each version of each path. The rows of a blob that the ledger has for this rule
    version are not scanned. Null text is the empty text, which is a blob too; null ids and repeated rows stay rows
    of the result; ids need not be unique. Columns other than the two named are not read.
    """
    rows = as_text(versions, text_col, id_col).withColumnRenamed(id_col, "version_id").withColumn("blob", F.sha2("text", 256))
    # one copy of each blob: the row with the smallest (id, tie); only ids and hashes are shuffled to find it
    firsts = rows.groupBy("blob").agg(F.min("version_id").alias("version_id"))
    if ledger is not None:
        firsts = firsts.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    unseen = rows.join(firsts.select("blob", "version_id"), (rows.blob == firsts.blob) & rows.version_id.eqNullSafe(firsts.version_id), "left_semi")
    new = written(_scanned(unseen, rule_version).groupBy("blob", "rule_version").agg(*[F.min(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")]), "ledger")
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == rule_version))
    found = rows.select("version_id", "blob").join(known.drop("rule_version"), "blob")
    return found.withColumnRenamed("version_id", id_col), new


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the findings of every document, with an empty ledger before."""
    found, _ = scan_versions(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
