"""Tar archives as a Spark data source: read by runs of members, written as shards with an index and a manifest.

Reading: the driver goes once over an archive's headers, seeking past the contents, and deals its members to partitions by
offset and size, so that several tasks read one archive and none holds all of it. A compressed archive can't be entered in the
middle and is one partition, read as a stream. Members of an archive that ends too early are read as far as they are whole,
and the archive has a row with an error.

Writing: each task puts its rows into shards of about a target size, each under a hidden name until it is whole, and
tells the driver what it has made. The manifest, written last, names the shards that count and what is in them: shards
of a task that failed or ran twice aren't in it. Rows with an error go to a table of failures beside the shards.

Paths are opened by Python in tasks, so they have to be in a file system that all of them reach by the same name.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import os
import tarfile
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

READ, WRITTEN = "corvane_tar", "corvane_shards"
RUN_BYTES, SHARD_BYTES = 8 << 20, 64 << 20
MANIFEST, FAILURES = "_manifest.json", "_failures.jsonl"


def _local(path: str) -> str:
    return path[5:].replace("//", "", 1) if path.startswith("file:///") else path.removeprefix("file:")


def _archives(path: str) -> list[str]:
    """The archives that a path names: itself, or those of a folder."""
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")))
    return [path]


def _unpacked(path: str):
    """The stream inside a compressed file, which raises where the file ends too early."""
    kinds = ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open))
    with open(path, "rb") as f:
        first = f.read(6)
    return next((opened(path, "rb") for mark, opened in kinds if first.startswith(mark)), None)


@dataclass
class Run(InputPartition):
    """Members of one archive: (name, offset, size) each; None for all of a compressed one. ``error`` tells what is wrong with the archive."""

    path: str
    members: list[tuple[str, int, int]] | None = field(default_factory=list)
    error: str | None = None


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.run_bytes = int(options.get("run_bytes", RUN_BYTES))

    def partitions(self) -> Sequence[Run]:
        return [run for path in _archives(self.path) for run in self._runs(path)]

    def _runs(self, path: str) -> list[Run]:
        runs, size = [Run(path)], 0
        try:
            with tarfile.open(path, "r:") as tar:
                end = os.path.getsize(path)
                for m in tar:
                    if m.isfile() and m.offset_data + m.size > end:
                        raise tarfile.ReadError(f"{m.name} is cut")
                    if m.isfile() and m.name.endswith(self.suffix):
                        if size and size + m.size > self.run_bytes:
                            runs, size = [*runs, Run(path)], 0
                        runs[-1].members.append((m.name, m.offset_data, m.size))
                        size += m.size
        except (tarfile.TarError, OSError, EOFError) as e:
            if len(runs) == 1 and not runs[0].members and not isinstance(e, OSError) and _unpacked(path) is not None:
                return [Run(path, None)]
            runs.append(Run(path, [], str(e) or type(e).__name__))
        return [r for r in runs if r.members or r.error]

    def read(self, run: Run) -> Iterator[tuple]:
        if run.error:
            yield run.path, None, None, run.error
        elif run.members is None:
            try:
                with _unpacked(run.path) as f, tarfile.open(fileobj=f, mode="r|") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(self.suffix):
                            yield run.path, m.name, tar.extractfile(m).read().decode("utf-8", "replace"), None
            except (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError) as e:
                yield run.path, None, None, str(e) or type(e).__name__
        else:
            with open(run.path, "rb") as f:
                for name, at, size in run.members:
                    f.seek(at)
                    yield run.path, name, f.read(size).decode("utf-8", "replace"), None


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return READ

    def schema(self) -> str:
        return "archive string, member string, value string, error string"

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def read_members(spark: SparkSession, path: str, suffix: str = "", run_bytes: int = RUN_BYTES) -> DataFrame:
    """archive, member, value, error: the text files inside an archive or a folder's archives; a broken archive has a row with its error."""
    spark.dataSource.register(TarSource)
    return spark.read.format(READ).option("suffix", suffix).option("run_bytes", str(run_bytes)).load(path)


def broken_archives(members: DataFrame) -> DataFrame:
    """key, error of the archives that could not be read to their end, for the dead letters."""
    return members.where("error is not null").select(F.col("archive").alias("key"), "error")


@dataclass
class Made(WriterCommitMessage):
    shards: list[dict]
    failures: list[dict]


class ShardWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = _local(options["path"]), overwrite
        self.target = int(options.get("shard_bytes", SHARD_BYTES))

    def write(self, rows: Iterator) -> Made:
        os.makedirs(self.path, exist_ok=True)
        shards, failures, tar, hidden, index, size = [], [], None, "", [], 0

        def close() -> None:
            nonlocal tar
            if tar is not None:
                tar.close()
                name = os.path.basename(hidden)[1:]
                os.replace(hidden, os.path.join(self.path, name))  # whole from here on
                shards.append({"shard": name, "members": index})
                tar = None

        try:
            for r in rows:
                if r["error"] is not None or r["name"] is None:
                    failures.append({"name": r["name"], "error": r["error"] if r["error"] is not None else "no name"})
                    continue
                content = (r["value"] or "").encode()
                if tar is not None and size + len(content) > self.target:
                    close()
                if tar is None:
                    hidden, index, size = os.path.join(self.path, f".shard-{uuid.uuid4().hex}.tar"), [], 0
                    tar = tarfile.open(hidden, "w")
                about = tarfile.TarInfo(r["name"])
                about.size = len(content)
                tar.addfile(about, io.BytesIO(content))
                index.append({"name": r["name"], "bytes": len(content)})
                size += len(content)
            close()
        except BaseException:
            if tar is not None:
                tar.close()
                os.remove(hidden)
            raise
        return Made(shards, failures)

    def commit(self, messages: list[Made | None]) -> None:
        made = [m for m in messages if m is not None]
        before = None if self.overwrite else read_manifest(self.path)
        shards = [*(before["shards"] if before else []), *[s for m in made for s in m.shards]]
        with open(os.path.join(self.path, FAILURES), "w" if self.overwrite else "a", encoding="utf-8") as f:
            f.writelines(json.dumps(x) + "\n" for m in made for x in m.failures)
        hidden = os.path.join(self.path, f".manifest-{uuid.uuid4().hex}")
        with open(hidden, "w", encoding="utf-8") as f:
            json.dump({"shards": shards, "rows": sum(len(s["members"]) for s in shards)}, f)
        os.replace(hidden, os.path.join(self.path, MANIFEST))

    def abort(self, messages: list[Made | None]) -> None:
        for m in messages:
            for s in m.shards if m is not None else []:
                os.remove(os.path.join(self.path, s["shard"]))


class ShardSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return WRITTEN

    def schema(self) -> str:
        return "name string, value string, error string"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def read_manifest(path: str) -> dict | None:
    """The shards that count, with their members, or None where nothing has been committed."""
    try:
        with open(os.path.join(_local(path), MANIFEST), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def write_shards(df: DataFrame, path: str, name: str = "name", value: str = "value", error: str | None = None, shard_bytes: int = SHARD_BYTES, mode: str = "append") -> None:
    """Texts as members of tar shards at ``path``; rows whose ``error`` isn't null, and those without a name, are failures."""
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"), (F.col(error) if error else F.lit(None)).cast("string").alias("error"))
    df.sparkSession.dataSource.register(ShardSink)
    rows.write.format(WRITTEN).option("shard_bytes", str(shard_bytes)).mode(mode).save(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """name, value of the members of committed shards."""
    found = read_manifest(path) or {"shards": []}
    counted = spark.createDataFrame([(os.path.join(_local(path), s["shard"]),) for s in found["shards"]], "archive string")
    return read_members(spark, path).join(F.broadcast(counted), "archive", "left_semi").select(F.col("member").alias("name"), "value")  # a row for each shard
