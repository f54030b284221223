"""Moves, copies and trash as two steps: everything is staged, and only then does anything take its place.

A writer of a Python data source stages: each task copies its photographs and sidecars to hidden names beside their
destinations, where a copy is needed at all, and notes each in a journal file of its own. Its commit, one small file with
the names of the journals, is the turning point. Before it a failed run is rolled back to nothing; after it, publishing
renames what was staged, and may be done again until all is through. Both are jobs over the journal: the driver sees a
name and four numbers of each task, never the files.

Paths are those of a file system that all executors mount, or in any store that Arrow opens; times of modification
are kept where files are local paths.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SOURCE = "shutterloom_files"
_OUTCOME = "source string, dest string, action string, error string, mtime_ms long, bytes long"
_ERRORS = (OSError, pa.ArrowException)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def _info(path: str) -> pyarrow.fs.FileInfo | None:
    system, inner = _open(path)
    found = system.get_file_info(inner)
    return found if found.type == pyarrow.fs.FileType.File else None


def _beside(path: str, name: str) -> str:
    folder, _, _ = path.rpartition("/")
    return f"{folder}/{name}" if folder else name


def _sidecar(path: str) -> str:
    return _beside(path, path.rpartition("/")[2].rsplit(".", 1)[0] + ".xmp")


def _staged(dest: str, operation: str) -> str:
    return _beside(dest, f".{dest.rpartition('/')[2]}.{operation}.part")


def _kept_time(source: str, dest: str) -> None:
    """dest as old as source, as far as the file system allows it."""
    if "://" not in source and "://" not in dest:
        try:
            at = os.stat(source.removeprefix("file:"))
            os.utime(dest.removeprefix("file:"), ns=(at.st_atime_ns, at.st_mtime_ns))
        except OSError:
            pass


def _copy(source: str, part: str) -> None:
    (a, x), (b, y) = _open(source), _open(part)
    b.create_dir(y.rpartition("/")[0], recursive=True)
    pyarrow.fs.copy_files(x, y, source_filesystem=a, destination_filesystem=b)
    _kept_time(source, part)


def _rename(source: str, dest: str) -> None:
    system, x = _open(source)
    inner = _open(dest)[1]
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    system.move(x, inner)


def _delete(path: str) -> None:
    if _info(path):
        system, inner = _open(path)
        system.delete_file(inner)


@dataclass
class _Staged(WriterCommitMessage):
    journal: str
    done: int
    skipped: int
    failed: int


class _Stage(DataSourceWriter):
    def __init__(self, journal: str, operation: str, move: bool) -> None:
        self.journal, self.operation, self.move = journal, operation, move

    def _one(self, row: Row) -> dict:
        made = {"source": row.source, "dest": row.dest, "action": row.action, "error": None, "sidecar": False, "parts": [], "mtime_ms": None, "bytes": None}
        try:
            found = _info(row.source)
            if row.action == "do" and _info(row.dest):
                made["action"] = "skip_exists"
            elif row.action == "do" and not found:
                made["action"] = "skip_missing"
            elif row.action == "do":
                made |= {"mtime_ms": found.mtime_ns // 1_000_000 if found.mtime_ns else None, "bytes": found.size}
                # a rename needs no copy
                plain = self.move and _open(row.source)[0].equals(_open(row.dest)[0])
                if not plain:
                    made["parts"].append(_staged(row.dest, self.operation))
                    _copy(row.source, made["parts"][0])
                own, target = _sidecar(row.source), _sidecar(row.dest)
                try:
                    if _info(own) and not _info(target):
                        if not plain:
                            _copy(own, _staged(target, self.operation))
                            made["parts"].append(_staged(target, self.operation))
                        made["sidecar"] = True
                except _ERRORS:
                    pass  # a sidecar that cannot follow is no failure of its photograph
        except _ERRORS as e:
            made["error"] = f"{row.source}: {e}"
            for part in made.pop("parts"):
                _delete(part)
            made["parts"] = []
        return made

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        name = f"{self.journal}/{uuid.uuid4().hex}.jsonl"
        system, inner = _open(name)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        counts = [0, 0, 0]
        parts: list[str] = []
        try:
            with system.open_output_stream(inner) as out:
                for row in iterator:
                    made = self._one(row)
                    parts += made["parts"]
                    counts[2 if made["error"] else 0 if made["action"] == "do" else 1] += 1
                    out.write(json.dumps(made).encode() + b"\n")
        except BaseException:
            for part in parts:
                _delete(part)
            raise
        return _Staged(name.rpartition("/")[2], *counts)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, inner = _open(f"{self.journal}/_committed.part")
        with system.open_output_stream(inner) as out:
            out.write(json.dumps([m.journal for m in messages if m is not None]).encode())
        system.move(inner, _open(f"{self.journal}/_committed")[1])

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, inner = _open(f"{self.journal}/_aborted")
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(json.dumps([m.journal for m in messages if m is not None]).encode())


class FileOperations(DataSource):
    """Takes rows (source, dest, action) of operators.storage.transfer_plan(); options journal, operation, move."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "source string, dest string, action string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Stage(self.options["journal"], self.options["operation"], self.options["move"] == "true")


def _journal(spark: SparkSession, journal: str, marker: str) -> DataFrame:
    system, inner = _open(f"{journal}/{marker}")
    with system.open_input_stream(inner) as f:
        names = json.loads(f.read())
    schema = "source string, dest string, action string, error string, sidecar boolean, parts array<string>, mtime_ms long, bytes long"
    return spark.read.schema(schema).json([f"{journal}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def _each(rows: DataFrame, step: Callable[[dict], dict]) -> DataFrame:
    """_OUTCOME of step() for each row of a journal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source", pa.string()), ("dest", pa.string()), ("action", pa.string()), ("error", pa.string()), ("mtime_ms", pa.int64()), ("bytes", pa.int64())])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in map(step, batch.to_pylist())], schema=schema)

    return rows.mapInArrow(run, _OUTCOME)


def published(spark: SparkSession, journal: str, operation: str, move: bool) -> DataFrame:
    """Puts what a committed journal staged in its place; says source, dest, action, error, mtime_ms, bytes. It may be done again."""

    def put(source: str, dest: str, staged: bool) -> None:
        part = _staged(dest, operation)
        if staged and _info(part):
            _rename(part, dest)
        elif not staged and _info(source):
            _rename(source, dest)
        if staged and move:
            _delete(source)

    def step(x: dict) -> dict:
        if x["action"] == "do" and x["error"] is None:
            try:
                staged = bool(x["parts"])
                put(x["source"], x["dest"], staged)
                if x["sidecar"]:
                    try:
                        put(_sidecar(x["source"]), _sidecar(x["dest"]), staged)
                    except _ERRORS:
                        pass
            except _ERRORS as e:
                x["error"] = f"{x['source']}: {e}"
        return x

    return _each(_journal(spark, journal, "_committed"), step)


def rolled_back(spark: SparkSession, plan: DataFrame, operation: str) -> int:
    """Deletes all that a run which did not commit may have staged; says for how many files."""

    def step(x: dict) -> dict:
        for dest in (x["dest"], _sidecar(x["dest"])):
            try:
                _delete(_staged(dest, operation))
            except _ERRORS as e:
                x["error"] = str(e)
        return x | {"mtime_ms": None, "bytes": None, "error": x.get("error")}

    return _each(plan.where("action = 'do'").select("source", "dest", "action"), step).count()


def carry_out(plan: DataFrame, journal: str, move: bool, operation: str | None = None) -> DataFrame:
    """Carries a plan out, in two steps; the outcomes, as published() says them, are a table below ``journal``.

    Nothing that exists is overwritten, a source that has gone is skipped, and a failure is a row. A run that cannot be
    committed raises, and leaves no file behind. One that stopped after its commit goes on when it is called again with the
    same journal and operation.
    """
    spark, operation = plan.sparkSession, operation or uuid.uuid4().hex[:12]
    spark.dataSource.register(FileOperations)
    if not _info(f"{journal}/_committed"):
        try:
            plan.select("source", "dest", "action").write.format(SOURCE).mode("append").options(journal=journal, operation=operation, move=str(move).lower()).save()
        except Exception:
            rolled_back(spark, plan, operation)
            raise
    outcomes = f"{journal}/outcomes"
    published(spark, journal, operation, move).write.mode("overwrite").parquet(outcomes)
    return spark.read.schema(_OUTCOME).parquet(outcomes)


def trash_plan(paths: DataFrame, trash: str, operation: str) -> DataFrame:
    """source, dest, action: each path (path) to a folder of its own in the trash, so that no names clash there."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    dest = F.concat(F.lit(f"{trash.rstrip('/')}/{operation}/"), F.substring(F.sha2("path", 256), 1, 32), F.lit("/"), name)
    return paths.where("path is not null").select(F.col("path").alias("source"), dest.alias("dest"), F.lit("do").alias("action")).distinct()


def trashed(paths: DataFrame, trash: str, journal: str, operation: str) -> DataFrame:
    """Moves photographs and their sidecars to a trash folder; nothing is deleted. Outcomes as of carry_out().

    Rows with action do and no error are tombstones: source is where a file was, dest where it is, with its time and
    size. A missing source is a skip. Sum them up with storage.transfer_result().
    """
    return carry_out(trash_plan(paths, trash, operation), journal, True, operation)


def restore_plan(tombstones: DataFrame) -> DataFrame:
    """The plan that brings trashed files back to where they were."""
    gone = tombstones.where("action = 'do' and error is null")
    return gone.select(F.col("dest").alias("source"), F.col("source").alias("dest"), F.lit("do").alias("action"))
