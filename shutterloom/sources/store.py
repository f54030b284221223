"""The feature store: a Parquet table keyed by path, valid for one modification time, size and version."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.storage import evicted
from .segments import MERGE, Manifested

KEYS = ("path", "mtime_ms", "bytes")
VERSION = 1


def hits(files: DataFrame, store: DataFrame, version: int = VERSION) -> DataFrame:
    """Stored rows of files that have not changed."""
    return store.where(F.col("version") == version).join(files.select(*KEYS), list(KEYS), "left_semi")


def misses(files: DataFrame, store: DataFrame, version: int = VERSION) -> DataFrame:
    """Files to be worked on: only keys of the store are read."""
    return files.join(store.where(F.col("version") == version).select(*KEYS), list(KEYS), "left_anti")


def refreshed(files: DataFrame, store: DataFrame, featurise, version: int = VERSION) -> DataFrame:
    """hits and, for the misses, what ``featurise`` makes of them, as rows of the store."""
    fresh = featurise(misses(files, store, version)).withColumn("version", F.lit(version))
    return hits(files, store, version).unionByName(fresh)


def put(rows: DataFrame, path: str, max_bytes: int | None = None) -> None:
    """Appends rows; those with a larger payload than the cap are refused. Spark's commit makes it atomic."""
    (rows if max_bytes is None else rows.where(F.coalesce(F.length("payload"), F.lit(0)) <= max_bytes)).write.mode("append").parquet(path)


def put_within(rows: DataFrame, store: DataFrame, cap: int, max_bytes: int | None = None) -> DataFrame:
    """The store (KEYS, used, bytes ...) after rows are put: those over the cap of one are refused, and where all are over
    ``cap`` together the least recently used go, to 90 %. Write it as the store's next version; nothing is replaced in place."""
    every = store.unionByName(rows if max_bytes is None else rows.where(F.coalesce(F.length("payload"), F.lit(0)) <= max_bytes))
    gone = evicted(every.select("path", "used", "bytes"), cap).select("path", "used")
    return every.join(gone, ["path", "used"], "left_anti")


def compacted(store: DataFrame, files: DataFrame, version: int = VERSION) -> DataFrame:
    """The newest row of each current key."""
    newest = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("used"), F.desc(F.xxhash64(*store.columns))))
    return hits(files, store, version).withColumn("_n", newest).where("_n = 1").drop("_n")


def total_bytes(store: DataFrame) -> DataFrame:
    return store.groupBy("tier").agg(F.sum("bytes").alias("bytes"))


@dataclass(frozen=True)
class BucketStore(Manifested):
    """A store that no put rewrites: segments bucketed by path, of which the newest row of a path counts.

    All segments have the same buckets, so they meet each other, and files are looked up in them, without a shuffle of
    the store: only the files are dealt out by path. A put or a removal, whose rows are tombstones, adds one segment and
    publishes it at once; one that fails leaves the version before. Columns are those of the first put, among them
    path, mtime_ms, bytes and version, and used and payload where sizes are capped.
    """

    buckets: int = 64
    merge: int = MERGE

    def _name(self, segment: str) -> str:
        return f"store_{hashlib.md5(self.root.encode()).hexdigest()}_{segment.replace('-', '_')}"

    def _table(self, segment: str, schema: T.StructType) -> DataFrame:
        """A segment as a table that knows its buckets, in a session that has not written it too."""
        name = self._name(segment)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {self.buckets} BUCKETS LOCATION '{self.root}/segment={segment}'")
        return self.spark.table(name)

    def _alive(self) -> list[DataFrame]:
        """The rows of each segment that no newer one replaces, tombstones included."""
        manifest = self.manifest()
        if manifest["schema"] is None:
            return []
        schema, alive = T.StructType.fromJson(manifest["schema"]), []
        numbers = manifest["buckets"]["segments"]
        for i, number in enumerate(numbers):
            rows = self._table(number, schema)
            for newer in numbers[i + 1 :]:
                rows = rows.join(self._table(newer, schema).select("path"), "path", "left_anti")
            alive.append(rows)
        return alive

    def standing(self) -> DataFrame | None:
        """The rows that count; None before the first put."""
        made = None
        for rows in self._alive():
            rows = rows.where("not _gone").drop("_gone")
            made = rows if made is None else made.unionByName(rows)
        return made

    def _same(self, rows: DataFrame, files: DataFrame, version: int) -> Column:
        # path is the one key of the join, as of the buckets; the differences are looked at beside it
        other = (rows["mtime_ms"] - files["_mtime_ms"] == 0) & (rows["bytes"] - files["_bytes"] == 0)
        return (rows["path"] == files["_path"]) & other & (rows["version"] == version) & ~rows["_gone"]

    def hits(self, files: DataFrame, version: int = VERSION) -> DataFrame | None:
        """Stored rows of files (KEYS) that have not changed."""
        made = None
        for rows in self._alive():
            keys = files.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
            found = rows.join(keys, self._same(rows, keys, version), "left_semi").drop("_gone")
            made = found if made is None else made.unionByName(found)
        return made

    def misses(self, files: DataFrame, version: int = VERSION) -> DataFrame:
        """Files to be worked on: only keys of the store are read."""
        keys = files.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
        for rows in self._alive():
            rows = rows.select(*KEYS, "version", "_gone")
            keys = keys.join(rows, self._same(rows, keys, version), "left_anti")
        return keys.select(*[F.col(f"_{k}").alias(k) for k in KEYS])

    def _add(self, rows: DataFrame, number: int) -> None:
        manifest = self.manifest()
        if number <= manifest["number"]:
            return
        numbers = (manifest["buckets"] or {"segments": []})["segments"]
        schema = self._write(rows, str(number))
        self._publish({"number": number, "schema": schema.jsonValue(), "buckets": {"segments": [*numbers, str(number)]}})

    def _write(self, rows: DataFrame, segment: str) -> T.StructType:
        name = self._name(segment)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        laid = rows.repartition(self.buckets, "path").write.mode("overwrite").bucketBy(self.buckets, "path").sortBy("path")
        laid.option("path", f"{self.root}/segment={segment}").saveAsTable(name)
        return self.spark.table(name).schema

    def put(self, rows: DataFrame, number: int, max_bytes: int | None = None) -> None:
        """Adds rows as write ``number``; one that is not above the last is done already and left out.

        Of several rows of a path the one with the largest mtime_ms, then used or bytes, is put; payloads over
        ``max_bytes`` are refused. Every ``merge`` segments what stands is merged into one.
        """
        if max_bytes is not None:
            rows = rows.where(F.coalesce(F.length("payload"), F.lit(0)) <= max_bytes)
        order = [F.desc(c) for c in ("mtime_ms", "used", "bytes") if c in rows.columns]
        newest = F.row_number().over(Window.partitionBy("path").orderBy(*order, F.desc(F.xxhash64(*rows.columns))))
        self._add(rows.where("path is not null").withColumn("_n", newest).where("_n = 1").drop("_n").withColumn("_gone", F.lit(False)), number)
        segments = self.manifest()["buckets"]["segments"]
        if len(segments) > self.merge:
            self._merge(number)

    def _merge(self, number: int) -> None:
        """What stands as one segment."""
        merged = f"{number}-merged"
        self._write(self.standing().withColumn("_gone", F.lit(False)), merged)
        self._publish(self.manifest() | {"buckets": {"segments": [merged]}, "revision": 1})

    def acquired(self, files: DataFrame, featurise: Callable[[DataFrame], DataFrame], number: int, version: int = VERSION) -> DataFrame:
        """The rows of files (KEYS): what is stored as it is, and what ``featurise`` makes of the rest, which is put as write ``number``."""
        fresh = featurise(self.misses(files, version)).withColumn("version", F.lit(version))
        self.put(fresh, number)
        return self.hits(files, version)

    def remove(self, paths: DataFrame, number: int) -> None:
        """Tombstones for paths (path), as write ``number``."""
        schema = T.StructType.fromJson(self.manifest()["schema"])
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in ("path", "_gone")]
        self._add(paths.where("path is not null").select("path").distinct().select("path", *none, F.lit(True).alias("_gone")).select(*schema.names), number)

    def kept_within(self, cap: int, number: int) -> None:
        """Removes the least recently used rows, as write ``number``, where all are over ``cap``: down to 90 %. Only path, used and bytes are read."""
        gone = evicted(self.standing().select("path", "used", "bytes"), cap).select("path")
        self.remove(gone, number)
