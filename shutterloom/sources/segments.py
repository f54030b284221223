"""A table in segments: each write adds its own rows, and a manifest says at once which segments count.

Rows lie in buckets of their key's range. A segment holds the rows of one write in one bucket; a row takes the place of
those of older segments with its key. A write adds segments of the buckets it touches, then publishes the next
manifest: a reader sees all of it or nothing, and a write that fails leaves the version before. A bucket with many
segments is merged into one by the write that makes them too many.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Key values in a bucket, and segments of a bucket from which they are merged.
SPAN, MERGE = 50_000, 8
_DIGITS = 12


@dataclass(frozen=True)
class Manifested:
    """What says which files below ``root``, in any store that Spark writes to, count. One writer at a time."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> dict:
        """number of the last write (-1: none), and the segments of each bucket, oldest first."""
        fs, folder = self._fs(f"{self.root}/manifests")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"number": -1, "schema": None, "buckets": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).collect()))

    def _publish(self, manifest: dict) -> None:
        name = f"{manifest['number']:0{_DIGITS}d}-{manifest.get('revision', 0)}.json"
        fs, part = self._fs(f"{self.root}/manifests/.{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(part, self._fs(f"{self.root}/manifests/{name}")[1]):
            raise OSError(f"{self.root}: another writer published {name}")


@dataclass(frozen=True)
class Segments(Manifested):
    """Rows with a whole-number key."""

    key: str = "ord"
    span: int = SPAN
    merge: int = MERGE

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that keys (key) lie in: a number for each at most."""
        return sorted(r.b for r in keys.where(F.col(self.key).isNotNull()).select(F.floor(F.col(self.key) / self.span).alias("b")).distinct().collect())

    def raw(self, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """All rows of the segments of some buckets, or of all, with _write, the number of the write they are of."""
        manifest = self.manifest() if manifest is None else manifest
        wanted = manifest["buckets"] if buckets is None else {str(b): manifest["buckets"].get(str(b), []) for b in buckets}
        paths = [f"{self.root}/{p}" for ps in wanted.values() for p in ps]
        if manifest["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows that stand, of some buckets or of all; None before the first write."""
        rows = self.raw(buckets)
        return None if rows is None else self._standing(rows).drop("_write")

    def _standing(self, rows: DataFrame) -> DataFrame:
        newest = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("_write")))
        return rows.withColumn("_n", newest).where("_n = 1").drop("_n")

    def write(self, rows: DataFrame, number: int, state: dict | None = None) -> None:
        """Adds rows, one for each key at most, as write ``number``; one that is not above the last is done already and left out.

        ``state`` goes with the manifest. Columns must be those of the first write.
        """
        manifest = self.manifest()
        if number <= manifest["number"]:
            return
        target = f"write={number}"
        laid = rows.withColumns({"_write": F.lit(number).cast("long"), "_bucket": F.floor(F.col(self.key) / self.span)})
        schema = laid.drop("_bucket").schema
        laid.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{target}")
        buckets = dict(manifest["buckets"])
        for b in self._written(target):
            buckets[b] = [*buckets.get(b, []), f"{target}/_bucket={b}"]
        crowded = [b for b, paths in buckets.items() if len(paths) > self.merge]
        made = {"number": number, "schema": schema.jsonValue(), "buckets": buckets, "state": state}
        if crowded:
            merged = self._standing(self.raw([int(b) for b in crowded], made)).withColumn("_bucket", F.floor(F.col(self.key) / self.span))
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/merge={number}")
            buckets |= {b: [f"merge={number}/_bucket={b}"] for b in crowded}
        self._publish(made)

    def _written(self, target: str) -> list[str]:
        fs, folder = self._fs(f"{self.root}/{target}")
        return sorted(f.getPath().getName().removeprefix("_bucket=") for f in fs.listStatus(folder) if f.getPath().getName().startswith("_bucket="))
