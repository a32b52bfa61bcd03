"""A stored table that can be changed: rows in buckets of their key, versions by manifest.

A version is a manifest, one JSON file that names the folder of each bucket.  A change writes new folders
for the buckets it touches and then, as its only visible step, the next manifest, by a rename that fails if the name is taken.
A write that is killed before leaves the old version as it was, and readers of a version keep
its files until :meth:`Table.expire`.  Two writers at one moment are kept apart where a rename onto
an existing file fails, as in HDFS; a plain local folder only checks before it renames.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another change was first; read again and repeat."""


class Table:
    """A keyed table below ``path``; ``buckets`` and ``schema`` are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests
    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.text(self._name(version), wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> int:
        """The manifest under its number, whole or not at all."""
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(self._name(manifest["version"]))
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is there already")
        return manifest["version"]

    # ------------------------------------------------------------ rows
    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def create(self, schema: T.StructType, buckets: int = 64) -> int:
        """An empty first version."""
        return self._publish({"version": 0, "schema": schema.jsonValue(), "buckets": buckets, "folders": {}})

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(version))

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _replace(self, manifest: dict, touched: set[int], rows: DataFrame) -> int:
        """The next version, in which the touched buckets hold ``rows``."""
        folder = f"data/{uuid.uuid4().hex}"
        bucket = self._bucket(manifest["buckets"])
        rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
        new = {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}
        kept = {b: f for b, f in manifest["folders"].items() if int(b) not in touched}
        return self._publish({**manifest, "version": manifest["version"] + 1, "folders": kept | new})

    def _touched(self, manifest: dict, rows: DataFrame) -> set[int]:
        """The buckets of some rows: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect()}

    def upsert(self, changes: DataFrame, order: str | None = None) -> int:
        """The version after ``changes`` (the columns of the table, and ``order``): of several rows of a key the last in ``order`` wins.

        Rows that are there already change nothing; without any other row the version stays as it is.  Keys must not be null.
        """
        manifest = self._manifest()
        names = [f["name"] for f in manifest["schema"]["fields"]]
        last = Window.partitionBy(*self.keys).orderBy(*([F.desc(order)] if order else []), *[F.desc(F.to_json(F.struct(*names)))])
        rows = changes.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*names)
        whole = lambda d: d.select(*self.keys, F.to_json(F.struct(*names)).alias("__whole"))
        old = self._rows(manifest, self._touched(manifest, rows))
        new = rows.withColumn("__whole", F.to_json(F.struct(*names))).join(whole(old), [*self.keys, "__whole"], "left_anti").drop("__whole").select(*names)
        touched = self._touched(manifest, new)
        if not touched:
            return manifest["version"]
        return self._replace(manifest, touched, self._rows(manifest, touched).join(new, self.keys, "left_anti").select(*names).unionByName(new))

    def insert(self, rows: DataFrame, order: str) -> int:
        """The version with the rows whose keys are not there yet, the first by ``order`` of several; without any the version stays as it is."""
        manifest = self._manifest()
        names = [f["name"] for f in manifest["schema"]["fields"]]
        first = Window.partitionBy(*self.keys).orderBy(order, F.to_json(F.struct(*names)))
        rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*names)
        new = rows.join(self._rows(manifest, self._touched(manifest, rows)).select(*self.keys), self.keys, "left_anti").select(*names)
        touched = self._touched(manifest, new)
        return self._replace(manifest, touched, self._rows(manifest, touched).unionByName(new)) if touched else manifest["version"]

    def delete(self, keys: DataFrame) -> int:
        """The version without the rows of these keys; if none is there the version stays as it is."""
        manifest = self._manifest()
        names = [f["name"] for f in manifest["schema"]["fields"]]
        gone = self._rows(manifest, self._touched(manifest, keys)).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        touched = self._touched(manifest, gone)
        if not touched:
            return manifest["version"]
        return self._replace(manifest, touched, self._rows(manifest, touched).join(keys.select(*self.keys).distinct(), self.keys, "left_anti").select(*names))

    def expire(self, keep: int = 1) -> None:
        """Deletes the versions before the last ``keep``, and all files that no version names: a write that is under way loses its own."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._name(v)), False)
        used = {f for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        data = self._path(f"{self.path}/data")
        for run in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f"data/{run.getPath().getName()}"
            if not any(f.startswith(name + "/") for f in used):
                self._fs.delete(run.getPath(), True)
                continue
            for bucket in self._fs.listStatus(run.getPath()):
                one = f"{name}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and one not in used:
                    self._fs.delete(bucket.getPath(), True)
        self._fs.delete(self._path(f"{self.path}/drafts"), True)
