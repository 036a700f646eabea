"""Versions of a table: each is written whole beside the others and becomes the table's by one manifest, put in place in one step.

A writer names the version that it started from.  The manifest of the next version can be created only once, so of
two writers from one version one wins and the other is told; a writer that stops before its manifest leaves the table as
it was.  Vectors are applied by signature: only to rows whose text is still the one that they were made of.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Characters of a text that its vector and its signature are made of.
SIGNED = 28_000


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


class Versions:
    """The versions of one table under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(self.path).getFileSystem(conf)
        self._files = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def all(self) -> list[int]:
        """Numbers of the versions, from 1, rising."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def current(self) -> int:
        """The newest version; 0 where there is none."""
        return max(self.all(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        return json.loads("\n".join(r.value for r in self.spark.read.text(self._manifest(version)).collect()))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self.spark.read.schema(m["schema"]).parquet(f"{self.path}/data/{m['data']}")

    def commit(self, rows: DataFrame, expected: int, note: str = "") -> int:
        """Make `rows` the version after `expected`; raises Conflict where that is not the newest one any more."""
        if self.current() != expected:
            raise Conflict(f"version {expected} is not the newest")
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{data}")
        self._publish(expected + 1, {"version": expected + 1, "data": data, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "note": note})
        return expected + 1

    def _publish(self, version: int, manifest: dict) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/versions"))
        draft = self._path(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            self._files.rename(draft, self._path(self._manifest(version)), self._no)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Conflict(f"version {version} was made by another writer") from None

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest `keep` versions, and data that no version names; not while others write."""
        versions = self.all()
        for v in versions[:-keep] if keep else versions:
            self._fs.delete(self._path(self._manifest(v)), False)
        named = {self.manifest(v)["data"] for v in self.all()}
        folder = self._path(f"{self.path}/data")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)


def signature(text: str = "content"):
    return F.md5(F.substring(text, 1, SIGNED))


def with_vectors(memory: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, content, embedding, …) and (id, embedding, signature) → the rows with the new vectors, where the text has still that signature; others keep what they have."""
    new = vectors.select("id", F.col("embedding").alias("__v"), F.col("signature").alias("__s"))
    fresh = F.col("__s").eqNullSafe(signature()) & F.col("__v").isNotNull()
    return memory.join(new, "id", "left").withColumn("embedding", F.when(fresh, F.col("__v")).otherwise(F.col("embedding"))).select(memory.columns)
