"""A set of immutable Parquet shards with size-tiered compaction and a versioned manifest.

``append`` writes an arrival as small shards.  ``compact`` merges runs of shards of similar
size (a tier: the power of ``fanout`` below the shard's bytes) into files of about
``target`` bytes, until no tier under the target has ``fanout`` shards.  Either ends in a
commit: the manifest of the next version is written aside and renamed to its name, which
fails if another writer has taken that version.  Readers open one version; files that no
retained version lists go in ``vacuum``.  A merge moves no row between tasks: each task
reads whole shards and writes one file.

Defined cases: nulls, empty texts and repeated rows are kept as they come; an arrival
without rows commits no shard; columns are those of the first arrival, in its order, and an
arrival that lacks one or has another is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    file: str  # below the root
    rows: int
    bytes: int


class ShardSet:
    def __init__(self, spark: SparkSession, root: str, target: int = 64 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("manifest"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def version(self) -> int:
        """The latest committed version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("manifest"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        at = self.fs.open(self._path(f"manifest/v{version:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
        finally:
            at.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(*s) for s in self.manifest(version)["shards"]]

    def _commit(self, base: dict, schema: str, shards: list[Shard]) -> int:
        new = {"version": base["version"] + 1, "schema": schema, "shards": [[s.file, s.rows, s.bytes] for s in shards]}
        aside = self._path(f"manifest/tmp-{uuid.uuid4().hex}")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.isAbsolute() and aside.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, self._path(f"manifest/v{new['version']:012d}.json"), none)
        except Exception as e:
            self.fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {new['version']} is taken") from e
            raise
        return new["version"]

    def _write(self, df: DataFrame) -> list[Shard]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        size = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(name)) if s.getPath().getName().endswith(".parquet")}
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").groupBy(F.col("_metadata.file_name").alias("file")).count().collect()  # one row a file
        return [Shard(f"{name}/{r['file']}", r["count"], size[r["file"]]) for r in sorted(rows, key=lambda r: r["file"])]

    def append(self, df: DataFrame) -> int:
        """Writes the arrival once; a version that another writer takes meanwhile is built upon."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).json()
        written: list[Shard] | None = None
        while True:
            base = self.manifest()
            if base["schema"] and sorted(json.loads(base["schema"])["fields"], key=str) != sorted(json.loads(schema)["fields"], key=str):
                raise ValueError("the arrival's columns differ from the shards'")
            if written is None:
                written = self._write(df.select([f["name"] for f in json.loads(base["schema"] or schema)["fields"]]))
            try:
                return self._commit(base, base["schema"] or schema, [Shard(*s) for s in base["shards"]] + written)
            except CommitConflict:
                continue

    def run_to_merge(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the lowest tier that has enough of them."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target:
                tier = 0
                while self.fanout ** (tier + 1) <= s.bytes:
                    tier += 1
                tiers.setdefault(tier, []).append(s)
        return next((t for _, t in sorted(tiers.items()) if len(t) >= self.fanout), [])

    def compact(self) -> int:
        """Merges until no tier is full; returns the latest version."""
        while run := self.run_to_merge((base := self.manifest()) and [Shard(*s) for s in base["shards"]]):
            files = max(1, round(sum(s.bytes for s in run) / self.target))
            merged = self._write(self._read(base["schema"], run).coalesce(files))
            gone = {s.file for s in run}
            try:
                self._commit(base, base["schema"], [Shard(*s) for s in base["shards"] if s[0] not in gone] + merged)
            except CommitConflict:  # the files that no version lists go, and the run is taken from the new version
                self.fs.delete(self._path(merged[0].file.rsplit("/", 1)[0]), True)
                continue
            if len(merged) >= len(run):
                break
        return self.version()

    def _read(self, schema: str, shards: list[Shard]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{s.file}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        base = self.manifest(version)
        if not base["schema"]:
            raise ValueError("nothing is committed yet")
        return self._read(base["schema"], [Shard(*s) for s in base["shards"]])

    def vacuum(self, retain: int = 1) -> int:
        """Deletes files that the last ``retain`` versions don't list, and older manifests."""
        last = self.version()
        keep = {s.file for v in range(max(1, last - retain + 1), last + 1) for s in self.shards(v)}
        gone = 0
        if not self.fs.exists(self._path("data")):
            return 0
        for folder in self.fs.listStatus(self._path("data")):
            name = f"data/{folder.getPath().getName()}"
            files = [f"{name}/{s.getPath().getName()}" for s in self.fs.listStatus(folder.getPath()) if s.getPath().getName().endswith(".parquet")]
            old = [f for f in files if f not in keep]
            gone += len(old)
            if len(old) == len(files):
                self.fs.delete(folder.getPath(), True)
            else:
                for f in old:
                    self.fs.delete(self._path(f), False)
        for v in range(1, last - retain + 1):
            self.fs.delete(self._path(f"manifest/v{v:012d}.json"), False)
        return gone
