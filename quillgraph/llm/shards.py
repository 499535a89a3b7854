"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder with immutable runs (Parquet folders) and manifests. Each arrival is appended as a run of
small shards. Compaction takes ``fan_in`` runs of one size tier and rewrites them as one run of target-sized
files, without a shuffle; a run whose files have reached that size is settled and is never rewritten, so a row
is written about log(target / arrival) times. A version is one manifest file that names its runs. It appears
by a rename that fails if the name exists, so readers see whole versions and of two writers one retries.

Runs number a few for each tier plus the settled ones; the driver reads the manifest and no rows.

Defined results: columns and their names are free, null values and repeated rows are kept as they are, a null
arrival is an arrival of its own, an empty arrival adds a version but no run, reading an empty store needs a
schema and gives no rows. An arrival's new columns join the schema from that version on and are null in earlier rows;
columns that it lacks are null in its own; a column that comes with another type is refused before anything is written.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import file_system

ARRIVAL = "arrival_run"


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int
    rows: int
    merges: int = 0


@dataclass
class Manifest:
    version: int = 0
    schema: str | None = None
    runs: list[Run] = field(default_factory=list)


def widened(known: str | None, new: StructType) -> StructType:
    """The schema ``known`` (JSON, or None) and the columns of ``new`` that it lacks; names are compared as Spark does."""
    if known is None:
        return new
    schema = StructType.fromJson(json.loads(known))
    kinds = {f.name.lower(): f.dataType.simpleString() for f in schema}
    for f in new:
        if f.name.lower() not in kinds:
            schema = schema.add(f.name, f.dataType, True)
        elif kinds[f.name.lower()] != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {kinds[f.name.lower()]} in the store and {f.dataType.simpleString()} in the arrival")
    return schema


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20, codec: str = "zstd"):
        self.spark, self.root, self.target_bytes, self.fan_in, self.base_bytes, self.codec = spark, root.rstrip("/"), target_bytes, fan_in, base_bytes, codec

    # -- manifests

    def versions(self) -> list[int]:
        fs, where = file_system(self.spark, f"{self.root}/manifests")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(where) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None and not known:
            return Manifest()
        version = known[-1] if version is None else version
        lines = [json.loads(r[0]) for r in self.spark.read.text(f"{self.root}/manifests/v{version:010d}.json").collect()]
        return Manifest(lines[0]["version"], lines[0]["schema"], [Run(**x) for x in lines[1:]])

    def _commit(self, new: Manifest) -> Manifest:
        """Publish ``new`` or raise CommitConflict; a version is never replaced."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        body = "\n".join(json.dumps(x) for x in [{"version": new.version, "schema": new.schema}, *map(asdict, new.runs)]) + "\n"
        fs, draft = file_system(self.spark, f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/v{new.version:010d}.json")
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {new.version}") from e
            raise
        return new

    def _update(self, change, tries: int = 20) -> Manifest:
        """Commit ``change(current)``; try again on what another writer has committed meanwhile."""
        for _ in range(tries):
            try:
                return self._commit(change(self.manifest()))
            except CommitConflict:
                continue
        raise CommitConflict(f"{tries} tries")

    # -- runs

    def _measure(self, path: str, schema: StructType, merges: int = 0) -> Run | None:
        fs, where = file_system(self.spark, path)
        sizes = [s.getLen() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]
        rows = self.spark.read.schema(schema).parquet(path).count() if sizes else 0  # from the footers
        return Run(path, sum(sizes), len(sizes), rows, merges) if rows else None

    def append(self, df: DataFrame, arrival: Column | None = None) -> Manifest:
        """Append ``df`` as one run, or as a run for each value of ``arrival``, written in one pass."""
        widened(self.manifest().schema, df.schema)
        folder, own = f"{self.root}/runs/{uuid.uuid4().hex}", ARRIVAL
        while own in {c.lower() for c in df.columns}:
            own += "_"
        writer = (df if arrival is None else df.withColumn(own, arrival)).write.option("compression", self.codec)
        (writer if arrival is None else writer.partitionBy(own)).parquet(folder)
        paths = [folder]
        if arrival is not None:
            fs, where = file_system(self.spark, folder)
            paths = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory())
        runs = [r for p in paths if (r := self._measure(p, df.schema))]
        return self._update(lambda m: Manifest(m.version + 1, widened(m.schema, df.schema).json(), [*m.runs, *runs]))

    def tier(self, run: Run) -> int:
        """Runs of one tier differ in size by less than ``fan_in``; -1: settled."""
        if run.bytes >= run.files * self.target_bytes / 2:
            return -1
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.base_bytes, self.fan_in)) + 1) if run.bytes >= self.base_bytes else 0

    def plan(self, manifest: Manifest) -> list[list[Run]]:
        """Groups of runs to merge: ``fan_in`` of a tier, the smallest first."""
        tiers: dict[int, list[Run]] = {}
        for run in sorted(manifest.runs, key=lambda r: (r.bytes, r.path)):
            tiers.setdefault(self.tier(run), []).append(run)
        return [runs[i : i + self.fan_in] for t, runs in sorted(tiers.items()) if t >= 0 for i in range(0, len(runs) - self.fan_in + 1, self.fan_in)]

    def merge(self, group: list[Run]) -> Manifest:
        """Rewrite the group's rows as files of about the target size and swap the runs in one commit."""
        schema = StructType.fromJson(json.loads(self.manifest().schema))
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        files = max(1, math.ceil(sum(r.bytes for r in group) / self.target_bytes))
        self.spark.read.schema(schema).parquet(*[r.path for r in group]).coalesce(files).write.option("compression", self.codec).parquet(path)
        made = self._measure(path, schema, 1 + max(r.merges for r in group))
        gone = {r.path for r in group}

        def swap(m: Manifest) -> Manifest:
            if not gone <= {r.path for r in m.runs}:
                raise RuntimeError("another writer has merged these runs")
            return Manifest(m.version + 1, m.schema, [*[r for r in m.runs if r.path not in gone], made])

        try:
            if made is None or made.rows != sum(r.rows for r in group):
                raise RuntimeError(f"{path} does not hold the rows of the runs it merges")
            return self._update(swap)
        except RuntimeError:  # no version names what was written
            fs, where = file_system(self.spark, path)
            fs.delete(where, True)
            raise

    def compact(self) -> Manifest:
        """Merge until no tier holds ``fan_in`` runs."""
        while groups := self.plan(self.manifest()):
            for group in groups:
                self.merge(group)
        return self.manifest()

    def expire(self, keep: int = 1) -> None:
        """Drop all but the last ``keep`` versions and the runs that only those named."""
        known = self.versions()
        live = {r.path for v in known[-keep:] for r in self.manifest(v).runs}
        for v in known[:-keep]:
            for path in {r.path for r in self.manifest(v).runs} - live:
                fs, where = file_system(self.spark, path)
                fs.delete(where, True)
            fs, where = file_system(self.spark, f"{self.root}/manifests/v{v:010d}.json")
            fs.delete(where, False)

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m.schema)) if m.schema else schema
        if schema is None:
            raise ValueError("the store is empty: give a schema")
        if not m.runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[r.path for r in m.runs])
