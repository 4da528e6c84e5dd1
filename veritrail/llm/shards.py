"""Sharding by size-tiered compaction, in DataFrame operations alone.

A store is a folder of immutable shards (Parquet files) and versioned manifests. An
append writes the arrivals as small shards and commits a manifest that lists them too. A
shard's tier is the power of FANOUT of its size; once a tier below the target has
FANOUT shards, they are merged into files of about the target's size (without a
shuffle: whole shards are read together) and a new manifest lists the result in their
place. A manifest is written under a name of its own; a small file that names it is then
renamed, without overwriting, to its version's number. The rename fails if another
writer has taken that number: then nothing has changed, and the commit is made again on
the newer version, with the shards that are already written (a merge whose shards
somebody else has merged meanwhile is given up, and its files go). Readers of an older
version keep their files until expire() removes what no kept version lists; it also
removes what a lost writer has left, once that is older than ORPHAN_HOURS.

Paths of shards come to the driver where shards are read or merged, as they do in any
list of files that Spark makes of a table: a path for each TARGET_BYTES of data.

Defined results: null and empty texts and repeated rows are kept as they are; an empty
arrival commits a version without new shards; all columns are kept, whatever their
names, but arrivals of one store share a schema; a store without a manifest is version 0
and has no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Shards that one merge takes at most; more are merged in further rounds.
MERGE_FILES = 10_000
#: How often a commit is tried again when other writers are faster, and the age from which on unlisted files are a lost writer's.
RETRIES, ORPHAN_HOURS = 20, 48.0
_MANIFEST = "path string, tier int, bytes long, rows long"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class Store:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self.jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, tier, bytes and rows of the shards of a version, the newest unless said otherwise."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(self._named(version))

    def _named(self, version: int) -> str:
        """The folder of a version's manifest."""
        return f"{self.path}/manifests/" + self.spark.read.text(f"{self.path}/manifests/v{version:09d}").first()[0]

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Make manifest version base + 1, or raise if that version exists by now."""
        name = f"m{uuid.uuid4().hex}"
        folder, fs = self._fs(f"{self.path}/manifests/{name}")
        manifest.select("path", "tier", "bytes", "rows").coalesce(1).write.parquet(folder.toString())
        pointer, final = (self._fs(f"{self.path}/manifests/{x}")[0] for x in (f"p{name}", f"v{base + 1:09d}"))
        out = fs.create(pointer, False)
        out.write(name.encode())
        out.close()
        fs_package = self.jvm.org.apache.hadoop.fs
        context = fs_package.FileContext.getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(pointer, final, self.spark.sparkContext._gateway.new_array(getattr(fs_package, "Options$Rename"), 0))
        except Exception as error:
            fs.delete(pointer, False)
            fs.delete(folder, True)
            raise Conflict(f"version {base + 1} was committed by another writer, or the rename failed") from error
        return base + 1

    def _listed(self, folder: str, schema: StructType) -> DataFrame:
        """Manifest rows of the files of a run: counted where they lie, one row a file."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        tier = F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.greatest(F.col("bytes"), F.lit(1)) / self.floor())))
        return rows.groupBy("path", "bytes").agg(F.count("*").alias("rows")).select("path", tier.cast("int").alias("tier"), "bytes", "rows")

    def _committed(self, folder: str, schema: StructType, gone: DataFrame | None = None) -> int | None:
        """Commit the files of folder in place of those of gone (path); None if some of these are listed no more."""
        new, many = self._listed(folder, schema), gone.count() if gone else 0
        try:
            for _ in range(RETRIES):
                base = self.version()
                listed = self.manifest(base)
                if gone and listed.join(gone, "path", "left_semi").count() < many:
                    break
                rest = listed.join(gone, "path", "left_anti") if gone else listed
                try:
                    return self.commit(rest.unionByName(new), base)
                except Conflict:
                    continue
            else:
                raise Conflict(f"other writers were faster {RETRIES} times")
        except BaseException:
            self._delete(folder)
            raise
        self._delete(folder)
        return None

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def floor(self) -> float:
        """Bytes of tier 0's upper end: FANOUT ** 3 of them make a target."""
        return self.target / self.fanout**3

    def append(self, arrivals: DataFrame, splits: int | None = None) -> int:
        """Write arrivals as small shards and commit; splits deals each task's rows into so many shards."""
        folder, schema = f"{self.path}/data/{uuid.uuid4().hex}", arrivals.schema
        if splits:
            name, taken = "_arrival", {c.lower() for c in arrivals.columns}
            while name in taken:
                name += "_"
            arrivals.withColumn(name, F.pmod(F.xxhash64(F.col(f"`{arrivals.columns[0]}`")), F.lit(splits))).write.partitionBy(name).parquet(folder)
        else:
            arrivals.write.parquet(folder)
        return self._committed(folder, schema)

    def compact(self) -> int:
        """Merge every tier that has FANOUT shards or more, until none has; returns the version."""
        while True:
            base = self.version()
            tiers = self.manifest(base).where(F.col("bytes") < self.target * 3 // 4).groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout)
            full = tiers.orderBy("tier").first()
            if full is None:
                return base
            # Similar sizes: the full tier and what is smaller, which else would wait for company.
            mine = (F.col("tier") <= full["tier"]) & (F.col("bytes") < self.target * 3 // 4)
            merged = self.manifest(base).where(mine)
            # The paths of one merge, without rows: a number of files, bounded by MERGE_FILES a round.
            paths = [r["path"] for r in merged.orderBy("path").limit(MERGE_FILES).select("path").collect()]
            chosen = self.spark.createDataFrame([(p,) for p in paths], "path string")
            size = merged.join(chosen, "path", "left_semi").agg(F.sum("bytes")).first()[0]
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)
            rows.coalesce(max(1, round(size / self.target))).write.parquet(folder)
            self._committed(folder, rows.schema, chosen)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if it has none."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*paths) if paths else None

    def expire(self, keep: int = 1, orphan_hours: float = ORPHAN_HOURS) -> None:
        """Drop all but the newest versions, the shards that only they list, and runs of lost writers: listed nowhere and older than orphan_hours."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        listed = lambda vs: self.spark.read.schema(_MANIFEST).parquet(*map(self._named, vs)).select("path").distinct()
        if old:
            for row in listed(old).join(listed(kept), "path", "left_anti").toLocalIterator():
                path, fs = self._fs(row["path"])
                fs.delete(path, False)
        for v in old:
            for name in (self._named(v), f"{self.path}/manifests/v{v:09d}"):
                self._delete(name)
        folder, fs = self._fs(f"{self.path}/data")
        if not fs.exists(folder):
            return
        before = self.jvm.System.currentTimeMillis() - orphan_hours * 3_600_000
        # Folders of runs, one for each commit; a run's files lie in it or in folders of splits.
        runs = [s.getPath().getName() for s in fs.listStatus(folder) if s.getModificationTime() < before]
        live = {r["run"] for r in listed(self.versions()).selectExpr("regexp_extract(path, '/data/([0-9a-f]{32})/', 1) AS run").distinct().collect()} if runs and versions else set()
        for run in runs:
            if run not in live:
                self._delete(f"{self.path}/data/{run}")
