"""Immutable shards under a versioned manifest, with size-tiered compaction."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

#: Size of a full shard, and how many runs of a tier are merged at least; a tier's shards are FAN_IN times the one below.
TARGET_BYTES, FAN_IN = 64 << 20, 4
#: Arrivals in which op3 appends its table.
ARRIVALS = 4


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int


class ShardStore:
    """A table of Parquet shards. A manifest lists the shards of a version; it is written aside and renamed to the next
    version's name, which fails if another writer took that name first, so readers see a whole version or the one
    before. Shards never change; compaction writes new ones, and the versions before stay readable until vacuum()
    takes their files. The driver handles names and sizes of files only. The file system must refuse to rename a file
    onto one that is there, as HDFS and local ones do; on a plain object store a single writer is needed."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def tier(self, size: int) -> int:
        """0 for a full shard, 1 for those down to target / fan_in, and so on."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), self.fan_in)))

    def version(self) -> int:
        found = self._fs.listStatus(self._path(f"{self.root}/manifest"))
        return max([int(s.getPath().getName()[1:-5]) for s in found if s.getPath().getName().startswith("v")], default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:09d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)]

    def _commit(self, version: int, shards: list[Shard]) -> None:
        aside = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps([asdict(s) for s in shards]).encode()))
        out.close()
        name = self._path(f"{self.root}/manifest/v{version:09d}.json")
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {version} was committed by another writer")

    def _write(self, df: DataFrame) -> list[Shard]:
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(run)
        found = [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._path(run))]
        return [Shard(p, n, self.tier(n)) for p, n in found if p.endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """An arrival becomes small shards, as many as its tasks, in a new version."""
        version, before = self.version(), self.shards()
        self._commit(version + 1, before + self._write(df))
        return version + 1

    def compact(self) -> int:
        """While a tier below the full one has fan_in shards, or all tiers together have that many at the end, merge
        them, in one job a tier and without a shuffle, to shards of the target size; each merge commits a version."""
        while True:
            version, shards = self.version(), self.shards()
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                if s.tier:
                    tiers.setdefault(s.tier, []).append(s)
            ripe = [t for t, own in sorted(tiers.items(), reverse=True) if len(own) >= self.fan_in and len(own) > self._files(own)]
            if not ripe:
                return version
            old = tiers[ripe[0]]
            new = self._write(self.spark.read.parquet(*[s.path for s in old]).coalesce(self._files(old)))
            gone = {s.path for s in old}
            self._commit(version + 1, [s for s in shards if s.path not in gone] + new)

    def vacuum(self, keep: int = 1) -> int:
        """Takes the files that only versions before the last `keep` hold, and their manifests; how many files went.
        Readers of those versions must have ended."""
        last = self.version()
        first = max(1, last - max(1, keep) + 1)
        held = {s.path for v in range(first, last + 1) for s in self.shards(v)}
        names = [v for v in range(1, first) if self._fs.exists(self._path(f"{self.root}/manifest/v{v:09d}.json"))]
        gone = {s.path for v in names for s in self.shards(v)} - held
        for v in names:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:09d}.json"), False)
        return sum(self._fs.delete(self._path(p), False) for p in sorted(gone))

    def _files(self, shards: list[Shard]) -> int:
        return max(1, math.ceil(sum(s.bytes for s in shards) / self.target))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[s.path for s in self.shards(version)])


def compacted(df: DataFrame, id_col: str = "doc_id", arrivals: int = ARRIVALS, root: str | None = None, target: int = TARGET_BYTES) -> ShardStore:
    """A store to which df was appended in arrivals, by hash of id, and then compacted.

    Every row, repeated ones and those with null ids too, is in one shard; columns stay as they are. An empty table
    gives a store of empty shards.
    """
    spark = df.sparkSession
    store = ShardStore(spark, root or f"{shared_dir(spark)}/shards/{uuid.uuid4().hex}", target)
    for k in range(arrivals):
        store.append(df.filter(F.pmod(F.xxhash64(id_col), F.lit(arrivals)) == k))
    store.compact()
    return store


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, read back from the compacted shards of the last version."""
    rows = compacted(table(spark, sf_dir, "documents")).read()
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_sharding_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last manifest: a row for each shard."""
    store = compacted(table(spark, sf_dir, "documents"))
    return spark.createDataFrame([(store.version(), s.path, s.bytes, s.tier) for s in store.shards()], "version long, path string, bytes long, tier int")


OP3_SQL = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents"
