"""Operator 1, sharding: size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut, shared_path, table, text_of
from .warc import file_system

#: Bytes of a finished shard (three quarters of it are enough); a tier's sizes lie within the factor; a run that does not make
#: a finished shard has so many shards at least.
TARGET_BYTES, TIER_FACTOR, RUN = 128 << 20, 4, 4
#: Rows of an arriving shard at most, rows that a merge reads at a time, and bytes of a merged shard's row group, about.
SHARD_ROWS, READ_ROWS, GROUP_BYTES = 65536, 1024, 64 << 20
#: Shards that one part of the manifest lists at most.
PART_SHARDS = 4096
#: Seconds after which files that no manifest lists count as left behind by a failed attempt.
GRACE = 86400
#: Arrivals in which the query brings its table in.
ARRIVALS = 8


class Shard(NamedTuple):
    path: str  # below the root
    bytes: int
    rows: int
    digest: int = 0  # the sum of its rows' hashes


class Part(NamedTuple):
    """A file that lists shards; ``open``: those that are not finished."""

    name: str
    shards: int
    open: int


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def tier(size: int, factor: int = TIER_FACTOR) -> int:
    return int(math.log(max(size, 1), factor))


def finished(s: Shard, target: int = TARGET_BYTES) -> bool:
    return s.bytes * 4 >= target * 3


def plan(shards: Iterable[Shard], target: int = TARGET_BYTES, factor: int = TIER_FACTOR, run: int = RUN) -> list[list[Shard]]:
    """Runs to merge, each of shards of one tier, the smallest first.

    A run is closed when it makes a finished shard, so none exceeds the target by half. What is left of a tier is merged if
    there are ``run`` shards of it or more, which brings the result to a higher tier: a byte is written once per tier at
    most, and at most ``run`` - 1 shards of each tier wait for others. One sort of the unfinished shards.
    """
    tiers: dict[int, list[Shard]] = defaultdict(list)
    for s in shards:
        if not finished(s, target):
            tiers[tier(s.bytes, factor)].append(s)
    runs = []
    for k in sorted(tiers):
        now, size = [], 0
        for s in sorted(tiers[k], key=lambda s: (s.bytes, s.path)):
            now.append(s)
            size += s.bytes
            if size * 4 >= target * 3:
                runs.append(now)
                now, size = [], 0
        if len(now) >= max(2, run):
            runs.append(now)
    return runs


def _tail(path: str) -> str:
    """Folder and name: tasks give the files of all batches one name."""
    return "/".join(path.rsplit("/", 2)[-2:])


def _hash(field: StructField) -> Column:
    """A column that xxhash64 takes: maps and variants as JSON."""
    odd = any(f'"{k}"' in json.dumps(field.jsonValue()) for k in ("map", "variant"))
    return F.to_json(F.struct(F.col(f"`{field.name}`"))) if odd else F.col(f"`{field.name}`")


def row_digest(kind: StructType) -> Column:
    """The sum of the rows' hashes, whatever their order."""
    return F.coalesce(F.sum(F.xxhash64(*map(_hash, kind.fields)).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))


@contextmanager
def _exact_times(spark: SparkSession):
    """Timestamps of any year are written as microseconds, as they are."""
    wanted = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS", "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class ShardStore:
    """A folder of immutable shards and manifests. Readers see the newest manifest, or any version they name.

    A version is a short file that names its parts; parts list shards and are immutable too. An arrival adds a part, and a
    compaction rewrites only parts that hold unfinished shards or are less than half full, so what a commit writes does not
    grow with the store.
    """

    def __init__(self, spark: SparkSession, root: str, part_shards: int = PART_SHARDS):
        self.spark, self.root, self.part_shards = spark, root.rstrip("/"), part_shards
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._path, self._fs = spark._jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("manifests", "parts", "arrivals", "merged"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _load(self, name: str):
        f = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)))
        finally:
            f.close()

    def _save(self, name: str, data) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()

    def manifest(self, version: int | None = None) -> tuple[int, list[Part], str | None]:
        """(version, parts, schema); version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, [], None
        data = self._load(f"manifests/v{version:010d}.json")
        return version, [Part(*p) for p in data["parts"]], data["schema"]

    def shards(self, parts: Iterable[Part]) -> list[Shard]:
        return [Shard(*s) for p in parts for s in self._load(f"parts/{p.name}")]

    def write_parts(self, shards: list[Shard], target: int = TARGET_BYTES) -> list[Part]:
        """Finished shards and others in parts of their own."""
        out = []
        for done in (True, False):
            some = sorted(s for s in shards if finished(s, target) == done)
            for k in range(0, len(some), self.part_shards):
                chunk = some[k : k + self.part_shards]
                out.append(Part(f"{uuid.uuid4().hex}.json", len(chunk), 0 if done else len(chunk)))
                self._save(f"parts/{out[-1].name}", chunk)
        return out

    def commit(self, base: int, parts: list[Part], schema: str | None) -> int:
        """Writes version base + 1 under a private name and renames it into place. A rename that finds the version there
        fails, so of two writers with the same base one gets a Conflict; half a manifest is never seen."""
        final, draft = f"manifests/v{base + 1:010d}.json", f"manifests/.draft-{uuid.uuid4().hex}"
        self._save(draft, {"schema": schema, "parts": parts})
        to = self._path(f"{self.root}/{final}")
        if self._fs.exists(to) or not self._fs.rename(self._path(f"{self.root}/{draft}"), to):
            self._fs.delete(self._path(f"{self.root}/{draft}"), False)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def _measured(self, kind: StructType, files: list[str]) -> dict[str, tuple[int, int]]:
        """Rows and digest of each file, as Spark reads it."""
        per = self.spark.read.schema(kind).parquet(*files).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), row_digest(kind).alias("d"))
        return {_tail(r["f"]): (r["n"], int(r["d"])) for r in per.collect()}

    def append(self, df: DataFrame, arrivals: int = 1, rows: int = SHARD_ROWS, target: int = TARGET_BYTES) -> int:
        """Writes the rows as small shards, a few per partition, and commits them, an empty table too; the last version.

        With several ``arrivals`` the rows are dealt to as many batches in one pass; each is committed by itself, and a round
        of compaction follows it. A retried task leaves no shard, as Spark's own commit protocol moves only finished files
        into place.
        """
        base, parts, schema = self.manifest()
        kind = df.schema
        if schema is not None and schema != kind.json():
            raise ValueError("the arrival's columns differ from the store's")
        folder, dealt = f"arrivals/{uuid.uuid4().hex}", f"__batch_{uuid.uuid4().hex}"
        batches = df.withColumn(dealt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(arrivals)))
        with _exact_times(self.spark):
            batches.write.partitionBy(dealt).option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.root}/{folder}")
        held = {}
        for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
            if s.isDirectory():
                held[s.getPath().getName()] = [(f"{folder}/{s.getPath().getName()}/{f.getPath().getName()}", f.getLen()) for f in self._fs.listStatus(s.getPath()) if f.getPath().getName().endswith(".parquet")]
        files = [f"{self.root}/{p}" for batch in held.values() for p, _ in batch]
        known = self._measured(kind, files) if files else {}
        for k, batch in enumerate([held[n] for n in sorted(held)] or [[]]):
            if k:
                self.compact(target)
                base, parts, _ = self.manifest()
            new = [Shard(p, size, *known[_tail(p)]) for p, size in batch if _tail(p) in known]
            base = self.commit(base, parts + self.write_parts(new, target), kind.json())
        return base

    def compact(self, target: int = TARGET_BYTES, factor: int = TIER_FACTOR, run: int = RUN) -> int:
        """One round of size-tiered compaction; the version afterwards, the same one if there was nothing to merge.

        Each run is merged by one task that streams its shards, so memory does not grow with the target. Before the commit
        the merged shards are read again: their rows and digests must be those of the shards that they replace. Merged
        shards stay until vacuum().
        """
        base, parts, schema = self.manifest()
        loose = [p for p in parts if p.open or p.shards * 2 < self.part_shards]
        known = self.shards(loose)
        runs = plan(known, target, factor, run)
        if not runs:
            return base
        jobs = self.spark.createDataFrame([(k, [s.path for s in r]) for k, r in enumerate(runs)], "run int, paths array<string>").repartition(len(runs))
        made = cut(jobs.mapInPandas(_merger(self.root), "run int, path string, bytes long")).collect()
        read = self._measured(StructType.fromJson(json.loads(schema)), [f"{self.root}/{r['path']}" for r in made])
        merged = {r["run"]: Shard(r["path"], r["bytes"], *read.get(_tail(r["path"]), (0, 0))) for r in made}
        for k, r in enumerate(runs):
            if (merged[k].rows, merged[k].digest) != (sum(s.rows for s in r), sum(s.digest for s in r)):
                raise RuntimeError("a merge has changed, lost or repeated rows")
        gone = {s.path for r in runs for s in r}
        kept = [p for p in parts if p not in loose]
        return self.commit(base, kept + self.write_parts([s for s in known if s.path not in gone] + list(merged.values()), target), schema)

    def compact_all(self, target: int = TARGET_BYTES, factor: int = TIER_FACTOR, run: int = RUN) -> int:
        """Rounds until nothing is left to merge."""
        before = -1
        while (after := self.compact(target, factor, run)) != before:
            before = after
        return after

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Deletes the manifests but for the newest ``keep``, the parts and shards that only these list, and whatever else
        no manifest lists once it is older than ``grace`` seconds: the leavings of failed attempts."""
        versions = self.versions()
        old, new = versions[:-keep], versions[-keep:]
        parts_of = lambda vs: {p for v in vs for p in self.manifest(v)[1]}
        live, dead = parts_of(new), parts_of(old)
        names = lambda parts: {f"parts/{p.name}" for p in parts} | {s.path for s in self.shards(parts)}
        kept, gone = names(live), names(dead - live)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        limit, top = (time.time() - grace) * 1000, self._fs.makeQualified(self._path(self.root)).toString()
        for folder in ("parts", "arrivals", "merged", "manifests"):
            files = self._fs.listFiles(self._path(f"{self.root}/{folder}"), True)
            while files.hasNext():
                f = files.next()
                name = f.getPath().toString()[len(top) + 1 :]
                stale = f.getModificationTime() <= limit and not name.startswith("manifests/v")
                if name not in kept and (name in gone or stale):
                    self._fs.delete(f.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        _, parts, schema = self.manifest(version)
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        paths = [f"{self.root}/{s.path}" for s in self.shards(parts)]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)


def _merger(root: str):
    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, top = file_system(root)
        store.create_dir(f"{top}/merged", recursive=True)
        for part in parts:
            out = []
            for run, paths in zip(part["run"], part["paths"]):
                name = f"merged/{uuid.uuid4().hex}.parquet"  # a repeated task writes another file, which nothing lists
                writer, held, size = None, [], 0
                for p in paths:
                    with pq.ParquetFile(store.open_input_file(f"{top}/{p}"), buffer_size=1 << 20, pre_buffer=False) as f:
                        if writer is None:
                            writer = pq.ParquetWriter(f"{top}/{name}", f.schema_arrow, filesystem=store, compression="zstd")
                        for batch in f.iter_batches(READ_ROWS):
                            held.append(batch if batch.schema == writer.schema else batch.cast(writer.schema))
                            size += batch.nbytes
                            if size >= GROUP_BYTES:
                                writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
                                held, size = [], 0
                if held:
                    writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
                writer.close()
                out.append((run, name, store.get_file_info(f"{top}/{name}").size))
            yield pd.DataFrame(out, columns=["run", "path", "bytes"])

    return merge


def shard(df: DataFrame, root: str, arrivals: int = 1, target: int = TARGET_BYTES, factor: int = TIER_FACTOR) -> ShardStore:
    """A store with the rows, brought in as so many arrivals, compacted and vacuumed.

    All columns and rows stay as they are: nulls, repeated rows, empty and very long texts, timestamps of any year. A table
    without rows gives a store without shards. Up to RUN - 1 shards of each tier stay below the target, waiting for others.
    """
    store = ShardStore(df.sparkSession, root)
    store.append(df, arrivals, target=target)
    store.compact_all(target, factor)
    store.vacuum()
    return store


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, repeated and null ones too, as the compacted store's newest version gives it back; the table is brought
    in as ARRIVALS arrivals. No rows give no rows."""
    store = shard(table(spark, sf_dir, "documents"), shared_path(spark, "shards"), ARRIVALS)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(text_of(), 256).alias("text_sha256"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
