"""Sharding (operator 6): small immutable shards, size-tiered compaction, versioned manifests.

A ``ShardStore`` is a folder in a file system that driver and executors share.  Arrivals are appended as
Parquet files that never change.  What the store holds is what its newest manifest lists: a JSON
file ``v<number>.json`` whose rename into place is the commit (it fails if that version exists, and is
then tried anew on the newer one).  Readers of older versions are not disturbed until ``vacuum``.

A manifest has two layers.  Shards that may still be merged stand in it by themselves; they are few, as compaction
keeps them to less than ``fan_in`` a tier.  Finished shards stand in part files that never change, of which the manifest
names some: a commit writes what it adds, not the list of all shards.

Compaction is size-tiered: shards below half the target fall into tiers by powers of ``fan_in``; a tier
with ``fan_in`` shards is merged.  One Spark job merges a whole round: the file scan packs files into
partitions of a fraction of the target, those are coalesced to as many tasks as target-sized files are
needed, and each task writes one file.  There is no shuffle and no rewriting of shards that have
reached half the target.  A merge that would not lower the number of shards is not committed, its files go, and
its tier waits for other shards; the other tiers are merged nevertheless.

Defined cases: an empty arrival adds no shard, an empty store reads as an empty table of its schema; any
columns may be null or have any name; rows repeat as they came.  All files go through Hadoop's file
system API, so a store can be where only Spark reaches.
"""

from __future__ import annotations

import atexit
import json
import math
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _remove, free_name, read_table, shared_dir

TARGET_BYTES, FAN_IN = 64 << 20, 4
#: A shard of this share of the target is finished.
FULL = 0.5
#: Part files of about one size that are joined into one.
PARTS_FAN_IN = 8
#: Arrivals that op6 splits the corpus into.
ARRIVALS = 12


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    n_bytes: int
    n_rows: int
    arrival: int  # version in which its oldest rows came


@dataclass(frozen=True)
class Part:
    """A file that lists finished shards."""

    path: str
    n_shards: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    open: list[Shard] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    note: str = ""


class Conflict(Exception):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _listed(self, below: str) -> list[tuple[str, int]]:
        """Data files below a folder: (path below the store's folder, bytes)."""
        top = self._path(below)
        if not self._fs.exists(top):
            return []
        base = self._fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
        out, walk = [], self._fs.listFiles(top, True)
        while walk.hasNext():
            f = walk.next()
            if f.getPath().getName().endswith(".parquet"):
                out.append((f.getPath().toString().removeprefix(base), f.getLen()))
        return sorted(out)

    def _text(self, below: str) -> str:
        stream = self._fs.open(self._path(below))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # manifests

    def versions(self) -> list[int]:
        top = self._path("manifests")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        raw = json.loads(self._text(f"manifests/v{version:012d}.json"))
        return Manifest(raw["version"], raw["schema"], [Shard(**s) for s in raw["open"]], [Part(**p) for p in raw["parts"]], raw["note"])

    def shards(self, manifest: Manifest) -> list[Shard]:
        """All shards of a version."""
        return [*(s for p in manifest.parts for s in self._listing(p)), *manifest.open]

    def _listing(self, part: Part) -> list[Shard]:
        return [Shard(**json.loads(line)) for line in self._text(part.path).splitlines()]

    def _write(self, below: str, text: str) -> None:
        stream = self._fs.create(self._path(below), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _part(self, shards: list[Shard]) -> Part:
        path = f"manifests/part-{uuid.uuid4().hex}.jsonl"
        self._write(path, "\n".join(json.dumps(asdict(s)) for s in shards))
        return Part(path, len(shards))

    def _with_part(self, parts: list[Part], done: list[Shard]) -> list[Part]:
        """Parts with newly finished shards; the newest are joined while ``PARTS_FAN_IN`` of them have about one size, so
        a shard's line is written a logarithmic number of times."""
        if not done:
            return parts
        parts = [*parts, self._part(done)]
        while len(parts) >= PARTS_FAN_IN:
            some = parts[-PARTS_FAN_IN:]
            sizes = [p.n_shards for p in some]
            if max(sizes) > PARTS_FAN_IN * min(sizes):
                break
            parts = [*parts[:-PARTS_FAN_IN], self._part([s for p in some for s in self._listing(p)])]
        return parts

    def _commit(self, manifest: Manifest) -> Manifest:
        """Atomic: a file of its own, renamed to the version's name, which must be free."""
        name = f"manifests/.draft-{uuid.uuid4().hex}"
        draft, final = self._path(name), self._path(f"manifests/v{manifest.version:012d}.json")
        self._write(name, json.dumps(asdict(manifest)))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(manifest.version)
        return manifest

    def _finished(self, shard: Shard) -> bool:
        return shard.n_bytes >= FULL * self.target

    def _change(self, schema: str, added: list[Shard], removed: set[str], note: str) -> Manifest:
        """Commits on top of the newest version; on a conflict once more, unless what is to go has gone."""
        while True:
            now = self.manifest() or Manifest(0, schema)
            held = {s.path for s in now.open}
            if not removed <= held:
                raise Conflict(f"{len(removed - held)} shards to be merged are gone")
            arrival = now.version + 1
            new = [s if s.arrival else Shard(s.path, s.n_bytes, s.n_rows, arrival) for s in added]
            open_ = [*(s for s in now.open if s.path not in removed), *(s for s in new if not self._finished(s))]
            try:
                return self._commit(Manifest(arrival, now.schema, open_, self._with_part(now.parts, [s for s in new if self._finished(s)]), note))
            except Conflict:
                continue

    # writing

    def _rows(self, below: str, schema: T.StructType) -> dict[str, int]:
        """Rows by file: one count over the written files, of which no column is decoded."""
        paths = [f"{self.root}/{p}" for p, _ in self._listed(below)]
        if not paths:
            return {}
        counted = self.spark.read.schema(schema).parquet(*paths).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
        return {"/".join(unquote(r[0]).split("/")[-2:]): r[1] for r in counted.collect()}

    def _shards(self, below: str, schema: T.StructType, rows: dict[str, int], arrival: int) -> list[Shard]:
        return [Shard(p, size, n, arrival) for p, size in self._listed(below) if (n := rows.get("/".join(p.split("/")[-2:]), 0))]

    def append(self, df: DataFrame) -> Manifest:
        """One arrival: its rows as new shards, one per task, in one commit."""
        below = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{below}")
        return self._change(df.schema.json(), self._shards(below, df.schema, self._rows(below, df.schema), 0), set(), "append")

    def append_many(self, df: DataFrame, arrival) -> list[Manifest]:
        """Arrivals told apart by a column (an expression), written in one job, committed one after the other."""
        name = free_name(df.columns, "arrival")
        below = f"data/{uuid.uuid4().hex}"
        df.withColumn(name, arrival).write.partitionBy(name).parquet(f"{self.root}/{below}")
        rows = self._rows(below, df.schema)
        found = sorted({p.split("/")[-2] for p, _ in self._listed(below)}, key=lambda d: (len(d), d))
        if not found:
            return [self._change(df.schema.json(), [], set(), "append")]
        return [self._change(df.schema.json(), self._shards(f"{below}/{d}", df.schema, rows, 0), set(), f"append {d}") for d in found]

    # compaction

    def tier(self, n_bytes: int) -> int:
        """0 for the target's fan_in-th part to the target, -1 below that, and so on."""
        return math.floor(math.log(max(n_bytes, 1) / self.target, self.fan_in)) + 1

    def due(self, manifest: Manifest, stuck: frozenset[str] = frozenset()) -> list[Shard]:
        """Shards of the smallest tier that has ``fan_in`` unfinished shards; none: nothing is due.  A tier whose
        shards are all ``stuck`` is passed over."""
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.open:
            if not self._finished(s):
                tiers.setdefault(self.tier(s.n_bytes), []).append(s)
        full = [t for t, found in sorted(tiers.items()) if len(found) >= self.fan_in and any(s.path not in stuck for s in found)]
        return sorted(tiers[full[0]], key=lambda s: (s.n_bytes, s.path)) if full else []

    def _merge(self, shards: list[Shard], schema: T.StructType) -> list[Shard]:
        below = f"data/{uuid.uuid4().hex}"
        files = max(1, -(-sum(s.n_bytes for s in shards) // self.target))
        # the scan packs files into partitions of this size, several to a task; in a session of its own, so that no
        # other scan is dealt otherwise meanwhile
        own = self.spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, self.target // 8)))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        own.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards]).coalesce(files).write.parquet(f"{self.root}/{below}")
        out = self._shards(below, schema, self._rows(below, schema), min(s.arrival for s in shards))
        if sum(s.n_rows for s in out) != sum(s.n_rows for s in shards):
            raise RuntimeError("a merge changed the number of rows")
        return out

    def compact(self) -> Manifest | None:
        """Merges tier by tier until none is due; each merge is one commit."""
        stuck: frozenset[str] = frozenset()
        while (now := self.manifest()) is not None and (shards := self.due(now, stuck)):
            merged = self._merge(shards, T.StructType.fromJson(json.loads(now.schema)))
            if len(merged) >= len(shards):
                for s in merged:
                    self._fs.delete(self._path(s.path), False)
                stuck |= {s.path for s in shards}
                continue
            self._change(now.schema, merged, {s.path for s in shards}, f"merge {len(shards)} into {len(merged)}")
        return self.manifest()

    def vacuum(self, keep: int = 1) -> int:
        """Deletes data and parts that none of the newest ``keep`` versions lists; returns the number of data files.

        Not while another writer is between writing and committing.
        """
        known = [self.manifest(v) for v in self.versions()[-keep:]]
        held = {s.path for m in known for s in self.shards(m)}
        parts = {p.path for m in known for p in m.parts}
        gone = [p for p, _ in self._listed("data") if p not in held]
        for p in gone:
            self._fs.delete(self._path(p), False)
        for s in self._fs.listStatus(self._path("manifests")) if known else []:
            name = f"manifests/{s.getPath().getName()}"
            if name.startswith("manifests/part-") and name not in parts:
                self._fs.delete(s.getPath(), False)
        return len(gone)

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found is None:
            raise FileNotFoundError(f"no manifest in {self.root}")
        schema = T.StructType.fromJson(json.loads(found.schema))
        shards = self.shards(found)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents, appended in arrivals, compacted, and read back from the last version."""
    root = f"{shared_dir(spark).rstrip('/')}/resultfeed-shards-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, root)
    store = ShardStore(spark, root)
    docs = read_table(spark, sf_dir, "documents")
    store.append_many(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).cast("int"))
    store.compact()
    store.vacuum()
    body = F.coalesce(F.col("text"), F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""
