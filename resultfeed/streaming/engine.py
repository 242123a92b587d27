"""The loop: apply a micro-batch of changes, decide which queries it can touch, find what changed in them, deliver it.

State lives in a folder shared by driver and executors.  A table is a base, and deltas that hold the net change of
each key in a batch; deltas are only ever added, merged in tiers, and folded into a new base in the background.  A
query that maps rows to rows (``rowwise``) is answered from the changed rows alone and stores no result; any other is run
again and compared with its stored one.  ``state.json`` is replaced last: a batch that failed or was cut off
is replayed from the same versions, gives the same events under the same (query, batch id), and so replaces what it
had written.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resultfeed.config import Config, Metrics
from resultfeed.functions.encode import now_ms
from resultfeed.operators.diff import diff
from resultfeed.plans.predicate import may_match
from resultfeed.registry import Registry, SharedQuery
from resultfeed.sources import changelog
from resultfeed.sources.files import SharedFiles

from .sinks import Batch, Sink

log = logging.getLogger("resultfeed.engine")
POS = "__pos"
#: Deltas of one level that are merged into one of the next.
MERGE = 8
#: A new base is written when the changed keys exceed this share of the base's rows.
COMPACT_SHARE = 0.1
#: Changed keys that are sent to all executors rather than shuffled with the table; and those that are written into
#: the scan's filter, so that Parquet's row groups are skipped.
BROADCAST_KEYS, FILTER_KEYS = 200_000, 500
#: Records that are handled in one task: a small batch's shuffles cost more than its work.
ONE_TASK = 5_000
#: Predicates in one pruning job.
PREDICATES_AT_ONCE = 100
#: Milliseconds from which a query is logged as slow.
SLOW_MS = 100


@dataclass
class Delta:
    path: str
    rows: int  # at most
    level: int = 0


@dataclass
class TableState:
    """Where a table's current version is: files of the base, and of the changes since, oldest first."""

    name: str
    keys: list[str]
    schema_json: str
    base: str | None
    base_rows: int = 0
    deltas: list[Delta] = field(default_factory=list)

    def __post_init__(self):
        self.deltas = [d if isinstance(d, Delta) else Delta(**d) for d in self.deltas]

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema_json))

    def delta_schema(self) -> T.StructType:
        """Batch, key, whether the row is gone, and the row."""
        schema = self.schema()
        key = T.StructType([T.StructField(f"k{i}", schema[k].dataType) for i, k in enumerate(self.keys)])
        return T.StructType([T.StructField("batch", T.LongType()), T.StructField("key", key), T.StructField("gone", T.BooleanType()), T.StructField("row", schema)])

    def delta_rows(self) -> int:
        return sum(d.rows for d in self.deltas)

    def paths(self) -> set[str]:
        return {d.path for d in self.deltas} | ({self.base} if self.base else set())


@dataclass
class _Seen:
    """What one job tells about a batch's records of a table."""

    rows: int
    cut: bool
    partial: bool
    inserts: bool  # only


@dataclass
class Engine:
    spark: SparkSession
    root: str
    registry: Registry
    sink: Sink
    config: Config = field(default_factory=Config)
    metrics: Metrics = field(default_factory=Metrics)
    tables: dict[str, TableState] = field(default_factory=dict)
    last_batch: int = -1

    def __post_init__(self):
        self.files = SharedFiles(self.spark, self.root)
        #: Held by a batch and by what must not fall into the middle of one.  Heartbeats don't need it.
        self.lock = threading.RLock()
        self._readers, self._readers_lock = 0, threading.Lock()
        self._before: set[str] = set()  # paths of the version before the current one
        self._stopped: list[str] = []  # queries whose snapshots are to go
        self._compacting: dict[str, tuple[TableState, str, Future]] = {}
        self._background = ThreadPoolExecutor(1, "compact")

    # tables

    def add_table(self, name: str, df: DataFrame, keys: list[str], path: str | None = None) -> None:
        """A source table at its first version; ``path`` if it lies in Parquet already, else it is written."""
        name = name.lower()
        if path is None:
            path = self.files.path(f"tables/{name}/base-0")
            df.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path).count()
        with self.lock:
            self.tables[name] = TableState(name, keys, df.schema.json(), path, rows)
            self._view(self.spark, self.tables[name])

    def _deltas(self, spark: SparkSession, state: TableState, deltas: list[Delta]) -> DataFrame:
        """The last record of each key in some deltas.  A key is once in a delta that no merge has made."""
        rows = spark.read.schema(state.delta_schema()).parquet(*[d.path for d in deltas])
        if len(deltas) == 1:
            return rows
        last = rows.groupBy("key").agg(F.max_by(F.struct("batch", "gone", "row"), "batch").alias("now"))
        return last.select("now.batch", "key", "now.gone", "now.row")

    def table(self, spark: SparkSession, state: TableState) -> DataFrame:
        """The current version.  Read anew each time: a view keeps its list of files."""
        schema = state.schema()
        base = spark.read.schema(schema).parquet(state.base) if state.base else spark.createDataFrame([], schema)
        if not state.deltas:
            return base
        delta = self._deltas(spark, state, state.deltas)
        changed = delta.select("key")
        if state.delta_rows() <= BROADCAST_KEYS:
            changed = F.broadcast(changed)
        key = changelog.key_of(F.struct(*[F.col(f"`{c}`") for c in schema.names]), state.keys)
        left = base.join(changed, key.eqNullSafe(F.col("key")), "left_anti")
        return left.unionByName(delta.where("not gone").select("row.*"))

    def _view(self, spark: SparkSession, state: TableState) -> None:
        self.table(spark, state).createOrReplaceTempView(state.name)

    def _held(self, spark: SparkSession, state: TableState, rows: int) -> Callable[[DataFrame], DataFrame]:
        """Rows of the table by key; ``rows``: how many keys can be asked for at most."""

        def held(wanted: DataFrame) -> DataFrame:
            table = self.table(spark, state)
            if len(state.keys) == 1 and rows <= FILTER_KEYS:
                values = [r[0] for r in wanted.select("key.k0").distinct().collect()]
                if not values:
                    table = spark.createDataFrame([], state.schema())
                elif None not in values:
                    table = table.where(F.col(f"`{state.keys[0]}`").isin(values))
            return changelog.looked_up(table, state.keys, wanted, rows <= BROADCAST_KEYS)

        return held

    def _net(self, spark: SparkSession, state: TableState, changes: DataFrame, seen: _Seen, old: bool, kept: list[DataFrame]) -> DataFrame:
        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        if seen.rows <= ONE_TASK:
            changes = changes.coalesce(1)
        typed = changelog.images(changes.where(F.lower("tbl") == state.name), state.schema())
        held = None if seen.inserts else self._held(spark, state, 2 * seen.rows)
        return keep(changelog.net(typed, state.schema(), state.keys, held, seen.partial, old, seen.cut, keep, seen.rows <= BROADCAST_KEYS))

    def _advance(self, state: TableState, change: DataFrame, batch_id: int, seen: _Seen) -> TableState:
        """The table's next version: writes the changed keys only."""
        path = self.files.path(f"tables/{state.name}/delta-{batch_id}")
        rows = change.select(F.lit(batch_id).cast("long").alias("batch"), "key", F.col("new").isNull().alias("gone"), F.col("new").alias("row"))
        rows.write.mode("overwrite").parquet(path)
        delta = Delta(path, 2 * seen.rows)
        if seen.cut:
            return TableState(state.name, state.keys, state.schema_json, None, 0, [delta])
        return TableState(state.name, state.keys, state.schema_json, state.base, state.base_rows, [*state.deltas, delta])

    def _merged(self, spark: SparkSession, state: TableState) -> TableState:
        """Merges the newest deltas while ``MERGE`` of them have one level: each change is rewritten a logarithmic
        number of times."""
        # what a compaction has begun with stays as it is
        begun = {d.path for start, _, _ in self._compacting.values() for d in start.deltas}
        fixed, deltas = [d for d in state.deltas if d.path in begun], [d for d in state.deltas if d.path not in begun]
        while len(deltas) >= MERGE and len({d.level for d in deltas[-MERGE:]}) == 1:
            some = deltas[-MERGE:]
            path = f"{some[-1].path.split('-to-')[0]}-to-{some[0].level + 1}"
            self._deltas(spark, state, some).write.mode("overwrite").parquet(path)
            deltas[-MERGE:] = [Delta(path, sum(d.rows for d in some), some[0].level + 1)]
        return TableState(state.name, state.keys, state.schema_json, state.base, state.base_rows, fixed + deltas)

    # compaction

    def _compact_due(self, state: TableState) -> bool:
        return state.name not in self._compacting and state.delta_rows() > COMPACT_SHARE * max(state.base_rows, 1000)

    def _start_compaction(self, state: TableState) -> None:
        """Writes a new base from a version of the table, while batches go on."""
        path = self.files.path(f"tables/{state.name}/base-{self.last_batch}-{now_ms()}")

        def work() -> int:
            self.table(self.spark, state).write.mode("overwrite").parquet(path)
            return self.spark.read.schema(state.schema()).parquet(path).count()

        self._compacting[state.name] = (state, path, self._background.submit(work))

    def _finish_compactions(self, wait: bool = False) -> None:
        """Puts finished bases in place; deltas that came after them stay."""
        for name, (start, path, work) in list(self._compacting.items()):
            if not (wait or work.done()):
                continue
            del self._compacting[name]
            try:
                rows = work.result()
            except Exception:
                log.exception("compaction of %s failed; it is tried again", name)
                continue
            now, old = self.tables[name], {d.path for d in start.deltas}
            kept = [d for d in now.deltas if d.path not in old]
            # after a truncation the new base is of no use
            if now.base == start.base and [d for d in now.deltas if d.path in old] == start.deltas:
                self.tables[name] = TableState(name, now.keys, now.schema_json, path, rows, kept)

    def compact(self, name: str) -> None:
        """A new base now."""
        with self.lock:
            self._finish_compactions(wait=True)
            self._start_compaction(self.tables[name])
            self._finish_compactions(wait=True)
            self._view(self.spark, self.tables[name])
            self._save()

    # queries

    @contextmanager
    def _timed(self, query: SharedQuery) -> Iterator[None]:
        """Counts a query and its time; slow ones are logged."""
        began = time.monotonic()
        self.metrics.add("queries")
        try:
            yield
        except Exception:
            self.metrics.add("query_errors")
            raise
        finally:
            took = int((time.monotonic() - began) * 1000)
            self.metrics.add("query_ms", took)
            if took > SLOW_MS:
                log.debug("slow query: %d ms: %s", took, query.sql)

    def run_query(self, spark: SparkSession, sql: str) -> DataFrame:
        """A result with unambiguous column names."""
        df = spark.sql(sql)
        taken, names = {c.lower() for c in df.columns}, []
        for c in df.columns:
            name, n = c, 0
            while name.lower() in {x.lower() for x in names} or (n and name.lower() in taken):
                n += 1
                name = f"{c}_{n}"
            names.append(name)
        return df.toDF(*names) if names != df.columns else df

    def _snapshot_path(self, query_id: str, version: int) -> str:
        return self.files.path(f"snapshots/{query_id}/v{version}")

    def _write_snapshot(self, spark: SparkSession, query: SharedQuery, version: int) -> DataFrame:
        """Stores a result, with the place of each row: ids ascend with the partitions of a global sort."""
        with self._timed(query):
            result = self.run_query(spark, query.analysis.sql)
            path = self._snapshot_path(query.id, version)
            result.withColumn(POS, F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
        query.schema_json = result.schema.json()
        return self._stored(spark, query, version)

    def _stored(self, spark: SparkSession, query: SharedQuery, version: int) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(query.schema_json))
        return spark.read.schema(T.StructType([*schema.fields, T.StructField(POS, T.LongType())])).parquet(self._snapshot_path(query.id, version))

    def snapshot(self, spark: SparkSession, query: SharedQuery, version: int | None = None) -> DataFrame:
        """A result in the query's order: stored, or, for a rowwise query, run on the tables as they are."""
        if query.analysis.rowwise:
            return self.run_query(spark, query.analysis.sql)
        return self._stored(spark, query, query.version if version is None else version).orderBy(POS).drop(POS)

    def start_query(self, query: SharedQuery) -> None:
        """First snapshot of a new query."""
        if query.analysis.rowwise:
            with self._timed(query):
                query.schema_json = self.run_query(self.spark, query.analysis.sql).schema.json()  # its errors come now
        else:
            self._write_snapshot(self.spark, query, self.last_batch)
        query.version = self.last_batch

    def stop_query(self, query: SharedQuery) -> None:
        """Its stored results go, when no batch may be reading them."""
        self._stopped.append(query.id)
        if self.lock.acquire(blocking=False):
            try:
                self._clean()
            finally:
                self.lock.release()

    def pruned(self, changes: dict[str, DataFrame], cut: set[str], queries: list[SharedQuery]) -> list[SharedQuery]:
        """Queries that the net changes can touch.  A query is skipped only if it is prunable by the one table of
        its that changed, and no row before or after any change can match its predicate."""
        out, by_table = [], {}
        for q in queries:
            changed = [t for t in q.analysis.tables if t in changes]
            if q.analysis.prunable and changed == [q.analysis.prune_table] and changed[0] not in cut:
                by_table.setdefault(changed[0], []).append(q)
            else:
                out.append(q)
        for t, group in by_table.items():
            schema = self.tables[t].schema()
            sides = changes[t].select(F.explode(F.array("old", "new")).alias("row")).where("row is not null").select("row.*")
            for at in range(0, len(group), PREDICATES_AT_ONCE):
                some = group[at : at + PREDICATES_AT_ONCE]
                flags = []
                for k, q in enumerate(some):
                    try:
                        condition = may_match(schema, q.analysis.predicate)
                        sides.select(condition).schema  # analysis only
                    except AnalysisException:  # not an expression of this row
                        condition = F.lit(True)
                    flags.append(F.coalesce(F.max(condition), F.lit(False)).alias(f"q{k}"))
                try:
                    hit = list(sides.agg(*flags).first())
                except Exception:  # a predicate failed on some row: nothing can be ruled out
                    hit = [True] * len(some)
                for q, h in zip(some, hit, strict=True):
                    if h:
                        out.append(q)
                    else:
                        self.metrics.add("skipped")
        return out

    # batches

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` body.  Raises on any failure, so that the batch is not acknowledged."""
        with self.lock:
            if batch_id <= self.last_batch:
                return
            self._finish_compactions()
            kept = [batch.persist()]
            try:
                self._process(batch.sparkSession, kept, batch_id)
            except Exception:
                for state in self.tables.values():  # views of changed rows, or of a version that isn't
                    self._view(batch.sparkSession, state)
                raise
            finally:
                for frame in kept:
                    frame.unpersist()
            for state in self.tables.values():
                if self._compact_due(state):
                    self._start_compaction(state)

    def _seen(self, changes: DataFrame) -> tuple[dict[str, _Seen], int, int]:
        """One job: records by table (as many rows as there are tables), transactions, and records."""
        name = F.lower("tbl").alias("tbl")
        found = changes.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("op") == "T").alias("cut"), F.max(F.coalesce("partial", F.lit(False))).alias("partial"), F.min(F.col("op").isin("I", "T")).alias("inserts"), F.collect_set("tx").alias("tx"))
        rows = found.collect()
        return {r.tbl: _Seen(r.n, r.cut, r.partial, r.inserts) for r in rows if r.tbl in self.tables}, len({x for r in rows for x in r.tx}), sum(r.n for r in rows)

    def _process(self, spark: SparkSession, kept: list[DataFrame], batch_id: int) -> None:
        changes = kept[0]
        seen, transactions, records = self._seen(changes)
        self.metrics.add("transactions", transactions)
        self.metrics.add("changes", records)
        touched, cut = sorted(seen), {t for t, s in seen.items() if s.cut}
        queries = self.registry.for_tables(touched)
        # rows before the batch are needed where a query is pruned by them or computed from them
        asks = {t: any(q.analysis.prune_table == t or q.analysis.rowwise for q in queries if t in q.analysis.tables) for t in touched}
        change = {t: self._net(spark, self.tables[t], changes, seen[t], asks[t], kept) for t in touched}
        queries = self.pruned(change, cut, queries)
        tables = self.tables | {t: self._advance(self.tables[t], change[t], batch_id, seen[t]) for t in touched}
        rowwise = self._rowwise(spark, [q for q in queries if q.analysis.rowwise], change, cut)
        for t in {*touched, *[t for q in queries for t in q.analysis.tables if t in tables]}:
            self._view(spark, tables[t])
        subscribers = {q.id: self.registry.subscribers(q.id) for q in queries}
        with ThreadPoolExecutor(self.config.requery_parallelism) as pool:
            done = list(pool.map(lambda q: self._answer(spark, q, batch_id, subscribers[q.id], rowwise.get(q.id)), queries))
        self._before = {p for t in self.tables.values() for p in t.paths()}
        self.tables = tables
        for q, seq in zip(queries, done, strict=True):
            q.seq, q.version = seq, batch_id
        self.last_batch = batch_id
        for t in touched:
            if len(self.tables[t].deltas) >= MERGE:
                self.tables[t] = self._merged(spark, self.tables[t])
                self._view(self.spark, self.tables[t])
            elif spark is not self.spark:
                self._view(self.spark, self.tables[t])
        self._save()

    def _rowwise(self, spark: SparkSession, queries: list[SharedQuery], change: dict[str, DataFrame], cut: set[str]) -> dict[str, tuple[DataFrame, DataFrame]]:
        """For each rowwise query, its result over the changed rows as they were and as they are."""
        out: dict[str, list[DataFrame]] = {q.id: [] for q in queries}
        for side in ("old", "new"):
            for t in {q.analysis.tables[0] for q in queries}:
                rows = self.table(spark, self.tables[t]) if side == "old" and t in cut else change[t].where(f"{side} is not null").select(f"{side}.*")
                rows.createOrReplaceTempView(t)
            for q in queries:  # planned here, on the views as they are now
                out[q.id].append(self.run_query(spark, q.analysis.sql))
        return {k: tuple(v) for k, v in out.items()}

    def _answer(self, spark: SparkSession, query: SharedQuery, batch_id: int, subscribers: dict[str, list[str]], sides: tuple[DataFrame, DataFrame] | None) -> int:
        """Finds what changed in a query's result, delivers it, and returns the query's sequence number after that."""
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", query.id[:16])
        if sides is None:
            self.metrics.add("requeries")
            new = self._write_snapshot(spark, query, batch_id).drop(POS)
            old = self._stored(spark, query, query.version).drop(POS)
        else:
            self.metrics.add("incremental")
            old, new = sides
        ts = now_ms()
        events = diff(old, new, list(query.identity), ts).persist()
        try:
            if events.isEmpty():
                return query.seq
            seq = query.seq + 1
            sent = self.sink.write(Batch(query.id, batch_id, seq, ts, events, lambda: self.snapshot(spark, query, batch_id), subscribers))
            self.metrics.add("msgs_out", sent)
            return seq
        finally:
            events.unpersist()

    def start(self, changes: DataFrame, checkpoint: str, **trigger):
        """A streaming query over a change log (``changelog.SCHEMA``)."""
        writer = changes.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def run(self, changes: Callable[[], DataFrame], checkpoint: str, stop: threading.Event | None = None, wait: Callable[[float], bool] | None = None, **trigger) -> None:
        """Keeps a streaming query going until ``stop``: after a failure it starts anew from its checkpoint, one second
        later, then two, up to a minute; a batch that succeeds sets the delay back."""
        stop = stop or threading.Event()
        wait = wait or stop.wait
        delay = 1.0
        while not stop.is_set():
            reached, query = self.last_batch, None
            try:
                query = self.start(changes(), checkpoint, **trigger)
                while not stop.is_set() and not query.awaitTermination(0.2):
                    pass
                if query.isActive:
                    query.stop()
                return
            except Exception as e:
                if query is not None and query.isActive:
                    query.stop()
                delay = 1.0 if self.last_batch > reached else delay
                self.metrics.add("restarts")
                log.warning("change stream failed, next try in %.0f s: %s", delay, str(e).splitlines()[0] if str(e) else type(e).__name__)
                if wait(delay):
                    return
                delay = min(delay * 2, 60.0)

    # state

    @contextmanager
    def reading(self) -> Iterator[None]:
        """While it lasts, no file of an older version is deleted."""
        with self._readers_lock:
            self._readers += 1
        try:
            yield
        finally:
            with self._readers_lock:
                self._readers -= 1

    def _save(self) -> None:
        state = {
            "last_batch": self.last_batch,
            "tables": [asdict(t) for t in self.tables.values()],
            "queries": [{"id": q.id, "sql": q.sql, "identity": q.identity, "seq": q.seq, "version": q.version, "schema_json": q.schema_json} for q in self.registry.queries()],
        }
        self.files.write("state.json", json.dumps(state))
        self._clean()

    def _clean(self) -> None:
        """Deletes files that neither this version nor the one before it needs."""
        with self._readers_lock:
            if self._readers:
                return
        known = {q.id for q in self.registry.queries()}
        for query_id in [i for i in self._stopped if i not in known]:
            self.files.delete(f"snapshots/{query_id}")
        self._stopped.clear()
        for q in self.registry.queries():
            if q.analysis.rowwise or q.version is None:
                continue
            held = sorted((int(n[1:]) for n in self.files.names(f"snapshots/{q.id}") if n[1:].lstrip("-").isdigit()), reverse=True)
            for v in held[2:]:
                self.files.delete(f"snapshots/{q.id}/v{v}")
        used = self._before | {p for t in self.tables.values() for p in t.paths()} | {path for _, path, _ in self._compacting.values()} | {p for start, _, _ in self._compacting.values() for p in start.paths()}
        for t in self.tables:
            for n in self.files.names(f"tables/{t}"):
                if self.files.path(f"tables/{t}/{n}") not in used:
                    self.files.delete(f"tables/{t}/{n}")

    def save(self) -> None:
        with self.lock:
            self._save()

    def save_subscription(self, sub_id: str, query: SharedQuery, mode: str, new: bool) -> None:
        """A subscription outlives the process from now on: a small file of its own; a new query is in the state."""
        if new:
            self.save()
        self.files.write(f"subscriptions/{quote(sub_id, safe='')}.json", json.dumps({"sql": query.sql, "identity": query.identity, "mode": mode}))

    def drop_subscription(self, sub_id: str) -> None:
        self.files.delete(f"subscriptions/{quote(sub_id, safe='')}.json")

    def restore(self) -> bool:
        """Tables, queries, snapshots and subscriptions as they were after the last finished batch."""
        if not self.files.exists("state.json"):
            return False
        state = json.loads(self.files.read("state.json"))
        with self.lock:
            self.last_batch = state["last_batch"]
            self.tables = {t["name"]: TableState(**t) for t in state["tables"]}
            for t in self.tables.values():
                self._view(self.spark, t)
            known = {q["id"]: q for q in state["queries"]}
            for name in self.files.names("subscriptions"):
                if not name.endswith(".json"):
                    continue
                sub = json.loads(self.files.read(f"subscriptions/{name}"))
                made, new = self.registry.subscribe(unquote(name[: -len(".json")]), sub["sql"], tuple(sub["identity"]), sub["mode"])
                if not new:
                    continue
                if made.id in known:
                    q = known[made.id]
                    made.seq, made.version, made.schema_json = q["seq"], q["version"], q["schema_json"]
                else:
                    self.start_query(made)
        return True
