"""Where batches of events go.  A batch of a query is written under (query, batch id), so a replay replaces it."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resultfeed.functions.encode import DIFF, TS, delivered, rendered


@dataclass(frozen=True)
class Batch:
    """One non-empty change of a query's result."""

    query_id: str
    batch_id: int
    seq: int
    ts: int
    events: DataFrame  # mz_timestamp, mz_diff, columns
    snapshot: Callable[[], DataFrame]  # the new result, in its order
    subscribers: dict[str, list[str]]  # mode -> ids


def event_json(df: DataFrame) -> Column:
    """{"mz_timestamp", "mz_diff", "data": {..}} with explicit nulls."""
    data = F.struct(*[rendered(F.col(f"`{f.name}`"), f.dataType).alias(delivered(f)) for f in df.schema.fields if f.name not in (TS, DIFF)])
    return F.to_json(F.struct(F.col(TS), F.col(DIFF), data.alias("data")), {"ignoreNullFields": "false"})


def data_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[rendered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"})


def payloads(batch: Batch) -> dict[str, DataFrame]:
    """For each mode that has subscribers: its rows as JSON text, made once however many subscribe."""
    out = {}
    if batch.subscribers.get("events"):
        out["events"] = batch.events.select(event_json(batch.events).alias("value"))
    if batch.subscribers.get("snapshot"):
        rows = batch.snapshot()
        out["snapshot"] = rows.select(data_json(rows).alias("value"))
    return out


class Sink:
    def write(self, batch: Batch) -> int:
        """Delivers a batch; returns the number of messages."""
        raise NotImplementedError


@dataclass
class MemorySink(Sink):
    """Messages by subscription id, for tests and small results: they are collected."""

    messages: dict[str, dict[tuple[str, int], dict]] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def write(self, batch: Batch) -> int:
        n = 0
        for mode, rows in payloads(batch).items():
            body = {"seq": batch.seq, "ts": batch.ts, mode: [json.loads(r.value) for r in rows.collect()]}
            with self._lock:
                for sub in batch.subscribers[mode]:
                    self.messages.setdefault(sub, {})[(batch.query_id, batch.batch_id)] = body
                    n += 1
        return n

    def of(self, sub: str) -> list[dict]:
        with self._lock:
            return sorted(self.messages.get(sub, {}).values(), key=lambda m: m["seq"])


@dataclass
class JsonLinesSink(Sink):
    """A folder per query, mode and batch, written by the executors; subscribers read their query's folder."""

    path: str

    def write(self, batch: Batch) -> int:
        made = payloads(batch)
        for mode, rows in made.items():
            body = rows.select(F.lit(batch.seq).alias("seq"), F.lit(batch.ts).alias("ts"), F.parse_json("value").alias("event"))
            body.write.mode("overwrite").json(f"{self.path}/query={batch.query_id}/mode={mode}/batch={batch.batch_id:012d}")
        return len(made)


@dataclass
class KafkaSink(Sink):
    """One record per row, keyed by the query; consumers drop (query, batch, seq) they know."""

    options: dict[str, str]
    topic: str

    def write(self, batch: Batch) -> int:
        made = payloads(batch)
        for mode, rows in made.items():
            head = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(str(v)).cast("binary").alias("value")) for k, v in (("mode", mode), ("batch", batch.batch_id), ("seq", batch.seq), ("ts", batch.ts))])
            rows.select(F.lit(batch.query_id).alias("key"), "value", head.alias("headers")).write.format("kafka").options(**self.options).option("topic", self.topic).option("includeHeaders", "true").save()
        return len(made)


@dataclass
class BusSink(Sink):
    """Messages per subscriber through ``publish(subject, bytes)``; each payload is serialised once.

    A batch of more than ``most`` rows goes as several messages with one seq, numbered by ``part``; the one
    that ends it says ``last``.  So the driver holds one message at a time, however large a batch is.
    """

    publish: Callable[[str, bytes], None]
    subject: Callable[[str], str]
    flush: Callable[[], None] = lambda: None
    most: int = 1000

    def write(self, batch: Batch) -> int:
        n = 0
        for mode, rows in payloads(batch).items():
            part, held, left = 0, [], iter(r.value for r in rows.toLocalIterator())
            while held or not part:
                held = held or list(islice(left, self.most))
                behind = list(islice(left, self.most))
                parts = "" if not part and not behind else f'"part":{part},"last":{"false" if behind else "true"},'
                body = f'{{"seq":{batch.seq},"ts":{batch.ts},{parts}"{mode}":[{",".join(held)}]}}'.encode()
                for sub in batch.subscribers[mode]:
                    self.publish(self.subject(sub), body)
                    n += 1
                part, held = part + 1, behind
        self.flush()
        return n
