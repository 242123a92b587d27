"""Subscriptions and the queries they share; plain driver-side state behind one lock that no Spark job holds."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from resultfeed.plans.analyze import Analysis, Analyzer, QueryError

MODES = ("events", "snapshot")


class SubscriptionError(ValueError):
    pass


@dataclass
class Subscription:
    id: str
    query_id: str
    mode: str
    last_activity: float


@dataclass
class SharedQuery:
    """What subscribers with the same text and identity columns share."""

    id: str
    sql: str
    identity: tuple[str, ...]
    analysis: Analysis
    subscribers: set[str] = field(default_factory=set)
    seq: int = 0
    version: int | None = None  # of its snapshot
    schema_json: str | None = None  # of its result


class Registry:
    def __init__(self, analyzer: Analyzer, max_subscriptions: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self._analyzer, self._max, self._clock = analyzer, max_subscriptions, clock
        self.lock = threading.RLock()
        self._subs: dict[str, Subscription] = {}
        self._queries: dict[str, SharedQuery] = {}
        self._tables: dict[str, set[str]] = {}

    def subscribe(self, sub_id: str, sql: str, identity: tuple[str, ...] = (), mode: str = "events", ready: Callable[[SharedQuery], None] | None = None) -> tuple[SharedQuery, bool]:
        """The shared query and whether it is new.  ``ready`` makes a new query's first snapshot, without the lock; the
        query is indexed only after that.  The caller keeps batches and other subscribers away meanwhile."""
        if mode not in MODES:
            raise SubscriptionError(f"Unknown mode '{mode}'")
        if not re.fullmatch(r"[^.\s*>]+", sub_id):
            raise SubscriptionError(f"Bad subscription id '{sub_id}'")
        analysis = self._analyzer.analyze(sql, tuple(identity))
        if not analysis.tables:
            raise QueryError("No table in query")
        with self.lock:
            self._admit(sub_id)
            query = self._queries.get(analysis.key)
        new = query is None
        if new:
            query = SharedQuery(analysis.key, sql, tuple(identity), analysis)
            if ready is not None:
                ready(query)
        with self.lock:
            self._admit(sub_id)
            if self._queries.setdefault(query.id, query) is query:
                for t in analysis.tables:
                    self._tables.setdefault(t, set()).add(query.id)
            else:
                query, new = self._queries[query.id], False
            query.subscribers.add(sub_id)
            self._subs[sub_id] = Subscription(sub_id, query.id, mode, self._clock())
            return query, new

    def _admit(self, sub_id: str) -> None:
        if len(self._subs) >= self._max:
            raise SubscriptionError(f"Max subscriptions ({self._max}) reached")
        if sub_id in self._subs:
            raise SubscriptionError(f"Subscription '{sub_id}' already exists")

    def analyzed(self, sql: str) -> Analysis:
        return self._analyzer.analyze(sql)

    def unsubscribe(self, sub_id: str) -> tuple[bool, SharedQuery | None]:
        """Whether it existed, and the query that went with its last subscriber."""
        with self.lock:
            sub = self._subs.pop(sub_id, None)
            if sub is None:
                return False, None
            query = self._queries[sub.query_id]
            query.subscribers.discard(sub_id)
            if query.subscribers:
                return True, None
            del self._queries[query.id]
            for t in query.analysis.tables:
                self._tables[t].discard(query.id)
                if not self._tables[t]:
                    del self._tables[t]
            return True, query

    def heartbeat(self, sub_id: str) -> bool:
        with self.lock:
            if sub_id not in self._subs:
                return False
            self._subs[sub_id].last_activity = self._clock()
            return True

    def cleanup(self, timeout: float) -> tuple[list[str], list[SharedQuery]]:
        """Drops subscriptions idle for ``timeout`` seconds or more; their ids, and queries without subscribers left."""
        with self.lock:
            now = self._clock()
            gone = [s.id for s in self._subs.values() if now - s.last_activity >= timeout]
            return gone, [q for q in (self.unsubscribe(i)[1] for i in gone) if q is not None]

    def query(self, query_id: str) -> SharedQuery | None:
        with self.lock:
            return self._queries.get(query_id)

    def queries(self) -> list[SharedQuery]:
        with self.lock:
            return list(self._queries.values())

    def subscription(self, sub_id: str) -> Subscription | None:
        with self.lock:
            return self._subs.get(sub_id)

    def subscribers(self, query_id: str) -> dict[str, list[str]]:
        """Subscription ids of a query by mode."""
        with self.lock:
            query = self._queries.get(query_id)
            out: dict[str, list[str]] = {m: [] for m in MODES}
            for i in sorted(query.subscribers if query else ()):
                out[self._subs[i].mode].append(i)
            return out

    def has_table(self, table: str) -> bool:
        with self.lock:
            return table.lower() in self._tables

    def for_tables(self, tables) -> list[SharedQuery]:
        """Queries that read any of the tables, each once."""
        with self.lock:
            ids = set().union(*[self._tables.get(t.lower(), set()) for t in tables]) if tables else set()
            return [self._queries[i] for i in sorted(ids)]

    def stats(self) -> tuple[int, int]:
        """(subscriptions, queries)"""
        with self.lock:
            return len(self._subs), len(self._queries)
