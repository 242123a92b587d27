"""Requests and responses: what a client of the engine talks to, whatever carries the messages."""

from __future__ import annotations

import json
import logging
import threading
from dataclasses import asdict, dataclass, field
from urllib.parse import quote

from resultfeed.config import Config
from resultfeed.operators.diff import init_events, late_join_events
from resultfeed.functions.encode import now_ms
from resultfeed.plans.analyze import QueryError
from resultfeed.registry import MODES, SubscriptionError
from resultfeed.streaming.engine import Engine
from resultfeed.streaming.sinks import data_json, event_json

log = logging.getLogger("resultfeed.service")


@dataclass
class SubscribeRequest:
    query: str
    identity_columns: list[str] = field(default_factory=list)
    mode: str = "events"

    @classmethod
    def from_json(cls, raw: str | bytes | dict) -> SubscribeRequest:
        body = raw if isinstance(raw, dict) else json.loads(raw)
        if not isinstance(body, dict) or not isinstance(body.get("query"), str):
            raise ValueError("Invalid request: query is missing")
        out = cls(body["query"], list(body.get("identity_columns") or []), body.get("mode") or "events")
        if out.mode not in MODES:
            raise ValueError(f"Invalid request: unknown mode '{out.mode}'")
        return out


@dataclass
class SubscribeResponse:
    success: bool
    subscription_id: str | None = None
    subject: str | None = None
    query_id: str | None = None
    error: str | None = None
    is_new: bool = False
    seq: int = 0
    mode: str = "events"
    events: list[dict] = field(default_factory=list)
    snapshot: list[dict] = field(default_factory=list)
    #: Where the first rows lie as JSON lines, if they are too many for a message.
    location: str | None = None

    def to_dict(self) -> dict:
        """Without what is null, and without empty arrays."""
        return {k: v for k, v in asdict(self).items() if v is not None and v != []}


class Service:
    def __init__(self, engine: Engine, config: Config | None = None):
        self.engine, self.config = engine, config or engine.config
        self._stop = threading.Event()
        self._timers: list[threading.Thread] = []

    # addresses

    def subscription_of(self, subject: str) -> str | None:
        """The id in ``prefix.<id>.verb``; None if there is none."""
        head, _, rest = subject.partition(f"{self.config.bus_prefix}.")
        sub, _, verb = rest.rpartition(".")
        return sub if not head and verb and sub and "." not in sub else None

    def handle(self, subject: str, body: bytes | dict | None = None) -> dict:
        """A request by its subject: subscribe, unsubscribe, heartbeat, health."""
        self.engine.metrics.add("msgs_in")
        if subject == f"{self.config.bus_prefix}.health":
            return self.health()
        verb, sub = subject.rpartition(".")[2], self.subscription_of(subject)
        if sub is None:
            return {"success": False, "error": "Missing subscription_id in subject"}
        if verb == "subscribe":
            try:
                request = SubscribeRequest.from_json(body or b"{}")
            except ValueError as e:
                return SubscribeResponse(False, sub, error=str(e)).to_dict()
            return self.subscribe(sub, request).to_dict()
        if verb in ("unsubscribe", "heartbeat"):
            return {"success": getattr(self, verb)(sub)}
        return {"success": False, "error": f"Unknown verb '{verb}'"}

    # verbs

    def subscribe(self, sub_id: str, request: SubscribeRequest) -> SubscribeResponse:
        """Registers a query and answers with its current rows: events of a new query carry the time, those of a
        shared one timestamp 0 and its sequence number.  More than ``inline_rows`` rows are written by the
        executors, and the answer says where; no batch waits for either."""
        engine, registry = self.engine, self.engine.registry

        def failed(e: Exception) -> SubscriptionError:
            text = str(e).splitlines()
            return SubscriptionError(f"Query failed: {text[0] if text else type(e).__name__}")

        def first(query):
            try:
                engine.start_query(query)
            except Exception as e:
                raise failed(e) from None

        try:
            with engine.reading():
                with engine.lock:  # not in the middle of a batch
                    query, new = registry.subscribe(sub_id, request.query, tuple(request.identity_columns), request.mode, first)
                    engine.save_subscription(sub_id, query, request.mode, new)
                    rows = engine.snapshot(engine.spark, query)
                    out = SubscribeResponse(True, sub_id, self.config.subject(sub_id, "changes"), query.id, None, new, query.seq, request.mode)
                try:
                    self._first_rows(out, rows)
                except Exception as e:  # no subscription without its first rows
                    self.unsubscribe(sub_id)
                    raise failed(e) from None
                return out
        except (QueryError, SubscriptionError) as e:
            return SubscribeResponse(False, sub_id, error=str(e), mode=request.mode)

    def _first_rows(self, out: SubscribeResponse, rows) -> None:
        if out.mode == "snapshot":
            made = rows.select(data_json(rows).alias("value"))
        else:
            events = init_events(rows, now_ms()) if out.is_new else late_join_events(rows)
            made = events.select(event_json(events).alias("value"))
        most = self.config.inline_rows
        head = [r.value for r in made.limit(most + 1).collect()]
        if len(head) > most:
            out.location = self.engine.files.path(f"first/{quote(out.subscription_id, safe='')}")
            made.write.mode("overwrite").text(out.location)
        else:
            setattr(out, "snapshot" if out.mode == "snapshot" else "events", [json.loads(v) for v in head])

    def unsubscribe(self, sub_id: str) -> bool:
        found, gone = self.engine.registry.unsubscribe(sub_id)
        if found:
            self.engine.drop_subscription(sub_id)
        if gone is not None:
            self.engine.stop_query(gone)
        return found

    def heartbeat(self, sub_id: str) -> bool:
        return self.engine.registry.heartbeat(sub_id)

    def cleanup(self, timeout: float | None = None) -> list[str]:
        ids, gone = self.engine.registry.cleanup(self.config.client_timeout_secs if timeout is None else timeout)
        for i in ids:
            self.engine.drop_subscription(i)
        for q in gone:
            self.engine.stop_query(q)
        return ids

    def health(self) -> dict:
        subs, queries = self.engine.registry.stats()
        m = self.engine.metrics
        return {"status": "ok", "server_id": self.config.server_id, "subscriptions": subs, "queries": queries, "msgs_in": m["msgs_in"], "msgs_out": m["msgs_out"]}

    def ping(self) -> bool:
        return self.engine.spark.sql("SELECT 1").first()[0] == 1

    def pool_status(self) -> tuple[int, int, int]:
        """Tasks that run, cores that are free, and cores in all: what a connection pool is to a database client."""
        tracker = self.engine.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
        most = self.engine.spark.sparkContext.defaultParallelism
        active = min(most, sum(s.numActiveTasks for s in stages if s))
        return active, most - active, most

    def sample(self, sql: str, most: int = 100) -> dict:
        """Any SELECT over the engine's tables, for a look at them: the number of its rows, and the first ones."""
        try:
            found = self.engine.run_query(self.engine.spark, self.engine.registry.analyzed(sql).sql)
            head = [json.loads(r.value) for r in found.select(data_json(found).alias("value")).limit(most).collect()]
            return {"success": True, "row_count": len(head) if len(head) < most else found.count(), "rows": head}
        except Exception as e:
            return {"success": False, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}

    # what carries the messages

    def serve(self, bus, stop: threading.Event | None = None) -> None:
        """Answers requests of a bus (``subscribe``, ``requests``, ``publish``) one at a time until ``stop``.

        ``requests`` yields (subject, reply subject or None, body), or None when nothing came for a while.
        """
        stop = stop or self._stop
        for verb in ("subscribe", "unsubscribe", "heartbeat"):
            bus.subscribe(f"{self.config.bus_prefix}.*.{verb}")
        bus.subscribe(f"{self.config.bus_prefix}.health")
        for request in bus.requests():
            if stop.is_set():
                return
            if request is None:
                continue
            subject, reply, body = request
            try:
                answer = self.handle(subject, body)
            except Exception as e:  # one request's failure is its own
                log.exception("request on %s failed", subject)
                answer = {"success": False, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}
            if reply:
                bus.publish(reply, json.dumps(answer).encode())

    # timers

    def start(self) -> None:
        """Drops idle subscriptions, and logs counters once a minute, until ``stop``."""

        def every(seconds: float, work) -> None:
            while not self._stop.wait(seconds):
                try:
                    work()
                except Exception:
                    log.exception("%s failed", work.__name__)

        def stats() -> None:
            log.info("subscriptions=%d queries=%d %s", *self.engine.registry.stats(), self.engine.metrics.snapshot())

        made = {"cleanup": (self.config.cleanup_interval_secs, self.cleanup), "stats": (60, stats)}
        self._timers = [threading.Thread(target=every, args=args, daemon=True, name=name) for name, args in made.items()]
        for t in self._timers:
            t.start()

    def stop(self) -> None:
        """Ends timers and listeners; waits for each as long as the settings say."""
        self._stop.set()
        for t in self._timers:
            t.join(self.config.shutdown_timeout_secs)
