"""The engine end to end: registry, service, streaming with restart, pruning soundness, and the corpus."""

import json
import random
from collections import Counter

import pytest

from resultfeed.config import Config
from resultfeed.plans.analyze import Analyzer, QueryError
from resultfeed.registry import Registry, SubscriptionError
from resultfeed.service import Service, SubscribeRequest
from resultfeed.sources import changelog
from resultfeed.streaming.engine import Engine
from resultfeed.streaming.sinks import BusSink, JsonLinesSink, MemorySink

ORDERS = "id int, user_id int, product string, amount decimal(10,2), status string"
ROWS = [(1, 1, "a", "10.00", "pending"), (2, 1, "b", "20.00", "pending"), (3, 2, "c", "30.00", "completed"), (4, 2, "d", "40.00", "shipped"), (5, 3, "e", "50.00", "pending"), (6, 3, "f", "60.00", "shipped")]
PENDING = "SELECT * FROM orders WHERE status = 'pending'"


def orders(spark, rows=ROWS):
    from decimal import Decimal

    return spark.createDataFrame([(*r[:3], Decimal(r[3]), r[4]) for r in rows], ORDERS)


def engine_of(spark, path, sink=None, **config):
    registry = Registry(Analyzer(spark), max_subscriptions=100)
    return Engine(spark, str(path), registry, sink or MemorySink(), Config(**config))


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_registry(spark):
    clock = Clock()
    r = Registry(Analyzer(spark), 3, clock)
    a, new = r.subscribe("s1", "SELECT * FROM users")
    b, again = r.subscribe("s2", "select  *  from users")
    assert new and not again and a is b and r.stats() == (2, 1)
    with pytest.raises(SubscriptionError, match="already exists"):
        r.subscribe("s1", "SELECT * FROM users")
    with pytest.raises(QueryError, match="Only SELECT"):
        r.subscribe("x", "INSERT INTO t VALUES (1)")
    with pytest.raises(QueryError, match="No table"):
        r.subscribe("x", "SELECT 1")
    with pytest.raises(SubscriptionError):
        r.subscribe("a.b", "SELECT * FROM users")
    c, other = r.subscribe("s3", "SELECT * FROM users", ("id",))
    assert other and c is not a  # identity columns are part of what is shared
    with pytest.raises(SubscriptionError, match="Max"):
        r.subscribe("s4", "SELECT * FROM users")
    assert r.has_table("USERS") and {q.id for q in r.for_tables(["users"])} == {a.id, c.id}
    assert r.unsubscribe("s3") == (True, c) and r.unsubscribe("s3") == (False, None)
    assert r.unsubscribe("s1") == (True, None) and r.stats() == (1, 1)
    clock.now = 10
    assert r.heartbeat("s2") and not r.heartbeat("nobody")
    clock.now = 20
    assert r.cleanup(11)[0] == [] and r.cleanup(10)[0] == ["s2"]
    assert r.stats() == (0, 0) and not r.has_table("users")


def change(lsn, op, before=None, after=None, tbl="orders", tx=None, partial=False):
    return (lsn, 0, tx or lsn, tbl, op, before and json.dumps(before), after and json.dumps(after), partial)


def row(i, status, amount="1.00"):
    return {"id": i, "user_id": 1, "product": "p", "amount": amount, "status": status}


def batch(spark, *changes):
    return spark.createDataFrame(list(changes), changelog.SCHEMA)


def test_demo_changes(spark, tmp_path):
    e = engine_of(spark, tmp_path)
    e.add_table("orders", orders(spark), ["id"])
    s = Service(e)
    got = s.subscribe("c1", SubscribeRequest(PENDING, ["id"])).to_dict()
    assert got["success"] and got["is_new"] and len(got["events"]) == 3 and got["seq"] == 0 and got["events"][0]["mz_timestamp"] > 0
    assert sorted(x["data"]["amount"] for x in got["events"]) == ["10.00", "20.00", "50.00"]
    late = s.subscribe("c2", SubscribeRequest(PENDING, ["id"], "snapshot")).to_dict()
    assert not late["is_new"] and len(late["snapshot"]) == 3 and "events" not in late
    assert {x["mz_timestamp"] for x in s.subscribe("c3", SubscribeRequest(PENDING, ["id"])).events} == {0}
    e.process(batch(spark, change(1, "I", after=row(7, "pending"))), 0)
    e.process(batch(spark, change(2, "U", after=row(1, "shipped"))), 1)  # leaves the filter
    e.process(batch(spark, change(3, "U", after=row(4, "completed"))), 2)  # neither side matches
    assert e.metrics["skipped"] == 1 and e.metrics["incremental"] == 2 and e.metrics["requeries"] == 0
    e.process(batch(spark, change(4, "D", before={"id": 2}), change(5, "I", after=row(9, "shipped"), tx=4)), 3)
    messages = e.sink.of("c1")
    assert [m["seq"] for m in messages] == [1, 2, 3]
    assert [[(x["mz_diff"], x["data"]["id"]) for x in m["events"]] for m in messages] == [[(1, 7)], [(-1, 1)], [(-1, 2)]]
    assert [x["id"] for x in sorted(e.sink.of("c2")[-1]["snapshot"], key=lambda x: x["id"])] == [5, 7]
    e.process(batch(spark, change(6, "T")), 4)
    assert {x["mz_diff"] for x in e.sink.of("c1")[-1]["events"]} == {-1}
    assert s.health()["subscriptions"] == 3 and s.ping()
    assert s.handle("resultfeed.c2.unsubscribe") == {"success": True} and s.handle("resultfeed.c2.heartbeat") == {"success": False}
    assert s.handle("resultfeed.health")["queries"] == 1 and not s.handle("resultfeed..subscribe")["success"]
    assert s.handle("resultfeed.c9.subscribe", b"{}")["error"].startswith("Invalid request")
    assert "Query failed" in s.handle("resultfeed.c9.subscribe", {"query": "SELECT nope FROM orders"})["error"]
    assert e.registry.subscription("c9") is None
    assert set(s.cleanup(0)) == {"c1", "c3"}


def test_stream_restart_and_replay(spark, tmp_path):
    log, root, checkpoint = tmp_path / "log", tmp_path / "state", str(tmp_path / "checkpoint")
    log.mkdir()

    def write(n, *changes):
        text = "".join(json.dumps(dict(zip(changelog.SCHEMA.names, c, strict=True))) + "\n" for c in changes)
        (tmp_path / f"{n}.json").write_text(text)
        (tmp_path / f"{n}.json").rename(log / f"{n}.json")

    def run(e):
        q = e.start(changelog.read_files(spark, str(log)), checkpoint)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    sink = MemorySink()
    e = engine_of(spark, root, sink)
    e.add_table("orders", orders(spark), ["id"])
    Service(e).subscribe("c1", SubscribeRequest(PENDING, ["id"]))
    write(1, change(1, "I", after=row(7, "pending")), change(2, "U", after=row(7, "shipped"), tx=1), change(3, "I", after=row(8, "pending"), tx=1))
    run(e)
    assert [(x["mz_diff"], x["data"]["id"]) for x in sink.of("c1")[0]["events"]] == [(1, 8)]  # several changes of a key count as the last

    class Fails(MemorySink):
        def write(self, b):
            super().write(b)
            raise RuntimeError("sink is down")

    write(2, change(4, "D", before={"id": 8}))
    again = engine_of(spark, root, Fails())
    assert again.restore() and again.registry.stats() == (1, 1)
    with pytest.raises(Exception, match="sink is down"):
        run(again)
    final = engine_of(spark, root, sink)
    assert final.restore()
    run(final)
    assert [m["seq"] for m in sink.of("c1")] == [1, 2]
    assert [(x["mz_diff"], x["data"]["id"]) for x in sink.of("c1")[1]["events"]] == [(-1, 8)]


QUERIES = [
    PENDING, "SELECT id, amount FROM orders WHERE amount > 30", "SELECT status, COUNT(*) AS n FROM orders WHERE user_id = 1 GROUP BY status",
    "SELECT o.id FROM orders o WHERE o.status IN ('shipped', 'completed') AND o.product LIKE 'p%'", "SELECT id FROM orders WHERE product IS NULL",
    "SELECT id FROM orders WHERE NOT (status = 'pending') ORDER BY amount DESC, id LIMIT 3", "SELECT id FROM orders WHERE user_id = 'x'", "SELECT a.id FROM orders a JOIN orders b ON a.user_id = b.id WHERE a.status = 'pending'",
]


def test_skipping_is_sound_and_events_fold_to_results(spark, tmp_path):
    """Random changes: folding all events gives the query's result, so no skipped query had changed."""
    rng = random.Random(3)
    e = engine_of(spark, tmp_path)
    e.add_table("orders", orders(spark), ["id"])
    s, state = Service(e), {}
    for i, q in enumerate(QUERIES):
        got = s.subscribe(f"q{i}", SubscribeRequest(q))
        if i == 6:
            assert not got.success or got.events == []  # a type error in the query itself
            continue
        state[f"q{i}"] = Counter(json.dumps(x["data"]) for x in got.events)
    lsn, alive = 10, {r[0] for r in ROWS}
    for n in range(4):
        changes = []
        for _ in range(rng.randint(1, 3)):
            lsn += 1
            i = rng.randint(1, 9)
            r = {"id": i, "user_id": rng.randint(1, 3), "product": rng.choice(["p1", "q", None]), "amount": f"{rng.randint(1, 60)}.00", "status": rng.choice(["pending", "shipped", "completed"])}
            if i in alive and rng.random() < 0.4:
                changes.append(change(lsn, "D", before={"id": i}))
                alive.discard(i)
            else:
                changes.append(change(lsn, "U" if i in alive else "I", after=r))
                alive.add(i)
        e.process(batch(spark, *changes), n)
    for sub, rows in state.items():
        for m in e.sink.of(sub):
            for x in m["events"]:
                rows[json.dumps(x["data"])] += x["mz_diff"]
        query = e.registry.query(e.registry.subscription(sub).query_id)
        now = e.run_query(spark, query.analysis.sql)
        from resultfeed.streaming.sinks import data_json

        assert +rows == Counter(r.v for r in now.select(data_json(now).alias("v")).collect()) or Counter(map(lambda t: json.dumps(json.loads(t)), (r.v for r in now.select(data_json(now).alias("v")).collect()))) == +rows, query.sql


def test_other_sinks(spark, tmp_path):
    sent = []
    e = engine_of(spark, tmp_path / "a", BusSink(lambda subject, body: sent.append((subject, json.loads(body))), lambda sub: f"x.{sub}.changes"))
    e.add_table("orders", orders(spark), ["id"])
    Service(e).subscribe("c1", SubscribeRequest(PENDING, ["id"]))
    e.process(batch(spark, change(1, "I", after=row(7, "pending"))), 0)
    assert sent[0][0] == "x.c1.changes" and sent[0][1]["seq"] == 1 and sent[0][1]["events"][0]["data"]["id"] == 7
    e.sink = JsonLinesSink(str(tmp_path / "out"))
    e.process(batch(spark, change(2, "I", after=row(8, "pending"))), 1)
    got = spark.read.json(str(tmp_path / "out"))
    assert [(r.seq, r.batch, r.event.data.id) for r in got.collect()] == [(2, 1, 8)]


def _station_tables(spark):
    """A small network of weather stations: the tables of the questions below."""

    def make(name, schema, rows):
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)

    make("region", "code string, label string, parent string", [("N", "north", None), ("N1", "north coast", "N"), ("S", "south", None), ("E", "east", None)])
    make("station", "sid int, code string, height int, sensors array<string>, facts string, online boolean", [
        (11, "N1", 4, ["rain", "wind"], '{"maker": "ada"}', True), (12, "N1", 250, ["wind"], '{"maker": "bell", "roof": {"m": 3}}', True),
        (13, "S", 900, ["snow", "rain"], "{}", False), (14, "S", 35, [], None, True), (15, None, 60, ["rain"], '{"maker": "ada"}', None)])
    make("visit", "vid int, sid int, who string, hours double, state string", [
        (1, 11, "kim", 2.5, "done"), (2, 11, "lee", 1.0, "open"), (3, 12, "kim", 4.0, "done"), (4, 13, "lee", 8.0, "done"), (5, 13, "kim", None, "open"), (6, 14, "kim", 0.5, "late")])
    make("part_used", "vid int, part string, n int", [(1, "vane", 1), (1, "bolt", 8), (3, "bolt", 2), (4, "lens", 1), (4, "bolt", 3)])
    make("price", "part string, cents int", [("vane", 12900), ("bolt", 40), ("lens", 45000)])


#: A feature of SQL, a question that needs it, the tables to index, and its rows (sorted as text).
QUESTIONS = [
    ("distinct", "SELECT DISTINCT who FROM visit", ("visit",), [("kim",), ("lee",)]),
    ("boolean literal", "SELECT sid FROM station WHERE online = true AND height < 100", ("station",), [(11,), (14,)]),
    ("array membership", "SELECT sid FROM station WHERE 'rain' = ANY(sensors)", ("station",), [(11,), (13,), (15,)]),
    ("json field", "SELECT sid, facts->'roof'->>'m' AS m FROM station WHERE facts->>'maker' = 'bell'", ("station",), [(12, "3")]),
    ("top-k", "SELECT sid FROM station ORDER BY height DESC LIMIT 2", ("station",), [(12,), (13,)]),
    ("nulls last", "SELECT vid FROM visit ORDER BY hours DESC NULLS LAST, vid LIMIT 5", ("visit",), [(1,), (2,), (3,), (4,), (6,)]),
    ("left join", "SELECT r.code, s.sid FROM region r LEFT JOIN station s ON s.code = r.code AND s.online", ("region", "station"), [("E", None), ("N", None), ("N1", 11), ("N1", 12), ("S", 14)]),
    ("inner join", "SELECT v.vid, s.height FROM visit v INNER JOIN station s ON s.sid = v.sid WHERE v.state = 'open'", ("station", "visit"), [(2, 4), (5, 900)]),
    ("four tables", "SELECT v.who, s.code, u.part, u.n * p.cents AS cents FROM part_used u JOIN price p ON p.part = u.part JOIN visit v ON v.vid = u.vid JOIN station s ON s.sid = v.sid WHERE p.cents > 10000", ("part_used", "price", "station", "visit"), [("kim", "N1", "vane", 12900), ("lee", "S", "lens", 45000)]),
    ("count and sum", "SELECT state, COUNT(*) AS n, SUM(hours) AS h FROM visit GROUP BY state", ("visit",), [("done", 3, 14.5), ("late", 1, 0.5), ("open", 2, 1.0)]),
    ("average and having", "SELECT code, AVG(height) AS mean FROM station GROUP BY code HAVING COUNT(*) >= 2", ("station",), [("N1", 127.0), ("S", 467.5)]),
    ("in a subquery", "SELECT label FROM region WHERE code IN (SELECT code FROM station WHERE sid IN (SELECT sid FROM visit WHERE who = 'lee'))", ("region", "station", "visit"), [("north coast",), ("south",)]),
    ("derived table", "SELECT t.code FROM (SELECT r.code, COUNT(s.sid) AS n FROM region r LEFT JOIN station s ON s.code = r.code GROUP BY r.code) t WHERE t.n = 0", ("region", "station"), [("E",), ("N",)]),
    ("CTEs and coalesce", "WITH spent AS (SELECT u.vid, SUM(u.n * p.cents) AS cents FROM part_used u JOIN price p ON p.part = u.part GROUP BY u.vid), visit AS (SELECT * FROM visit WHERE who = 'kim') SELECT visit.vid, COALESCE(spent.cents, 0) AS cents FROM visit LEFT JOIN spent ON spent.vid = visit.vid", ("part_used", "price", "visit"), [(1, 13220), (3, 80), (5, 0), (6, 0)]),
    ("row number", "SELECT vid FROM (SELECT vid, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY vid DESC) AS age FROM visit) t WHERE age = 1", ("visit",), [(2,), (3,), (5,), (6,)]),
    ("case", "SELECT sid, CASE WHEN height >= 500 THEN 'peak' WHEN height >= 50 THEN 'hill' END AS place FROM station", ("station",), [(11, None), (12, "hill"), (13, "peak"), (14, None), (15, "hill")]),
    ("union all", "SELECT part AS name, 'part' AS what FROM price UNION ALL SELECT label, 'region' FROM region WHERE parent IS NOT NULL", ("price", "region"), [("bolt", "part"), ("lens", "part"), ("north coast", "region"), ("vane", "part")]),
]


def test_questions(spark):
    _station_tables(spark)
    a = Analyzer(spark)
    for feature, sql, tables, rows in QUESTIONS:
        found = a.analyze(sql)
        assert found.tables == tables, feature
        assert sorted((tuple(r) for r in spark.sql(found.sql).collect()), key=str) == sorted(rows, key=str), feature
        assert found.rowwise == (feature in ("boolean literal", "array membership", "json field", "case")), feature


class Server:
    """The table as a database would have it, record by record."""

    NAMES = ("id", "user_id", "product", "amount", "status")

    def __init__(self, rng):
        self.rng, self.rows, self.lsn = rng, {r[0]: dict(zip(self.NAMES, r, strict=True)) for r in ROWS}, 0

    def step(self):
        rng, self.lsn = self.rng, self.lsn + 1
        values = {"user_id": rng.randint(1, 3), "product": rng.choice(["p1", "q", None]), "amount": f"{rng.randint(1, 60)}.00", "status": rng.choice(["pending", "shipped", None])}
        kind = rng.random()
        if kind < 0.02:
            self.rows = {}
            return change(self.lsn, "T")
        if not self.rows or kind < 0.25:
            i = next(i for i in range(1, 99) if i not in self.rows and rng.random() < 0.5)
            self.rows[i] = {"id": i, **values}
            return change(self.lsn, "I", after=self.rows[i])
        i = rng.choice(sorted(self.rows))
        if kind < 0.4:
            old = self.rows.pop(i)
            return change(self.lsn, "D", before=old if rng.random() < 0.3 else {"id": i})
        old, partial = dict(self.rows[i]), rng.random() < 0.6
        told = {k: v for k, v in values.items() if not partial or rng.random() < 0.4}
        to = next(j for j in range(100, 999) if j not in self.rows) if rng.random() < 0.3 else i
        del self.rows[i]
        self.rows[to] = {**old, **told, "id": to}
        before = {"id": i} if to != i else old if rng.random() < 0.3 else None
        return change(self.lsn, "U", before=before, after={"id": to, **told}, partial=partial)


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_and_results_follow_a_server(spark, tmp_path, monkeypatch, seed):
    """Random batches of full, partial, null-setting and key-changing records, deletes and truncations, with merges and
    compactions: the engine's table is the server's, and each client's events add up to its query's result."""
    from resultfeed.streaming import engine as module

    monkeypatch.setattr(module, "MERGE", 3)
    monkeypatch.setattr(module, "COMPACT_SHARE", 0.02)
    rng = random.Random(seed)
    server, e = Server(rng), engine_of(spark, tmp_path)
    e.add_table("orders", orders(spark), ["id"])
    s, state = Service(e), {}
    for i, q in enumerate([PENDING, "SELECT status, COUNT(*) AS n FROM orders GROUP BY status", "SELECT id FROM orders WHERE product IS NULL", "SELECT user_id, product FROM orders"]):
        state[f"q{i}"] = Counter(json.dumps(x["data"]) for x in s.subscribe(f"q{i}", SubscribeRequest(q, ["id"] if i == 0 else [])).events)
    for n in range(7):
        e.process(batch(spark, *[server.step() for _ in range(rng.randint(1, 12))]), n)
        now = {r.id: tuple(r) for r in e.table(spark, e.tables["orders"]).collect()}
        want = {i: (r["id"], r["user_id"], r["product"], r["amount"], r["status"]) for i, r in server.rows.items()}
        assert {i: (*r[:3], str(r[3]), r[4]) for i, r in now.items()} == want, n
    e.compact("orders")
    assert not e.tables["orders"].deltas and e.table(spark, e.tables["orders"]).count() == len(server.rows)
    for sub, rows in state.items():
        for m in e.sink.of(sub):
            for x in m["events"]:
                rows[json.dumps(x["data"])] += x["mz_diff"]
        query = e.registry.query(e.registry.subscription(sub).query_id)
        from resultfeed.streaming.sinks import data_json

        now = e.run_query(spark, query.analysis.sql)
        assert +rows == Counter(json.dumps(json.loads(r.v)) for r in now.select(data_json(now).alias("v")).collect()), query.sql


def test_a_batch_writes_its_changes_only(spark, tmp_path, monkeypatch):
    from resultfeed.streaming import engine as module

    monkeypatch.setattr(module, "MERGE", 4)
    e = engine_of(spark, tmp_path)
    big = spark.range(20_000).selectExpr("CAST(id AS INT) AS id", "1 AS user_id", "repeat('x', 50) AS product", "CAST(1 AS DECIMAL(10,2)) AS amount", "'shipped' AS status")
    e.add_table("orders", big, ["id"])
    Service(e).subscribe("c1", SubscribeRequest(PENDING, ["id"]))
    size = lambda path: sum(f.stat().st_size for f in path.rglob("*") if f.is_file())
    base = size(tmp_path / "tables")
    for n in range(10):
        e.process(batch(spark, change(n + 1, "U", after=row(n, "pending"))), n)
        held = {p.name for p in (tmp_path / "tables" / "orders").iterdir() if p.is_dir()}
        assert len(held) <= 1 + 4 + 1 + 4 and size(tmp_path / "tables") < base + 40_000, held  # base, deltas, and those of the version before
    deltas = e.tables["orders"].deltas
    assert [d.level for d in deltas] == [1, 1, 0, 0] and [spark.read.parquet(d.path).count() for d in deltas] == [4, 4, 1, 1]
    assert not (tmp_path / "snapshots").exists() and not (tmp_path / "events").exists()
    assert len(e.sink.of("c1")) == 10
    e.compact("orders")
    e.process(batch(spark, change(20, "D", before={"id": 3})), 10)
    e.process(batch(spark, change(21, "D", before={"id": 4})), 11)
    assert len([p for p in (tmp_path / "tables" / "orders").iterdir() if p.is_dir() and p.name.startswith("base")]) == 1
    assert e.table(spark, e.tables["orders"]).count() == 19_998


def test_subscriptions_outlive_the_process(spark, tmp_path):
    e = engine_of(spark, tmp_path)
    e.add_table("orders", orders(spark), ["id"])
    s, odd = Service(e), "Ünï/c%"
    s.subscribe("c1", SubscribeRequest(PENDING, ["id"]))
    s.subscribe(odd, SubscribeRequest("SELECT COUNT(*) AS n FROM orders", [], "snapshot"))
    s.subscribe("c3", SubscribeRequest(PENDING, ["id"]))
    s.unsubscribe("c3")
    again = engine_of(spark, tmp_path)
    assert again.restore() and again.registry.stats() == (2, 2) and again.registry.subscription(odd).mode == "snapshot"
    again.process(batch(spark, change(1, "I", after=row(7, "pending"))), 0)
    assert again.sink.of("c1")[0]["events"][0]["data"]["id"] == 7 and again.sink.of(odd)[0]["snapshot"] == [{"n": 7}]
    assert sorted(Service(again).cleanup(0)) == ["c1", odd] and not any((tmp_path / "subscriptions").glob("*.json"))


def test_heartbeats_do_not_wait_for_a_batch(spark, tmp_path):
    import threading

    inside, go, answers = threading.Event(), threading.Event(), []

    class Slow(MemorySink):
        def write(self, b):
            inside.set()
            assert go.wait(60)
            return super().write(b)

    e = engine_of(spark, tmp_path, Slow())
    e.add_table("orders", orders(spark), ["id"])
    s = Service(e)
    s.subscribe("c1", SubscribeRequest(PENDING, ["id"]))
    s.subscribe("c2", SubscribeRequest("SELECT COUNT(*) AS n FROM orders"))
    work = threading.Thread(target=lambda: e.process(batch(spark, change(1, "I", after=row(7, "pending"))), 0))
    work.start()
    assert inside.wait(60)
    other = threading.Thread(target=lambda: answers.extend([s.heartbeat("c1"), s.unsubscribe("c2"), s.health()["subscriptions"], s.pool_status()[2] > 0]))
    other.start()
    other.join(20)
    assert answers == [True, True, 1, True] and work.is_alive()
    go.set()
    work.join(60)
    assert len(e.sink.of("c1")) == 1
    e.process(batch(spark, change(2, "I", after=row(8, "pending"))), 1)
    assert not [p for p in (tmp_path / "snapshots").glob("*") if list(p.iterdir())]  # of c2, whose query stopped in the middle of a batch


def test_restart_after_failures(spark, tmp_path):
    import threading

    log, waits, stop = tmp_path / "log", [], threading.Event()
    log.mkdir()

    class Fails(MemorySink):
        left = 3

        def write(self, b):
            if self.left:
                self.left -= 1
                raise RuntimeError("sink is down")
            n = super().write(b)
            stop.set()
            return n

    e = engine_of(spark, tmp_path / "state", Fails())
    e.add_table("orders", orders(spark), ["id"])
    Service(e).subscribe("c1", SubscribeRequest(PENDING, ["id"]))
    (log / "1.json").write_text(json.dumps(dict(zip(changelog.SCHEMA.names, change(1, "I", after=row(7, "pending")), strict=True))))
    e.run(lambda: changelog.read_files(spark, str(log)), str(tmp_path / "c"), stop, lambda s: waits.append(s))
    assert waits == [1.0, 2.0, 4.0] and e.metrics["restarts"] == 3 and [m["seq"] for m in e.sink.of("c1")] == [1]


def test_many_first_rows(spark, tmp_path):
    e = engine_of(spark, tmp_path, inline_rows=4)
    e.add_table("orders", orders(spark), ["id"])
    s = Service(e)
    got = s.subscribe("c1", SubscribeRequest("SELECT * FROM orders ORDER BY id", [], "snapshot"))
    assert got.success and not got.snapshot and [json.loads(r.value)["id"] for r in spark.read.text(got.location).collect()] == [1, 2, 3, 4, 5, 6]
    assert len(s.subscribe("c2", SubscribeRequest("SELECT * FROM orders LIMIT 4")).events) == 4
    sent = []
    e.sink = BusSink(lambda subject, body: sent.append(json.loads(body)), str, most=2)
    e.process(batch(spark, *[change(i, "I", after=row(i, "pending")) for i in range(10, 15)]), 0)
    parts = [m for m in sent if "snapshot" in m]
    assert [(m["part"], m["last"], len(m["snapshot"])) for m in parts] == [(i, i == 5, 2 if i < 5 else 1) for i in range(6)]


def test_results_with_odd_names(spark, tmp_path):
    e = engine_of(spark, tmp_path)
    e.add_table("orders", orders(spark), ["id"])
    s = Service(e)
    for i, sql in enumerate(['SELECT id, status AS mz_diff, product AS "a.b", amount AS id, user_id AS id_1 FROM orders', 'SELECT status AS mz_diff, COUNT(*) AS "x.y", MAX(id) AS _n, 1 AS mz_diff FROM orders GROUP BY status']):
        got = s.subscribe(f"c{i}", SubscribeRequest(sql, ["id"] if not i else ["mz_diff"])).to_dict()
        assert got["success"], got
    assert got["events"][0]["data"].keys() == {"mz_diff", "x.y", "_n", "mz_diff_1"}
    e.process(batch(spark, change(1, "U", after=row(1, "shipped"))), 0)
    first, second = e.sink.of("c0")[0]["events"], e.sink.of("c1")[0]["events"]
    assert [(x["mz_diff"], x["data"]["mz_diff"], x["data"]["a.b"]) for x in first] == [(-1, "pending", "a"), (1, "shipped", "p")]
    assert sorted((x["mz_diff"], x["data"]["mz_diff"], x["data"]["x.y"]) for x in second) == [(-1, "pending", 3), (-1, "shipped", 2), (1, "pending", 2), (1, "shipped", 3)]


def test_sample(spark, tmp_path):
    e = engine_of(spark, tmp_path)
    e.add_table("orders", orders(spark), ["id"])
    s = Service(e)
    assert s.sample("SELECT id FROM orders ORDER BY id", 2) == {"success": True, "row_count": 6, "rows": [{"id": 1}, {"id": 2}]}
    assert not s.sample("DROP TABLE orders")["success"] and not s.sample("SELECT nope FROM orders")["success"]


class FakeBus:
    def __init__(self, *requests):
        self.asked, self.sent, self._requests = [], [], requests

    def subscribe(self, subject):
        self.asked.append(subject)

    def requests(self):
        yield from self._requests

    def publish(self, subject, body):
        self.sent.append((subject, json.loads(body)))


def test_requests_over_a_bus(spark, tmp_path):
    e = engine_of(spark, tmp_path)
    e.add_table("orders", orders(spark), ["id"])
    bus = FakeBus(("resultfeed.c1.subscribe", "r1", json.dumps({"query": PENDING, "identity_columns": ["id"]}).encode()), None, ("resultfeed.c1.heartbeat", "r2", b""), ("resultfeed.c1.unsubscribe", None, b""), ("resultfeed.health", "r3", b""), ("resultfeed.c1.subscribe", "r4", b"not json"))
    Service(e).serve(bus)
    assert bus.asked == ["resultfeed.*.subscribe", "resultfeed.*.unsubscribe", "resultfeed.*.heartbeat", "resultfeed.health"]
    assert [s for s, _ in bus.sent] == ["r1", "r2", "r3", "r4"] and len(bus.sent[0][1]["events"]) == 3 and bus.sent[1][1] == {"success": True}
    assert bus.sent[2][1]["subscriptions"] == 0 and not bus.sent[3][1]["success"]
