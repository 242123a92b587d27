"""Replication, message bus and database, against small servers of the tests' own."""

import base64
import hashlib
import hmac
import json
import socket
import struct
import threading

import pytest
from test_sources import INSERT, begin, commit, relation, row

from resultfeed.bus import Bus
from resultfeed.config import Config
from resultfeed.plans.analyze import Analyzer
from resultfeed.registry import Registry
from resultfeed.service import Service, SubscribeRequest
from resultfeed.sources.database import Database, jdbc_url
from resultfeed.sources.pgoutput import PgOutputSource
from resultfeed.sources.replication import Replication, ServerError, Spooler, follow, lsn_text
from resultfeed.streaming.engine import Engine
from resultfeed.streaming.sinks import BusSink, MemorySink


class Server(threading.Thread):
    """Accepts connections and hands each to ``talk``, in order."""

    def __init__(self, *talks):
        super().__init__(daemon=True)
        self.talks, self.errors = talks, []
        self.listener = socket.create_server(("127.0.0.1", 0))
        self.port = self.listener.getsockname()[1]
        self.start()

    def run(self):
        for talk in self.talks:
            link, _ = self.listener.accept()
            link.settimeout(20)
            try:
                talk(link, link.makefile("rb"))
            except Exception as e:  # told to the test
                self.errors.append(e)
            finally:
                link.close()


def sent(kind, body=b""):
    return kind + struct.pack(">I", len(body) + 4) + body


def got(f):
    kind = f.read(1)
    return kind, f.read(struct.unpack(">I", f.read(4))[0] - 4)


def startup(f):
    size = struct.unpack(">I", f.read(4))[0]
    body = f.read(size - 4)
    return dict(zip(*[iter(body[4:].rstrip(b"\0").split(b"\0"))] * 2, strict=True))


READY = sent(b"S", b"server_version\x0016\0") + sent(b"Z", b"I")
OK = sent(b"R", struct.pack(">I", 0))


def login_md5(link, f, salt=b"abcd"):
    assert startup(f)[b"replication"] == b"database"
    link.sendall(sent(b"R", struct.pack(">I", 5) + salt))
    inner = hashlib.md5(b"secretann").hexdigest().encode()
    assert got(f) == (b"p", b"md5" + hashlib.md5(inner + salt).hexdigest().encode() + b"\0")
    link.sendall(OK + READY)


def login_scram(link, f, password=b"secret"):
    startup(f)
    link.sendall(sent(b"R", struct.pack(">I", 10) + b"SCRAM-SHA-256\0\0"))
    _, body = got(f)
    assert body.startswith(b"SCRAM-SHA-256\0")
    bare = body[len(b"SCRAM-SHA-256\0") + 4 :].removeprefix(b"n,,")
    salt, nonce = b"saltsalt", bare.split(b"r=")[1] + b"server"
    first = b"r=" + nonce + b",s=" + base64.b64encode(salt) + b",i=4096"
    link.sendall(sent(b"R", struct.pack(">I", 11) + first))
    _, final = got(f)
    bare_final, proof = final.split(b",p=")
    salted = hashlib.pbkdf2_hmac("sha256", password, salt, 4096)
    mac = lambda k, t: hmac.new(k, t, hashlib.sha256).digest()
    text = b",".join([bare, first, bare_final])
    key = bytes(a ^ b for a, b in zip(base64.b64decode(proof), mac(hashlib.sha256(mac(salted, b"Client Key")).digest(), text), strict=True))
    if key != mac(salted, b"Client Key"):
        return link.sendall(sent(b"E", b"SFATAL\0C28P01\0Mpassword authentication failed\0\0"))
    link.sendall(sent(b"R", struct.pack(">I", 12) + b"v=" + base64.b64encode(mac(mac(salted, b"Server Key"), text))) + OK + READY)


def start(link, f, made=True, at=0):
    _, text = got(f)
    assert text == b'CREATE_REPLICATION_SLOT "slot" LOGICAL pgoutput NOEXPORT_SNAPSHOT\0'
    link.sendall((sent(b"C", b"CREATE\0") if made else sent(b"E", b"SERROR\0C42710\0Malready exists\0\0")) + sent(b"Z", b"I"))
    _, text = got(f)
    assert b"START_REPLICATION SLOT \"slot\" LOGICAL 0/%d (proto_version '1', publication_names '\"pub\"')" % at in text
    link.sendall(sent(b"W", b"\0\0\0"))


def data(*messages):
    return b"".join(sent(b"d", b"w" + struct.pack(">QQq", 0, 0, 0) + m) for m in messages)


def flushed(f, at_least):
    """Reads status reports until one confirms a position."""
    while True:
        kind, body = got(f)
        if kind == b"d" and body[:1] == b"r" and struct.unpack_from(">Q", body, 9)[0] >= at_least:
            return struct.unpack_from(">Q", body, 9)[0]


def test_replication_from_server_to_client(spark, tmp_path):
    """Messages over two connections, the first of which breaks inside a transaction: spooled whole, read as a stream,
    delivered once, and confirmed only when they are on disk."""
    delete, confirmed, stop = b"D" + struct.pack(">I", 7) + b"K" + row(["1", *[None] * 7]), [], threading.Event()

    def first(link, f):
        login_md5(link, f)
        start(link, f)
        link.sendall(data(relation(), begin(5, 3), INSERT, commit(5)) + sent(b"d", b"k" + struct.pack(">QqB", 6, 0, 0)))
        threading.Event().wait(0.5)  # spooled meanwhile
        link.sendall(data(begin(8, 4), delete))

    def second(link, f):
        login_scram(link, f)
        start(link, f, made=False, at=6)
        link.sendall(data(relation(), begin(5, 3), INSERT, commit(5), begin(8, 4), delete, commit(8)))  # the first one again
        threading.Event().wait(0.5)
        link.sendall(sent(b"d", b"k" + struct.pack(">QqB", 9, 0, 1)))
        confirmed.append(flushed(f, 9))
        stop.set()

    server, waits = Server(first, second), []
    spooler = Spooler(str(tmp_path / "spool"))
    follow(f"postgres://ann:secret@127.0.0.1:{server.port}/shop", "slot", "pub", spooler, stop, 10, lambda s: waits.append(s))
    assert not server.errors and confirmed == [9] and waits == [1.0] and spooler.flushed == 9
    spark.dataSource.register(PgOutputSource)
    stream = spark.readStream.format("pgoutput").option("path", str(tmp_path / "spool")).option("maxFiles", "1").load()
    e = Engine(spark, str(tmp_path / "state"), Registry(Analyzer(spark)), MemorySink(), Config())
    schema = "id int, name string, email string, age int, active boolean, created_at timestamp_ntz, updated_at timestamp_ntz, data string"
    e.add_table("users", spark.createDataFrame([], schema), ["id"])
    Service(e).subscribe("c", SubscribeRequest("SELECT id, name, data->>'a' AS a FROM users WHERE age > 20", ["id"]))
    q = e.start(stream, str(tmp_path / "checkpoint"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    events = [[(x["mz_diff"], x["data"]) for x in m["events"]] for m in e.sink.of("c")]
    assert events == [[(1, {"id": 1, "name": "Ann", "a": "1"})], [(-1, {"id": 1, "name": "Ann", "a": "1"})]]


def test_logins(tmp_path):
    refused = Server(lambda link, f: login_scram(link, f, b"other"))
    with pytest.raises(ServerError, match="28P01"):
        Replication(f"postgres://ann:secret@127.0.0.1:{refused.port}/shop", 10)
    plain = Server(lambda link, f: (startup(f), link.sendall(sent(b"R", struct.pack(">I", 3))), got(f) == (b"p", b"secret\0") and link.sendall(OK + READY)))
    Replication(f"postgres://ann:secret@127.0.0.1:{plain.port}/shop", 10).close()
    with pytest.raises(ValueError, match="TLS"):
        Replication("postgres://ann@127.0.0.1/shop?sslmode=require")
    assert lsn_text(0x16B374D848) == "16/B374D848"


def test_spool(tmp_path):
    folder = tmp_path / "s"
    s = Spooler(str(folder), most_bytes=200)
    for n in range(6):
        for m in ([relation()] if not n else []) + [begin(n + 1, n), INSERT, commit(n + 1)]:
            s.take(m)
    s.take(begin(9, 9))  # open: not on disk
    s.flush()
    names = sorted(p.name for p in folder.iterdir() if p.suffix == ".tx")
    from resultfeed.sources.pgoutput import framed, transactions

    rows = [r for n in names for _, part in transactions(framed(str(folder / n))) for r in part]
    assert len(names) > 1 and [r[2] for r in rows] == list(range(6)) and s.flushed == 7  # each file stands by itself
    (folder / f"{99:020d}.part").write_bytes(b"torn")
    (folder / "last").write_text("0 2")  # the process ended before it wrote the mark
    assert (Spooler(str(folder)).next, Spooler(str(folder)).flushed) == (len(names), 7)
    (folder / "last").write_text(f"{len(names) - 1} 7")
    for n in names:
        (folder / n).unlink()
    again = Spooler(str(folder))
    assert again.next == len(names) and not list(folder.glob("*.part"))  # numbers don't come back


class BusServer(Server):
    """One subject's requests to the first connection; then it breaks, and the second one gets the rest."""

    def __init__(self, requests):
        self.published, self.subscribed, self.done = [], [], threading.Event()
        self.requests = requests
        super().__init__(self.talk, self.talk)

    def talk(self, link, f):
        link.sendall(b'INFO {"server_id":"x"}\r\n')
        assert f.readline().startswith(b"CONNECT {")
        assert f.readline() == b"PING\r\n"
        link.sendall(b"PONG\r\n")
        subjects = [f.readline().split()[1].decode() for _ in range(4)]
        self.subscribed.append(subjects)
        link.sendall(b"PING\r\n")
        assert f.readline() == b"PONG\r\n"
        for subject, reply, body in self.requests.pop(0):
            link.sendall(f"MSG {subject} 1 {reply} {len(body)}\r\n".encode() + body + b"\r\n")
            while True:
                _, to, size = f.readline().split()
                self.published.append((to.decode(), json.loads(f.read(int(size) + 2))))
                if to.decode() == reply:
                    break
        if not self.requests:
            self.done.set()


def test_service_over_a_bus(spark, tmp_path):
    ask = json.dumps({"query": "SELECT id FROM t WHERE id > 1", "identity_columns": ["id"]}).encode()
    server = BusServer([[("resultfeed.c1.subscribe", "_r.1", ask)], [("resultfeed.c1.heartbeat", "_r.2", b""), ("resultfeed.health", "_r.3", b"")]])
    bus = Bus(f"nats://u:p@127.0.0.1:{server.port}", pause=0.05)
    e = Engine(spark, str(tmp_path), Registry(Analyzer(spark)), BusSink(bus.publish, lambda sub: f"resultfeed.{sub}.changes"), Config())
    e.add_table("t", spark.createDataFrame([(1,), (2,)], "id long"), ["id"])
    stop = threading.Event()
    work = threading.Thread(target=Service(e).serve, args=(bus, stop), daemon=True)
    work.start()
    assert server.done.wait(60) and not server.errors
    stop.set()
    bus.close()
    (_, first), (_, beat), (_, health) = server.published
    assert first["success"] and [x["data"] for x in first["events"]] == [{"id": 2}] and beat == {"success": True} and health["subscriptions"] == 1
    assert server.subscribed[0] == server.subscribed[1] and "resultfeed.health" in server.subscribed[0]
    with pytest.raises(ValueError):
        bus.publish("a b", b"")


def test_database(spark, tmp_path):
    assert jdbc_url("postgres://u%40x:p@db:5433/shop?sslmode=require") == ("jdbc:postgresql://db:5433/shop?sslmode=require", {"user": "u@x", "password": "p"})
    url = "jdbc:derby:memory:resultfeed;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1, 101).selectExpr("CAST(id AS INT) AS ID", "CONCAT('n', id) AS NAME")
    try:
        rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "people").save()
    except Exception as e:
        pytest.skip(f"no embedded database: {str(e).splitlines()[0]}")
    db = Database(spark, Config(database_url=url, db_pool_size=4), driver)
    assert db.ping()
    whole = db.table("people", "ID")
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 100
    e = Engine(spark, str(tmp_path), Registry(Analyzer(spark)), MemorySink(), Config())
    db.load(e, "people", ["ID"], "ID")
    assert [r.name for r in spark.sql("SELECT name FROM people WHERE id = 7").collect()] == ["n7"]
