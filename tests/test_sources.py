import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resultfeed.config import Config, Metrics, mask_url, setup_logging
from resultfeed.functions.encode import content_key, from_row_json, row_json
from resultfeed.functions.types import oid_type, spark_type, text_value
from resultfeed.sources import changelog
from resultfeed.sources.pgoutput import Decoder, PgOutputSource, transactions
from resultfeed.sources.replication import Spooler

COLUMNS = [("id", 23), ("name", 25), ("email", 25), ("age", 23), ("active", 16), ("created_at", 1114), ("updated_at", 1114), ("data", 3802)]


def relation(oid=7, table="Users", columns=COLUMNS, keys=("id",)):
    body = b"R" + struct.pack(">I", oid) + b"public\0" + table.encode() + b"\0d" + struct.pack(">H", len(columns))
    return body + b"".join(bytes([name in keys]) + name.encode() + b"\0" + struct.pack(">Ii", kind, -1) for name, kind in columns)


def row(values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += v if isinstance(v, bytes) else b"n" if v is None else b"t" + struct.pack(">I", len(v.encode())) + v.encode()
    return out


def begin(lsn=5, xid=9):
    return b"B" + struct.pack(">QqI", lsn, 0, xid)


def commit(lsn=5):
    return b"C\0" + struct.pack(">QQq", lsn, lsn + 1, 0)


ROW = ["1", "Ann", None, "30", "t", "2024-01-01 00:00:00", None, '{"a": 1}']
INSERT = b"I" + struct.pack(">I", 7) + b"N" + row(ROW)


def test_decode_rows():
    d = Decoder()
    assert d.decode(INSERT) is None  # no relation yet
    assert d.decode(relation()).table == "users"
    c = d.decode(INSERT)
    assert (c.kind, c.table, c.before) == ("insert", "users", None)
    assert c.after == {"id": 1, "name": "Ann", "email": None, "age": 30, "active": True, "created_at": "2024-01-01 00:00:00", "updated_at": None, "data": '{"a": 1}'}
    new = row(["1", "Bea", None, "31", "f", b"u", None, None])
    full = d.decode(b"U" + struct.pack(">I", 7) + b"O" + row(ROW) + b"N" + new)
    assert full.before["name"] == "Ann" and full.after["name"] == "Bea" and full.partial and "created_at" not in full.after
    keyed = d.decode(b"U" + struct.pack(">I", 7) + b"K" + row(["1", *[None] * 7]) + b"N" + row(ROW))
    assert keyed.before == {"id": 1} and not keyed.partial
    gone = d.decode(b"D" + struct.pack(">I", 7) + b"K" + row(["1", *[None] * 7]))
    assert gone.kind == "delete" and gone.before == {"id": 1} and gone.after is None
    assert d.decode(b"T" + struct.pack(">IB", 2, 0) + struct.pack(">II", 7, 8)).tables == ("users",)
    assert d.decode(b"I" + struct.pack(">I", 7) + b"N" + struct.pack(">H", 1) + b"b" + struct.pack(">I", 2) + b"\xde\xad").after == {"id": "\\xdead"}


def test_decode_control_and_damage():
    d = Decoder()
    b = d.decode(begin())
    assert (b.kind, b.lsn, b.xid) == ("begin", 5, 9)
    assert d.decode(commit()).kind == "commit"
    assert d.decode(b"Y whatever").kind == "other"
    d.decode(relation())
    for whole in (begin(), commit(), relation(), INSERT):
        for n in range(len(whole)):
            assert d.decode(whole[:n]) is None or n == 0 or d.decode(whole[:n]).kind in ("other",), (whole[:1], n)


def test_values():
    assert text_value("t", 16) is True and text_value("f", 16) is False
    assert text_value("42", 23) == 42 and text_value("3.14", 701) == 3.14 and text_value("x", 23) == "x"
    assert oid_type(1700, ((10 << 16) | 2) + 4) == T.DecimalType(10, 2)
    assert spark_type("numeric(10,2)") == T.DecimalType(10, 2) and spark_type("TEXT[]") == T.ArrayType(T.StringType()) and spark_type("inet") == T.StringType()


def test_transactions_are_whole():
    got = list(transactions(iter([relation(), begin(1, 3), INSERT, INSERT, commit(), begin(2, 4), INSERT])))
    assert len(got) == 1 and [r[:5] for r in got[0][1]] == [(1, 0, 3, "users", "I"), (1, 1, 3, "users", "I")]
    late = list(transactions(iter([relation(), begin(0x1000 << 32, 3), INSERT, commit()])))
    assert late[0][1][0][0] == 0x1000 << 32


def test_stream_source(spark, tmp_path):
    s = Spooler(str(tmp_path / "spool"), most_bytes=1)
    for m in [relation(), begin(1, 3), INSERT, commit(), begin(2, 4), b"D" + struct.pack(">I", 7) + b"K" + row(["1", *[None] * 7]), commit()]:
        s.take(m)
    spark.dataSource.register(PgOutputSource)
    seen = []

    def run():
        stream = spark.readStream.format("pgoutput").option("path", str(tmp_path / "spool")).option("maxFiles", "1").load()
        q = stream.writeStream.foreachBatch(lambda df, n: seen.append([tuple(r) for r in df.select("tx", "tbl", "op").collect()])).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert [x for x in seen if x] == [[(3, "users", "I")], [(4, "users", "D")]]
    for m in [begin(3, 5), INSERT, commit()]:
        s.take(m)
    run()
    assert [x for x in seen if x][2:] == [[(5, "users", "I")]]
    assert len(list((tmp_path / "spool").glob("*.tx"))) <= 2  # what finished batches have read is gone


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def test_next_version(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], SCHEMA)
    j = lambda i, v="x": f'{{"id": {i}, "v": "{v}"}}'
    log = spark.createDataFrame([
        (1, 0, 1, "t", "I", None, j(4, "d"), False), (1, 1, 1, "t", "U", None, j(1, "a1"), False), (1, 2, 1, "t", "U", None, j(1, "a2"), False), (2, 0, 1, "t", "D", j(2), None, False),
        (2, 1, 1, "t", "I", None, j(2, "again"), False), (3, 0, 1, "t", "U", j(3, "c"), j(9, "moved"), False), (4, 0, 1, "t", "U", None, '{"id": 4}', True), (4, 1, 1, "t", "U", None, '{"id": 2, "v": null}', True),
    ], changelog.SCHEMA)
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(changelog.next_version(t, log.where("lsn < 4"), ["id"])) == {(1, "a2"), (2, "again"), (4, "d"), (9, "moved")}
    assert rows(changelog.next_version(t, log, ["id"])) == {(1, "a2"), (2, None), (4, "d"), (9, "moved")}  # what a partial record lacks stays; null is set
    wiped = spark.createDataFrame([(1, 0, 1, "t", "I", None, j(7), False), (2, 0, 1, "t", "T", None, None, False), (3, 0, 1, "t", "I", None, j(8), False)], changelog.SCHEMA)
    assert rows(changelog.next_version(t, wiped, ["id"])) == {(8, "x")}
    # moves of moves, with values that no record tells
    chain = spark.createDataFrame([(n, 0, 1, "t", "U", f'{{"id": {a}}}', f'{{"id": {b}}}', True) for n, (a, b) in enumerate([(1, 10), (10, 11), (2, 1), (11, 12)])], changelog.SCHEMA)
    assert rows(changelog.next_version(t, chain, ["id"])) == {(12, "a"), (1, "b"), (3, "c")}


def test_old_rows(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], SCHEMA)
    log = spark.createDataFrame([
        (1, 0, 1, "t", "U", None, '{"id": 1, "v": "b"}', False), (2, 0, 1, "t", "D", '{"id": 2}', None, False), (3, 0, 1, "t", "D", '{"id": 5}', None, False),
        (4, 0, 1, "t", "U", '{"id": 3, "v": "told"}', '{"id": 3, "v": "d"}', False), (5, 0, 1, "t", "I", None, '{"id": 9, "v": "n"}', False),
    ], changelog.SCHEMA)
    asked = []

    def held(wanted):
        asked.extend(r.key.k0 for r in wanted.collect())
        return changelog.looked_up(t, ["id"], wanted, True)

    got = {r.key.k0: (r.op, r.old and r.old.v, r.new and r.new.v) for r in changelog.net(changelog.images(log, SCHEMA), SCHEMA, ["id"], held).collect()}
    assert got == {1: ("U", "a", "b"), 2: ("D", "b", None), 5: ("D", None, None), 3: ("U", "told", "d"), 9: ("U", None, "n")}
    assert sorted(asked) == [1, 2, 5]  # a full image, or an insert, asks nothing of the table


def test_encoding(spark):
    df = spark.sql("SELECT 1 AS i, CAST('NaN' AS DOUBLE) AS f, CAST(1.50 AS DECIMAL(10,2)) AS d, X'DEAD' AS b, CAST(NULL AS STRING) AS n, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t, TIMESTAMP '2024-01-02 03:04:05.5' AS z, array(1.0, NULL) AS a, '{\"k\": [1]}' AS j, DATE '2024-01-02' AS dt")
    text = df.select(row_json(df, json_columns=("j",)).alias("r")).first().r
    assert text == '{"i":1,"f":null,"d":"1.50","b":"\\\\xdead","n":null,"t":"2024-01-02 03:04:05","z":"2024-01-02T03:04:05.5+00:00","a":["1.0",null],"j":{"k":[1]},"dt":"2024-01-02"}'
    a, b = spark.sql("SELECT 1 AS x, CAST(NULL AS INT) AS y"), spark.sql("SELECT CAST(NULL AS INT) AS x, 1 AS y")
    assert a.select(content_key(a).alias("k")).first().k != b.select(content_key(b).alias("k")).first().k
    back = spark.sql("SELECT '{\"id\": 3, \"v\": null}' AS r").select(from_row_json(F.col("r"), SCHEMA).alias("x")).first().x
    assert (back.id, back.v) == (3, None)


def test_config():
    c = Config.from_env({"DATABASE_URL": "postgres://u:secret@h/db", "DB_POOL_SIZE": "4", "LOG_FORMAT": "json"})
    assert c.db_pool_size == 4 and "secret" not in str(c.summary()) and c.subject("s1", "changes").endswith(".s1.changes")
    assert Config.from_env({"POSTGRES_URL": "x"}).database_url == "x"
    for bad in ({"DB_POOL_SIZE": "0"}, {"DB_POOL_SIZE": "101"}, {"CLIENT_TIMEOUT_SECS": "4"}, {"MAX_SUBSCRIPTIONS": "0"}, {"DB_POOL_SIZE": "many"}):
        with pytest.raises(ValueError):
            Config.from_env(bad)
    assert mask_url("nats://a:b@h:1") == "nats://a:***@h:1"
    setup_logging(c).info("works")
    m = Metrics()
    m.add("queries"), m.add("query_ms", 30)
    assert m.query_stats() == (1, 0, 30.0)
