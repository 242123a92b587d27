"""Query catalogue: the SQL surface that subscribed queries use, and the engine's own operators, each with DuckDB SQL
that gives the same rows.

Plain SQL entries go through the dialect shim and ``spark.sql``, as a subscribed query does.  Operator entries call the
package's functions; for them the SQL is an oracle only.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resultfeed.functions.encode import from_row_json, hex_bytes, row_json
from resultfeed.operators import diff
from resultfeed.plans.dialect import to_spark
from resultfeed.plans.predicate import may_match, parse, tri_state, tri_state_json
from resultfeed.sources.files import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Views of the tables that a query names, made anew: a view keeps the list of files it was made with."""
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, text)
        return spark.sql(to_spark(text))

    return run


#: Queries whose one text is PostgreSQL, runs on Spark through the shim, and on DuckDB as it is.
SQL = {
    "pred_eq": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "pred_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'",
    "pred_range": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount <= 0.05 AND l_tax > 0.01",
    "pred_reversed": "SELECT o_orderkey FROM orders WHERE 200000 < o_totalprice",
    "pred_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "pred_null": "SELECT k FROM (SELECT o_orderkey AS k, NULLIF(o_orderstatus, 'F') AS s FROM orders) t WHERE s IS NULL",
    "pred_not_null": "SELECT k FROM (SELECT o_orderkey AS k, NULLIF(o_orderstatus, 'F') AS s FROM orders) t WHERE s IS NOT NULL",
    "pred_and_or": "SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND (value > 100 OR user_id = -1)",
    "pred_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT (p_brand = 'Brand#11')",
    "pred_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' OR p_type LIKE 'S%'",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "fetch_first": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey FETCH FIRST 10 ROWS ONLY",
    "nulls_order": "SELECT k, s, CAST(ROW_NUMBER() OVER (ORDER BY s DESC NULLS FIRST, k) AS BIGINT) AS place FROM (SELECT o_orderkey AS k, NULLIF(o_orderstatus, 'P') AS s FROM orders) t",
    "join_inner": "SELECT c.c_name, o.o_orderkey AS order_id, o.o_totalprice FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_left": "SELECT p.p_partkey, l.l_orderkey FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 49",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_theta": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey",
    "join_self": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_multi": "SELECT c.c_name AS customer, p.p_name AS product, l.l_quantity, l.l_extendedprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey",
    "join_lateral": "SELECT n.n_name, t.c_custkey FROM nation n, LATERAL (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000) t",
    "group_agg": "SELECT o_custkey, COUNT(*) AS order_count, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_spent FROM orders GROUP BY o_custkey",
    "group_having": "SELECT p_brand, COUNT(*) AS cnt, MAX(p_retailprice) AS mx FROM part GROUP BY p_brand HAVING COUNT(*) > 10",
    "group_avg": "SELECT o_custkey, CAST(AVG(CAST(k AS DOUBLE)) AS DOUBLE) AS mean FROM (SELECT o_custkey, o_orderkey % 100 AS k FROM orders) t GROUP BY o_custkey HAVING AVG(CAST(k AS DOUBLE)) > 50",
    "bool_true": "SELECT p_partkey FROM (SELECT p_partkey, p_size > 25 AS large FROM part) t WHERE large = true",
    "now_past": "SELECT event_id FROM events WHERE ts < NOW() AND event_type = 'click'",
    "cte_shadow": "WITH orders AS (SELECT * FROM orders WHERE o_orderkey > 1000), late AS (SELECT * FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, o_custkey FROM late",
    "regex_column": "SELECT p_partkey FROM part WHERE p_name ~* SUBSTRING(UPPER(p_type), 1, 2)",
    "group_none": "SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders",
    "group_filter": "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'click') AS clicks, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY user_id",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "subq_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "subq_any": "SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "subq_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "subq_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)",
    "derived": "SELECT n_name, n_cust FROM (SELECT n.n_name, COUNT(c.c_custkey) AS n_cust FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey GROUP BY n.n_nationkey, n.n_name) s WHERE n_cust > 0",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), li AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT b.o_orderkey, COALESCE(li.n, 0) AS n FROM big b LEFT JOIN li ON b.o_orderkey = li.l_orderkey",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM t WHERE n < 24) SELECT t.n, x.n_name FROM t JOIN nation x ON x.n_nationkey = t.n",
    "window_rn": "SELECT p_partkey, p_brand, CAST(ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS BIGINT) AS price_rank FROM part",
    "window_rank": "SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d, CAST(NTILE(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS q FROM part",
    "window_frame": "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_id, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS first_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events",
    "case_tier": "SELECT c.c_custkey, s.order_count, CASE WHEN s.spent > 1500000 THEN 'gold' WHEN s.spent BETWEEN 200000 AND 1500000 THEN 'silver' WHEN s.order_count IS NULL THEN 'idle' ELSE 'plain' END AS tier FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS order_count, COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS spent FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey) s ON c.c_custkey = s.o_custkey WHERE c.c_acctbal > 0",
    "json_extract": "SELECT event_id, props->>'k' AS k FROM events WHERE props->>'k' IS NOT NULL",
    "distinct": "SELECT DISTINCT o_orderstatus FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS LAST, o_orderkey",
    "union_all": "SELECT c_name AS name, 'customer' AS type FROM customer UNION ALL SELECT s_name AS name, 'supplier' AS type FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "strings": "SELECT c_custkey, UPPER(c_name) AS u, LENGTH(c_name) AS n, SUBSTRING(c_name, 1, 4) AS head, c_name || '/' || c_mktsegment AS joined, REPLACE(c_mktsegment, 'I', 'i') AS r FROM customer",
    "numbers": "SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS f, CAST(CEIL(o_totalprice) AS BIGINT) AS c, ABS(-o_orderkey) AS a, o_orderkey % 7 AS m, SIGN(o_custkey - 500)::INT AS s FROM orders",
    "dates": "SELECT event_id, DATE_TRUNC('day', ts)::DATE::TEXT AS d, CAST(EXTRACT(HOUR FROM ts) AS INT) AS h, CAST(EXTRACT(MONTH FROM ts) AS INT) AS m FROM events",
    "text_literal_compare": "SELECT event_id FROM events WHERE ts >= '2024-01-15 00:00:00'",
    "quoted_names": 'SELECT "o_orderkey" AS "Key", o_orderstatus AS "status" FROM "orders" WHERE "o_orderstatus" = \'O\'',
}

#: DuckDB spells these otherwise.
ORACLE = {
    "json_extract": "SELECT event_id, props->>'$.k' AS k FROM events WHERE props->>'$.k' IS NOT NULL",
    "fetch_first": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10",
    "regex_column": "SELECT p_partkey FROM part WHERE regexp_matches(p_name, SUBSTRING(UPPER(p_type), 1, 2), 'i')",
}

_V = """v0 AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0),
v1 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'S' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 1)"""
_A = _V + ", a AS (SELECT * FROM v0 WHERE o_orderstatus = 'P'), b AS (SELECT * FROM v1 WHERE o_orderstatus = 'P')"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``orders`` before and after a synthetic transaction: keys ending in 0 come, in 1 go, multiples of 7 change."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 7 == 0, "S").otherwise(F.col("o_orderstatus"))
    return orders.where("o_orderkey % 10 <> 0"), orders.where("o_orderkey % 10 <> 1").withColumn("o_orderstatus", status)


def _diff_bag(spark, sf_dir):
    old, new = (v.where("o_orderstatus = 'P'") for v in versions(spark, sf_dir))
    return diff.diff_bag(old, new).drop("mz_timestamp")


def _diff_identity(spark, sf_dir):
    old, new = (v.select("o_orderkey", "o_orderstatus") for v in versions(spark, sf_dir))
    return diff.diff_identity(old, new, ["o_orderkey"]).drop("mz_timestamp")


def _init_events(spark, sf_dir):
    return diff.init_events(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus"), 0)


def _skip_decision(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    key = F.col("a.o_orderkey") == F.col("b.o_orderkey")
    pairs = old.alias("a").join(new.alias("b"), key, "full_outer").where(~F.col("a.o_orderstatus").eqNullSafe(F.col("b.o_orderstatus")))
    sides = pairs.select(F.explode(F.array("a.o_orderstatus", "b.o_orderstatus")).alias("o_orderstatus")).where("o_orderstatus IS NOT NULL")
    asked = {"pending": "o_orderstatus = 'P'", "none": "o_orderstatus = 'Z'"}
    found = sides.agg(*[F.max(may_match(sides.schema, parse(p)).cast("int")).alias(k) for k, p in asked.items()])
    return found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("query_id"), F.col(k).alias("requery")) for k in asked])).alias("x")).select("x.*")


def _tri_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "value")
    return rows.select("event_id", tri_state(rows, parse("event_type = 'click' AND value > 50")).alias("r"))


def _seq_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("query_id"), F.floor(F.col("event_id") / 5).alias("tx"))
    return diff.seq_batches(rows, "query_id", "tx")


def _fold_snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return diff.fold_last(rows, ["user_id"], "event_id", F.col("event_type") == "error").drop("event_id")


def _fold_events(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return diff.fold(diff.init_events(old, 0).unionByName(diff.diff_identity(old, new, ["o_orderkey"])))


def _subscribers(spark, sf_dir):
    """A registry with a subscriber for each user of ``events``, the clients of a service: driver-side state by nature,
    bounded by its maximum of subscriptions."""
    from resultfeed.plans.analyze import Analyzer
    from resultfeed.registry import Registry

    class Clock:
        now = 0.0

        def __call__(self) -> float:
            return self.now

    clock = Clock()
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")).alias("at")).orderBy("at").collect()
    return Registry(Analyzer(spark), max_subscriptions=len(rows), clock=clock), clock, rows


def _fanout(spark, sf_dir):
    """Messages of one change per shared query and mode: who gets it by the registry, what by the sinks."""
    from resultfeed.streaming.sinks import Batch, payloads

    registry, _, users = _subscribers(spark, sf_dir)
    for u in users:
        registry.subscribe(str(u.user_id), f"SELECT * FROM orders WHERE o_orderkey = {u.user_id % 7}", (), "snapshot" if u.user_id % 3 == 0 else "events")
    out, rows = [], spark.range(1).select(F.col("id").alias("o_orderkey"))
    for q in registry.queries():
        batch = Batch(q.id, 0, 1, 0, diff.init_events(rows, 0), lambda: rows, registry.subscribers(q.id))
        key = int(q.sql.rsplit("=", 1)[1])
        out += [(key, mode, len(batch.subscribers[mode])) for mode in payloads(batch)]
    return spark.createDataFrame(out, "query_id long, mode string, subs long")


def _cleanup_stale(spark, sf_dir):
    """Subscribers whose last heartbeat is too long ago, by the registry's clock."""
    registry, clock, users = _subscribers(spark, sf_dir)
    for u in users:
        clock.now = u.at / 1e6
        registry.subscribe(str(u.user_id), "SELECT * FROM orders")
        registry.heartbeat(str(u.user_id))
    clock.now = 1706616000.0  # 2024-01-30 12:00:00
    gone, _ = registry.cleanup(30)
    at = {str(u.user_id): u.at for u in users}
    made = spark.createDataFrame([(int(i), at[i]) for i in gone], "user_id long, at long")
    return made.select("user_id", F.expr("timestampadd(MICROSECOND, at, TIMESTAMP_NTZ '1970-01-01 00:00:00')").alias("last_activity"))


def _replicated(rows) -> list[bytes]:
    """Replication messages of a transaction that inserted rows (tx, event_id, event_type)."""
    text = lambda v: b"t" + struct.pack(">I", len(v)) + v
    columns = b"".join(bytes([k]) + n + b"\0" + struct.pack(">Ii", oid, -1) for k, n, oid in ((1, b"event_id", 20), (0, b"event_type", 25)))
    tx = rows[0][0]
    out = [b"R" + struct.pack(">I", 1) + b"public\0events\0d" + struct.pack(">H", 2) + columns, b"B" + struct.pack(">QqI", tx, 0, tx)]
    out += [b"I" + struct.pack(">I", 1) + b"N" + struct.pack(">H", 2) + text(str(i).encode()) + text(kind.encode()) for _, i, kind in rows]
    return [*out, b"C\0" + struct.pack(">QQq", tx, tx, 0)]


def _tx_batches(spark, sf_dir):
    """Records by transaction, from replication messages through the decoder; rows that a subscribed predicate can
    match count as relevant."""
    import pandas as pd

    from resultfeed.sources import changelog, pgoutput

    def decoded(rows: pd.DataFrame) -> pd.DataFrame:
        messages = _replicated(list(rows.sort_values("event_id").itertuples(index=False, name=None)))
        return pd.DataFrame([r for _, part in pgoutput.transactions(iter(messages)) for r in part], columns=changelog.SCHEMA.names)

    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).cast("long").alias("tx"), "event_id", "event_type")
    records = events.groupBy("tx").applyInPandas(decoded, changelog.SCHEMA)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    rows = records.select("tx", F.from_json("after", schema).alias("row")).select("tx", "row.*")
    hit = may_match(schema, parse("event_type = 'signup'"))
    return rows.groupBy("tx").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(hit.cast("long")).alias("n_relevant"))


def _partial_updates(spark, sf_dir):
    """The next version of ``orders`` after several records of a key in one batch: full and partial updates, nulls that
    are set, an insert that is updated, a key that changes, and a delete that is undone."""
    from resultfeed.sources import changelog

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k, part = F.col("o_orderkey"), lambda *c: F.to_json(F.struct(F.col("o_orderkey"), *c), {"ignoreNullFields": "false"})
    status, priority = lambda v: F.lit(v).cast("string").alias("o_orderstatus"), lambda v: F.lit(v).cast("string").alias("o_orderpriority")
    none = F.lit(None).cast("string")
    moved = F.to_json(F.struct((-k).alias("o_orderkey"), status("M")))

    def record(where: str, seq: int, op: str, before, after, partial: bool):
        return orders.where(where).select(k.alias("lsn"), F.lit(seq).cast("long").alias("seq"), F.lit(1).cast("long").alias("tx"), F.lit("orders").alias("tbl"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"), F.lit(partial).alias("partial"))

    log = [
        record("o_orderkey % 10 = 1", 0, "U", none, part(status("X"), priority("new")), False), record("o_orderkey % 10 = 1", 1, "U", none, part(status("Y")), True),
        record("o_orderkey % 10 = 2", 0, "U", none, part(priority(None)), True),
        record("o_orderkey % 10 = 3", 0, "U", part(), moved, True),
        record("o_orderkey % 10 = 4", 0, "D", part(), none, False), record("o_orderkey % 10 = 4", 1, "I", none, part(status("B")), False), record("o_orderkey % 10 = 4", 2, "U", none, part(priority("back")), True),
        record("o_orderkey % 10 = 5", 0, "D", part(), none, False),
    ]
    changes = log[0]
    for more in log[1:]:
        changes = changes.unionByName(more)
    return changelog.next_version(orders, changes, ["o_orderkey"])


def _engine(spark, sf_dir):
    """An engine over the old version of ``orders``, and the change records that lead to the new one, in two batches."""
    from resultfeed.plans.analyze import Analyzer
    from resultfeed.registry import Registry
    from resultfeed.streaming.engine import Engine
    from resultfeed.streaming.sinks import JsonLinesSink

    root = scratch(spark)
    old, new = versions(spark, sf_dir)
    engine = Engine(spark, f"{root}/state", Registry(Analyzer(spark)), JsonLinesSink(f"{root}/out"))
    engine.add_table("orders", old, ["o_orderkey"])
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.o_orderkey") == F.col("b.o_orderkey"), "full_outer").where("NOT (struct(a.*) <=> struct(b.*))")
    op = F.when(F.col("a.o_orderkey").isNull(), "I").when(F.col("b.o_orderkey").isNull(), "D").otherwise("U")
    image = lambda t: F.when(F.col(f"{t}.o_orderkey").isNotNull(), F.to_json(F.struct(f"{t}.*")))
    key = F.coalesce("a.o_orderkey", "b.o_orderkey")
    log = both.select(key.alias("lsn"), F.lit(0).cast("long").alias("seq"), key.alias("tx"), F.lit("orders").alias("tbl"), op.alias("op"), F.when(op == "D", image("a")).alias("before"), image("b").alias("after"), F.lit(False).alias("partial"))
    return engine, log


def _served(spark, sf_dir, sql: str, identity: list[str]):
    """What a subscriber of ``sql`` is sent for two batches of changes: sink rows of all batches."""
    from resultfeed.service import Service, SubscribeRequest

    engine, log = _engine(spark, sf_dir)
    answer = Service(engine).subscribe("client", SubscribeRequest(sql, identity))
    if not answer.success:
        raise RuntimeError(answer.error)
    for n in (0, 1):
        engine.process(log.where(F.col("lsn") % 2 == n), n)
    return engine, spark.read.json(f"{engine.sink.path}/query={answer.query_id}/mode=events")


def _engine_events(spark, sf_dir):
    """Subscribe, two batches, and the events of a rowwise query in the sink (no requery, no stored result)."""
    engine, sent = _served(spark, sf_dir, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'", ["o_orderkey"])
    if engine.metrics["incremental"] != 2 or engine.metrics["requeries"]:
        raise RuntimeError("the query should have been answered from the changed rows")
    return sent.select("seq", F.col("event.mz_diff").cast("int").alias("mz_diff"), F.col("event.data.o_orderkey").alias("o_orderkey"), F.col("event.data.o_orderstatus").alias("o_orderstatus"))


def _engine_requery(spark, sf_dir):
    """The same for an aggregate, which is run again and compared: first rows and events folded give its result."""
    _, sent = _served(spark, sf_dir, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", ["o_orderstatus"])
    old, _ = versions(spark, sf_dir)
    first = diff.init_events(old.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), 0)
    events = sent.select(F.col("event.mz_timestamp").alias("mz_timestamp"), F.col("event.mz_diff").cast("int").alias("mz_diff"), F.col("event.data.o_orderstatus").alias("o_orderstatus"), F.col("event.data.n").alias("n"))
    return diff.fold(first.unionByName(events))


def _engine_table(spark, sf_dir):
    """The engine's table after both batches: base and deltas, merged on read."""
    engine, log = _engine(spark, sf_dir)
    for n in (0, 1):
        engine.process(log.where(F.col("lsn") % 2 == n), n)
    return engine.table(spark, engine.tables["orders"])


def _snapshot_order(spark, sf_dir):
    """A stored result keeps the query's order."""
    from resultfeed.streaming.engine import POS

    engine, _ = _engine(spark, sf_dir)
    query, _ = engine.registry.subscribe("client", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 500", (), "snapshot", engine.start_query)
    stored = engine._stored(spark, query, query.version)
    return stored.select("o_orderkey", (F.row_number().over(Window.orderBy(POS))).cast("long").alias("place"))


_ANALYZED = {
    "simple": ("SELECT * FROM public.Orders WHERE o_orderkey = 5", "orders", True, True),
    "no_where": ("SELECT o_orderkey FROM orders", "orders", False, True),
    "join": ("SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey > 5", "customer,orders", False, False),
    "self_join": ("SELECT * FROM orders a JOIN orders b ON a.o_orderkey = b.o_custkey WHERE a.o_orderkey > 5", "orders", False, False),
    "subquery": ("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)", "customer,orders", False, False),
    "shadow": ("WITH orders AS (SELECT * FROM orders) SELECT * FROM orders", "orders", False, False),
    "union": ("SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer", "customer,orders", False, False),
    "aggregate": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'P'", "orders", True, False),
    "unstable": ("SELECT * FROM events WHERE ts > now()", "events", False, False),
    "half_clear": ("SELECT * FROM orders WHERE o_orderkey = 5 AND o_custkey IN (SELECT c_custkey FROM customer)", "customer,orders", True, False),
    "command": ("INSERT INTO orders VALUES (1)", "Only SELECT", False, False),
    "two": ("SELECT 1; SELECT 2", "Parse", False, False),
    "empty": ("  -- nothing", "Empty", False, False),
}


def _analyze(spark, sf_dir):
    """What the analyzer finds in a dozen texts: tables or the error, whether changes prune, whether rows stand alone."""
    from resultfeed.plans.analyze import Analyzer, QueryError

    analyzer, rows = Analyzer(spark), []
    for name, (sql, *_) in _ANALYZED.items():
        try:
            found = analyzer.analyze(sql)
            rows.append((name, ",".join(found.tables), found.prunable, found.rowwise))
        except QueryError as e:
            rows.append((name, str(e).split(":")[0], False, False))
    return spark.createDataFrame(rows, "name string, found string, prunable boolean, rowwise boolean")


def _query_keys(spark, sf_dir):
    """Texts that share a result: case and blanks fold outside literals and quoted names only."""
    from resultfeed.plans.analyze import query_key

    texts = ["SELECT * FROM t WHERE a = 'X'", "select  *\nfrom T -- c\n where A = 'X' ;", "SELECT * FROM t WHERE a = 'x'", "SELECT * FROM t WHERE a = 'X '", 'SELECT "A" FROM t', 'SELECT "a" FROM t']
    keys = [query_key(t) for t in texts]
    return spark.createDataFrame([(i, keys.index(k)) for i, k in enumerate(keys)], "text long, shares_with long")


def _coerced(spark, sf_dir):
    """Literals of another type than the column's: what converts is compared, what doesn't is unknown."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("string").alias("v"), (F.col("event_id") % 3 == 0).alias("third"))
    asked = {"text_number": "v > 50", "number_text": "event_id = '7'", "bad_text": "event_id = 'x'", "text_bad": "event_type = 5", "bool_text": "third = true", "list": "event_id IN (1, '2', 3.0)"}
    return rows.select("event_id", *[tri_state(rows, parse(p)).alias(k) for k, p in asked.items()])


def _tri_state_json(spark, sf_dir):
    """The same predicate over rows that come as JSON, as change records carry them."""
    rows = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"), "value")
    packed = rows.select("event_id", row_json(rows, ["event_type", "value"]).alias("row"))
    schema = T.StructType([rows.schema["event_type"], rows.schema["value"]])
    return tri_state_json(packed, "row", schema, parse("event_type = 'click' AND value > 50")).drop("row")


def _decoded(spark, sf_dir):
    """All kinds of replication messages, decoded: built per nation, an insert, an update with its old key, an update
    that leaves a large value alone, a delete; and a truncation at the end."""
    import json

    import pandas as pd

    from resultfeed.sources.pgoutput import transactions

    def decode(batches):
        for rows in batches:
            out = []
            for key, name in rows.itertuples(index=False):
                value = lambda v: b"n" if v is None else v if isinstance(v, bytes) else b"t" + struct.pack(">I", len(v.encode())) + v.encode()
                row = lambda *v: struct.pack(">H", len(v)) + b"".join(map(value, v))
                k, columns = str(key), b"".join(bytes([f]) + n + b"\0" + struct.pack(">Ii", oid, -1) for f, n, oid in ((1, b"ID", 20), (0, b"name", 25), (0, b"live", 16)))
                messages = [
                    b"R" + struct.pack(">I", 9) + b"public\0Nation\0d" + struct.pack(">H", 3) + columns, b"B" + struct.pack(">QqI", key + 1, 0, key),
                    b"I" + struct.pack(">I", 9) + b"N" + row(k, name, "t"), b"U" + struct.pack(">I", 9) + b"K" + row(k, None, None) + b"N" + row(str(key + 100), name, "f"),
                    b"U" + struct.pack(">I", 9) + b"N" + row(str(key + 100), b"u", None), b"D" + struct.pack(">I", 9) + b"K" + row(str(key + 100), None, None), b"T" + struct.pack(">IB", 1, 0) + struct.pack(">I", 9), b"C\0" + struct.pack(">QQq", 0, key + 2, 0),
                ]
                for _, part in transactions(iter(messages)):
                    for lsn, seq, tx, tbl, op, before, after, partial in part:
                        b, a = json.loads(before or "{}"), json.loads(after or "{}")
                        out.append((lsn, seq, tbl, op, b.get("id"), a.get("id"), a.get("name"), a.get("live"), partial))
            yield pd.DataFrame(out, columns=["lsn", "seq", "tbl", "op", "old_id", "id", "name", "live", "partial"]).astype({"old_id": "Int64", "id": "Int64", "live": "boolean"})

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return rows.mapInPandas(decode, "lsn long, seq long, tbl string, op string, old_id long, id long, name string, live boolean, partial boolean")


def _json_back(spark, sf_dir):
    """Rows as JSON and back."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"), "o_totalprice", "o_orderdate")
    return rows.select(from_row_json(row_json(rows), rows.schema).alias("r")).select("r.*")


def _value_json(spark, sf_dir):
    """How single values are delivered: exact decimals and bytes as text, NaN as null, arrays with nulls."""
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"), (F.col("n_nationkey") / 4).cast("decimal(10,2)").alias("d"), F.col("n_name").cast("binary").alias("b"), F.lit(float("nan")).alias("f"),
        F.array(F.col("n_nationkey"), F.lit(None).cast("long")).alias("a"), F.lit(None).cast("string").alias("z"),
    )
    return rows.select("k", row_json(rows, ["d", "b", "f", "a", "z"]).alias("data"))


def _odd_names(spark, sf_dir):
    """A difference of results whose columns are named like the engine's own, and with dots."""
    names = ["o_orderkey", "mz_diff", "a.b", "_n"]
    old, new = (v.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(1).alias("one")).toDF(*names) for v in versions(spark, sf_dir))
    made = diff.diff_identity(old, new, ["o_orderkey"]).drop("mz_timestamp")
    return made.toDF("d", "k", "mz_diff", "a.b", "_n")


def _row_json(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("id"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"))
    return rows.select("o_orderkey", row_json(rows, ["id", "s"]).alias("data"))


def _bytes_hex(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", hex_bytes(F.col("n_name").cast("binary")).alias("h"))


def _array_any(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(to_spark("SELECT p_partkey FROM part WHERE 'ring' = ANY(split(p_name, ' '))"))


def _late_join(spark, sf_dir):
    return diff.late_join_events(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"))


def _identity_hash(spark, sf_dir):
    from resultfeed.functions.encode import content_key

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return rows.select("n_nationkey", content_key(rows).alias("h"))


OPERATORS = {
    "init_events": (_init_events, "SELECT CAST(0 AS BIGINT) AS mz_timestamp, 1 AS mz_diff, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'"),
    "late_join": (_late_join, "SELECT CAST(0 AS BIGINT) AS mz_timestamp, 1 AS mz_diff, c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "diff_bag": (_diff_bag, f"WITH {_A} SELECT *, -1 AS mz_diff FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 1 AS mz_diff FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"),
    "diff_identity": (_diff_identity, f"WITH {_V}, j AS (SELECT v0.o_orderkey AS k0, v0.o_orderstatus AS s0, v1.o_orderkey AS k1, v1.o_orderstatus AS s1 FROM v0 FULL OUTER JOIN v1 ON v0.o_orderkey = v1.o_orderkey) SELECT k0 AS o_orderkey, s0 AS o_orderstatus, -1 AS mz_diff FROM j WHERE k0 IS NOT NULL AND (k1 IS NULL OR s0 IS DISTINCT FROM s1) UNION ALL SELECT k1, s1, 1 FROM j WHERE k1 IS NOT NULL AND (k0 IS NULL OR s0 IS DISTINCT FROM s1)"),
    "fold_events": (_fold_events, f"WITH {_V} SELECT * FROM v1"),
    "fold_snapshot": (_fold_snapshot, "SELECT user_id, event_type, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1 AND event_type <> 'error'"),
    "skip_decision": (_skip_decision, f"WITH {_V}, ch AS (SELECT v0.o_orderkey AS k0, v1.o_orderkey AS k1, v0.o_orderstatus AS s0, v1.o_orderstatus AS s1 FROM v0 FULL OUTER JOIN v1 ON v0.o_orderkey = v1.o_orderkey WHERE v0.o_orderstatus IS DISTINCT FROM v1.o_orderstatus), q AS (SELECT 'pending' AS query_id, 'P' AS s UNION ALL SELECT 'none', 'Z') SELECT q.query_id, MAX(CASE WHEN ch.s0 = q.s OR ch.s1 = q.s THEN 1 ELSE 0 END) AS requery FROM ch CROSS JOIN q GROUP BY q.query_id"),
    "tri_state": (_tri_state, "SELECT event_id, CASE WHEN NULLIF(event_type, 'error') = 'click' AND value > 50 THEN 'match' WHEN NULLIF(event_type, 'error') <> 'click' OR value <= 50 THEN 'no_match' ELSE 'unknown' END AS r FROM events"),
    "seq_batches": (_seq_batches, "SELECT query_id, tx, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY tx) AS BIGINT) AS seq, n_events FROM (SELECT event_type AS query_id, CAST(FLOOR(event_id / 5.0) AS BIGINT) AS tx, COUNT(*) AS n_events FROM events GROUP BY event_type, CAST(FLOOR(event_id / 5.0) AS BIGINT)) t"),
    "fanout": (_fanout, "WITH s AS (SELECT user_id % 7 AS query_id, user_id AS sub_id, CASE WHEN user_id % 3 = 0 THEN 'snapshot' ELSE 'events' END AS mode FROM (SELECT DISTINCT user_id FROM events) d) SELECT query_id, mode, COUNT(*) AS subs FROM s GROUP BY query_id, mode"),
    "cleanup_stale": (_cleanup_stale, "SELECT user_id, MAX(ts) AS last_activity FROM events GROUP BY user_id HAVING MAX(ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL '30' SECOND"),
    "tx_batches": (_tx_batches, "SELECT tx, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS n_relevant FROM (SELECT CAST(FLOOR(event_id / 100.0) AS BIGINT) AS tx, event_type FROM events) t GROUP BY tx"),
    "partial_updates": (_partial_updates, """SELECT CASE WHEN o_orderkey % 10 = 3 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey,
        CASE o_orderkey % 10 WHEN 1 THEN 'Y' WHEN 3 THEN 'M' WHEN 4 THEN 'B' ELSE o_orderstatus END AS o_orderstatus,
        CASE o_orderkey % 10 WHEN 1 THEN 'new' WHEN 2 THEN NULL WHEN 4 THEN 'back' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 10 <> 5"""),
    "engine_events": (_engine_events, f"""WITH {_V}, a AS (SELECT * FROM v0 WHERE o_orderstatus = 'P'), b AS (SELECT * FROM v1 WHERE o_orderstatus = 'P'),
        e AS (SELECT -1 AS mz_diff, o_orderkey, o_orderstatus FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT 1, o_orderkey, o_orderstatus FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a))
        SELECT CAST(1 + o_orderkey % 2 AS BIGINT) AS seq, mz_diff, o_orderkey, o_orderstatus FROM e"""),
    "engine_requery": (_engine_requery, f"WITH {_V} SELECT o_orderstatus, COUNT(*) AS n FROM v1 GROUP BY o_orderstatus"),
    "engine_table": (_engine_table, f"WITH {_V} SELECT * FROM v1"),
    "snapshot_order": (_snapshot_order, f"WITH {_V} SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderstatus DESC NULLS FIRST, o_orderkey) AS place FROM v0 QUALIFY place <= 500"),
    "analyze": (_analyze, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{found}', {str(p).upper()}, {str(r).upper()})" for k, (_, found, p, r) in _ANALYZED.items()) + ") AS t(name, found, prunable, rowwise)"),
    "query_keys": (_query_keys, "SELECT CAST(i AS BIGINT) AS text, CAST(CASE WHEN i = 1 THEN 0 ELSE i END AS BIGINT) AS shares_with FROM range(6) AS t(i)"),
    "coerced": (_coerced, """SELECT event_id, CASE WHEN value > 50 THEN 'match' WHEN value <= 50 THEN 'no_match' ELSE 'unknown' END AS text_number, CASE WHEN event_id = 7 THEN 'match' ELSE 'no_match' END AS number_text,
        'unknown' AS bad_text, 'unknown' AS text_bad, CASE WHEN event_id % 3 = 0 THEN 'match' ELSE 'no_match' END AS bool_text, CASE WHEN event_id IN (1, 2, 3) THEN 'match' ELSE 'no_match' END AS list FROM events"""),
    "tri_state_json": (_tri_state_json, "SELECT event_id, CASE WHEN NULLIF(event_type, 'error') = 'click' AND value > 50 THEN 'match' WHEN NULLIF(event_type, 'error') <> 'click' OR value <= 50 THEN 'no_match' ELSE 'unknown' END AS r FROM events"),
    "decoded": (_decoded, """SELECT n_nationkey + 1 AS lsn, CAST(seq AS BIGINT) AS seq, 'nation' AS tbl, op, CASE WHEN seq = 1 THEN n_nationkey WHEN seq = 3 THEN n_nationkey + 100 END AS old_id,
        CASE WHEN seq = 0 THEN n_nationkey WHEN seq IN (1, 2) THEN n_nationkey + 100 END AS id, CASE WHEN seq < 2 THEN n_name END AS name, CASE seq WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS live, seq = 2 AS partial
        FROM nation, (VALUES (0, 'I'), (1, 'U'), (2, 'U'), (3, 'D'), (4, 'T')) AS t(seq, op)"""),
    "json_back": (_json_back, "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s, o_totalprice, o_orderdate FROM orders"),
    "value_json": (_value_json, r"""SELECT n_nationkey AS k, '{"d":"' || CAST(CAST(n_nationkey / 4.0 AS DECIMAL(10, 2)) AS VARCHAR) || '","b":"\\x' || lower(hex(encode(n_name))) || '","f":null,"a":[' || n_nationkey || ',null],"z":null}' AS data FROM nation"""),
    "odd_names": (_odd_names, f"""WITH {_V}, j AS (SELECT v0.o_orderkey AS k0, v0.o_custkey AS c0, v0.o_orderstatus AS s0, v1.o_orderkey AS k1, v1.o_custkey AS c1, v1.o_orderstatus AS s1 FROM v0 FULL OUTER JOIN v1 ON v0.o_orderkey = v1.o_orderkey)
        SELECT -1 AS d, k0 AS k, c0 AS mz_diff, s0 AS "a.b", 1 AS _n FROM j WHERE k0 IS NOT NULL AND (k1 IS NULL OR s0 IS DISTINCT FROM s1) UNION ALL SELECT 1, k1, c1, s1, 1 FROM j WHERE k1 IS NOT NULL AND (k0 IS NULL OR s0 IS DISTINCT FROM s1)"""),
    "row_json": (_row_json, "SELECT o_orderkey, CAST(json_object('id', o_orderkey, 's', NULLIF(o_orderstatus, 'F')) AS VARCHAR) AS data FROM orders"),
    "bytes_hex": (_bytes_hex, r"SELECT n_nationkey, '\x' || lower(hex(encode(n_name))) AS h FROM nation"),
    "identity_hash": (_identity_hash, "SELECT n_nationkey, sha256(CAST(json_object('n_nationkey', n_nationkey, 'n_name', n_name) AS VARCHAR)) AS h FROM nation"),
    "array_any": (_array_any, "SELECT p_partkey FROM part WHERE 'ring' = ANY(string_split(p_name, ' '))"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _sql(v) for k, v in SQL.items()} | {k: run for k, (run, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: ORACLE.get(k, v) for k, v in SQL.items()} | {k: sql for k, (_, sql) in OPERATORS.items()}
