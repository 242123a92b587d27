"""The change log: records of committed row changes, and what they do to a table.

Records are ordered by (lsn, seq).  ``after`` is a JSON object.  A record that is not ``partial`` has a full row
(columns that its JSON lacks are null); a partial one changes only the columns that its JSON holds, null included, so
"absent" and "null" differ.  ``net`` folds all records of a key, in order, into one change.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: op: I, U, D, or T (truncate).  ``before`` may be null or hold the key only.  ``seq``: place among records of one lsn.
SCHEMA = T.StructType([
    T.StructField("lsn", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("tx", T.LongType()), T.StructField("tbl", T.StringType()), T.StructField("op", T.StringType()),
    T.StructField("before", T.StringType()), T.StructField("after", T.StringType()), T.StructField("partial", T.BooleanType()),
])


def read_files(spark, path: str, max_files: int = 1) -> DataFrame:
    """A stream over JSON-lines files of change records; a file holds whole transactions."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def _once(make):
    """Columns of a table's plan, made once per session and table: they take some hundred calls into the JVM, a good part
    of a small batch's time."""

    @functools.lru_cache(maxsize=256)
    def cached(context: int, *key):
        return make(*((T.StructType.fromJson(json.loads(key[0])),) + key[1:]))

    @functools.wraps(make)
    def wrapped(schema: T.StructType, *more):
        return cached(id(SparkContext._active_spark_context), schema.json(), *(tuple(x) if isinstance(x, list) else x for x in more))

    return wrapped


def images(changes: DataFrame, schema: T.StructType) -> DataFrame:
    """Records of one table with typed ``before`` and ``after`` structs, and the columns that each holds."""
    return changes.select(*_image_columns(schema))


@_once
def _image_columns(schema: T.StructType) -> list[Column]:
    held = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    return [
        F.struct(F.col("lsn"), F.coalesce("seq", F.lit(0).cast("long")).alias("seq")).alias("at"), "op", F.coalesce("partial", F.lit(False)).alias("partial"),
        F.from_json("before", schema).alias("before"), F.from_json("after", schema).alias("after"), held("before").alias("has_before"), held("after").alias("has_after"),
    ]


def key_of(row: str | Column, keys: list[str]) -> Column:
    row = F.col(row) if isinstance(row, str) else row
    return F.struct(*[row[k].alias(f"k{i}") for i, k in enumerate(keys)])


def _values(row: Column, schema: T.StructType) -> Column:
    return F.struct(*[row[f.name].alias(f"v{i}") for i, f in enumerate(schema.fields)])


def row_of(values: Column, schema: T.StructType) -> Column:
    """Values by position as a struct with the table's names."""
    return F.struct(*[values[f"v{i}"].alias(f.name) for i, f in enumerate(schema.fields)])


def steps(typed: DataFrame, schema: T.StructType, keys: list[str], truncated: bool = True) -> DataFrame:
    """What each record does to a key: at (lsn, seq, n), op (U: the row is there with ``vals``; D: it's gone), ``info``
    (which values the record tells), the row before it if the record tells (``known``, ``old``), and ``moved`` (the
    old key, where a partial record moves a row to another key).

    An update that changes the key is a delete of the old one, then a row at the new one.  An insert says that there
    was no row before.  Records before the last truncation are dropped.
    """
    live = typed
    if truncated:
        cut = typed.where("op = 'T'").agg(F.max("at").alias("cut"))
        live = typed.where("op <> 'T'").join(F.broadcast(cut), F.col("cut").isNull() | (F.col("at") > F.col("cut")))  # one row
    return live.select(_step_column(schema, keys)).select("s.*")


@_once
def _step_column(schema: T.StructType, keys: list[str]) -> Column:
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    keyed = ~F.array_contains(F.array(*[F.col("before")[k].isNull() for k in keys]), True)
    moves = (F.col("op") == "U") & F.col("before").isNotNull() & keyed & ~key_of("before", keys).eqNullSafe(key_of("after", keys))
    full = ~F.col("partial") | (F.col("op") == "I")
    told = F.size(F.array_except(names, "has_before")) == 0
    nothing, none = F.lit(None), F.array(*[F.lit(True) for _ in schema.fields])

    def step(n: int, op: str, row: str, vals, info, known, old, moved) -> Column:
        return F.struct(
            F.struct(F.col("at.lsn").alias("lsn"), F.col("at.seq").alias("seq"), F.lit(n).alias("n")).alias("at"), F.lit(op).alias("op"), key_of(row, keys).alias("key"),
            vals.alias("vals"), info.alias("info"), known.alias("known"), old.alias("old"), moved.alias("moved"),
        )

    old, empty = _values(F.col("before"), schema), _values(F.from_json(F.lit(None).cast("string"), schema), schema)
    old = F.when(F.col("before").isNotNull() & (F.col("op") != "I"), old)
    info = F.when(full, none).otherwise(F.transform(names, lambda c: F.array_contains("has_after", c)))
    gone = step(0, "D", "before", empty, none, told, old, F.lit(None).cast(_key_type(schema, keys)))
    here = step(
        1, "U", "after", _values(F.col("after"), schema), info, (F.col("op") == "I") | moves | told, F.when(~moves, old),
        F.when(moves & F.exists(info, lambda x: ~x), key_of("before", keys)).otherwise(nothing.cast(_key_type(schema, keys))),
    )
    made = F.when(F.col("op") == "D", F.array(gone)).when(moves, F.array(gone, here)).otherwise(F.array(here))
    return F.explode(made).alias("s")


def _key_type(schema: T.StructType, keys: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"k{i}", schema[k].dataType) for i, k in enumerate(keys)])


@_once
def _last(schema: T.StructType) -> list[Column]:
    """For each value, the last that any record of the group tells, and whether one does."""
    out = []
    for i in range(len(schema.fields)):
        out.append(F.max_by(F.col("vals")[f"v{i}"], F.when(F.col("info")[i], F.col("at"))).alias(f"v{i}"))
        out.append(F.max(F.col("info")[i]).alias(f"i{i}"))
    return out


@_once
def _gathered(schema: T.StructType) -> list[Column]:
    n = range(len(schema.fields))
    return [F.struct(*[F.col(f"v{i}") for i in n]).alias("vals"), F.array(*[F.col(f"i{i}") for i in n]).alias("info")]


def _settled(found: DataFrame, schema: T.StructType, keys: list[str], held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps whose moved rows have all their values: those that the record lacks come from the old key, as it was just
    before.  One round per link of a chain of moves; a batch without such records takes none."""
    todo = found.where(F.col("moved").isNotNull()).persist()
    done = found.where(F.col("moved").isNull())
    place = lambda a: F.struct(F.col(f"{a}.at.lsn"), F.col(f"{a}.at.seq"))
    while not todo.isEmpty():
        a, b = todo.alias("a"), todo.alias("b")
        earlier = (F.col("a.moved") == F.col("b.key")) & (place("b") < place("a"))
        ready = a.join(b, earlier, "left_anti").persist()
        r, d = ready.alias("r"), done.alias("d")
        told = r.join(d, (F.col("r.moved") == F.col("d.key")) & (place("d") < place("r")))
        told = told.select(F.col("r.at").alias("to"), F.col("d.at").alias("at"), F.col("d.vals").alias("vals"), F.col("d.info").alias("info"))
        told = told.groupBy("to").agg(*_last(schema)).select("to", *[c.alias(f"t_{n}") for n, c in zip(("vals", "info"), _gathered(schema), strict=True)])
        rows = held(ready.select(F.col("moved").alias("key")).distinct())
        full = ready.join(told, F.col("at") == F.col("to"), "left").join(rows.select(F.col("key").alias("hk"), F.col("held")), F.col("moved") == F.col("hk"), "left")
        of = lambda i: F.when(F.col("info")[i], F.col("vals")[f"v{i}"]).when(F.col("t_info")[i], F.col("t_vals")[f"v{i}"]).otherwise(F.col("held")[f"v{i}"])
        vals = F.struct(*[of(i).alias(f"v{i}") for i in range(len(schema.fields))])
        filled = full.select("at", "op", "key", vals.alias("vals"), F.array(*[F.lit(True) for _ in schema.fields]).alias("info"), "known", "old", F.lit(None).cast(_key_type(schema, keys)).alias("moved"))
        done = done.unionByName(filled)
        todo = todo.join(ready.select(F.col("at").alias("ra")), F.col("at") == F.col("ra"), "left_anti").persist()
    return done


def folded(typed: DataFrame, schema: T.StructType, keys: list[str], partial: bool, held: Callable[[DataFrame], DataFrame], truncated: bool = True) -> DataFrame:
    """One row per key: key, op (U, D), vals and info (as of the last record that tells each), known and old (the row
    before the batch, as far as the first record tells).  ``partial``: whether any record is; ``held(keys)`` gives the
    table's rows (key, held) before the batch."""
    made = steps(typed, schema, keys, truncated)
    if partial:
        made = _settled(made, schema, keys, held)
    first = F.min_by(F.struct("known", "old"), "at").alias("was")
    if partial:
        rows = made.groupBy("key").agg(F.max_by("op", "at").alias("op"), first, *_last(schema)).select("key", "op", *_gathered(schema), "was.known", "was.old")
    else:
        last = F.max_by(F.struct("op", "vals", "info"), "at").alias("now")
        rows = made.groupBy("key").agg(last, first).select("key", "now.op", "now.vals", "now.info", "was.known", "was.old")
    return rows


def net(
    typed: DataFrame, schema: T.StructType, keys: list[str], held: Callable[[DataFrame], DataFrame] | None, partial: bool = True, old: bool = True,
    truncated: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df, few: bool = False,
) -> DataFrame:
    """The net change of each key: key, op, old and new rows (structs with the table's names; null: no such row).

    The table is looked at (``held``; None: it has nothing that could be asked for) only for keys whose records lack
    values, or, if ``old`` is asked for, don't tell the row before.  ``partial`` and ``truncated``: whether any record
    is.  ``keep`` may persist what is used twice; ``few``: the keys can be sent to all executors.
    """
    nothing = lambda keys_: keys_.select("key", F.lit(None).cast(_values_type(schema)).alias("held")).limit(0)
    rows = folded(typed, schema, keys, partial, nothing if truncated or held is None else held, truncated)
    if truncated or held is None or not (partial or old):
        return rows.select(*_net_columns(schema, False, truncated))
    rows = keep(rows)
    lacks = (F.col("op") == "U") & F.exists("info", lambda x: ~x) if partial else F.lit(False)
    asks = lacks | (~F.col("known") if old else F.lit(False))
    found = held(rows.where(asks).select("key")).select(F.col("key").alias("hk"), "held")
    joined = rows.join(F.broadcast(found) if few else found, F.col("key").eqNullSafe(F.col("hk")), "left")
    return joined.select(*_net_columns(schema, True, False))


@_once
def _net_columns(schema: T.StructType, held: bool, truncated: bool) -> list[Column]:
    nothing = F.lit(None).cast(_values_type(schema))
    found = F.col("held") if held else nothing
    vals = F.struct(*[F.when(F.col("info")[i], F.col("vals")[f"v{i}"]).otherwise(found[f"v{i}"]).alias(f"v{i}") for i in range(len(schema.fields))])
    was = nothing if truncated else F.when(F.col("known"), F.col("old")).otherwise(found)
    return [F.col("key"), F.col("op"), F.when(was.isNotNull(), row_of(was, schema)).alias("old"), F.when(F.col("op") == "U", row_of(vals, schema)).alias("new")]


def _values_type(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f"v{i}", f.dataType) for i, f in enumerate(schema.fields)])


def looked_up(table: DataFrame, keys: list[str], wanted: DataFrame, few: bool) -> DataFrame:
    """Rows of ``table`` with the wanted keys: key and held (values by position).  ``few``: the keys are known to be so
    few that they can be sent to all executors, and the table is not shuffled."""
    rows = table.select(key_of(F.struct(*[F.col(f"`{c}`") for c in table.columns]), keys).alias("key"), _values(F.struct(*[F.col(f"`{c}`") for c in table.columns]), table.schema).alias("held"))
    wanted = wanted.select(F.col("key").alias("wk")).distinct()
    return rows.join(F.broadcast(wanted) if few else wanted, F.col("key").eqNullSafe(F.col("wk")), "left_semi")


def next_version(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` after the records in ``changes`` (of ``SCHEMA``, of this table only)."""
    schema = table.schema
    typed = images(changes, schema)
    cut = typed.where("op = 'T'").limit(1).count() > 0
    change = net(typed, schema, keys, lambda wanted: looked_up(table, keys, wanted, False), old=False, truncated=cut)
    left = table.where(F.lit(False)) if cut else table.join(change.select("key"), key_of(F.struct(*[F.col(f"`{c}`") for c in table.columns]), keys).eqNullSafe(F.col("key")), "left_anti")
    return left.unionByName(change.where("new is not null").select("new.*"))
