"""Snapshots and their differences, by DataFrame operations only.

Rows are bags: duplicates count.  With identity columns, the old and new row of an identity are paired, so that an
update is a ``-1`` followed by a ``+1``; without them rows are counted.  Columns go by position inside, so that they
may have any name, and the same one more than once.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resultfeed.functions.encode import DIFF, TS, comparable, delivered, event, event_columns

log = logging.getLogger("resultfeed.diff")


def init_events(df: DataFrame, ts: int) -> DataFrame:
    """A ``+1`` for each row of a new result, in its order."""
    return event(df, 1, ts)


def late_join_events(snapshot: DataFrame) -> DataFrame:
    """What a later subscriber of a shared query gets: its rows as ``+1`` with timestamp 0."""
    return event(snapshot, 1, 0)


def _placed(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _keys(df: DataFrame, columns: list[str]) -> list:
    return [comparable(F.col(c), df.schema[c].dataType) for c in columns]


def _events(placed: DataFrame, n, ts: int, names: list[str]) -> DataFrame:
    return placed.select(F.lit(ts).cast("long").alias(TS), n.cast("int").alias(DIFF), *event_columns([F.col(f"c{i}") for i in range(len(names))], names))


def diff_bag(old: DataFrame, new: DataFrame, ts: int = 0) -> DataFrame:
    """Events from ``old`` to ``new`` without identity: one event per row copy gained or lost.

    One shuffle with partial sums: a row that very many copies share is summed before it moves.
    """
    names, columns = new.columns, [f"c{i}" for i in range(len(new.columns))]
    both = _placed(old).withColumn("d", F.lit(-1)).unionByName(_placed(new).withColumn("d", F.lit(1)))
    plain = all(both.schema[c].dataType.typeName() not in ("map", "variant") for c in columns)
    keys = columns if plain else [k.alias(f"k{i}") for i, k in enumerate(_keys(both, columns))]
    summed = both.groupBy(*keys).agg(F.sum("d").alias("n"), *([] if plain else [F.first(F.struct(*columns)).alias("row")])).where(F.col("n") != 0)
    rows = summed if plain else summed.select("row.*", "n")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))))
    return _events(copies, F.signum("n"), ts, names)


def diff_identity(old: DataFrame, new: DataFrame, identity: list[str], ts: int = 0) -> DataFrame:
    """Events with identity columns: unchanged rows none, changed ones ``-1`` old then ``+1`` new, side by side.

    Rows that share an identity are numbered by content and paired by number.
    """
    names, columns = new.columns, [f"c{i}" for i in range(len(new.columns))]
    missing = [c for c in identity if c not in names]
    if missing:
        log.warning("identity columns %s are not in the result; comparing whole rows", missing)
        return diff_bag(old, new, ts)
    kinds = {f"c{i}": f.dataType.typeName() for i, f in enumerate(new.schema.fields)}
    same = {c: {"map": f"array_sort(map_entries({c}))", "variant": f"to_json({c})"}.get(k, c) for c, k in kinds.items()}
    key, whole = ", ".join(same[f"c{names.index(c)}"] for c in identity), ", ".join(same.values())

    def side(df: DataFrame, tag: str) -> DataFrame:
        number = f"row_number() OVER (PARTITION BY {key} ORDER BY {whole})"
        return _placed(df).selectExpr(f"struct({key}) AS {tag}k", f"{number} AS {tag}n", f"struct({whole}) AS {tag}c", f"struct({', '.join(columns)}) AS {tag}r")

    paired = side(old, "a").join(side(new, "b"), F.expr("ak <=> bk AND an = bn"), "full_outer").where("NOT (ac <=> bc)")
    rows = paired.selectExpr("explode(filter(array(named_struct('d', -1, 'r', ar), named_struct('d', 1, 'r', br)), e -> e.r IS NOT NULL)) AS e")
    return _events(rows.select("e.d", "e.r.*"), F.col("d"), ts, names)


def diff(old: DataFrame, new: DataFrame, identity: list[str] | None = None, ts: int = 0) -> DataFrame:
    return diff_identity(old, new, identity, ts) if identity else diff_bag(old, new, ts)


def fold(events: DataFrame) -> DataFrame:
    """The rows that all events add up to: the inverse of ``init_events`` and ``diff``."""
    fields = [f for f in events.schema.fields if f.name not in (TS, DIFF)]
    names, columns = [delivered(f) for f in fields], [f"c{i}" for i in range(len(fields))]
    rows = events.select(F.col(DIFF).alias("d"), *[F.col(f"`{f.name}`").alias(c) for f, c in zip(fields, columns, strict=True)])
    kept = rows.groupBy(*columns).agg(F.sum("d").alias("n")).where(F.col("n") > 0)
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).select(*columns).toDF(*names)


def fold_last(events: DataFrame, identity: list[str], order: str, deleted) -> DataFrame:
    """State by identity: the last record of each, unless it says the row is gone."""
    last = F.row_number().over(Window.partitionBy(*identity).orderBy(F.col(order).desc()))
    return events.withColumn("_rn", last).where((F.col("_rn") == 1) & ~deleted).drop("_rn")


def seq_batches(events: DataFrame, query: str, batch: str) -> DataFrame:
    """Non-empty batches per query with their sequence numbers from 1."""
    counted = events.groupBy(query, batch).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.withColumn("seq", F.row_number().over(Window.partitionBy(query).orderBy(batch)).cast("long"))
