"""How rows are delivered: JSON objects with explicit nulls, exact decimals and readable bytes."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hex_bytes(c: Column) -> Column:
    r"""Binary as ``\x`` and lower-case hex."""
    return F.concat(F.lit("\\x"), F.lower(F.hex(c)))


def rendered(c: Column, kind: T.DataType, json: bool = False) -> Column:
    """A column as it goes into JSON: NaN and infinities null, decimals and binary as text, JSON embedded."""
    if json:
        return F.try_parse_json(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    if isinstance(kind, T.BinaryType):
        return hex_bytes(c)
    if isinstance(kind, (T.DecimalType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return c.cast("string")
    if isinstance(kind, T.TimestampNTZType):
        return c.cast("string")
    if isinstance(kind, T.TimestampType):
        return F.concat(F.replace(F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rendered(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[rendered(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: rendered(v, kind.valueType))
    return c


def row_json(df: DataFrame, columns: list[str] | None = None, json_columns: tuple[str, ...] = ()) -> Column:
    """A JSON object per row, nulls included, in the order of the columns."""
    fields = [df.schema[c] for c in (columns if columns is not None else df.columns)]
    parts = [rendered(F.col(f"`{f.name}`"), f.dataType, f.name in json_columns).alias(f.name) for f in fields]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}) if parts else F.lit("{}")


def from_row_json(c: Column, schema: T.StructType) -> Column:
    """The typed row behind ``row_json`` (binary excepted): null where a value doesn't parse."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def content_key(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row's JSON: differs for (1, null) and (null, 1)."""
    return F.sha2(row_json(df, columns), 256)


def comparable(c: Column, kind: T.DataType) -> Column:
    """A column in a form that Spark can group by and compare: maps as sorted entries, variants as JSON."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(c))
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c


def now_ms() -> int:
    return int(time.time() * 1000)


TS, DIFF = "mz_timestamp", "mz_diff"
#: Column metadata: the name under which a column is delivered, where it differs.
NAME = "resultfeed.name"


def delivered(field: T.StructField) -> str:
    return field.metadata.get(NAME, field.name)


def event_columns(columns: list[Column], names: list[str]) -> list[Column]:
    """A result's columns beside those of an event: one that is named like them, or like another, gets a free name, and
    keeps its own as metadata."""
    taken, out = {TS, DIFF}, []
    for c, name in zip(columns, names, strict=True):
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(c.alias(free) if free == name else c.alias(free, metadata={NAME: name}))
    return out


def event(df: DataFrame, diff: int, ts: int) -> DataFrame:
    """Rows as events: mz_timestamp, mz_diff, and the columns."""
    n = len(df.columns)
    placed = df.toDF(*[f"c{i}" for i in range(n)])
    return placed.select(F.lit(ts).cast("long").alias(TS), F.lit(diff).cast("int").alias(DIFF), *event_columns([F.col(f"c{i}") for i in range(n)], df.columns))
