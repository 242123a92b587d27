"""PostgreSQL types as Spark types, for query results and for change records."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Type names (lower case, without length) of the query path.
BY_NAME: dict[str, T.DataType] = {
    "int2": T.ShortType(), "smallint": T.ShortType(), "int4": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(), "serial": T.IntegerType(),
    "int8": T.LongType(), "bigint": T.LongType(), "bigserial": T.LongType(), "float4": T.FloatType(), "real": T.FloatType(), "float8": T.DoubleType(), "double precision": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "text": T.StringType(), "varchar": T.StringType(), "character varying": T.StringType(), "bpchar": T.StringType(), "char": T.StringType(), "name": T.StringType(),
    "uuid": T.StringType(), "json": T.StringType(), "jsonb": T.StringType(), "timestamp": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "date": T.DateType(), "time": T.StringType(), "timetz": T.StringType(), "bytea": T.BinaryType(),
    "interval": T.DayTimeIntervalType(),
}

#: Type OIDs of the change path; any other is text.
BY_OID: dict[int, T.DataType] = {
    16: T.BooleanType(), 17: T.BinaryType(), 20: T.LongType(), 21: T.ShortType(), 23: T.IntegerType(), 25: T.StringType(), 114: T.StringType(), 700: T.FloatType(), 701: T.DoubleType(),
    1042: T.StringType(), 1043: T.StringType(), 1082: T.DateType(), 1114: T.TimestampNTZType(), 1184: T.TimestampType(), 2950: T.StringType(), 3802: T.StringType(),
}
NUMERIC_OID, JSON_OIDS = 1700, (114, 3802)


def spark_type(declared: str) -> T.DataType:
    """Spark's type for a declared PostgreSQL type such as ``numeric(10,2)`` or ``text[]``; unknown ones are text."""
    name = " ".join(declared.lower().split())
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2]))
    if m := re.fullmatch(r"(?:numeric|decimal)(?:\((\d+)(?:, ?(\d+))?\))?", name):
        return T.DecimalType(min(int(m[1]), 38), int(m[2] or 0)) if m[1] else T.DecimalType(38, 18)
    return BY_NAME.get(re.sub(r"\(\d+\)", "", name).strip(), T.StringType())


def oid_type(oid: int, modifier: int = -1) -> T.DataType:
    if oid == NUMERIC_OID:
        return T.DecimalType(((modifier - 4) >> 16) & 0xFFFF, (modifier - 4) & 0xFFFF) if modifier >= 4 else T.DecimalType(38, 18)
    return BY_OID.get(oid, T.StringType())


def text_value(text: str, oid: int) -> object:
    """A value of a change record from its text: booleans and numbers as such, all else as text."""
    if oid == 16:
        return text in ("t", "true")
    try:
        if oid in (20, 21, 23):
            return int(text)
        if oid in (700, 701):
            return float(text)
    except ValueError:
        return text
    return text
