"""PostgreSQL's logical replication messages (``pgoutput``, version 1): decoder and Spark data source.

``Decoder`` keeps relations by id and turns messages into changes; old tuples are kept as before images.
``PgOutputSource`` reads files of framed messages, as :mod:`~resultfeed.sources.replication` spools them, as a stream
of change records, whole transactions at a time.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from resultfeed.functions.types import JSON_OIDS, text_value

from .changelog import SCHEMA
from .replication import SUFFIX, framed, number


@dataclass(frozen=True)
class Relation:
    oid: int
    schema: str
    table: str
    columns: tuple[tuple[str, int, bool], ...]  # name, type, part of the replica identity


@dataclass(frozen=True)
class Change:
    """kind: begin, commit, insert, update, delete, truncate, relation, other."""

    kind: str
    table: str = ""
    before: dict | None = None
    after: dict | None = None
    lsn: int = 0
    xid: int = 0
    tables: tuple[str, ...] = ()
    partial: bool = False


class Truncated(Exception):
    """A message that ends too early."""


class _Bytes:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Truncated
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Truncated
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out


@dataclass
class Decoder:
    relations: dict[int, Relation] = field(default_factory=dict)

    def decode(self, message: bytes) -> Change | None:
        """The change a message stands for; None for a message cut short or one of an unknown relation."""
        if not message:
            return None
        try:
            b, kind = _Bytes(message, 1), message[:1]
            if kind == b"B":
                return Change("begin", lsn=b.number(">Q"), xid=(b.take(8), b.number(">I"))[1])
            if kind == b"C":
                b.take(1)
                return Change("commit", lsn=(b.number(">Q"), b.number(">Q"), b.take(8))[1])
            if kind == b"R":
                return self._relation(b)
            if kind == b"T":
                n, _ = b.number(">I"), b.take(1)
                return Change("truncate", tables=tuple(self.relations[i].table for i in (b.number(">I") for _ in range(n)) if i in self.relations))
            if kind in (b"I", b"U", b"D"):
                return self._row(kind, b)
            return Change("other")
        except Truncated:
            return None

    def _relation(self, b: _Bytes) -> Change:
        oid, schema, table, _ = b.number(">I"), b.text(), b.text(), b.take(1)
        columns = []
        for _ in range(b.number(">H")):
            flag, name, kind, _ = b.number(">B"), b.text(), b.number(">I"), b.take(4)
            columns.append((name.lower(), kind, bool(flag & 1)))
        self.relations[oid] = Relation(oid, schema, table.lower(), tuple(columns))
        return Change("relation", table=table.lower())

    def _row(self, kind: bytes, b: _Bytes) -> Change | None:
        relation = self.relations.get(b.number(">I"))
        if relation is None:
            return None
        before, after, partial = None, None, False
        mark = b.take(1)
        if mark in (b"K", b"O"):
            row, short = self._tuple(relation, b)
            key = {c for c, _, is_key in relation.columns if is_key}
            before = row if mark == b"O" else {c: v for c, v in row.items() if c in key}
            partial |= short
            mark = b.take(1) if kind == b"U" else b""
        if kind != b"D":
            if mark != b"N":
                return None
            after, short = self._tuple(relation, b)
            partial |= short
        return Change({b"I": "insert", b"U": "update", b"D": "delete"}[kind], relation.table, before, after, partial=partial)

    def _tuple(self, relation: Relation, b: _Bytes) -> tuple[dict, bool]:
        """Values by column; an unchanged large value is left out and makes the row partial."""
        row, partial = {}, False
        for i in range(b.number(">H")):
            name, oid, _ = relation.columns[i] if i < len(relation.columns) else (f"column{i}", 25, False)
            mark = b.take(1)
            if mark == b"n":
                row[name] = None
            elif mark == b"u":
                partial = True
            elif mark == b"t":
                text = b.take(b.number(">I")).decode("utf-8", "replace")
                row[name] = text if oid in JSON_OIDS else text_value(text, oid)
            elif mark == b"b":
                row[name] = "\\x" + b.take(b.number(">I")).hex()
            else:
                raise Truncated
        return row, partial


def transactions(messages: Iterator[bytes]) -> Iterator[tuple[int, list[tuple]]]:
    """Whole transactions as (number of messages read so far, records of ``SCHEMA``)."""
    decoder, rows, lsn, xid, n = Decoder(), [], 0, 0, 0
    op = {"insert": "I", "update": "U", "delete": "D"}
    for n, message in enumerate(messages, 1):
        c = decoder.decode(message)
        if c is None or c.kind in ("relation", "other"):
            continue
        if c.kind == "begin":
            rows, lsn, xid = [], c.lsn, c.xid
        elif c.kind == "commit":
            yield n, rows
            rows = []
        elif c.kind == "truncate":
            rows += [(lsn, len(rows) + i, xid, t, "T", None, None, False) for i, t in enumerate(c.tables)]
        else:
            image = lambda r: None if r is None else json.dumps(r)
            rows.append((lsn, len(rows), xid, c.table, op[c.kind], image(c.before), image(c.after), c.partial))


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are numbers of spooled files: each holds whole transactions and stands by itself, so that a batch reads
    its own files only."""

    def __init__(self, path: str, most: int, keep: bool):
        self.path, self.most, self.keep = path, most, keep

    def _numbers(self) -> list[int]:
        return sorted(number(n) for n in os.listdir(self.path) if n.endswith(SUFFIX))

    def _file(self, n: int) -> str:
        return os.path.join(self.path, f"{n:020d}{SUFFIX}")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": min(self._numbers(), default=0)}

    def _rows(self, numbers: list[int]) -> Iterator[tuple]:
        for n in numbers:
            for _, rows in transactions(framed(self._file(n))):
                yield from rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = [n for n in self._numbers() if n >= start["next"]][: self.most]
        return iter(list(self._rows(found))), {"next": found[-1] + 1 if found else start["next"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(list(self._rows([n for n in self._numbers() if start["next"] <= n < end["next"]])))

    def commit(self, end: dict) -> None:
        """Files that a finished batch has read go."""
        for n in self._numbers() if not self.keep else []:
            if n < end["next"]:
                os.remove(self._file(n))


class PgOutputSource(DataSource):
    """``spark.readStream.format("pgoutput").option("path", ..)``: a folder that a ``Spooler`` fills.

    ``maxFiles`` bounds a batch (one file holds some megabytes at most, or one transaction); with ``keep`` files stay
    when they have been read.
    """

    @classmethod
    def name(cls) -> str:
        return "pgoutput"

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Reader(self.options["path"], int(self.options.get("maxFiles", "16")), self.options.get("keep", "false").lower() == "true")
