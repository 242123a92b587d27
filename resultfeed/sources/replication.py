"""A live change source: PostgreSQL's streaming replication protocol, spooled as files of whole transactions.

``Replication`` speaks the wire protocol (version 3) over a socket: start-up, authentication (trust, password, MD5,
SCRAM-SHA-256), slot, stream, keep-alives and status.  ``Spooler`` writes each transaction's ``pgoutput`` messages into
numbered files that stand by themselves (a file begins with the relations known by then); a file appears by rename, when
it is on disk, and only then is its last commit reported to the server as flushed.  So the server keeps what isn't
spooled, and :class:`~resultfeed.sources.pgoutput.PgOutputSource` reads what is.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import logging
import os
import select
import socket
import struct
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qs, unquote, urlsplit

log = logging.getLogger("resultfeed.replication")
#: Seconds between status reports, and of silence after which a report is sent anyway.
STATUS_SECS, IDLE_SECS = 10.0, 30.0
#: Microseconds from 1970 to 2000, where the server's clock starts.
EPOCH = 946_684_800_000_000
SUFFIX = ".tx"


class ServerError(RuntimeError):
    """What the server says: SQLSTATE and message."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def lsn_text(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"


@dataclass
class Scram:
    """Client side of SCRAM-SHA-256 (RFC 5802, without channel binding)."""

    password: str
    nonce: str = field(default_factory=lambda: base64.b64encode(os.urandom(18)).decode())

    def first(self) -> bytes:
        return f"n,,n=,r={self.nonce}".encode()

    def final(self, server_first: bytes) -> bytes:
        said = dict(x.split("=", 1) for x in server_first.decode().split(","))
        if not said["r"].startswith(self.nonce):
            raise ServerError("28000", "the server's nonce isn't ours")
        salted = hashlib.pbkdf2_hmac("sha256", self.password.encode(), base64.b64decode(said["s"]), int(said["i"]))
        mac = lambda key, text: hmac.new(key, text, hashlib.sha256).digest()
        client = mac(salted, b"Client Key")
        bare = f"c=biws,r={said['r']}"
        text = ",".join([f"n=,r={self.nonce}", server_first.decode(), bare]).encode()
        proof = bytes(a ^ b for a, b in zip(client, mac(hashlib.sha256(client).digest(), text), strict=True))
        self._verifier = base64.b64encode(mac(mac(salted, b"Server Key"), text))
        return f"{bare},p={base64.b64encode(proof).decode()}".encode()

    def check(self, server_final: bytes) -> None:
        if server_final != b"v=" + self._verifier:
            raise ServerError("28000", "the server doesn't know the password")


class Replication:
    """One replication connection."""

    def __init__(self, url: str, timeout: float = 30.0):
        at = urlsplit(url)
        self.host, self.port = at.hostname or "localhost", at.port or 5432
        self.user, self.password = unquote(at.username or "postgres"), unquote(at.password or "")
        self.database = at.path.lstrip("/") or self.user
        if parse_qs(at.query).get("sslmode", ["disable"])[0] not in ("disable", "allow", "prefer"):
            raise ValueError("only connections without TLS are supported")
        self._socket = socket.create_connection((self.host, self.port), timeout)
        self._buffer = bytearray()
        try:
            self._start()
        except BaseException:
            self.close()
            raise

    def close(self) -> None:
        self._socket.close()

    # messages

    def _send(self, kind: bytes, body: bytes) -> None:
        self._socket.sendall(kind + struct.pack(">I", len(body) + 4) + body)

    def _have(self, n: int) -> None:
        while len(self._buffer) < n:
            got = self._socket.recv(1 << 16)
            if not got:
                raise ConnectionError("the server closed the connection")
            self._buffer += got

    def _receive(self) -> tuple[bytes, bytes]:
        self._have(5)
        size = struct.unpack_from(">I", self._buffer, 1)[0] + 1
        self._have(size)
        kind, body = bytes(self._buffer[:1]), bytes(self._buffer[5:size])
        del self._buffer[:size]
        if kind == b"E":
            said = {x[:1]: x[1:].decode("utf-8", "replace") for x in body.split(b"\0") if x}
            raise ServerError(said.get(b"C", "?????"), said.get(b"M", "unknown error"))
        return kind, body

    def waiting(self, seconds: float) -> bool:
        """Whether something can be read."""
        return bool(self._buffer) or bool(select.select([self._socket], [], [], seconds)[0])

    # start-up

    def _start(self) -> None:
        settings = {"user": self.user, "database": self.database, "replication": "database", "client_encoding": "UTF8"}
        body = struct.pack(">I", 196608) + b"".join(f"{k}\0{v}\0".encode() for k, v in settings.items()) + b"\0"
        self._socket.sendall(struct.pack(">I", len(body) + 4) + body)
        scram = None
        while True:
            kind, body = self._receive()
            if kind == b"Z":
                return
            if kind != b"R":
                continue
            asked = struct.unpack_from(">I", body)[0]
            if asked == 3:
                self._send(b"p", self.password.encode() + b"\0")
            elif asked == 5:
                inner = hashlib.md5((self.password + self.user).encode()).hexdigest()
                self._send(b"p", b"md5" + hashlib.md5(inner.encode() + body[4:8]).hexdigest().encode() + b"\0")
            elif asked == 10:
                if b"SCRAM-SHA-256" not in body[4:].split(b"\0"):
                    raise ServerError("28000", "no common way of authentication")
                scram = Scram(self.password)
                first = scram.first()
                self._send(b"p", b"SCRAM-SHA-256\0" + struct.pack(">I", len(first)) + first)
            elif asked == 11:
                self._send(b"p", scram.final(body[4:]))
            elif asked == 12:
                scram.check(body[4:])
            elif asked != 0:
                raise ServerError("28000", f"authentication method {asked} is not supported")

    def command(self, text: str) -> None:
        self._send(b"Q", text.encode() + b"\0")
        error = None
        while True:
            try:
                kind, _ = self._receive()
            except ServerError as e:
                error = e
                continue
            if kind == b"Z":
                if error:
                    raise error
                return

    # stream

    def make_slot(self, slot: str) -> None:
        """The slot, unless it is there."""
        try:
            self.command(f'CREATE_REPLICATION_SLOT "{slot}" LOGICAL pgoutput NOEXPORT_SNAPSHOT')
        except ServerError as e:
            if e.code != "42710":
                raise

    def stream(self, slot: str, publication: str, start: int = 0) -> None:
        """Starts to stream from ``start``; 0 means where the slot stands."""
        quoted = publication.replace("'", "''").replace('"', '""')
        self._send(b"Q", f"START_REPLICATION SLOT \"{slot}\" LOGICAL {lsn_text(start)} (proto_version '1', publication_names '\"{quoted}\"')".encode() + b"\0")
        while self._receive()[0] != b"W":
            pass

    def messages(self, flushed: Callable[[], int], stop: threading.Event, pause: float = 0.05) -> Iterator[bytes | None]:
        """``pgoutput`` messages as they come, None after a pause without any.  Reports ``flushed()`` every
        ``STATUS_SECS``, and when the server asks."""
        reported, end = 0.0, 0
        while not stop.is_set():
            if time.monotonic() - reported >= STATUS_SECS:
                self.status(flushed())
                reported = time.monotonic()
            if not self.waiting(pause):
                yield None
                continue
            kind, body = self._receive()
            if kind == b"c":
                return
            if kind != b"d":
                continue
            if body[:1] == b"w":
                yield body[25:]
            elif body[:1] == b"k":
                end, _, asked = struct.unpack_from(">QQB", body, 1)
                if asked:
                    self.status(flushed())
                    reported = time.monotonic()

    def status(self, flushed: int) -> None:
        now = int(time.time() * 1_000_000) - EPOCH
        self._send(b"d", b"r" + struct.pack(">QQQqB", flushed, flushed, flushed, now, 0))


class Spooler:
    """Whole transactions into numbered files of a folder."""

    def __init__(self, folder: str, most_bytes: int = 8 << 20):
        self.folder, self.most = folder, most_bytes
        os.makedirs(folder, exist_ok=True)
        for name in os.listdir(folder):
            if name.endswith(".part"):  # of a process that ended
                os.remove(os.path.join(folder, name))
        last, self.flushed = self._mark()
        for n in sorted(number(n) for n in os.listdir(folder) if n.endswith(SUFFIX)):
            if n > last:  # a process ended between a file and its mark
                ends = [struct.unpack_from(">Q", m, 10)[0] for m in framed(os.path.join(folder, f"{n:020d}{SUFFIX}")) if m[:1] == b"C"]
                last, self.flushed = n, max([self.flushed, *ends])
        self.next = last + 1
        self._relations: dict[int, bytes] = {}
        self._known: list[bytes] = []  # relations at the start of the file
        self._file: list[bytes] = []  # whole transactions
        self._open: list[bytes] | None = None  # messages of the transaction under way
        self._end = self.flushed

    def _mark(self) -> tuple[int, int]:
        """The last number given, and the position behind its last commit: files go when they have been read, their
        numbers don't come back."""
        try:
            with open(os.path.join(self.folder, "last")) as f:
                last, end = f.read().split()
                return int(last), int(end)
        except FileNotFoundError:
            return -1, 0

    def take(self, message: bytes) -> None:
        kind = message[:1]
        if kind == b"R":
            self._relations[struct.unpack_from(">I", message, 1)[0]] = message
        if kind == b"B":
            if not self._file:
                self._known = list(self._relations.values())
            self._open = [message]
        elif self._open is not None:
            self._open.append(message)
            if kind == b"C":
                end = struct.unpack_from(">Q", message, 10)[0]  # behind the commit
                if end > self._end:  # else it came before: a server sends again what it has no word of
                    self._file += self._open
                    self._end = end
                self._open = None
                if sum(map(len, self._file)) >= self.most:
                    self.flush()

    def flush(self) -> None:
        """What is whole goes to disk, and counts as flushed."""
        if not self._file:
            return
        name = os.path.join(self.folder, f"{self.next:020d}")
        with open(name + ".part", "wb") as f:
            for m in [*self._known, *self._file]:
                f.write(struct.pack(">I", len(m)) + m)
            f.flush()
            os.fsync(f.fileno())
        mark = os.path.join(self.folder, "last")
        with open(mark + ".part", "w") as f:
            f.write(f"{self.next} {self._end}")
            f.flush()
            os.fsync(f.fileno())
        os.rename(name + ".part", name + SUFFIX)
        os.rename(mark + ".part", mark)
        self.next, self._file, self.flushed = self.next + 1, [], self._end

    def drop_open(self) -> None:
        """A connection ended: the server sends the transaction under way again."""
        self._open = None


def framed(path: str) -> Iterator[bytes]:
    """Messages of a file, each behind its length (4 bytes, big-endian); a last incomplete one is left."""
    with open(path, "rb") as f:
        while len(head := f.read(4)) == 4:
            body = f.read(struct.unpack(">I", head)[0])
            if len(body) < struct.unpack(">I", head)[0]:
                return
            yield body


def number(name: str) -> int:
    return int(name.removesuffix(SUFFIX))


def follow(url: str, slot: str, publication: str, spooler: Spooler, stop: threading.Event, timeout: float = 30.0, wait: Callable[[float], bool] | None = None, connect: Callable[[str, float], Replication] = Replication) -> None:
    """Spools a publication until ``stop``.  A lost connection is made anew one second later, then two, up to a minute; a
    connection that brought something sets the delay back."""
    wait, delay = wait or stop.wait, 1.0
    while not stop.is_set():
        before, link = spooler.next, None
        try:
            link = connect(url, timeout)
            link.make_slot(slot)
            link.stream(slot, publication, spooler.flushed)
            for message in link.messages(lambda: spooler.flushed, stop):
                if message is None:
                    spooler.flush()
                else:
                    spooler.take(message)
            spooler.flush()
            link.status(spooler.flushed)
            if stop.is_set():
                return
            raise ConnectionError("the server ended the stream")
        except (OSError, ServerError, struct.error) as e:
            spooler.drop_open()
            if stop.is_set():
                return
            delay = 1.0 if spooler.next > before else delay
            log.warning("replication failed, next try in %.0f s: %s", delay, e)
            if wait(delay):
                return
            delay = min(delay * 2, 60.0)
        finally:
            if link is not None:
                link.close()
