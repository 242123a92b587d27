"""A client for a text-protocol message bus (``nats://``): subjects, replies, and a connection that comes back."""

from __future__ import annotations

import json
import logging
import select
import socket
import threading
import time
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

log = logging.getLogger("resultfeed.bus")


class Bus:
    """``publish`` from any thread; ``requests`` from one.  After a lost connection subscriptions are made anew."""

    def __init__(self, url: str, timeout: float = 10.0, pause: float = 0.2, tries: int = 60):
        at = urlsplit(url)
        self._address = (at.hostname or "localhost", at.port or 4222)
        self._login = {"user": unquote(at.username), "pass": unquote(at.password or "")} if at.username else {}
        self._timeout, self._pause, self._tries = timeout, pause, tries
        self._subjects: list[str] = []
        self._lock = threading.RLock()
        self._connect()

    def _connect(self) -> None:
        self._socket = socket.create_connection(self._address, self._timeout)
        self._buffer = bytearray()
        line = self._line()
        if not line.startswith(b"INFO"):
            raise ConnectionError("not a message bus")
        self._write(b"CONNECT " + json.dumps({"verbose": False, "pedantic": False, "name": "resultfeed", "lang": "python", "version": "1", **self._login}).encode() + b"\r\nPING\r\n")
        while (line := self._line()) != b"PONG":
            if line.startswith(b"-ERR"):
                raise ConnectionError(line.decode())
        for i, subject in enumerate(self._subjects, 1):
            self._write(f"SUB {subject} {i}\r\n".encode())

    def _again(self) -> None:
        """Connects once more: at once, then after pauses that double up to five seconds."""
        with self._lock:
            self._socket.close()
            delay = self._pause
            for n in range(self._tries):
                try:
                    return self._connect()
                except OSError as e:
                    log.warning("no connection to the bus (try %d): %s", n + 1, e)
                    time.sleep(delay)
                    delay = min(delay * 2, 5.0)
            raise ConnectionError("the bus doesn't answer")

    def _write(self, data: bytes) -> None:
        with self._lock:
            self._socket.sendall(data)

    def _have(self, n: int) -> None:
        while len(self._buffer) < n:
            got = self._socket.recv(1 << 16)
            if not got:
                raise ConnectionError("the bus closed the connection")
            self._buffer += got

    def _line(self) -> bytes:
        while (end := self._buffer.find(b"\r\n")) < 0:
            self._have(len(self._buffer) + 1)
        line = bytes(self._buffer[:end])
        del self._buffer[: end + 2]
        return line

    def subscribe(self, subject: str) -> None:
        self._subjects.append(subject)
        self._write(f"SUB {subject} {len(self._subjects)}\r\n".encode())

    def publish(self, subject: str, body: bytes) -> None:
        if not subject or any(c.isspace() for c in subject):
            raise ValueError(f"bad subject {subject!r}")
        data = f"PUB {subject} {len(body)}\r\n".encode() + body + b"\r\n"
        try:
            self._write(data)
        except OSError:
            self._again()
            self._write(data)

    def requests(self) -> Iterator[tuple[str, str | None, bytes] | None]:
        """(subject, reply subject, body) of each message; None after a pause without any."""
        while True:
            try:
                if not self._buffer and not select.select([self._socket], [], [], self._pause)[0]:
                    yield None
                    continue
                found = self._next()
            except (OSError, ValueError):  # closed under our hands, or by the server
                self._again()
                continue
            if found:
                yield found

    def _next(self) -> tuple[str, str | None, bytes] | None:
        line = self._line()
        if line == b"PING":
            self._write(b"PONG\r\n")
        elif line.startswith(b"MSG "):
            parts = line.decode().split()
            size = int(parts[-1])
            self._have(size + 2)
            body = bytes(self._buffer[:size])
            del self._buffer[: size + 2]
            return parts[1], parts[3] if len(parts) == 5 else None, body
        elif line.startswith(b"-ERR"):
            log.error("the bus says %s", line.decode())
        return None

    def close(self) -> None:
        self._socket.close()
