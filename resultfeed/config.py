"""Settings from the environment, counters, and logging.

A setting that is out of bounds or unparsable is an error; nothing falls back silently.
"""

from __future__ import annotations

import json
import logging
import os
import re
import threading
import time
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

PRODUCT = "resultfeed"


def _server_id() -> str:
    return f"rf-{int(time.time() * 1000) & 0xFFFFFF:06x}"


@dataclass(frozen=True)
class Config:
    """All settings with their defaults.  ``from_env`` reads them; ``validated`` checks bounds."""

    server_id: str = field(default_factory=_server_id)
    log_level: str = "info"
    log_format: str = "compact"
    shutdown_timeout_secs: int = 30
    database_url: str = ""
    db_pool_size: int = 16
    db_timeout_secs: int = 30
    bus_url: str = "nats://localhost:4222"
    bus_prefix: str = PRODUCT
    client_timeout_secs: int = 30
    cleanup_interval_secs: int = 10
    max_subscriptions: int = 10_000
    wal_slot: str = f"{PRODUCT}_slot"
    wal_publication: str = f"{PRODUCT}_pub"
    requery_parallelism: int = 8
    inline_rows: int = 10_000

    #: setting -> environment variables, the first that is set counts
    ENV = {
        "server_id": ("SERVER_ID",),
        "log_level": ("LOG_LEVEL",),
        "log_format": ("LOG_FORMAT",),
        "shutdown_timeout_secs": ("SHUTDOWN_TIMEOUT_SECS",),
        "database_url": ("DATABASE_URL", "POSTGRES_URL"),
        "db_pool_size": ("DB_POOL_SIZE",),
        "db_timeout_secs": ("DB_TIMEOUT_SECS",),
        "bus_url": ("NATS_URL",),
        "bus_prefix": ("NATS_PREFIX",),
        "client_timeout_secs": ("CLIENT_TIMEOUT_SECS",),
        "cleanup_interval_secs": ("CLEANUP_INTERVAL_SECS",),
        "max_subscriptions": ("MAX_SUBSCRIPTIONS",),
        "wal_slot": ("WAL_SLOT",),
        "wal_publication": ("WAL_PUBLICATION",),
        "requery_parallelism": ("REQUERY_PARALLELISM",),
        "inline_rows": ("INLINE_ROWS",),
    }
    #: setting -> (least, most)
    BOUNDS = {
        "shutdown_timeout_secs": (1, None),
        "db_pool_size": (1, 100),
        "db_timeout_secs": (1, None),
        "client_timeout_secs": (5, None),
        "cleanup_interval_secs": (1, None),
        "max_subscriptions": (1, None),
        "requery_parallelism": (1, 64),
        "inline_rows": (1, None),
    }

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = next((env[v] for v in cls.ENV[f.name] if env.get(v)), None)
            if raw is None:
                continue
            if f.type == "int":
                try:
                    found[f.name] = int(raw)
                except ValueError:
                    raise ValueError(f"{cls.ENV[f.name][0]}: not a whole number: {raw!r}") from None
            else:
                found[f.name] = raw
        return cls(**found).validated()

    def validated(self) -> Config:
        for name, (least, most) in self.BOUNDS.items():
            value = getattr(self, name)
            if value < least or (most is not None and value > most):
                raise ValueError(f"{self.ENV[name][0]} must be {least}..{most if most is not None else ''}, not {value}")
        return self

    def subject(self, subscription_id: str, verb: str) -> str:
        return f"{self.bus_prefix}.{subscription_id}.{verb}"

    def summary(self) -> dict[str, object]:
        """For the log: URLs without their passwords."""
        return {f.name: mask_url(v) if isinstance(v := getattr(self, f.name), str) and "://" in v else v for f in fields(self)}


def mask_url(url: str) -> str:
    return re.sub(r"(://[^:/@]*):[^@/]*@", r"\1:***@", url)


class Metrics:
    """Counters behind one lock."""

    NAMES = ("queries", "query_errors", "query_ms", "transactions", "changes", "requeries", "incremental", "skipped", "restarts", "msgs_in", "msgs_out")

    def __init__(self):
        self._lock = threading.Lock()
        self._n = dict.fromkeys(self.NAMES, 0)

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self._n[name] += n

    def __getitem__(self, name: str) -> int:
        with self._lock:
            return self._n[name]

    def query_stats(self) -> tuple[int, int, float]:
        """Queries run, failed, and their mean milliseconds."""
        with self._lock:
            n = self._n["queries"]
            return n, self._n["query_errors"], self._n["query_ms"] / n if n else 0.0

    def snapshot(self) -> dict[str, int]:
        with self._lock:
            return dict(self._n)


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"t": record.created, "level": record.levelname.lower(), "target": record.name, "message": record.getMessage()})


def setup_logging(config: Config) -> logging.Logger:
    """The package's logger in the configured level and format (compact, pretty, json)."""
    handler = logging.StreamHandler()
    forms = {"compact": "%(levelname).1s %(name)s %(message)s", "pretty": "%(asctime)s %(levelname)-7s %(name)s\n    %(message)s"}
    handler.setFormatter(_JsonLines() if config.log_format == "json" else logging.Formatter(forms[config.log_format]))
    logger = logging.getLogger(PRODUCT)
    logger.handlers[:] = [handler]
    logger.setLevel(config.log_level.upper())
    return logger
