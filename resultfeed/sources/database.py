"""Tables of a database through JDBC: the first version of what the engine follows."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resultfeed.config import Config

#: Rows that a connection fetches at once.
FETCH = 10_000


def jdbc_url(url: str) -> tuple[str, dict[str, str]]:
    """A JDBC URL and its login, from a ``postgres://user:password@host:port/database`` URL; a JDBC URL stays."""
    if url.startswith("jdbc:"):
        return url, {}
    at = urlsplit(url)
    login = {"user": unquote(at.username)} if at.username else {}
    if at.password:
        login["password"] = unquote(at.password)
    where = f"jdbc:postgresql://{at.hostname or 'localhost'}:{at.port or 5432}{at.path}"
    return where + (f"?{at.query}" if at.query else ""), login


@dataclass
class Database:
    """``db_pool_size`` bounds the connections of a read, ``db_timeout_secs`` the seconds of a statement."""

    spark: SparkSession
    config: Config
    driver: str | None = None

    def _options(self) -> dict[str, str]:
        url, login = jdbc_url(self.config.database_url)
        return {"url": url, **login, "fetchsize": str(FETCH), "queryTimeout": str(self.config.db_timeout_secs), **({"driver": self.driver} if self.driver else {})}

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self._options()).option("query", sql).load()

    def ping(self) -> bool:
        one = "SELECT 1 AS one" + (" FROM sysibm.sysdummy1" if ":derby:" in self.config.database_url else "")
        return self.query(one).first()[0] == 1

    def table(self, name: str, by: str | None = None) -> DataFrame:
        """A table; with ``by``, a number, date or time column, it is read over ``db_pool_size`` connections, each a
        range of the column's values.  Filters and columns that a query doesn't need go to the database."""
        whole = self.spark.read.format("jdbc").options(**self._options()).option("dbtable", name).load()
        if by is None:
            return whole
        low, high = whole.agg(F.min(F.col(f"`{by}`")), F.max(F.col(f"`{by}`"))).first()  # aggregated by the database
        if low is None or low == high:
            return whole
        ranged = {"partitionColumn": by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(self.config.db_pool_size)}
        return self.spark.read.format("jdbc").options(**self._options(), **ranged).option("dbtable", name).load()

    def load(self, engine, name: str, keys: list[str], by: str | None = None) -> None:
        """Copies a table into the engine's state, from where changes keep it up to date.  Column names become lower
        case, as in change records."""
        rows = self.table(name, by)
        engine.add_table(name.split(".")[-1], rows.toDF(*[c.lower() for c in rows.columns]), [k.lower() for k in keys])
