"""Which reader an address means."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..errors import GranaryError

# Schemes of addresses, and the dialect of SQL that each speaks.
SCHEMES = {"postgresql": "pg", "postgres": "pg", "mysql": "mysql", "mssql": "mssql", "sqlite": "sqlite"}
DRIVERS = {"pg": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "sqlite": "org.sqlite.JDBC"}
FILES = ("file", "hdfs", "s3", "s3a", "gs", "abfss", "viewfs")
#: Connections by preset: most and least.
POOLS = {"high": (20, 2), "standard": (10, 2), "low": (5, 1)}


@dataclass(frozen=True)
class Address:
    kind: str  # files, jdbc, document, search
    uri: str
    dialect: str = "spark"

    def options(self, table: str, pool: str = "standard", split: tuple[str, Any, Any] | None = None) -> dict[str, str]:
        """Options of the reader for one table.

        With ``split``, a column and its least and most value, JDBC reads in as
        many ranges as the pool has connections; without, one task reads all.
        """
        if self.kind == "jdbc":
            rest = self.uri.split("://", 1)[-1]
            name = {"pg": "postgresql", "mssql": "sqlserver"}.get(self.dialect, self.dialect)
            return {"url": f"jdbc:{name}:{'' if self.dialect == 'sqlite' else '//'}{rest}", "dbtable": table, "driver": DRIVERS[self.dialect], "numPartitions": str(POOLS[pool][0])} | (
                {"partitionColumn": split[0], "lowerBound": str(split[1]), "upperBound": str(split[2])} if split else {}
            )
        if self.kind == "document":
            return {"connection.uri": self.uri, "collection": table}
        return {"es.nodes": self.uri, "es.resource": table}

    @property
    def format(self) -> str:
        return {"files": "parquet", "jdbc": "jdbc", "document": "mongodb", "search": "org.elasticsearch.spark.sql"}[self.kind]


def detect(uri: str) -> Address:
    scheme = uri.split(":", 1)[0] if ":" in uri else ""
    if uri.startswith("/") or scheme in FILES:
        return Address("files", uri)
    if scheme == "jdbc":
        name = uri.split(":")[1]
        return Address("jdbc", uri.removeprefix("jdbc:"), {"postgresql": "pg", "sqlserver": "mssql"}.get(name, name))
    if scheme in SCHEMES:
        return Address("jdbc", uri, SCHEMES[scheme])
    if scheme in ("mongodb", "mongodb+srv"):
        return Address("document", uri)
    if scheme in ("http", "https"):
        return Address("search", uri)
    raise GranaryError("CONNECTION_FAILED", f"No source is known for {redacted(uri)}.", "Use a path, file:, hdfs:, s3a:, jdbc:, postgresql:, mysql:, mssql:, sqlite:, mongodb: or http(s):.")


def redacted(uri: str) -> str:
    """The address without user and password."""
    if "://" in uri and "@" in uri:
        scheme, rest = uri.split("://", 1)
        return f"{scheme}://***@{rest.rsplit('@', 1)[1]}"
    return uri
