"""Tables as Parquet folders and files, and one manifest that says which of them count.

A write makes a new folder and then replaces the manifest: inserts add their
folder to the table's, a write of one row puts its folder in place of one file.
Readers of an older version are never disturbed, and a write that fails leaves
nothing that counts.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..errors import GranaryError, collection_not_found
from ..sanitize import collection_name

MANIFEST = "_tables.json"
Paths = str | Sequence[str]


def _bare(path: str) -> str:
    """The path without its scheme, by which files and folders are compared."""
    return re.sub(r"^[a-z][a-z0-9]*:/*", "/", path).rstrip("/")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files, self.path = (fs.LocalFileSystem(), self.root) if self.root.startswith("/") else fs.FileSystem.from_uri(self.root)
        self.files.create_dir(self.path, recursive=True)

    def manifest(self) -> dict:
        """{"version": n, "tables": {name: path or paths}}."""
        try:
            with self.files.open_input_stream(f"{self.path}/{MANIFEST}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {"version": 0, "tables": {}}

    def bind(self, tables: Mapping[str, str]) -> None:
        """Adds tables that lie elsewhere; they are read and never written to."""
        self.publish({collection_name(k): v for k, v in tables.items()})

    def publish(self, paths: Mapping[str, Paths | None], seen: int | None = None) -> int:
        """All of these tables' new paths at once, or an error if another writer came first."""
        now = self.manifest()
        if seen is not None and now["version"] != seen:
            raise GranaryError("QUERY_ERROR", "Another write came first.", "Run the operation again.")
        tables = {k: v for k, v in {**now["tables"], **paths}.items() if v}
        text = json.dumps({"version": now["version"] + 1, "tables": tables}, indent=1, sort_keys=True)
        own = f"{self.path}/{MANIFEST}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(own) as f:
            f.write(text.encode())
        self.files.move(own, f"{self.path}/{MANIFEST}")
        return now["version"] + 1

    def names(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def locations(self, name: str, tables: Mapping[str, Paths] | None = None) -> list[str]:
        """The folders and files that hold the table's rows."""
        tables = self.manifest()["tables"] if tables is None else tables
        if name not in tables:
            raise collection_not_found(name, tables)
        return [tables[name]] if isinstance(tables[name], str) else list(tables[name])

    def read(self, name: str, tables: Mapping[str, Paths] | None = None) -> DataFrame:
        return self.spark.read.parquet(*self.locations(collection_name(name), tables))

    def _inside(self, path: str) -> list[str]:
        return [unquote(f) for f in self.spark.read.parquet(path).inputFiles()]

    def flat(self, paths: Sequence[str]) -> bool:
        """Whether files hold all columns: no folder of a table from elsewhere stands for a value."""
        own = _bare(self.root) + "/"
        return not any("=" in _bare(f).removeprefix(_bare(p)).rpartition("/")[0] for p in paths if not _bare(p).startswith(own) for f in self._inside(p))

    def without(self, paths: Sequence[str], file: str) -> list[str] | None:
        """The paths without one file; the folder that it lies in gives way to its other files."""
        for i, p in enumerate(paths):
            if _bare(p) == _bare(file):
                return [*paths[:i], *paths[i + 1 :]]
            if _bare(file).startswith(_bare(p) + "/"):
                return [*paths[:i], *(f for f in self._inside(p) if _bare(f) != _bare(file)), *paths[i + 1 :]]
        return None

    def write(self, name: str, df: DataFrame) -> str:
        """A new folder with the table's rows; nobody sees it until it is published."""
        path = f"{self.root}/{collection_name(name)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

