"""What the corpus operators share: tables, the shared folder, hashes and folds."""

from __future__ import annotations

import atexit
import contextlib
import io
import shutil
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space: said as what they hold, which is matched faster than what they do not.
SPACED_WORDS = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]+"
#: ASCII letters, for lower-casing these and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and
    driver and executors are one machine, as in tests, a folder below /tmp
    stands in; on a cluster each machine would have its own, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    return (where or "file:///tmp/checkpoints").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    if path.startswith(("file:", "/")):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    from pyarrow import fs

    try:
        store, inner = fs.FileSystem.from_uri(path)
        store.delete_dir(inner)
    except OSError:
        pass


#: Has a query's shuffle files removed when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    The lineage ends there: a lost executor costs no more than the tasks that
    it ran, and what follows is computed once. The shuffle files go at once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` made, once what was worked out from them is stored itself."""
    for df in tables:
        _remove(df._granary_path)


#: So many bytes of keys may be broadcast.
MOST_KEYS = 24 << 20


def keys(df: DataFrame, name: str, most: int = MOST_KEYS) -> DataFrame:
    """A table of keys, to be broadcast if its bytes, added up, are few, and joined by a shuffle if not."""
    df = stored(df, name)
    each = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    size = df.agg(F.sum(sum(each, F.lit(8)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a context.

    Batches of Spark's default size, 10,000 rows, are made smaller: rows are
    whole texts here, and a batch is held by the JVM and by its worker.
    """
    context = spark.sparkContext
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, "2000")
    if getattr(context, "_granary_shipped", False):
        return
    from .files import place

    top, held = Path(__file__).parents[2], io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted((top / "granary").rglob("*.py")):
            packed.write(path, path.relative_to(top).as_posix())
    folder = scratch(spark, "package")
    store, inner = place(folder)
    store.create_dir(inner, recursive=True)
    with store.open_output_stream(f"{inner}/granary_package.zip") as out:
        out.write(held.getvalue())
    context.addPyFile(f"{folder}/granary_package.zip")
    context._granary_shipped = True


def give_back() -> None:
    """Returns a worker's free memory to the machine at the end of a task: workers live on for other tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())  # what this pool frees, the call below returns
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def remainder(key: str | Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % of


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)
