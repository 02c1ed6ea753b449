"""Filters over streams: a compiled filter is a Column, and works on streams unchanged."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.predicates import predicate
from ..operators.reads import projected
from ..plans.filters import is_trivial


def watch(spark: SparkSession, path: str, spec: Mapping[str, Any] | None = None, *, projection: Mapping[str, Any] | None = None, profile: str = "sql") -> DataFrame:
    """A stream of the rows of new Parquet files below ``path`` that match."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    condition = predicate(spec, schema, profile)
    return projected(rows if is_trivial(spec) else rows.filter(condition), projection)


def append(rows: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet files, exactly once across restarts."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
