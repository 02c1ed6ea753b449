"""Writes as functions of tables: each returns the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GranaryError, unknown_field, unknown_operator
from ..plans.filters import equalities
from .predicates import Compiler, holds, literal, resolve
from .reads import order

UPDATES = ("$set", "$inc", "$unset", "$push", "$pull")
_ROW = "__granary_row"


def assignments(update: Mapping[str, Any], schema: T.StructType, required: Iterable[str] = (), profile: str = "sql") -> dict[str, Column]:
    """The new value of each field that the update names, from the row as it was."""
    if not isinstance(update, Mapping) or not any(update.get(k) for k in UPDATES):
        raise GranaryError("QUERY_ERROR", "The update changes nothing.", "Use $set, $inc, $unset, $push or $pull.")
    found: dict[str, Column] = {}
    for op, fields in update.items():
        if op not in UPDATES:
            raise unknown_operator(op)
        for name, value in (fields or {}).items():
            if name not in schema.names:
                raise unknown_field(name, schema.names)
            if name in found:
                raise GranaryError("QUERY_ERROR", f'"{name}" is changed twice.', "Name each field in one operator.")
            c, kind = resolve(name, schema)
            if (op == "$unset" or (op == "$set" and value is None)) and name in required:
                raise GranaryError("VALIDATION_ERROR", f'"{name}" is required.', "Give it a value.")
            found[name] = _assigned(op, c, kind, value, name, profile).cast(kind)
    return found


def _assigned(op: str, c: Column, kind: T.DataType, value: Any, name: str, profile: str) -> Column:
    if op == "$set":
        return literal(value, kind, name)
    if op == "$unset":
        return F.lit(None)
    if op == "$inc":
        if not isinstance(kind, T.NumericType):
            raise GranaryError("QUERY_ERROR", f'"{name}" is {kind.simpleString()}.', "Use $inc with numbers.")
        return c + literal(value, kind, name)
    if not isinstance(kind, T.ArrayType):
        raise GranaryError("QUERY_ERROR", f'"{name}" is {kind.simpleString()}.', f"Use {op} with arrays.")
    if op == "$push":
        return F.array_append(F.coalesce(c, F.array().cast(kind)), literal(value, kind.elementType, name).cast(kind.elementType))
    if isinstance(value, Mapping) and (not isinstance(kind.elementType, T.StructType) or any(str(k).startswith("$") or isinstance(v, Mapping) for k, v in value.items()) or set(value) != set(kind.elementType.names)):
        test = Compiler(T.StructType([T.StructField(name, kind)]), profile)
        return F.filter(c, lambda x: ~F.coalesce(test._element(x, kind.elementType, value, name), F.lit(False)))
    return F.filter(c, lambda x: ~F.coalesce(x == literal(value, kind.elementType, name).cast(kind.elementType), F.lit(False)))


def _changed(df: DataFrame, hit: Column, new: Mapping[str, Column]) -> list[Column]:
    return [(F.when(hit, new[c]).otherwise(F.col(f"`{c}`")) if c in new else F.col(f"`{c}`")).alias(c) for c in df.columns]


def update_many(df: DataFrame, spec: Mapping[str, Any] | None, update: Mapping[str, Any], *, required: Iterable[str] = (), profile: str = "sql") -> DataFrame:
    """One pass: where the filter holds, the new values, all from the row as it was."""
    return df.select(*_changed(df, holds(spec, df.schema, profile), assignments(update, df.schema, required, profile)))


def _with_row(df: DataFrame) -> DataFrame:
    """With an id of each row: its place in its file, or else in its partition."""
    try:
        return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(_ROW))
    except Exception as e:
        if "_metadata" not in str(e):
            raise
        return df.withColumn(_ROW, F.struct(F.lit("").alias("file_path"), F.monotonically_increasing_id().alias("row_index")))


def first_place(df: DataFrame, spec: Mapping[str, Any] | None, *, order_by: Mapping[str, Any] | None = None, profile: str = "sql") -> tuple[str, int] | None:
    """The file of the first row that matches, by ``order_by`` or else by its place, and its index there."""
    rows = df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(_ROW)).filter(holds(spec, df.schema, profile))
    found = rows.orderBy(*order(order_by, df.schema), F.col(f"{_ROW}.file_path"), F.col(f"{_ROW}.row_index")).select(_ROW).first()
    return tuple(found[0]) if found else None


def at(index: int) -> Column:
    """Whether a file's row has this index."""
    return F.col("_metadata.row_index") == index


def changed(df: DataFrame, hit: Column, new: Mapping[str, Column]) -> DataFrame:
    """The rows with new values where ``hit`` holds."""
    return df.select(*_changed(df, hit, new))


def _one(rows: DataFrame, spec: Mapping[str, Any] | None, order_by: Mapping[str, Any] | None, schema: T.StructType, profile: str) -> DataFrame:
    """The id of the first row that matches: one row at most, so it is always small enough to broadcast."""
    found = rows.filter(holds(spec, schema, profile)).orderBy(*order(order_by, schema), F.col(f"{_ROW}.file_path"), F.col(f"{_ROW}.row_index")).limit(1)
    return F.broadcast(found.select(F.col(_ROW).alias("__one"), F.lit(True).alias("__hit")))


def update_one(df: DataFrame, spec: Mapping[str, Any] | None, update: Mapping[str, Any], *, order_by: Mapping[str, Any] | None = None, required: Iterable[str] = (), profile: str = "sql") -> DataFrame:
    """The first match by ``order_by``, or by its place, is changed: one row, never more."""
    new = assignments(update, df.schema, required, profile)
    rows = _with_row(df)
    joined = rows.join(_one(rows, spec, order_by, df.schema, profile), F.col(_ROW) == F.col("__one"), "left")
    return joined.select(*_changed(df, F.coalesce("__hit", F.lit(False)), new))


def delete_many(df: DataFrame, spec: Mapping[str, Any] | None, *, profile: str = "sql") -> DataFrame:
    """Rows of which the filter is false or unknown stay."""
    return df.filter(~holds(spec, df.schema, profile))


def delete_one(df: DataFrame, spec: Mapping[str, Any] | None, *, order_by: Mapping[str, Any] | None = None, profile: str = "sql") -> DataFrame:
    rows = _with_row(df)
    return rows.join(_one(rows, spec, order_by, df.schema, profile), F.col(_ROW) == F.col("__one"), "left_anti").drop(_ROW)


def rows_of(spark: SparkSession, docs: Sequence[Mapping[str, Any]], schema: T.StructType) -> DataFrame:
    """Documents as rows of the table; a key that it lacks is an error, a missing one is null."""
    names = set(schema.names)
    for doc in docs:
        if extra := [k for k in doc if k not in names]:
            near = unknown_field(extra[0], schema.names)
            raise GranaryError("VALIDATION_ERROR", near.message, near.fix)
    if not docs:
        return spark.createDataFrame([], schema)
    one = spark.range(1)
    made = [one.select(*[literal(doc.get(f.name), f.dataType, f.name).cast(f.dataType).alias(f.name) for f in schema.fields]) for doc in docs] if len(docs) <= 20 else []
    if made:
        out = made[0]
        for m in made[1:]:
            out = out.union(m)
        return out
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return spark.createDataFrame([tuple(doc.get(f.name) for f in schema.fields) for doc in docs], loose)


def conformed(new: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the table's columns and types; a column that it lacks is an error, a missing one is null."""
    if extra := [c for c in new.columns if c not in schema.names]:
        raise GranaryError("VALIDATION_ERROR", f'The table has no "{extra[0]}".', f"Fields: {', '.join(schema.names)}.")
    return new.select(*[(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def insert(df: DataFrame, docs: Sequence[Mapping[str, Any]] | DataFrame) -> DataFrame:
    return df.unionByName(conformed(docs, df.schema) if isinstance(docs, DataFrame) else rows_of(df.sparkSession, docs, df.schema))


def upsert_doc(spec: Mapping[str, Any] | None, update: Mapping[str, Any]) -> dict[str, Any]:
    """What an upsert inserts: the filter's plain equalities and what $set gives."""
    return {**equalities(spec), **(update.get("$set") or {})}


def upsert(df: DataFrame, spec: Mapping[str, Any] | None, update: Mapping[str, Any], *, order_by: Mapping[str, Any] | None = None, profile: str = "sql") -> DataFrame:
    """The first match is changed; without any, a row is added."""
    there = F.broadcast(df.filter(holds(spec, df.schema, profile)).limit(1).select(F.lit(1).alias("__there")))
    new = rows_of(df.sparkSession, [upsert_doc(spec, update)], df.schema).withColumn("__new", F.lit(1))
    new = new.join(there, F.col("__new") == F.col("__there"), "left_anti").drop("__new")
    return update_one(df, spec, update, order_by=order_by, profile=profile).unionByName(new)


#: Batch operations and the functions that apply them to a table.
APPLY: dict[str, Callable[[DataFrame, Mapping[str, Any]], DataFrame]] = {
    "insert_one": lambda df, op: insert(df, [op["doc"]]),
    "insert_many": lambda df, op: insert(df, op["docs"]),
    "update_one": lambda df, op: (upsert if op.get("upsert") else update_one)(df, op.get("filter"), op["update"], order_by=op.get("order_by")),
    "update_many": lambda df, op: update_many(df, op.get("filter"), op["update"]),
    "delete_one": lambda df, op: delete_one(df, op.get("filter"), order_by=op.get("order_by")),
    "delete_many": lambda df, op: delete_many(df, op.get("filter")),
}


def batch(tables: Mapping[str, DataFrame], operations: Sequence[Mapping[str, Any]]) -> dict[str, DataFrame]:
    """The tables after all operations, in order; nothing is read or written until one is used."""
    now = dict(tables)
    for op in operations:
        name = op["collection"]
        now[name] = APPLY[op["operation"]](now[name], op)
    return now
