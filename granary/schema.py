"""Schemas of collections: types, rules, statements that make tables, and validation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import GranaryError

# The logical types as Spark, as SQL in four dialects, and in a search index.
SPARK_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "enum": T.StringType(), "unknown": T.StringType()}
SQL_TYPES = {
    "pg": {"string": "TEXT", "number": "DOUBLE PRECISION", "integer": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "date": "TIMESTAMPTZ", "enum": "TEXT", "array": "JSONB", "object": "JSONB", "unknown": "TEXT"},
    "mysql": {"string": "TEXT", "number": "DOUBLE", "integer": "INT", "long": "BIGINT", "boolean": "TINYINT(1)", "date": "DATETIME", "enum": "TEXT", "array": "JSON", "object": "JSON", "unknown": "TEXT"},
    "mssql": {"string": "NVARCHAR(MAX)", "number": "FLOAT", "integer": "INT", "long": "BIGINT", "boolean": "BIT", "date": "DATETIME2", "enum": "NVARCHAR(255)", "array": "NVARCHAR(MAX)", "object": "NVARCHAR(MAX)", "unknown": "NVARCHAR(MAX)"},
    "sqlite": {"string": "TEXT", "number": "REAL", "integer": "INTEGER", "long": "INTEGER", "boolean": "INTEGER", "date": "TEXT", "enum": "TEXT", "array": "TEXT", "object": "TEXT", "unknown": "TEXT"},
}
SIZED = {"pg": "VARCHAR({})", "mysql": "VARCHAR({})", "mssql": "NVARCHAR({})", "sqlite": "TEXT"}
INDEX_TYPES = {"string": "text", "number": "double", "integer": "integer", "long": "long", "boolean": "boolean", "date": "date", "enum": "keyword", "array": "nested", "object": "object", "unknown": "text"}
KEYWORD_MOST = 256


@dataclass(frozen=True)
class Field:
    kind: str = "string"
    required: bool = True
    most: int | None = None
    least: float | None = None
    values: tuple[str, ...] = ()
    element: Field | None = None
    fields: Mapping[str, Field] = field(default_factory=dict)
    rule: Callable[[Any], bool] | None = None
    default: Any = None

    def spark(self) -> T.DataType:
        if self.kind == "array":
            return T.ArrayType((self.element or Field()).spark())
        if self.kind == "object":
            return T.StructType([T.StructField(k, f.spark(), True) for k, f in self.fields.items()]) if self.fields else T.MapType(T.StringType(), T.StringType())
        return SPARK_TYPES[self.kind]

    def problem(self, value: Any) -> str | None:
        """What is expected instead of the value, if anything."""
        if value is None:
            return self.kind if self.required else None
        fits = {"string": str, "enum": str, "unknown": object, "number": int | float, "integer": int, "long": int, "boolean": bool, "date": date, "array": list | tuple, "object": Mapping}[self.kind]
        if not isinstance(value, fits) or (isinstance(value, bool) and self.kind in ("number", "integer", "long")):
            return self.kind
        if self.values and value not in self.values:
            return f"one of {', '.join(self.values)}"
        if self.most is not None and hasattr(value, "__len__") and len(value) > self.most:
            return f"at most {self.most} long"
        if self.least is not None and (len(value) if hasattr(value, "__len__") else value) < self.least:
            return f"at least {self.least}"
        if self.kind == "array" and self.element:
            return next((f"elements: {p}" for v in value if (p := self.element.problem(v))), None)
        if self.kind == "object":
            return next((f"{k}: {p}" for k, f in self.fields.items() if (p := f.problem(value.get(k)))), None)
        if self.rule and not self.rule(value):
            return "a value that the field's rule accepts"
        return None


    def takes(self, kind: T.DataType) -> bool:
        """Whether a column's type fits."""
        fits = {"string": T.StringType, "enum": T.StringType, "number": T.NumericType, "integer": T.IntegralType, "long": T.IntegralType, "boolean": T.BooleanType, "date": T.DateType | T.TimestampType | T.TimestampNTZType, "array": T.ArrayType, "object": T.StructType | T.MapType, "unknown": T.DataType}[self.kind]
        return isinstance(kind, fits) or isinstance(kind, T.NullType)

    def violation(self, c: Column, kind: T.DataType) -> Column:
        """What is expected instead of a column's value, or null: ``problem`` for whole columns."""
        if not self.takes(kind):
            return F.lit(self.kind)
        tests: list[tuple[Column, str]] = [(c.isNull(), self.kind)] if self.required else []
        inner: list[Column] = []
        if not isinstance(kind, T.NullType):
            long = F.length(c) if isinstance(kind, T.StringType) else F.size(c) if isinstance(kind, T.ArrayType | T.MapType) else None
            if self.values:
                tests.append((~c.isin(*self.values), f"one of {', '.join(self.values)}"))
            if self.most is not None and long is not None:
                tests.append((long > self.most, f"at most {self.most} long"))
            if self.least is not None and (long is not None or isinstance(kind, T.NumericType)):
                tests.append(((c if long is None else long) < self.least, f"at least {self.least}"))
            if self.kind == "array" and self.element:
                tests.append((F.exists(c, lambda x: self.element.violation(x, kind.elementType).isNotNull()), "elements that fit"))
            if isinstance(kind, T.StructType):
                inner = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), f.violation(c.getField(k), kind[k].dataType)) if k in kind.names else F.lit(f"{k}: {f.kind}")) for k, f in self.fields.items() if k in kind.names or f.required]
            if rule := self.rule:
                tests.append((c.isNotNull() & ~F.udf(lambda v: bool(rule(v)), "boolean")(c), "a value that the field's rule accepts"))
        return F.coalesce(*[F.when(t, F.lit(text)) for t, text in tests], *inner, F.lit(None).cast("string"))


@dataclass(frozen=True)
class Index:
    fields: Mapping[str, int]
    unique: bool = False
    sparse: bool = False
    expire_after_s: int | None = None


@dataclass(frozen=True)
class Collection:
    name: str
    fields: Mapping[str, Field]
    indexes: Sequence[Index] = ()

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(k, f.spark(), True) for k, f in self.fields.items()])

    @property
    def required(self) -> list[str]:
        return [k for k, f in self.fields.items() if f.required]

    def problems(self, doc: Mapping[str, Any]) -> list[dict[str, Any]]:
        found = [{"field": k, "message": f'"{k}" is not a field.', "expected": ", ".join(self.fields), "received": repr(v)} for k, v in doc.items() if k not in self.fields]
        for k, f in self.fields.items():
            if p := f.problem(doc.get(k)):
                found.append({"field": k, "message": f'"{k}" must be {p}.', "expected": p, "received": repr(doc.get(k)) if k in doc else "nothing"})
        return found

    def check(self, doc: Mapping[str, Any]) -> None:
        if found := self.problems(doc):
            raise GranaryError("VALIDATION_ERROR", " ".join(p["message"] for p in found), "Give each field a value of its type.", collection=self.name)

    def check_rows(self, df: DataFrame) -> None:
        """The same for the rows of a DataFrame, in one pass that ends with the first row that does not fit."""
        if extra := [k for k in df.columns if k not in self.fields]:
            raise GranaryError("VALIDATION_ERROR", f'"{extra[0]}" is not a field.', f"Fields: {', '.join(self.fields)}.", collection=self.name)
        tests = []
        for k, f in self.fields.items():
            there = k in df.columns
            if there or f.required:
                expected = f.violation(F.col("`" + k.replace("`", "``") + "`"), df.schema[k].dataType) if there else F.lit(f.kind)
                tests.append(F.concat(F.lit(f'"{k}" must be '), expected, F.lit(".")))
        bad = df.select(F.coalesce(*tests).alias("bad")).where("bad IS NOT NULL").first() if tests else None
        if bad:
            raise GranaryError("VALIDATION_ERROR", bad[0], "Give each field a value of its type.", collection=self.name)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def create_table(c: Collection, dialect: str = "spark") -> str:
    lines = []
    for name, f in c.fields.items():
        if dialect == "spark":
            lines.append(f"  `{name}` {f.spark().simpleString().upper()}" + " NOT NULL" * f.required)
            continue
        kind = SIZED[dialect].format(f.most) if f.kind == "string" and f.most else SQL_TYPES[dialect][f.kind]
        among = f" CHECK ({quoted(name)} IN ({', '.join(repr(v) for v in f.values)}))" if f.values else ""
        lines.append(f"  {quoted(name)} {kind}" + " NOT NULL" * f.required + among)
    body = ",\n".join(lines)
    return f"CREATE TABLE IF NOT EXISTS `{c.name}` (\n{body}\n) USING PARQUET" if dialect == "spark" else f"CREATE TABLE IF NOT EXISTS {quoted(c.name)} (\n{body}\n)"


def create_index(collection: str, index: Index, dialect: str = "pg") -> str:
    cols = ", ".join(f"{quoted(k)} {'ASC' if way == 1 else 'DESC'}" for k, way in index.fields.items())
    where = " WHERE " + " AND ".join(f"{quoted(k)} IS NOT NULL" for k in index.fields) if index.sparse and dialect == "pg" else ""
    return f"CREATE {'UNIQUE ' * index.unique}INDEX IF NOT EXISTS {quoted('idx_' + '_'.join([collection, *index.fields]))} ON {quoted(collection)} ({cols}){where}"


def search_mapping(c: Collection) -> dict[str, Any]:
    def one(f: Field) -> dict[str, Any]:
        if f.kind == "string":
            return {"type": "keyword"} if f.most and f.most <= KEYWORD_MOST else {"type": "text", "fields": {"keyword": {"type": "keyword", "ignore_above": KEYWORD_MOST}}}
        return {"type": INDEX_TYPES[f.kind]}

    return {"properties": {k: one(f) for k, f in c.fields.items()}}


def described(schema: T.StructType, known: Collection | None) -> list[dict[str, Any]]:
    if known:
        return [{"name": k, "type": f.kind, "required": f.required} | ({"enum": list(f.values)} if f.values else {}) for k, f in known.fields.items()]
    return [{"name": f.name, "type": f.dataType.simpleString(), "required": not f.nullable} for f in schema.fields]


def example(fields: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    """A filter over the first two fields."""
    values = {"number": {"$gte": 0}, "integer": {"$gte": 0}, "long": {"$gte": 0}, "boolean": True, "date": {"$gte": "2025-01-01T00:00:00"}, "int": {"$gte": 0}, "bigint": {"$gte": 0}, "double": {"$gte": 0}, "timestamp": {"$gte": "2025-01-01T00:00:00"}, "timestamp_ntz": {"$gte": "2025-01-01T00:00:00"}, "array": {"$size": 1}}
    return {f["name"]: f["enum"][0] if f.get("enum") else values.get(str(f["type"]).split("<")[0], {"$exists": True}) for f in fields[:2]}
