"""Filters as Column expressions, checked against the schema before anything runs."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import UTC, date, datetime, time
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GranaryError, unknown_field
from ..plans import filters as P

#: "sql": what a comparison with NULL cannot tell drops the row. "document": negations keep it.
PROFILES = ("sql", "document")
_COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
#: $type names and the Spark types that they stand for.
_TYPES = {"string": ("string",), "int": ("int", "smallint", "tinyint"), "long": ("bigint",), "double": ("double", "float"), "decimal": ("decimal",), "number": ("int", "smallint", "tinyint", "bigint", "double", "float", "decimal"), "bool": ("boolean",), "date": ("date", "timestamp", "timestamp_ntz"), "array": ("array",), "object": ("struct", "map", "variant"), "binData": ("binary",)}


def resolve(name: str, schema: T.StructType) -> tuple[Column, T.DataType]:
    """A column by its name, dots included, or else a path into structs."""
    if name in schema.names:
        return F.col("`" + name.replace("`", "``") + "`"), schema[name].dataType
    first, *rest = name.split(".")
    if rest and first in schema.names:
        at, kind = F.col("`" + first.replace("`", "``") + "`"), schema[first].dataType
        for part in rest:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                break
            at, kind = at.getField(part), kind[part].dataType
        else:
            return at, kind
    raise unknown_field(name, schema.names)


def literal(value: Any, kind: T.DataType, name: str) -> Column:
    """The value as a literal of the field's type, or an error that says what fits."""

    def refused(fits: str) -> GranaryError:
        return GranaryError("QUERY_ERROR", f'Field "{name}" is {kind.simpleString()}, but the value is {value!r}.', f"Give {fits}.")

    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.NumericType):
        if isinstance(value, bool) or not isinstance(value, int | float | Decimal):
            raise refused("a number")
        # Numbers keep their own type: 2.5 is not 2, and Spark widens the comparison.
        return F.lit(value)
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise refused("true or false")
        return F.lit(value)
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        if not isinstance(value, str):
            raise refused("a text")
        return F.lit(value)
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        if isinstance(value, str):
            try:
                value = datetime.fromisoformat(value)
            except ValueError:
                raise refused("a date, or a text like 2025-06-01T00:00:00") from None
        if not isinstance(value, date):
            raise refused("a date")
        if isinstance(value, datetime) and value.tzinfo and isinstance(kind, T.TimestampNTZType | T.DateType):
            value = value.astimezone(UTC).replace(tzinfo=None)
        # A time of day counts against dates too: they are compared as midnights.
        if isinstance(kind, T.TimestampNTZType) or (isinstance(kind, T.DateType) and isinstance(value, datetime) and value.time() != time()):
            return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(value).cast(kind) if isinstance(kind, T.DateType) or not isinstance(value, datetime) else F.lit(value)
    if isinstance(kind, T.BinaryType):
        if not isinstance(value, bytes | bytearray):
            raise refused("bytes")
        return F.lit(bytes(value))
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list | tuple):
            raise refused("a list")
        return F.array(*[literal(v, kind.elementType, name) for v in value]).cast(kind) if value else F.array().cast(kind)
    if isinstance(kind, T.StructType):
        if not isinstance(value, Mapping) or set(value) - set(kind.names):
            raise refused(f"an object with fields {', '.join(kind.names)}")
        return F.struct(*[literal(value.get(f.name), f.dataType, f"{name}.{f.name}").alias(f.name) for f in kind.fields]).cast(kind)
    if isinstance(kind, T.MapType):
        if not isinstance(value, Mapping):
            raise refused("an object")
        return F.create_map(*[x for k, v in value.items() for x in (literal(k, kind.keyType, name), literal(v, kind.valueType, name))]).cast(kind)
    return F.lit(value)


def _known(c: Column) -> Column:
    """Two-valued: what is unknown is false."""
    return F.coalesce(c, F.lit(False))


class Compiler:
    def __init__(self, schema: T.StructType, profile: str = "sql"):
        if profile not in PROFILES:
            raise GranaryError("QUERY_ERROR", f'Unknown profile "{profile}".', f"Use one of {', '.join(PROFILES)}.")
        self.schema, self.document = schema, profile == "document"

    def __call__(self, spec: Mapping[str, Any] | P.Node | None) -> Column:
        node = spec if isinstance(spec, P.Always | P.Test | P.Not | P.And | P.Or) else P.parse(spec)
        for name in P.fields_of(node):
            resolve(name, self.schema)
        return self._node(P.simplified(node))

    def _node(self, node: P.Node) -> Column:
        if isinstance(node, P.Always):
            return F.lit(node.value)
        if isinstance(node, P.And):
            return reduce(lambda a, b: a & b, map(self._node, node.parts))
        if isinstance(node, P.Or):
            return reduce(lambda a, b: a | b, map(self._node, node.parts))
        if isinstance(node, P.Not):
            inner = self._node(node.part)
            return ~_known(inner) if self.document else ~inner
        c, kind = resolve(node.field, self.schema)
        return self.test(c, kind, node)

    def _other(self, ref: P.Ref, kind: T.DataType, name: str) -> Column:
        c, other = resolve(ref.field, self.schema)
        if type(kind) is not type(other) and not all(isinstance(k, T.NumericType) for k in (kind, other)) and not all(isinstance(k, T.DateType | T.TimestampType | T.TimestampNTZType) for k in (kind, other)):
            raise GranaryError("QUERY_ERROR", f'"{name}" is {kind.simpleString()}, "{ref.field}" is {other.simpleString()}.', "Compare fields of one kind.")
        return c

    def test(self, c: Column, kind: T.DataType, node: P.Test) -> Column:
        op, value, name = node.op, node.value, node.field
        if op == "exists":
            return c.isNotNull() if value else c.isNull()
        if op in _COMPARE:
            right = self._other(value, kind, name) if isinstance(value, P.Ref) else literal(value, kind, name)
            if op == "ne" and self.document:
                return ~c.eqNullSafe(right)
            return getattr(c, _COMPARE[op])(right)
        if op in ("in", "nin"):
            there = [v for v in value if v is not None]
            inside = c.isin(*[literal(v, kind, name) for v in there]) if there else F.lit(False)
            if len(there) < len(value):  # a NULL in the list leaves everything else unknown
                inside = (c.isNull() | inside) if self.document else inside | F.lit(None).cast("boolean")
            if op == "in":
                return inside
            return ~_known(inside) if self.document else ~inside
        if op == "regex":
            return self._regex(c, kind, node)
        if op == "size":
            return self._size(c, kind, value, name)
        if op == "type":
            names = [value] if isinstance(value, str) else list(value or [])
            if not names or any(n not in _TYPES for n in names):
                raise GranaryError("QUERY_ERROR", f"$type of {name} is {value!r}.", f"Use {', '.join(_TYPES)}.")
            return c.isNotNull() & F.lit(kind.typeName().split("(")[0].replace("integer", "int").replace("long", "bigint") in {t for n in names for t in _TYPES[n]})
        if op == "mod":
            if not isinstance(value, list | tuple) or len(value) != 2 or not all(isinstance(v, int) for v in value) or not value[0] or not isinstance(kind, T.NumericType):
                raise GranaryError("QUERY_ERROR", f"$mod of {name} needs a divisor and a remainder.", "Write {$mod: [4, 0]} for a numeric field.")
            return c % value[0] == value[1]
        if op.startswith("bits"):
            if not isinstance(kind, T.IntegralType):
                raise GranaryError("QUERY_ERROR", f'Field "{name}" is not a whole number.', "Test bits of whole numbers.")
            mask = value if isinstance(value, int) else sum(1 << b for b in value)
            found = c.bitwiseAND(F.lit(mask))
            return {"bitsAllSet": found == mask, "bitsAnySet": found != 0, "bitsAllClear": found == 0, "bitsAnyClear": found != mask}[op]
        if not isinstance(kind, T.ArrayType):
            raise GranaryError("QUERY_ERROR", f'Field "{name}" is {kind.simpleString()}.', f"Use ${op} with arrays.")
        if op == "all":
            wanted = list(value) if isinstance(value, list | tuple) else [value]
            return F.size(F.array_except(F.array(*[literal(v, kind.elementType, name) for v in wanted]), c)) == 0 if wanted else F.lit(False)
        return F.exists(c, lambda x: _known(self._element(x, kind.elementType, value, name)))

    def _element(self, x: Column, kind: T.DataType, spec: Mapping[str, Any], name: str) -> Column:
        if all(str(k).startswith("$") and k not in ("$and", "$or", "$nor") for k in spec):
            return self._over(P.simplified(P._operators(name, spec)), lambda _: (x, kind))
        if not isinstance(kind, T.StructType):
            raise GranaryError("QUERY_ERROR", f'Elements of "{name}" have no fields.', "Use operators, like {$elemMatch: {$gt: 5}}.")

        def at(field: str) -> tuple[Column, T.DataType]:
            if field not in kind.names:
                raise unknown_field(field, kind.names)
            return x.getField(field), kind[field].dataType

        return self._over(P.simplified(P.parse(spec)), at)

    def _over(self, node: P.Node, at) -> Column:
        if isinstance(node, P.Always):
            return F.lit(node.value)
        if isinstance(node, P.Test):
            return self.test(*at(node.field), node)
        if isinstance(node, P.Not):
            inner = self._over(node.part, at)
            return ~_known(inner) if self.document else ~inner
        both = [self._over(p, at) for p in node.parts]
        return reduce((lambda a, b: a & b) if isinstance(node, P.And) else (lambda a, b: a | b), both)

    @staticmethod
    def _regex(c: Column, kind: T.DataType, node: P.Test) -> Column:
        if not isinstance(kind, T.StringType):
            raise GranaryError("QUERY_ERROR", f'Field "{node.field}" is {kind.simpleString()}.', "Match patterns with texts.")
        # A literal beginning is a comparison that reaches the file's statistics.
        if not node.options and (m := re.fullmatch(r"\^([\w\s\-/:@,;'\"=<>~#%&!]+)", node.value, re.ASCII)):
            return c.startswith(m[1])
        return c.rlike((f"(?{node.options})" if node.options else "") + node.value)

    @staticmethod
    def _size(c: Column, kind: T.DataType, value: Any, name: str) -> Column:
        if not isinstance(value, int) or isinstance(value, bool):
            raise GranaryError("QUERY_ERROR", f"$size of {name} is {value!r}.", "Give a whole number.")
        if isinstance(kind, T.ArrayType | T.MapType):
            return F.when(c.isNotNull(), F.size(c)) == value
        if isinstance(kind, T.StringType):
            return F.json_array_length(c) == value
        raise GranaryError("QUERY_ERROR", f'Field "{name}" is {kind.simpleString()}.', "Use $size with arrays.")


def predicate(spec: Mapping[str, Any] | None, schema: T.StructType, profile: str = "sql") -> Column:
    return Compiler(schema, profile)(spec)


def holds(spec: Mapping[str, Any] | None, schema: T.StructType, profile: str = "sql") -> Column:
    """The predicate, with unknown as false: what an update or a delete may touch."""
    return _known(predicate(spec, schema, profile))
