"""Reads: filter, sort, skip, limit, projection, counting, and the lookup of related rows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GranaryError
from ..plans.filters import is_trivial
from .predicates import predicate, resolve

#: Columns that a lookup of many parents adds and takes away again.
_WANTED, _KEY, _KID, _PLACE = "__granary_wanted", "__granary_key", "__granary_kid", "__granary_place"
_DIRECTIONS = {1: True, "asc": True, -1: False, "desc": False}


def order(sort: Mapping[str, Any] | None, schema) -> list[Column]:
    """Sort keys; missing values come last in ascending and first in descending order."""
    keys = []
    for name, way in (sort or {}).items():
        if isinstance(way, bool) or way not in _DIRECTIONS:
            raise GranaryError("QUERY_ERROR", f"Sort of {name} is {way!r}.", "Use 1, -1, 'asc' or 'desc'.")
        c, _ = resolve(name, schema)
        keys.append(c.asc_nulls_last() if _DIRECTIONS[way] else c.desc_nulls_first())
    return keys


def _whole(what: str, n: Any) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise GranaryError("QUERY_ERROR", f"{what} is {n!r}.", "Use a whole number, 0 or more.")
    return n


def projected(df: DataFrame, projection: Mapping[str, Any] | None) -> DataFrame:
    """Included fields in the order given; else all but the excluded ones."""
    if not projection:
        return df
    if included := [k for k, v in projection.items() if v]:
        return df.select(*[resolve(k, df.schema)[0].alias(k) for k in included])
    return df.drop(*projection)


def query(df: DataFrame, spec: Mapping[str, Any] | None, *, sort: Mapping[str, Any] | None = None, skip: int | None = None, limit: int | None = None, projection: Mapping[str, Any] | None = None, profile: str = "sql") -> DataFrame:
    """The rows that match, sorted, without the first ``skip``, at most ``limit``, in the fields asked for."""
    condition = predicate(spec, df.schema, profile)
    keys = order(sort, df.schema)
    found = df if is_trivial(spec) else df.filter(condition)
    found = found.orderBy(*keys) if keys else found
    if skip is not None and _whole("skip", skip):
        found = found.offset(skip)
    if limit is not None:
        found = found.limit(_whole("limit", limit))
    return projected(found, projection)


def count(df: DataFrame, spec: Mapping[str, Any] | None = None, profile: str = "sql") -> DataFrame:
    """One row, (count)."""
    return query(df, spec, profile=profile).agg(F.count(F.lit(1)).alias("count"))


def _same_kind(local: str, kind: T.DataType, foreign: str, other: T.DataType) -> None:
    if type(kind) is not type(other) and "string" in (kind.simpleString(), other.simpleString()):
        raise GranaryError("QUERY_ERROR", f"{local} is {kind.simpleString()}, {foreign} is {other.simpleString()}.", "Join fields of one type.")


def _checked(parent: DataFrame, to: str, kind: str) -> None:
    if kind not in ("left", "inner"):
        raise GranaryError("QUERY_ERROR", f'Lookup type "{kind}".', "Use left or inner.")
    if to in parent.columns:
        raise GranaryError("QUERY_ERROR", f'The parent has a field "{to}".', "Name the children otherwise.")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def _by_all(df: DataFrame) -> Column:
    """All fields of a row, to order by; those that have no order count as their JSON."""
    fields = [(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema.fields]
    return F.struct(*[c if _orderable(kind) else F.to_json(F.struct(c)) for c, kind in fields])


def _gathered(rows: Column) -> Column:
    """The rows of (key, row) in order of their keys."""
    in_order = F.array_sort(F.collect_list(rows), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.transform(in_order, lambda x: x["row"])


def _keyed(child: DataFrame) -> Column:
    return F.struct(_by_all(child).alias("key"), F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in child.columns]).alias("row"))


def lookup(parent: DataFrame, child: DataFrame, *, match: Mapping[str, Any] | None, local: str, foreign: str, to: str, kind: str = "left", unwind: bool = False, sort: Mapping[str, Any] | None = None, limit: int | None = None, profile: str = "sql") -> DataFrame:
    """The first parent that matches, with its children as an array ``to``.

    ``limit`` bounds the children, in the order of all their fields. A parent
    without any keeps an empty array; with ``kind="inner"`` it is dropped. With
    ``unwind`` there is a row for each child, or one with null.

    The parent is one scalar subquery, the same in both places that use it, so
    its fields and its children belong to one row even where several are first.
    Children are cut to ``limit`` before they are gathered.
    """
    _checked(parent, to, kind)
    key, kind_of = resolve(local, parent.schema)
    theirs, other = resolve(foreign, child.schema)
    _same_kind(local, kind_of, foreign, other)
    names = [f"f{i}" for i in range(len(parent.columns))]  # of the parent's fields, which may clash with anything
    first = query(parent, match, sort=sort, limit=1, profile=profile)
    first = first.select(F.struct(key.alias("key"), *[F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in zip(parent.columns, names, strict=True)]).alias("first")).scalar()
    kids = child.where(theirs == first.getField("key"))
    if limit is not None:
        kids = kids.orderBy(_by_all(child)).limit(_whole("limit", limit))
    out = kids.agg(_gathered(_keyed(child)).alias("kids")).select(first.alias("first"), "kids").where("first IS NOT NULL")
    if kind == "inner":
        out = out.where(F.size("kids") > 0)
    fields = [F.col("first").getField(n).alias(c) for c, n in zip(parent.columns, names, strict=True)]
    return out.select(*fields, (F.explode_outer("kids") if unwind else F.col("kids")).alias(to))


def lookup_many(parent: DataFrame, child: DataFrame, *, match: Mapping[str, Any] | None, local: str, foreign: str, to: str, kind: str = "left", unwind: bool = False, limit: int | None = None, profile: str = "sql") -> DataFrame:
    """An extension: the same for every parent that matches, by an ordinary join on the key.

    With ``unwind`` children are joined as rows and never gathered, so one key
    may have any number of them; their order is then not defined.
    """
    _checked(parent, to, kind)
    parents = query(parent, match, profile=profile)
    key, kind_of = resolve(local, parents.schema)
    theirs, other = resolve(foreign, child.schema)
    _same_kind(local, kind_of, foreign, other)
    wanted = parents.select(key.alias(_WANTED)).where(F.col(_WANTED).isNotNull()).distinct()
    kids = child.select(theirs.alias(_KEY), _keyed(child).alias(_KID)).join(wanted, F.col(_KEY) == F.col(_WANTED), "left_semi")
    if limit is not None:
        most = _whole("limit", limit)
        place = F.row_number().over(Window.partitionBy(_KEY).orderBy(F.col(_KID)["key"]))
        kids = kids.withColumn(_PLACE, place).where(F.col(_PLACE) <= most).drop(_PLACE)
    held = parents.withColumn(_WANTED, key)
    how = "inner" if kind == "inner" else "left"
    if unwind:
        joined = held.join(kids, F.col(_WANTED) == F.col(_KEY), how)
        return joined.select(*[F.col("`" + c.replace("`", "``") + "`") for c in parents.columns], F.col(_KID)["row"].alias(to))
    groups = kids.groupBy(_KEY).agg(_gathered(F.col(_KID)).alias(to))
    out = held.join(groups, F.col(_WANTED) == F.col(_KEY), how).drop(_WANTED, _KEY)
    return out.withColumn(to, F.coalesce(to, F.array().cast(groups.schema[to].dataType)))
