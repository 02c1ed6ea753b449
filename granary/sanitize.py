"""Names that may not be used, and the user's rules for values."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import GranaryError

#: Columns that the engine keeps to itself.
RESERVED = ("_metadata", "__granary_row", "__granary_wanted", "__granary_key", "__granary_kid", "__granary_place")


def collection_name(name: str) -> str:
    """A name that is safe as a folder's: no wildcards, blanks, slashes or dots in front."""
    if not isinstance(name, str) or not name or re.search(r"[*,\s/\\\\\"<>|?#:]", name) or name[0] in ".-_+" or ".." in name or len(name) > 200:
        raise GranaryError("QUERY_ERROR", f"{name!r} cannot be a collection.", "Use letters, digits, - and _, and begin with a letter or digit.")
    return name


def field_names(names: Sequence[str]) -> None:
    for n in names:
        if n in RESERVED or n.startswith("$"):
            raise GranaryError("QUERY_ERROR", f'"{n}" is reserved.', "Use another name.")


@dataclass(frozen=True)
class Rule:
    """``transform(value, field, collection)`` for one field, or for all of them."""

    transform: Callable[[Any, str, str], Any]
    field: str = "*"
    collection: str = "*"

    def fits(self, field: str, collection: str) -> bool:
        return self.field in ("*", field) and self.collection in ("*", collection)


def _value(value: Any, field: str, collection: str, rules: Sequence[Rule]) -> Any:
    for rule in rules:
        if rule.fits(field, collection):
            value = rule.transform(value, field, collection)
    return value


def document(doc: Mapping[str, Any], collection: str, rules: Sequence[Rule]) -> dict[str, Any]:
    return {k: _value(v, k, collection, rules) for k, v in doc.items()}


def columns(df: DataFrame, collection: str, rules: Sequence[Rule]) -> DataFrame:
    """Rules apply to each value of the columns that they fit. They are Python functions, so there is a call for each value."""

    def ruled(name: str) -> Column:
        c, calls = F.col("`" + name.replace("`", "``") + "`"), [r.transform for r in rules if r.fits(name, collection)]

        def run(value):
            for call in calls:
                value = call(value, name, collection)
            return value

        return F.udf(run, df.schema[name].dataType)(c).alias(name) if calls else c

    return df.select(*map(ruled, df.columns))


def update(change: Mapping[str, Any], collection: str, rules: Sequence[Rule]) -> dict[str, Any]:
    """Rules apply to what $set gives."""
    return {op: document(v, collection, rules) if op == "$set" and isinstance(v, Mapping) else v for op, v in change.items()}


def filter_values(spec: Mapping[str, Any] | None, collection: str, rules: Sequence[Rule]) -> dict[str, Any]:
    """Rules apply to the values that fields are compared with, at any depth."""

    def leaf(value: Any, field: str) -> Any:
        if isinstance(value, Mapping):
            return {op: [_value(x, field, collection, rules) for x in v] if op in ("$in", "$nin") and isinstance(v, list | tuple) else leaf(v, field) if op == "$not" else _value(v, field, collection, rules) if op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") else v for op, v in value.items()}
        return value if value is None or isinstance(value, re.Pattern) else _value(value, field, collection, rules)

    return {k: [filter_values(x, collection, rules) for x in v] if k in ("$and", "$or", "$nor") and isinstance(v, list | tuple) else leaf(v, k) for k, v in (spec or {}).items()}
