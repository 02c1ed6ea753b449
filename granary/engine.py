"""The engine: collections by name, reads, writes with receipts, discovery, events."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from . import guardrails, sanitize
from .errors import GranaryError, mapped, unknown_method
from .events import SLOW_MS, Events, Log, Receipt
from .operators import reads, writes
from .operators.predicates import holds
from .plans import filters, render
from .schema import Collection, Index, create_index, create_table, described, example, search_mapping
from .sources.retry import Retry
from .sources.store import Store
from .sources.uri import detect, redacted
from .timestamps import Timestamps


@dataclass(frozen=True)
class Config:
    """How an engine behaves; the same defaults for all."""

    uri: str
    label: str = ""
    profile: str = "sql"
    validate: bool = False
    sanitize: bool = True
    rules: Sequence[sanitize.Rule] = ()
    guardrails: bool = True
    logging: bool = True
    slow_ms: float = SLOW_MS
    timestamps: Timestamps | None = None
    pool: str = "standard"
    #: Of tables read by JDBC, the number or date that splits the read: {table: (column, least, most)}.
    splits: Mapping[str, tuple[str, Any, Any]] | None = None
    retry: Retry = Retry()


OPERATIONS = ("insert_one", "insert_many", "update_one", "update_many", "delete_one", "delete_many")


class Engine:
    """Collections below one address.

    Each engine has its own schemas, listeners and settings. With a folder as its
    address, tables are versions that writes replace; other addresses are read.
    """

    def __init__(self, spark: SparkSession, uri: str | Config, _store: Store | None = None, _staged: dict | None = None, **options: Any):
        self.config = uri if isinstance(uri, Config) else Config(uri, **options)
        self.spark, self.address = spark, detect(self.config.uri)
        self.events = Events()
        self.log = Log(self.events, self.config.slow_ms, self.config.logging)
        self.store = _store or (Store(spark, self.config.uri) if self.address.kind == "files" else None)
        self.schemas: dict[str, Collection] = {}
        self._staged, self._began, self._open = _staged, time.monotonic(), True
        self.events.emit("connected", backend="spark", label=self.config.label)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        raise unknown_method(name)

    # ---- events and life ----

    def on(self, name: str, call: Callable[[dict], Any]) -> None:
        self.events.on(name, call)

    def once(self, name: str, call: Callable[[dict], Any]) -> None:
        self.events.once(name, call)

    def off(self, name: str, call: Callable[[dict], Any]) -> None:
        self.events.off(name, call)

    def close(self) -> None:
        """Ends the engine; the session belongs to whoever made it."""
        self._open = False
        self.events.emit("disconnected", backend="spark", reason="closed")

    def graceful_shutdown(self, code: int = 0) -> None:
        self.events.emit("shutdown", exit_code=code)
        self.close()

    def status(self) -> dict[str, Any]:
        return {"state": "connected" if self._open else "closed", "backend": "spark", "driver": f"spark {self.spark.version}", "master": self.spark.conf.get("spark.master", ""), "application": self.spark.conf.get("spark.app.id", ""), "uri": redacted(self.config.uri), "label": self.config.label, "uptime_ms": (time.monotonic() - self._began) * 1000, "collections": self.collections()}

    def raw(self) -> SparkSession:
        return self.spark

    def execute(self, statement: str, *values: Any, **params: Any) -> DataFrame:
        """A statement of SQL with values for its question marks, or else with named parameters."""
        if values and params:
            raise GranaryError("QUERY_ERROR", "The statement has values by position and by name.", "Use one kind.")
        return self.spark.sql(statement, args=list(values) or params or None)

    # ---- tables ----

    def _tables(self) -> dict[str, str]:
        return self._staged["tables"] if self._staged is not None else self._files().manifest()["tables"]

    def _files(self) -> Store:
        if self.store is None:
            raise GranaryError("UNSUPPORTED_OPERATION", "This address is only read.", "Use a folder as the address.")
        return self.store

    def collections(self) -> list[str]:
        return sorted(self._tables()) if self.store else []

    def bind(self, **tables: str) -> None:
        """Names for Parquet tables that lie elsewhere."""
        self._files().bind(tables)

    def table(self, name: str) -> DataFrame:
        sanitize.collection_name(name)
        if self.store is None:
            options = self.address.options(name, self.config.pool, (self.config.splits or {}).get(name))
            return self.config.retry.run(lambda: self.spark.read.format(self.address.format).options(**options).load(), self.events)
        return self.store.read(name, self._tables())

    @contextmanager
    def _call(self, operation: str, name: str):
        began = time.monotonic()
        try:
            yield began
        except Exception as e:
            error = mapped(e, name, operation)
            self.events.emit("error", code=error.code, message=error.message, fix=error.fix, backend="spark")
            raise error from (None if error is e else e)

    def _filter(self, name: str, spec: Mapping[str, Any] | None) -> Mapping[str, Any]:
        return sanitize.filter_values(spec, name, self.config.rules) if self.config.rules else (spec or {})

    def _guard(self, operation: str, name: str, spec: Mapping[str, Any] | None, **options: Any) -> None:
        if self.config.guardrails:
            guardrails.check(operation, name, spec, self.events, **options)

    # ---- reads ----

    def query_many(self, name: str, spec: Mapping[str, Any] | None = None, *, sort=None, limit: int | None = None, skip: int | None = None, projection=None) -> DataFrame:
        with self._call("query_many", name) as began:
            spec = self._filter(name, spec)
            self._guard("query_many", name, spec, limit=limit)
            found = reads.query(self.table(name), spec, sort=sort, limit=limit, skip=skip, projection=projection, profile=self.config.profile)
            self.log.done(name, "query_many", began)
            return found

    def query_one(self, name: str, spec: Mapping[str, Any] | None = None, *, sort=None, skip: int | None = None, projection=None) -> Row | None:
        with self._call("query_one", name) as began:
            found = reads.query(self.table(name), self._filter(name, spec), sort=sort, skip=skip, limit=1, projection=projection, profile=self.config.profile).first()
            self.log.done(name, "query_one", began)
            return found

    def count(self, name: str, spec: Mapping[str, Any] | None = None) -> int:
        with self._call("count", name) as began:
            n = reads.count(self.table(name), self._filter(name, spec), self.config.profile).first()["count"]
            self.log.done(name, "count", began)
            return n

    def query_with_lookup(self, name: str, *, match, lookup: Mapping[str, Any], unwind: bool = False, sort=None, limit: int | None = None) -> Row | None:
        """The first match with its children; ``lookup`` has from, local, foreign, as and type."""
        with self._call("query_with_lookup", name) as began:
            found = reads.lookup(self.table(name), self.table(lookup["from"]), match=self._filter(name, match), local=lookup["local"], foreign=lookup["foreign"], to=lookup["as"], kind=lookup.get("type", "left"), unwind=unwind, sort=sort, limit=limit, profile=self.config.profile).first()
            self.log.done(name, "query_with_lookup", began)
            return found

    def query_many_with_lookup(self, name: str, *, match, lookup: Mapping[str, Any], unwind: bool = False, limit: int | None = None) -> DataFrame:
        """An extension: the same for all matches."""
        with self._call("query_many_with_lookup", name):
            return reads.lookup_many(self.table(name), self.table(lookup["from"]), match=self._filter(name, match), local=lookup["local"], foreign=lookup["foreign"], to=lookup["as"], kind=lookup.get("type", "left"), unwind=unwind, limit=limit, profile=self.config.profile)

    # ---- writes ----

    def insert_one(self, name: str, doc: Mapping[str, Any]) -> Receipt:
        return self._write("insert_one", name, lambda: self._insert(name, [doc]))

    def insert_many(self, name: str, docs: Sequence[Mapping[str, Any]] | DataFrame) -> Receipt:
        return self._write("insert_many", name, lambda: self._insert(name, docs))

    def update_one(self, name: str, spec, update: Mapping[str, Any], *, upsert: bool = False, order_by=None) -> Receipt:
        return self._write("update_one", name, lambda: self._update_one(name, spec, update, upsert, order_by))

    def update_many(self, name: str, spec, update: Mapping[str, Any], *, confirm: str | None = None) -> Receipt:
        return self._write("update_many", name, lambda: self._update_many(name, spec, update, confirm))

    def delete_one(self, name: str, spec, *, order_by=None) -> Receipt:
        return self._write("delete_one", name, lambda: self._delete(name, spec, None, order_by, one=True))

    def delete_many(self, name: str, spec, *, confirm: str | None = None) -> Receipt:
        return self._write("delete_many", name, lambda: self._delete(name, spec, confirm, None, one=False))

    def batch(self, operations: Sequence[Mapping[str, Any]]) -> Receipt:
        """All operations, in order, or none of them."""
        with self._call("batch", "*") as began:
            sums = dict.fromkeys(("matched", "modified", "inserted", "deleted"), 0)
            with self._transaction() as tx:
                for op in operations:
                    if op.get("operation") not in OPERATIONS:
                        raise GranaryError("UNSUPPORTED_OPERATION", f"A batch cannot {op.get('operation')!r}.", f"Use {', '.join(OPERATIONS)}.")
                    args = {k: v for k, v in op.items() if k not in ("operation", "collection")}
                    if "filter" in args or op["operation"].startswith(("update", "delete")):
                        args["spec"] = args.pop("filter", None)
                    done = getattr(tx, op["operation"])(op["collection"], **args)
                    for k in sums:
                        sums[k] += getattr(done, k)
            receipt = Receipt("batch", "*", **sums, duration_ms=(time.monotonic() - began) * 1000)
            self.log.done("*", "batch", began, receipt)
            return receipt

    def with_transaction(self, run: Callable[[Engine], Any]) -> Any:
        """What ``run`` does with the engine it gets counts as a whole, or, if it fails, not at all."""
        with self._call("with_transaction", "*"), self._transaction() as tx:
            return run(tx)

    @contextmanager
    def _transaction(self):
        if self._staged is not None:
            raise GranaryError("UNSUPPORTED_OPERATION", "Transactions do not nest.", "Use the engine that the transaction gave.")
        now = self._files().manifest()
        staged = {"tables": dict(now["tables"]), "changed": {}}
        tx = Engine(self.spark, self.config, _store=self.store, _staged=staged)
        tx.schemas, tx.events, tx.log = self.schemas, self.events, self.log
        yield tx
        if staged["changed"]:
            self.store.publish(staged["changed"], now["version"])

    def _write(self, operation: str, name: str, run: Callable[[], dict[str, int]]) -> Receipt:
        with self._call(operation, name) as began:
            receipt = Receipt(operation, name, **run(), duration_ms=(time.monotonic() - began) * 1000)
            self.log.done(name, operation, began, receipt)
            return receipt

    def _now(self) -> tuple[dict, int | None]:
        """Where the tables' rows are, and the version that says so."""
        if self._staged is not None:
            return self._staged["tables"], None
        now = self._files().manifest()
        return now["tables"], now["version"]

    def _publish(self, name: str, paths: str | list[str], seen: int | None) -> None:
        if self._staged is not None:
            self._staged["tables"][name] = self._staged["changed"][name] = paths
        else:
            self.store.publish({name: paths}, seen)

    def _replace(self, name: str, df: DataFrame) -> None:
        _, seen = self._now()
        self._publish(name, self._files().write(name, df), seen)

    def _append(self, name: str, new: DataFrame) -> None:
        """New files beside the table's; tables from elsewhere whose folders hold values are written anew."""
        tables, seen = self._now()
        paths = self._files().locations(name, tables)
        if self._files().flat(paths):
            self._publish(name, [*paths, self._files().write(name, new)], seen)
        else:
            self._replace(name, self.table(name).unionByName(new))

    def _one_row(self, name: str, spec, order_by, changes: Mapping[str, Any] | None) -> bool:
        """Changes the first match, or without ``changes`` deletes it: the file that holds it is replaced, no other."""
        tables, seen = self._now()
        paths, df = self._files().locations(name, tables), self._files().read(name, tables)
        new = writes.assignments(changes, df.schema, self._required(name), self.config.profile) if changes is not None else {}
        place = writes.first_place(df, spec, order_by=order_by, profile=self.config.profile)
        if place is None:
            return False
        file, hit = unquote(place[0]), writes.at(place[1])
        kept = self._files().without(paths, file) if self._files().flat(paths) else None
        # Where files do not stand for themselves, all of them count as the one that is replaced.
        part = df if kept is None else self.spark.read.schema(df.schema).parquet(file)
        hit = hit if kept is not None else hit & (F.col("_metadata.file_path") == place[0])
        if any(set(i.fields) & set(new) for i in self._unique_indexes(name)):
            self._unique(name, df.filter(~(writes.at(place[1]) & (F.col("_metadata.file_path") == place[0]))), writes.changed(part.filter(hit), F.lit(True), new), set(new))
        after = writes.changed(part, hit, new) if changes is not None else part.filter(~hit)
        self._publish(name, [*(kept or []), self._files().write(name, after)], seen)
        return True

    def compact(self, name: str) -> None:
        """Writes the table anew, in one folder: for tables that many inserts left in many files."""
        with self._call("compact", name):
            self._replace(name, self.table(name))

    def _required(self, name: str) -> list[str]:
        return self.schemas[name].required if name in self.schemas else []

    def _insert(self, name: str, docs) -> dict[str, int]:
        df = self.table(name)
        if isinstance(docs, DataFrame):
            new, seen = writes.conformed(self._ruled(name, docs), df.schema), Observation()
            self._unique(name, df, new)
            self._append(name, new.observe(seen, F.count(F.lit(1)).alias("n")))
            return {"inserted": seen.get["n"]}
        docs = [sanitize.document(d, name, self.config.rules) for d in docs]
        if self.config.timestamps:
            now = self.config.timestamps.now()
            docs = [self.config.timestamps.on_insert(d, now) for d in docs]
        if self.config.validate and name in self.schemas:
            for d in docs:
                self.schemas[name].check(d)
        if not docs:
            return {"inserted": 0}
        new = writes.rows_of(self.spark, docs, df.schema)
        self._unique(name, df, new)
        self._append(name, new)
        return {"inserted": len(docs)}

    def _ruled(self, name: str, new: DataFrame) -> DataFrame:
        """A DataFrame under what holds for documents: rules, times, the schema."""
        if self.config.rules:
            new = sanitize.columns(new, name, self.config.rules)
        if times := self.config.timestamps:
            now = times.now()
            new = new.withColumns({k: F.lit(now) for k in (times.created, times.updated) if k not in new.columns})
        if self.config.validate and name in self.schemas:
            self.schemas[name].check_rows(new)
        return new

    def _unique_indexes(self, name: str) -> list[Index]:
        return [i for i in self.schemas[name].indexes if i.unique] if name in self.schemas else []

    def _unique(self, name: str, df: DataFrame, new: DataFrame, touched: set[str] | None = None) -> None:
        """No key of the new rows is twice among them or in the table; nulls are never alike."""
        for index in self._unique_indexes(name):
            keys = list(index.fields)
            if touched is None or touched & set(keys):
                rows = new.select(*keys).dropna()
                self._no_twins(name, keys, rows.union(df.select(*keys).join(rows.distinct(), keys, "left_semi")))

    def _no_twins(self, name: str, keys: list[str], rows: DataFrame) -> None:
        if bad := rows.groupBy(*keys).count().where("count > 1").first():
            raise GranaryError("DUPLICATE_KEY", f"{name} has {', '.join(f'{k}={bad[k]!r}' for k in keys)} already.", "Use update_one, or look with query_one first.", collection=name)

    def _changes(self, name: str, update: Mapping[str, Any]) -> dict[str, Any]:
        update = sanitize.update(update, name, self.config.rules) if self.config.rules else dict(update)
        schema = self.schemas.get(name)
        if self.config.validate and schema:
            for k, v in (update.get("$set") or {}).items():
                if k in schema.fields and (p := schema.fields[k].problem(v)):
                    raise GranaryError("VALIDATION_ERROR", f'"{k}" must be {p}.', "Give a value of its type.", collection=name)
        return self.config.timestamps.on_update(update) if self.config.timestamps else update

    def _update_many(self, name: str, spec, update, confirm) -> dict[str, int]:
        spec = self._filter(name, spec)
        self._guard("update_many", name, spec, confirm=confirm)
        df, seen = self.table(name), Observation()
        hit = holds(spec, df.schema, self.config.profile)
        changes = self._changes(name, update)
        new = writes.assignments(changes, df.schema, self._required(name), self.config.profile)
        if any(set(i.fields) & set(new) for i in self._unique_indexes(name)):
            self._unique(name, df.filter(~hit), writes.changed(df.filter(hit), F.lit(True), new), set(new))
        after = writes.update_many(df.observe(seen, F.count_if(hit).alias("n")), spec, changes, required=self._required(name), profile=self.config.profile)
        self._replace(name, after)
        return {"matched": seen.get["n"], "modified": seen.get["n"]}

    def _update_one(self, name: str, spec, update, upsert: bool, order_by) -> dict[str, int]:
        spec = self._filter(name, spec)
        if self._one_row(name, spec, order_by, self._changes(name, update)):
            return {"matched": 1, "modified": 1}
        if not upsert:
            return {"matched": 0, "modified": 0}
        return self._insert(name, [writes.upsert_doc(spec, update)])

    def _delete(self, name: str, spec, confirm, order_by, one: bool) -> dict[str, int]:
        spec = self._filter(name, spec)
        self._guard("delete_one" if one else "delete_many", name, spec, **({} if one else {"confirm": confirm}))
        if one:
            n = int(self._one_row(name, spec, order_by, None))
            return {"matched": n, "deleted": n}
        df = self.table(name)
        hit = holds(spec, df.schema, self.config.profile)
        if filters.is_trivial(spec):  # the plan has no rows left to observe
            n = df.count()
            self._replace(name, df.limit(0))
        else:
            seen = Observation()
            self._replace(name, writes.delete_many(df.observe(seen, F.count_if(hit).alias("n")), spec, profile=self.config.profile))
            n = seen.get["n"]
        return {"matched": n, "deleted": n}

    # ---- schemas and discovery ----

    def register_collection(self, collection: Collection) -> None:
        sanitize.collection_name(collection.name)
        sanitize.field_names(list(collection.fields))
        self.schemas[collection.name] = collection

    def register_index(self, name: str, index: Index) -> None:
        c = self.schemas[name]
        if index not in c.indexes:
            self.schemas[name] = Collection(c.name, c.fields, [*c.indexes, index])

    def clear_schemas(self) -> None:
        self.schemas.clear()

    def ensure_collections(self, dry_run: bool = False, dialect: str = "spark") -> list[str]:
        """Empty tables for registered collections that are not there; the statements that say so."""
        there = set(self.collections())
        missing = [c for c in self.schemas.values() if c.name not in there]
        if not dry_run:
            for c in missing:
                self._replace(c.name, self.spark.createDataFrame([], c.spark()))
        return [create_table(c, dialect) for c in missing]

    def ensure_indexes(self, dry_run: bool = False, dialect: str = "pg") -> list[str]:
        """Statements for registered indexes. Unique ones are checked here and whenever a write touches their fields."""
        there = set() if dry_run else set(self.collections())
        for c in self.schemas.values():
            for i in self._unique_indexes(c.name) if c.name in there else ():
                with self._call("ensure_indexes", c.name):
                    self._no_twins(c.name, list(i.fields), self.table(c.name).select(*i.fields).dropna())
        return [create_index(c.name, i, dialect) for c in self.schemas.values() for i in c.indexes]

    def describe(self, name: str) -> dict[str, Any]:
        with self._call("describe", name):
            df, known = self.table(name), self.schemas.get(name)
            fields = described(df.schema, known)
            return {"name": name, "backend": "spark", "fields": fields, "indexes": [{"fields": dict(i.fields), "unique": i.unique} for i in (known.indexes if known else ())], "document_count": df.count(), "example_filter": example(fields)}

    def validate(self, name: str, *, filter=None, update=None, doc=None) -> dict[str, Any]:
        """What is wrong with an operation, without running it."""
        with self._call("validate", name):
            df, errors = self.table(name), []

            def tried(field: str, run: Callable[[], Any]) -> None:
                try:
                    run()
                except GranaryError as e:
                    errors.append({"field": field, "message": e.message, "expected": e.fix, "received": e.code})

            if filter is not None:
                tried("filter", lambda: holds(filter, df.schema, self.config.profile))
            if update is not None:
                tried("update", lambda: writes.assignments(update, df.schema, self._required(name), self.config.profile))
            if doc is not None:
                if name in self.schemas:
                    errors += self.schemas[name].problems(doc)
                else:
                    tried("doc", lambda: writes.rows_of(self.spark, [doc], df.schema))
            return {"valid": not errors, "errors": errors}

    def explain(self, name: str, *, filter=None, sort=None, limit: int | None = None, skip: int | None = None, projection=None, dialect: str = "pg") -> dict[str, Any]:
        """Spark's plan, and the same query in SQL and as a search."""
        with self._call("explain", name):
            spec = self._filter(name, filter)
            df = reads.query(self.table(name), spec, sort=sort, limit=limit, skip=skip, projection=projection, profile=self.config.profile)
            found = {"backend": "spark", "native": render.spark_plan(df)}
            try:
                found["sql"], found["values"] = render.select(name, spec, sort=sort, skip=skip, limit=limit, projection=projection, dialect=dialect)
                found["search"] = render.search(filters.simplified(filters.parse(spec)))
            except GranaryError as e:
                found["sql"] = e.message
            return found

    def search_mapping(self, name: str) -> dict[str, Any]:
        return search_mapping(self.schemas[name])
