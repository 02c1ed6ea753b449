import json

from datetime import UTC, datetime

import pytest

from granary import Collection, Engine, Field, GranaryError, Index
from granary.errors import closest, distance, mapped
from granary.operators import reads as R
from granary.operators import writes as W
from granary.sanitize import Rule, collection_name
from granary.schema import create_index, create_table
from granary.sources.uri import detect, redacted
from granary.streaming.filtered import append, watch
from granary.timestamps import Timestamps
from granary.tools import TOOLS, handle_tool_call

USERS = Collection(
    "users",
    {"email": Field("string", most=255), "name": Field(), "age": Field("integer", required=False), "role": Field("enum", values=("admin", "user", "mod")), "tags": Field("array", required=False, element=Field())},
    [Index({"email": 1}, unique=True)],
)
TIM = {"email": "t@x.org", "name": "Tim", "age": 30, "role": "admin", "tags": ["a"]}
BOB = {"email": "b@x.org", "name": "Bob", "age": 25, "role": "user"}


@pytest.fixture
def db(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), validate=True)
    engine.register_collection(USERS)
    engine.ensure_collections()
    engine.insert_many("users", [TIM, BOB])
    return engine


def names(db, spec=None):
    return [r["name"] for r in db.query_many("users", spec or {}, sort={"name": 1}, limit=100).collect()]


def test_reads(db):
    assert names(db, {"age": {"$gte": 26}}) == ["Tim"]
    assert db.query_one("users", {"role": "user"})["name"] == "Bob" and db.query_one("users", {"role": "mod"}) is None
    assert db.count("users") == 2 and db.count("users", {"age": {"$lt": 30}}) == 1


def test_updates(db):
    r = db.update_many("users", {"age": {"$gte": 25}}, {"$inc": {"age": 1}, "$push": {"tags": "z"}})
    assert (r.matched, r.modified) == (2, 2)
    assert {u["name"]: (u["age"], u["tags"]) for u in db.query_many("users", {}, limit=9).collect()} == {"Tim": (31, ["a", "z"]), "Bob": (26, ["z"])}
    db.update_many("users", {"name": "Tim"}, {"$pull": {"tags": "a"}, "$unset": {"age": True}})
    assert tuple(db.query_one("users", {"name": "Tim"})[k] for k in ("age", "tags")) == (None, ["z"])
    assert db.update_one("users", {"role": {"$in": ["admin", "user"]}}, {"$set": {"name": "One"}}, order_by={"name": 1}).modified == 1
    assert names(db) == ["One", "Tim"]
    for bad in ({}, {"$set": {}}, {"$set": {"age": 1}, "$inc": {"age": 1}}, {"$rename": {"a": "b"}}, {"$set": {"nope": 1}}, {"$unset": {"email": True}}, {"$inc": {"name": 1}}, {"$set": {"role": "boss"}}):
        with pytest.raises(GranaryError):
            db.update_many("users", {"name": "Tim"}, bad)


def test_upsert(db):
    assert db.update_one("users", {"email": "t@x.org"}, {"$set": {"name": "Tom"}}, upsert=True).matched == 1
    r = db.update_one("users", {"email": "n@x.org"}, {"$set": {"name": "New", "role": "mod"}}, upsert=True)
    assert (r.matched, r.inserted) == (0, 1) and names(db) == ["Bob", "New", "Tom"]


def test_deletes(db):
    assert db.delete_one("users", {"role": "user"}).deleted == 1 and names(db) == ["Tim"]
    assert db.delete_many("users", {"age": {"$gt": 99}}).deleted == 0
    assert db.delete_many("users", {}, confirm="DELETE_ALL").deleted == 1 and db.count("users") == 0


def test_one_row_at_most(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a")], "k int, v string")
    assert sorted(r["v"] for r in W.update_one(df, {"k": 1}, {"$set": {"v": "z"}}).collect()) == ["a", "a", "z"]
    assert W.update_one(df, {}, {"$set": {"v": "z"}}).where("v = 'z'").count() == 1
    assert W.delete_one(df, {"k": 1}).count() == 2


def test_nulls_survive_deletes(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert [r["k"] for r in W.delete_many(df, {"v": {"$gt": 0}}).collect()] == [1]


def test_update_reads_the_row_as_it_was(spark):
    df = spark.createDataFrame([(1, 10)], "a int, b int")
    assert W.update_many(df, {"a": 1}, {"$set": {"a": 2}, "$inc": {"b": 1}}).first().asDict() == {"a": 2, "b": 11}


@pytest.mark.parametrize("spec", [{}, {"$and": [{}]}, {"name": {}}, {"name": {"$nin": []}}, {"$or": [{}, {"name": "x"}]}, {"$nor": [{"$nor": [{}]}]}])
def test_guardrails(db, spec):
    told = []
    db.on("guardrail-blocked", told.append)
    for call in (lambda: db.delete_many("users", spec), lambda: db.update_many("users", spec, {"$set": {"name": "x"}}), lambda: db.delete_one("users", spec)):
        with pytest.raises(GranaryError) as e:
            call()
        assert e.value.code == "GUARDRAIL_BLOCKED"
    with pytest.raises(GranaryError):
        db.query_many("users", {"name": "Tim"})
    assert [t["operation"] for t in told] == ["delete_many", "update_many", "delete_one", "query_many"] and db.count("users") == 2


def test_validation_and_duplicates(db):
    for doc, code in (({**TIM, "email": 123}, "VALIDATION_ERROR"), ({**TIM, "role": "superadmin"}, "VALIDATION_ERROR"), ({"email": "q@x.org"}, "VALIDATION_ERROR"), ({**TIM, "extra": 1}, "VALIDATION_ERROR"), (TIM, "DUPLICATE_KEY")):
        with pytest.raises(GranaryError) as e:
            db.insert_one("users", doc)
        assert e.value.code == code
    assert db.insert_many("users", []).inserted == 0 and db.count("users") == 2


def test_batch_is_all_or_nothing(db):
    good = [{"operation": "insert_one", "collection": "users", "doc": {**BOB, "email": "c@x.org", "name": "Cid"}}, {"operation": "update_many", "collection": "users", "filter": {"name": "Tim"}, "update": {"$inc": {"age": 1}}}, {"operation": "delete_one", "collection": "users", "filter": {"name": "Bob"}}]
    r = db.batch(good)
    assert (r.inserted, r.modified, r.deleted, r.matched) == (1, 1, 1, 2) and names(db) == ["Cid", "Tim"]
    with pytest.raises(GranaryError):
        db.batch([{"operation": "delete_one", "collection": "users", "filter": {"name": "Cid"}}, {"operation": "insert_one", "collection": "users", "doc": {"bad": 1}}])
    assert names(db) == ["Cid", "Tim"]


def test_transactions(db):
    def run(tx):
        tx.delete_one("users", {"name": "Bob"})
        assert names(tx) == ["Tim"] and names(db) == ["Bob", "Tim"]
        with pytest.raises(GranaryError):
            tx.with_transaction(lambda _: None)
        return 7

    assert db.with_transaction(run) == 7 and names(db) == ["Tim"]

    def fails(tx):
        tx.delete_many("users", {"name": "Tim"})
        raise ValueError("no")

    with pytest.raises(GranaryError):
        db.with_transaction(fails)
    assert names(db) == ["Tim"]


def test_second_writer_is_told(db):
    with pytest.raises(GranaryError):
        db.with_transaction(lambda tx: (tx.delete_one("users", {"name": "Bob"}), db.delete_one("users", {"name": "Tim"})))
    assert names(db) == ["Bob"]


def test_lookup(spark, tmp_path):
    parents = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, k int")
    kids = spark.createDataFrame([(10, "b"), (10, "a"), (None, "n")], "k int, v string")
    args = {"local": "k", "foreign": "k", "to": "kids"}
    assert [r["v"] for r in R.lookup(parents, kids, match={"id": 1}, **args).first()["kids"]] == ["a", "b"]
    assert R.lookup(parents, kids, match={"id": 2}, **args).first()["kids"] == []
    assert R.lookup(parents, kids, match={"id": 3}, **args).first()["kids"] == []
    assert R.lookup(parents, kids, match={"id": 3}, kind="inner", **args).first() is None
    assert R.lookup(parents, kids, match={"id": 9}, **args).first() is None
    assert R.lookup(parents, kids, match={"id": 1}, limit=1, **args).first()["kids"][0]["v"] == "a"
    assert [r["kids"] and r["kids"]["v"] for r in R.lookup(parents, kids, match={"id": 3}, unwind=True, **args).collect()] == [None]
    assert {r["id"]: len(r["kids"]) for r in R.lookup_many(parents, kids, match={}, **args).collect()} == {1: 2, 2: 0, 3: 0}


def test_discovery(db):
    d = db.describe("users")
    assert d["document_count"] == 2 and d["fields"][3]["enum"] == ["admin", "user", "mod"] and d["indexes"][0]["unique"]
    assert db.validate("users", filter={"role": "admin"}, doc=TIM)["valid"]
    bad = db.validate("users", filter={"$or": [{"rol": 1}]}, update={"$set": {"x": 1}}, doc={"email": 1})
    assert not bad["valid"] and {"filter", "update", "email"} <= {e["field"] for e in bad["errors"]}
    e = db.explain("users", filter={"role": "admin"}, limit=5)
    assert e["sql"] == 'SELECT * FROM "users" WHERE "role" = $1 LIMIT 5' and e["values"] == ["admin"] and "PushedFilters" in e["native"]
    assert db.status()["collections"] == ["users"]
    with pytest.raises(GranaryError, match="Perhaps 'users' is meant"):
        db.count("user")
    with pytest.raises(GranaryError, match="query_many"):
        db.find("users")


def test_events_timestamps_and_rules(spark, tmp_path):
    now = datetime(2025, 6, 1, tzinfo=UTC)
    db = Engine(spark, str(tmp_path / "db"), slow_ms=0, timestamps=Timestamps(now=lambda: now), rules=[Rule(lambda v, f, c: v.strip() if isinstance(v, str) else v)])
    db.register_collection(Collection("notes", {"id": Field("integer"), "text": Field(), "created_at": Field("date"), "updated_at": Field("date")}))
    assert db.ensure_collections(dry_run=True) and db.collections() == []
    db.ensure_collections()
    heard = []
    db.on("operation", lambda e: heard.append(e["operation"]))
    db.once("slow-query", lambda e: heard.append("slow"))
    db.insert_one("notes", {"id": 1, "text": "  hi "})
    assert db.query_one("notes", {"text": " hi"})["created_at"] is not None
    db.update_many("notes", {"id": 1}, {"$set": {"text": " yo "}})
    assert db.query_one("notes", {"$or": [{"text": {"$in": [" yo"]}}]})["text"] == "yo"
    assert heard[:2] == ["insert_one", "slow"] and heard.count("slow") == 1 and "update_many" in heard
    ended = []
    db.on("shutdown", ended.append)
    db.graceful_shutdown(3)
    assert ended == [{"exit_code": 3}] and db.status()["state"] == "closed"


def test_tools(db):
    assert len(TOOLS) == 14
    call = lambda name, **args: json.loads(handle_tool_call(db, f"granary_{name}", args))
    assert call("query_many", collection="users", filter={"name": "Tim"}, limit=5)["result"][0]["age"] == 30
    assert call("query_one", collection="users", filter={"name": "No"}) == {"ok": True, "result": None}
    assert call("count", collection="users")["result"] == 2
    assert call("insert_one", collection="users", doc={**BOB, "email": "z@x.org"})["result"]["inserted"] == 1
    assert call("update_one", collection="users", filter={"name": "Tim"}, update={"$set": {"name": "T"}})["result"]["modified"] == 1
    assert call("delete_many", collection="users", filter={})["error"]["code"] == "GUARDRAIL_BLOCKED"
    assert call("query_many", collection="users", filter={})["error"]["code"] == "VALIDATION_ERROR"
    assert call("batch", operations=[{"operation": "delete_one", "collection": "users", "filter": {"name": "T"}}])["result"]["deleted"] == 1
    for name in ("describe", "validate", "explain"):
        assert call(name, collection="users")["ok"]
    assert call("status")["ok"] and call("nope")["error"]["code"] == "UNSUPPORTED_OPERATION"


def test_names_addresses_and_statements(spark, sf):
    for bad in ("", "a/b", "..", ".x", "a b", "a*", "-x"):
        with pytest.raises(GranaryError):
            collection_name(bad)
    assert detect("postgres://u:p@h/d").dialect == "pg" and detect("mongodb+srv://h").kind == "document" and detect("https://h").kind == "search" and detect("/x").kind == "files"
    assert detect("mssql://h/d").options("t")["url"] == "jdbc:sqlserver://h/d"
    with pytest.raises(GranaryError):
        detect("ftp://x")
    assert redacted("mysql://u:p@h/d") == "mysql://***@h/d"
    assert '"role" TEXT NOT NULL CHECK ("role" IN (\'admin\', \'user\', \'mod\'))' in create_table(USERS, "pg")
    assert '"email" VARCHAR(255) NOT NULL' in create_table(USERS, "mysql") and "USING PARQUET" in create_table(USERS)
    assert create_index("users", USERS.indexes[0]) == 'CREATE UNIQUE INDEX IF NOT EXISTS "idx_users_email" ON "users" ("email" ASC)'
    assert create_index("u", Index({"a": -1}, sparse=True)).endswith('("a" DESC) WHERE "a" IS NOT NULL')


def test_errors(spark):
    assert distance("kitten", "sitting") == 3 and closest("usrs", ["users", "orders"]) == "users" and closest("zzzzzz", ["users"]) is None
    for run, code in ((lambda: spark.sql("select * from nowhere"), "COLLECTION_NOT_FOUND"), (lambda: spark.range(1).select("x"), "QUERY_ERROR"), (lambda: spark.read.parquet("/nowhere"), "COLLECTION_NOT_FOUND"), (lambda: spark.sql("select cast('a' as int)").collect(), "QUERY_ERROR")):
        with pytest.raises(Exception) as e:
            run()
        assert mapped(e.value).code == code
    assert mapped(RuntimeError("connection refused")).retryable


def test_bound_tables_and_sql(spark, sf, tmp_path):
    db = Engine(spark, str(tmp_path / "db"))
    db.bind(orders=f"{sf}/orders.parquet", customer=f"{sf}/customer.parquet")
    found = db.query_with_lookup("customer", match={"c_mktsegment": "BUILDING"}, sort={"c_custkey": 1}, lookup={"from": "orders", "local": "c_custkey", "foreign": "o_custkey", "as": "orders"})
    assert all(o["o_custkey"] == found["c_custkey"] for o in found["orders"])
    assert db.execute("select :n + 1 as x", n=4).first()["x"] == 5
    before = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert db.delete_many("orders", {"o_orderstatus": "F"}).deleted > 0
    assert spark.read.parquet(f"{sf}/orders.parquet").count() == before


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    spec = {"event_type": "click", "value": {"$gte": 10}}
    append(watch(spark, str(tmp_path / "in"), spec, projection={"event_id": 1}), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == R.count(events, spec).first()["count"]




def _files(engine, name):
    return {f.rsplit("/", 1)[1] for f in engine.table(name).inputFiles()}


def test_writes_touch_few_files(db, spark):
    before = _files(db, "users")
    db.insert_one("users", {**BOB, "email": "c@x.org", "name": "Cid"})
    assert before < _files(db, "users") and names(db) == ["Bob", "Cid", "Tim"]
    for write in (lambda: db.update_one("users", {"name": "Cid"}, {"$inc": {"age": 1}}), lambda: db.delete_one("users", {"name": "Cid"})):
        held = _files(db, "users")
        (gone,) = {r[0] for r in db.table("users").where("name = 'Cid'").select("_metadata.file_name").collect()}
        write()
        assert held - _files(db, "users") == {gone} and len(_files(db, "users")) == len(held)
    assert names(db) == ["Bob", "Tim"] and tuple(db.query_one("users", {"name": "Bob"}))[:3] == ("b@x.org", "Bob", 25)
    db.compact("users")
    assert names(db) == ["Bob", "Tim"]


def test_tables_from_elsewhere_keep_their_folders_values(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, part string").write.partitionBy("part").parquet(str(tmp_path / "in"))
    db = Engine(spark, str(tmp_path / "a db"))
    db.bind(t=str(tmp_path / "in"))
    db.insert_one("t", {"id": 4, "part": "c"})
    db.update_one("t", {"part": "b"}, {"$set": {"id": 9}}, order_by={"id": 1})
    db.bind(u=str(tmp_path / "in"))
    db.delete_one("u", {"id": 2})
    assert sorted(map(tuple, db.table("t").collect())) == [(1, "a"), (3, "b"), (4, "c"), (9, "b")]
    assert sorted(map(tuple, db.table("u").collect())) == [(1, "a"), (3, "b")] and spark.read.parquet(str(tmp_path / "in")).count() == 3


def test_unique_holds_for_updates(db):
    for write in (lambda: db.update_many("users", {"age": {"$gt": 0}}, {"$set": {"email": "same@x.org"}}), lambda: db.update_one("users", {"name": "Bob"}, {"$set": {"email": "t@x.org"}}), lambda: db.update_one("users", {"email": "n@x.org"}, {"$set": {"email": "t@x.org", "name": "N", "role": "mod"}}, upsert=True)):
        with pytest.raises(GranaryError) as e:
            write()
        assert e.value.code == "DUPLICATE_KEY"
    assert db.update_one("users", {"name": "Bob"}, {"$set": {"email": "b@x.org"}}).modified == 1
    assert db.update_many("users", {"name": "Bob"}, {"$set": {"email": "new@x.org"}}).modified == 1
    assert db.ensure_indexes()
    db.register_index("users", Index({"active_role": 1}))
    db.insert_one("users", {**BOB, "email": "d@x.org"})
    db.register_index("users", Index({"name": 1}, unique=True))
    with pytest.raises(GranaryError) as e:
        db.ensure_indexes()
    assert e.value.code == "DUPLICATE_KEY" and db.ensure_indexes(dry_run=True)


def test_rows_of_a_frame_are_under_the_same_rules(db, spark, tmp_path):
    kinds = "email string, name string, age int, role string, tags array<string>"
    for row in (("e@x.org", "E", 1, "boss", None), (None, "E", 1, "mod", None), ("e" * 300, "E", 1, "mod", None), ("e@x.org", "E", 1, "mod", [None])):
        with pytest.raises(GranaryError) as e:
            db.insert_many("users", spark.createDataFrame([row], kinds))
        assert e.value.code == "VALIDATION_ERROR", row
    for df in (spark.createDataFrame([("e@x.org",)], "email string"), spark.createDataFrame([("e@x.org", "E", "old", "mod")], "email string, name string, age string, role string"), spark.createDataFrame([("e@x.org", "E", "mod", 1)], "email string, name string, role string, extra int")):
        with pytest.raises(GranaryError) as e:
            db.insert_many("users", df)
        assert e.value.code == "VALIDATION_ERROR"
    assert db.insert_many("users", spark.createDataFrame([("e@x.org", "E", 1, "mod", ["x"]), ("f@x.org", "F", None, "user", None)], kinds)).inserted == 2
    with pytest.raises(GranaryError) as e:
        db.insert_many("users", spark.createDataFrame([("t@x.org", "T", 1, "mod", [])], kinds))
    assert e.value.code == "DUPLICATE_KEY" and db.count("users") == 4
    now = datetime(2025, 6, 1, tzinfo=UTC)
    notes = Engine(spark, str(tmp_path / "notes"), validate=True, timestamps=Timestamps(now=lambda: now), rules=[Rule(lambda v, f, c: v.strip() if isinstance(v, str) else v)])
    notes.register_collection(Collection("notes", {"id": Field("integer"), "text": Field(rule=lambda v: v != "no"), "created_at": Field("date"), "updated_at": Field("date")}))
    notes.ensure_collections()
    notes.insert_many("notes", spark.createDataFrame([(1, "  hi ")], "id int, text string"))
    got = notes.query_one("notes", {"id": 1})
    assert got["text"] == "hi" and got["created_at"] == got["updated_at"] and got["created_at"] is not None
    with pytest.raises(GranaryError):
        notes.insert_many("notes", spark.createDataFrame([(2, " no ")], "id int, text string"))


def test_lookup_of_one_parent_and_maps(spark):
    parents = spark.range(0, 400, 1, 8).selectExpr("id", "id % 2 as k", "'p' as kids_of", "id as f0")
    kids = spark.createDataFrame([(0, {"a": 2}), (0, {"a": 1}), (1, {"b": 1}), (0, None)], "k int, m map<string,int>")
    args = {"local": "k", "foreign": "k", "to": "kids"}
    for _ in range(3):
        got = R.lookup(parents, kids, match={}, **args).first()
        assert got["f0"] == got["id"] and all(c["k"] == got["id"] % 2 for c in got["kids"])
    got = R.lookup(parents, kids, match={"id": 0}, limit=2, **args).first()["kids"]
    assert [c["m"] for c in got] == [None, {"a": 1}] or [c["m"] for c in got] == [{"a": 1}, {"a": 2}]
    many = R.lookup_many(parents, kids, match={"id": {"$lt": 2}}, limit=1, **args).collect()
    assert {r["id"]: len(r["kids"]) for r in many} == {0: 1, 1: 1}
    assert R.lookup_many(parents, kids, match={"id": {"$lt": 2}}, unwind=True, **args).count() == 4
    assert R.lookup(parents, kids, match={"id": 0}, limit=0, **args).first()["kids"] == []
    plan = R.lookup(parents, kids, match={}, **args)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_times_of_day_against_dates(spark):
    df = spark.sql("select date '2025-06-01' as d")
    for op, n in (("$lt", 1), ("$lte", 1), ("$gt", 0), ("$gte", 0), ("$eq", 0), ("$ne", 1)):
        assert R.query(df, {"d": {op: "2025-06-01T12:00:00"}}).count() == n, op
    assert R.query(df, {"d": "2025-06-01"}).count() == R.query(df, {"d": {"$in": ["2025-06-01T00:00:00", "2025-06-02T01:00:00"]}}).count() == 1


def test_fields_against_fields(spark):
    from granary.plans import render

    df = spark.createDataFrame([(1, 2, "x"), (2, 2, "y"), (3, 2, "z"), (None, 2, "n")], "a int, b long, s string")
    for op, n in (("$gt", 1), ("$gte", 2), ("$lt", 1), ("$lte", 2), ("$eq", 1), ("$ne", 2)):
        assert R.count(df, {"$expr": {op: ["$a", "$b"]}}).first()["count"] == n, op
    assert R.count(df, {"$expr": {"$lt": [2, "$a"]}}).first()["count"] == 1
    assert R.count(df, {"$expr": {"$ne": ["$a", "$b"]}}, "document").first()["count"] == 3
    assert R.count(df, {"$nor": [{"$expr": {"$gt": ["$a", "$b"]}}]}).first()["count"] == 2
    assert render.select("t", {"$expr": {"$gt": ["$a", "$b"]}})[0].endswith('WHERE "a" > "b"')
    for bad in ({}, {"$gt": ["$a"]}, {"$gt": [1, 2]}, {"$gt": ["$a", None]}, {"$gt": ["$a", "$s"]}, {"$gt": ["$a", "$nope"]}, {"$add": ["$a", "$b"]}):
        with pytest.raises(GranaryError):
            R.query(df, {"$expr": bad})


def test_retries_splits_and_values_by_position(spark, tmp_path):
    from granary.events import Events
    from granary.sources.retry import Retry

    events, told, waits, left = Events(), [], [], [3]
    events.on("reconnecting", lambda e: told.append(e["attempt"]))
    events.on("reconnected", lambda e: told.append("back"))

    def opens():
        left[0] -= 1
        if left[0] >= 0:
            raise RuntimeError("connection refused")
        return "open"

    policy = Retry(tries=3, first_s=1, most_s=3, sleep=waits.append)
    assert policy.run(opens, events) == "open" and told == [1, 2, 3, "back"]
    assert all(w <= most for w, most in zip(waits, (1, 2, 3), strict=True)) and min(waits) >= 0.5
    left[0] = 9
    with pytest.raises(RuntimeError):
        policy.run(opens, events)
    assert left[0] == 5
    with pytest.raises(ZeroDivisionError):
        policy.run(lambda: 1 / 0, events)
    options = detect("postgres://h/d").options("t", "low", ("id", 1, 100))
    assert (options["partitionColumn"], options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("id", "1", "100", "5")
    db = Engine(spark, str(tmp_path / "db"))
    assert db.execute("select ? + ? as x", 1, 2).first()["x"] == 3
    with pytest.raises(GranaryError):
        db.execute("select ? + :n", 1, n=2)
