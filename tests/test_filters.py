import random
from datetime import datetime

import pytest

from granary.errors import GranaryError
from granary.operators import reads as R
from granary.operators.predicates import predicate
from granary.plans import filters as P
from granary.plans import render


@pytest.fixture(scope="module")
def nulls3(spark):
    return spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, None), (3, "b", [])], "id int, v string, arr array<string>").cache()


def ids(df, spec, **kw):
    return sorted(r["id"] for r in R.query(df, spec, **kw).collect())


@pytest.mark.parametrize(
    ("spec", "sql", "document"),
    [
        ({}, [1, 2, 3], None),
        ({"v": "a"}, [1], None),
        ({"v": None}, [2], None),
        ({"v": {"$eq": None}}, [2], None),
        ({"v": {"$ne": "a"}}, [3], [2, 3]),
        ({"v": {"$ne": None}}, [1, 3], None),
        ({"v": {"$in": ["a", "b"]}}, [1, 3], None),
        ({"v": {"$in": []}}, [], None),
        ({"v": {"$in": "a"}}, [], None),
        ({"v": {"$nin": ["a"]}}, [3], [2, 3]),
        ({"v": {"$nin": []}}, [1, 2, 3], None),
        ({"v": {"$nin": ["a", None]}}, [], [3]),
        ({"v": {"$exists": True}}, [1, 3], None),
        ({"v": {"$not": {"$eq": "a"}}}, [3], [2, 3]),
        ({"id": {"$not": {"$gt": 1, "$lt": 3}}}, [1, 3], None),
        ({"$nor": [{"v": "a"}]}, [3], [2, 3]),
        ({"$or": [{}, {"v": "a"}]}, [1, 2, 3], None),
        ({"$nor": [{}]}, [], None),
        ({"$or": [{"v": "a"}, {"$and": [{"id": 3}, {"v": {"$regex": "^b"}}]}]}, [1, 3], None),
        ({"v": {"$regex": "A", "$options": "i"}}, [1], None),
        ({"arr": {"$size": 2}}, [1], None),
        ({"arr": {"$size": 0}}, [3], None),
        ({"arr": {"$all": ["x", "y"]}}, [1], None),
        ({"arr": {"$elemMatch": {"$eq": "x"}}}, [1], None),
        ({"arr": ["x", "y"]}, [1], None),
        ({"id": {"$mod": [2, 1]}}, [1, 3], None),
        ({"id": {"$bitsAllSet": 3}}, [3], None),
        ({"id": {"$bitsAnyClear": [0]}}, [2], None),
        ({"id": {"$bitsAllClear": 2}}, [1], None),
        ({"v": {"$type": "string"}}, [1, 3], None),
        ({"id": {"$gte": 2, "$lt": 3}}, [2], None),
    ],
)
def test_meaning(nulls3, spec, sql, document):
    assert ids(nulls3, spec) == sql
    assert ids(nulls3, spec, profile="document") == (sql if document is None else document)


@pytest.mark.parametrize(
    ("spec", "code"),
    [
        ({"v": {"$unknown": 1}}, "UNKNOWN_OPERATOR"),
        ({"$match": {}}, "UNKNOWN_OPERATOR"),
        ({"v": {"city": "x"}}, "UNKNOWN_OPERATOR"),
        ({"w": 1}, "QUERY_ERROR"),
        ({"v": 5}, "QUERY_ERROR"),
        ({"id": "five"}, "QUERY_ERROR"),
        ({"$and": []}, "QUERY_ERROR"),
        ({"$or": {}}, "QUERY_ERROR"),
        ({"v": {"$not": {}}}, "QUERY_ERROR"),
        ({"v": {"$options": "i"}}, "QUERY_ERROR"),
        ({"v": {"$regex": "(a+)+"}}, "QUERY_ERROR"),
        ({"v": {"$regex": "x" * 1001}}, "QUERY_ERROR"),
        ({"v": {"$gt": None}}, "QUERY_ERROR"),
    ],
)
def test_refused_before_running(nulls3, spec, code):
    with pytest.raises(GranaryError) as e:
        R.query(nulls3, spec)
    assert e.value.code == code and e.value.fix


def test_paths_and_dotted_names(spark):
    df = spark.createDataFrame([(1, ("Rome",), 7)], "id int, addr struct<city: string>, `a.b` int")
    assert ids(df, {"addr.city": "Rome"}) == [1]
    assert ids(df, {"a.b": 7}) == [1]
    with pytest.raises(GranaryError):
        R.query(df, {"addr.town": "Rome"})


def test_dates(spark):
    df = spark.sql("select 1 id, timestamp_ntz'2025-06-01 00:00:00' n, timestamp'2025-06-01 00:00:00' t, date'2025-06-01' d")
    for f in ("n", "t", "d"):
        assert ids(df, {f: {"$gte": datetime(2025, 6, 1)}}) == [1]
        assert ids(df, {f: {"$lt": "2025-06-01"}}) == []


@pytest.mark.parametrize("spec", [{}, {"a": {}}, {"$and": [{}]}, {"$or": [{}, {"a": 1}]}, {"a": {"$nin": []}}, {"$nor": [{"$nor": [{}]}]}, {"$nor": [{"a": {"$in": []}}]}])
def test_trivial(spec):
    assert P.is_trivial(spec)


@pytest.mark.parametrize("spec", [{"a": 1}, {"$nor": [{}]}, {"$or": [{"a": 1}, {"b": 2}]}, {"a": {"$exists": True}}])
def test_not_trivial(spec):
    assert not P.is_trivial(spec)


def test_pushdown(spark, sf):
    df = R.query(spark.read.parquet(f"{sf}/orders.parquet"), {"o_orderstatus": "O", "o_orderpriority": {"$regex": "^1-URG"}}, projection={"o_orderkey": 1})
    plan = render.spark_plan(df)
    assert "EqualTo(o_orderstatus,O)" in plan and "StringStartsWith(o_orderpriority,1-URG)" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


def test_options(nulls3):
    q = lambda **kw: [r["id"] for r in R.query(nulls3, {}, **kw).collect()]
    assert q(sort={"v": 1}) == [1, 3, 2] and q(sort={"v": -1}) == [2, 3, 1]
    assert q(sort={"id": "desc"}, skip=1, limit=1) == [2] and q(sort={"id": 1}, limit=0) == []
    assert R.query(nulls3, {}, projection={"arr": 0}).columns == ["id", "v"]
    assert R.query(nulls3, {}, projection={"v": 1, "arr": 0}).columns == ["v"]
    for bad in ({"sort": {"id": "DESC"}}, {"limit": -1}, {"skip": 1.5}, {"sort": {"id": True}}):
        with pytest.raises(GranaryError):
            R.query(nulls3, {}, **bad)


def _eval(node, row):
    """Three-valued logic, by hand."""
    if isinstance(node, P.Always):
        return node.value
    if isinstance(node, P.Not):
        x = _eval(node.part, row)
        return None if x is None else not x
    if isinstance(node, P.And | P.Or):
        xs, end = [_eval(p, row) for p in node.parts], isinstance(node, P.Or)
        return end if end in xs else None if None in xs else not end
    v = row[node.field]
    if node.op == "exists":
        return (v is not None) == node.value
    if v is None:
        return None
    if node.op in ("in", "nin"):
        return (v in node.value) == (node.op == "in")
    return {"eq": v == node.value, "ne": v != node.value, "gt": v > node.value, "lte": v <= node.value}[node.op]


def _random(r, depth=0):
    kind = r.choice(["f", "f", "$and", "$or", "$nor"]) if depth < 3 else "f"
    if kind != "f":
        return {kind: [_random(r, depth + 1) for _ in range(r.randint(1, 3))]}
    op = r.choice(["$eq", "$ne", "$gt", "$lte", "$in", "$nin", "$exists", "$not"])
    v = r.randint(0, 3)
    value = [v, r.randint(0, 3)][: r.randint(0, 2)] if op in ("$in", "$nin") else bool(v % 2) if op == "$exists" else {"$gt": v} if op == "$not" else v
    return {r.choice("ab"): {op: value}}


def test_random_filters_agree_with_three_valued_logic(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in (None, 0, 1, 2, 3) for b in (None, 0, 1, 2, 3))]
    df = spark.createDataFrame(rows, "id int, a int, b int").cache()
    r = random.Random(11)
    specs = [_random(r) for _ in range(60)]
    found = df.select("id", *[predicate(s, df.schema).alias(f"p{i}") for i, s in enumerate(specs)]).collect()
    for i, s in enumerate(specs):
        want = {x: _eval(P.parse(s), {"a": a, "b": b}) for x, a, b in rows}
        assert {f["id"]: f[f"p{i}"] for f in found} == want, s


@pytest.mark.parametrize(
    ("spec", "dialect", "text"),
    [
        ({"age": {"$gte": 18, "$lt": 65}}, "pg", 'SELECT * FROM "t" WHERE "age" >= $1 AND "age" < $2'),
        ({"r": {"$in": ["a", "b"]}}, "mysql", "SELECT * FROM `t` WHERE `r` IN (?, ?)"),
        ({"r": {"$in": []}}, "pg", 'SELECT * FROM "t" WHERE 1=0'),
        ({}, "sqlite", 'SELECT * FROM "t"'),
        ({"$nor": [{"a": 1}, {"b": None}]}, "mssql", 'SELECT * FROM "t" WHERE NOT ("a" = @p1 OR "b" IS NULL)'),
        ({"n": {"$regex": "^a.*b"}}, "sqlite", 'SELECT * FROM "t" WHERE "n" LIKE ?'),
    ],
)
def test_sql_text(spec, dialect, text):
    assert render.select("t", spec, dialect=dialect)[0] == text


def test_paging_and_search_text():
    assert render.select("t", {}, sort={"a": -1}, skip=5, limit=10)[0] == 'SELECT * FROM "t" ORDER BY "a" DESC LIMIT 10 OFFSET 5'
    assert render.select("t", {}, limit=3, dialect="mssql")[0] == 'SELECT TOP(3) * FROM "t"'
    assert render.select("t", {}, skip=3, limit=2, dialect="mssql")[0] == 'SELECT * FROM "t" ORDER BY (SELECT NULL) OFFSET 3 ROWS FETCH NEXT 2 ROWS ONLY'
    assert render.search(P.parse({"a": {"$gt": 1, "$lte": 5}})) == {"range": {"a": {"gt": 1, "lte": 5}}}
    assert render.search(P.parse({"$or": [{"a": 1}, {"b": {"$ne": 2}}]})) == {"bool": {"should": [{"term": {"a": 1}}, {"bool": {"must_not": [{"term": {"b": 2}}]}}], "minimum_should_match": 1}}
    assert render.like("^a.*b") == "a%b%" and render.like("50%") == "%50\\%%"
