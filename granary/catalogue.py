"""The engine's own queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reads as R
from .operators import writes as W


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _read(name: str, spec: dict | None, *fields: str, **options):
    return lambda s, d: R.query(_table(s, d, name), spec, projection=dict.fromkeys(fields, 1) or None, **options)


def _count(name: str, spec: dict | None):
    return lambda s, d: R.count(_table(s, d, name), spec)


def _write(name: str, change, *fields: str):
    def run(s, d):
        df = change(_table(s, d, name))
        return df.select(*fields) if fields else df

    return run


def _without_building(df: DataFrame, field: str = "c_acctbal") -> DataFrame:
    return W.update_many(df, {"c_mktsegment": "BUILDING"}, {"$unset": {field: True}})


def _nulls(spec: dict, profile: str, *fields: str, field: str = "c_acctbal", **options):
    return lambda s, d: R.query(_without_building(_table(s, d, "customer"), field), spec, projection=dict.fromkeys(fields, 1), profile=profile, **options)


_FIRST_BUILDING = {"match": {"c_mktsegment": "BUILDING"}, "sort": {"c_custkey": 1}}
_TO_ORDERS = {"local": "c_custkey", "foreign": "o_custkey", "to": "orders"}


def lookup_left(s, d):
    out = R.lookup(_table(s, d, "customer"), _table(s, d, "orders"), **_FIRST_BUILDING, **_TO_ORDERS)
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_min(F.transform("orders", lambda o: o["o_orderkey"])).alias("lo"), F.array_max(F.transform("orders", lambda o: o["o_orderkey"])).alias("hi"))


def lookup_left_empty(s, d):
    out = R.lookup(_table(s, d, "documents"), _table(s, d, "labels"), match={"doc_id": 2}, local="doc_id", foreign="doc_id", to="labels")
    return out.select("doc_id", F.size("labels").cast("long").alias("n"))


def lookup_unwind(s, d):
    out = R.lookup(_table(s, d, "customer"), _table(s, d, "orders"), **_FIRST_BUILDING, **_TO_ORDERS, unwind=True)
    return out.select("c_custkey", F.col("orders.o_orderkey").alias("o_orderkey"))


def lookup_limit(s, d):
    out = R.lookup(_table(s, d, "customer"), _table(s, d, "orders"), **_FIRST_BUILDING, **_TO_ORDERS, limit=3, unwind=True)
    return out.select("c_custkey", F.col("orders.o_orderkey").alias("o_orderkey"))


def lookup_many_limit(s, d):
    out = R.lookup_many(_table(s, d, "customer"), _table(s, d, "orders"), match={"c_nationkey": {"$lt": 5}}, **_TO_ORDERS, limit=2, unwind=True)
    return out.select("c_custkey", F.col("orders.o_orderkey").alias("o_orderkey"))


def filter_date_time(s, d):
    days = _table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"))
    return R.query(days, {"day": {"$gte": "1997-06-01T12:00:00", "$lt": "1997-07-01T12:00:00"}}, projection={"l_orderkey": 1, "l_partkey": 1})


def lookup_many(s, d):
    out = R.lookup_many(_table(s, d, "customer"), _table(s, d, "orders"), match={"c_nationkey": {"$lt": 5}}, **_TO_ORDERS)
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"))


def _tags(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.array("label").alias("tags"))


def batch_mixed(s, d):
    region = _table(s, d, "region")
    operations = [
        {"operation": "insert_one", "collection": "region", "doc": {"r_regionkey": 50, "r_name": "ADDED"}},
        {"operation": "update_many", "collection": "region", "filter": {"r_regionkey": 1}, "update": {"$set": {"r_name": "NEW"}}},
        {"operation": "delete_many", "collection": "region", "filter": {"r_regionkey": 0}},
    ]
    return W.batch({"region": region}, operations)["region"]


_FLAGSHIP = {"o_orderstatus": "O", "o_totalprice": {"$gte": 300000}}
_BEST_FIRST = {"o_totalprice": -1, "o_orderkey": 1}
FLAGSHIP = "topk_flagship"

#: name: (query, SQL)
_ALL = {
    "topk_flagship": (_read("orders", _FLAGSHIP, "o_orderkey", "o_custkey", "o_totalprice", sort=_BEST_FIRST, limit=50), "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice >= 300000 order by o_totalprice desc nulls first, o_orderkey asc nulls last limit 50"),
    "filter_eq": (_read("orders", {"o_orderstatus": "O"}, "o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'"),
    "filter_ne": (_read("orders", {"o_orderstatus": {"$ne": "O"}}, "o_orderkey", "o_orderstatus"), "select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'O'"),
    "filter_range": (_read("lineitem", {"l_quantity": {"$gte": 10, "$lt": 12}, "l_discount": {"$gt": 0.02, "$lte": 0.05}}, "l_orderkey", "l_partkey", "l_quantity", "l_discount"), "select l_orderkey, l_partkey, l_quantity, l_discount from lineitem where l_quantity >= 10 and l_quantity < 12 and l_discount > 0.02 and l_discount <= 0.05"),
    "filter_in": (_read("customer", {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, "c_custkey", "c_mktsegment"), "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "filter_nin": (_read("customer", {"c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}, "c_custkey", "c_mktsegment"), "select c_custkey, c_mktsegment from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')"),
    "filter_in_empty": (_count("customer", {"c_custkey": {"$in": []}}), 'select count(*) as "count" from customer where false'),
    "filter_nin_empty": (_count("customer", {"c_custkey": {"$nin": []}}), 'select count(*) as "count" from customer'),
    "filter_or_trivial": (_count("customer", {"$or": [{"c_custkey": {"$nin": []}}, {"c_custkey": 1}]}), 'select count(*) as "count" from customer where true or c_custkey = 1'),
    "filter_nor_trivial": (_count("customer", {"$nor": [{}]}), 'select count(*) as "count" from customer where not (true)'),
    "filter_and_or_nor": (_read("orders", {"$and": [{"$or": [{"o_orderstatus": "O"}, {"o_orderpriority": "1-URGENT"}]}, {"$nor": [{"o_totalprice": {"$lt": 1000}}, {"o_custkey": 1}]}]}, "o_orderkey"), "select o_orderkey from orders where (o_orderstatus = 'O' or o_orderpriority = '1-URGENT') and not (o_totalprice < 1000 or o_custkey = 1)"),
    "filter_not": (_read("orders", {"o_totalprice": {"$not": {"$gt": 1000, "$lt": 400000}}}, "o_orderkey", "o_totalprice"), "select o_orderkey, o_totalprice from orders where not (o_totalprice > 1000 and o_totalprice < 400000)"),
    "filter_regex_prefix": (_read("part", {"p_name": {"$regex": "^small"}}, "p_partkey", "p_name"), "select p_partkey, p_name from part where regexp_matches(p_name, '^small')"),
    "filter_regex_opt": (_read("part", {"p_name": {"$regex": "WIDGET", "$options": "i"}}, "p_partkey", "p_name"), "select p_partkey, p_name from part where regexp_matches(p_name, 'WIDGET', 'i')"),
    "filter_size": (lambda s, d: R.query(_table(s, d, "embeddings"), {"embedding": {"$size": 64}}).select("vec_id", F.size("embedding").alias("n")), "select vec_id, cast(len(embedding) as integer) as n from embeddings where len(embedding) = 64"),
    "filter_date": (_read("lineitem", {"l_shipdate": {"$gte": "1998-01-01T00:00:00"}}, "l_orderkey", "l_partkey", "l_shipdate"), "select l_orderkey, l_partkey, l_shipdate from lineitem where l_shipdate >= timestamp '1998-01-01'"),
    "filter_date_time": (filter_date_time, "select l_orderkey, l_partkey from lineitem where cast(l_shipdate as date) >= timestamp '1997-06-01 12:00:00' and cast(l_shipdate as date) < timestamp '1997-07-01 12:00:00'"),
    "filter_expr": (_read("lineitem", {"$expr": {"$gt": ["$l_partkey", "$l_orderkey"]}, "l_quantity": {"$lt": 5}}, "l_orderkey", "l_partkey"), "select l_orderkey, l_partkey from lineitem where l_partkey > l_orderkey and l_quantity < 5"),
    "filter_type": (_count("customer", {"c_name": {"$type": "string"}, "c_custkey": {"$type": ["int", "long"]}}), 'select count(*) as "count" from customer where c_name is not null and c_custkey is not null'),
    "filter_mod": (_read("orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey"), "select o_orderkey from orders where o_orderkey % 7 = 3"),
    "filter_bits": (_read("part", {"p_size": {"$bitsAllSet": 6}, "p_partkey": {"$bitsAnyClear": [0, 1]}}, "p_partkey", "p_size"), "select p_partkey, p_size from part where (p_size & 6) = 6 and (p_partkey & 3) <> 3"),
    "filter_all": (lambda s, d: R.query(_table(s, d, "documents").select("doc_id", F.split("text", " ").alias("words")), {"words": {"$all": ["the", "of"]}}).select("doc_id"), "select doc_id from documents where list_contains(string_split(text, ' '), 'the') and list_contains(string_split(text, ' '), 'of')"),
    "filter_elem_match": (lambda s, d: R.query(_table(s, d, "embeddings"), {"embedding": {"$elemMatch": {"$gt": 0.25, "$lt": 0.26}}}).select("vec_id"), "select vec_id from embeddings where len(list_filter(embedding, lambda x: x > 0.25::double and x < 0.26::double)) > 0"),
    "null_ne_sql": (_nulls({"c_acctbal": {"$ne": 0}}, "sql", "c_custkey"), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as c_acctbal from customer) select c_custkey from t where c_acctbal <> 0"),
    "null_ne_document": (_nulls({"c_acctbal": {"$ne": 0}}, "document", "c_custkey"), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as c_acctbal from customer) select c_custkey from t where c_acctbal is distinct from 0"),
    "null_nin_document": (_nulls({"c_nationkey": {"$nin": [1, 2, 3]}}, "document", "c_custkey", field="c_nationkey"), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_nationkey end as k from customer) select c_custkey from t where not coalesce(k in (1, 2, 3), false)"),
    "null_nin_sql": (_nulls({"c_nationkey": {"$nin": [1, 2, 3]}}, "sql", "c_custkey", field="c_nationkey"), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_nationkey end as k from customer) select c_custkey from t where k not in (1, 2, 3)"),
    "null_not_document": (_nulls({"c_acctbal": {"$not": {"$gt": 0, "$lt": 5000}}}, "document", "c_custkey"), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as b from customer) select c_custkey from t where not coalesce(b > 0 and b < 5000, false)"),
    "null_exists_false": (_nulls({"c_acctbal": {"$exists": False}}, "sql", "c_custkey"), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as c_acctbal from customer) select c_custkey from t where c_acctbal is null"),
    "null_eq": (_nulls({"c_acctbal": None}, "sql", "c_custkey"), "select c_custkey from customer where c_mktsegment = 'BUILDING'"),
    "null_sort": (_nulls({}, "sql", "c_custkey", "c_acctbal", sort={"c_acctbal": 1, "c_custkey": 1}), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as c_acctbal from customer) select c_custkey, c_acctbal from t order by c_acctbal asc nulls last, c_custkey asc nulls last"),
    "project_exclude": (lambda s, d: R.query(_table(s, d, "documents"), {}, projection={"text": 0}), "select * exclude (text) from documents"),
    "topk_offset": (_read("orders", _FLAGSHIP, "o_orderkey", "o_totalprice", sort=_BEST_FIRST, skip=20, limit=50), "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice >= 300000 order by o_totalprice desc nulls first, o_orderkey asc nulls last limit 50 offset 20"),
    "query_one": (_read("customer", {"c_mktsegment": "BUILDING"}, "c_custkey", "c_name", sort={"c_custkey": 1}, limit=1), "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 1"),
    "count_filter": (_count("events", {"event_type": "click", "value": {"$gte": 10}}), "select count(*) as \"count\" from events where event_type = 'click' and value >= 10"),
    "lookup_left": (lookup_left, "with m as (select * from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 1) select c_custkey, count(o_orderkey) as n, min(o_orderkey) as lo, max(o_orderkey) as hi from m left join orders on c_custkey = o_custkey group by c_custkey"),
    "lookup_left_empty": (lookup_left_empty, "select d.doc_id, count(l.doc_id) as n from documents d left join labels l using (doc_id) where d.doc_id = 2 group by d.doc_id"),
    "lookup_unwind": (lookup_unwind, "with m as (select * from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 1) select c_custkey, o_orderkey from m left join orders on c_custkey = o_custkey"),
    "lookup_many": (lookup_many, "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey where c_nationkey < 5 group by c_custkey"),
    "lookup_limit": (lookup_limit, "with m as (select * from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 1) select c_custkey, o_orderkey from m left join (select * from orders where o_custkey in (select c_custkey from m) order by o_orderkey limit 3) on c_custkey = o_custkey"),
    "lookup_many_limit": (lookup_many_limit, "with k as (select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) <= 2) select c_custkey, o_orderkey from customer left join k on c_custkey = o_custkey where c_nationkey < 5"),
    "update_set_inc": (_write("orders", lambda t: W.update_many(t, {"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "O"}, "$inc": {"o_totalprice": 10.5}}), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "select o_orderkey, o_custkey, case when o_orderstatus = 'P' then 'O' else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'P' then o_totalprice + 10.5::double else o_totalprice end as o_totalprice from orders"),
    "update_unset": (_write("customer", _without_building, "c_custkey", "c_acctbal"), "select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as c_acctbal from customer"),
    "update_push": (_write("embeddings", lambda t: W.update_many(_tags(t), {"label": 2}, {"$push": {"tags": 99}}), "vec_id", "tags"), "select vec_id, case when label = 2 then list_append([label], 99) else [label] end as tags from embeddings"),
    "update_pull": (_write("embeddings", lambda t: W.update_many(_tags(t), {"label": 2}, {"$pull": {"tags": 2}}), "vec_id", "tags"), "select vec_id, case when label = 2 then []::integer[] else [label] end as tags from embeddings"),
    "update_one": (_write("orders", lambda t: W.update_one(t, {"o_orderstatus": "F"}, {"$set": {"o_orderstatus": "X"}}, order_by={"o_orderkey": 1}), "o_orderkey", "o_orderstatus"), "with r as (select min(o_orderkey) as k from orders where o_orderstatus = 'F') select o_orderkey, case when o_orderkey = (select k from r) then 'X' else o_orderstatus end as o_orderstatus from orders"),
    "upsert_insert": (_write("region", lambda t: W.upsert(t, {"r_regionkey": 99}, {"$set": {"r_name": "ATLANTIS"}})), "select r_regionkey, r_name from region union all select 99, 'ATLANTIS'"),
    "upsert_update": (_write("region", lambda t: W.upsert(t, {"r_regionkey": 2}, {"$set": {"r_name": "ATLANTIS"}})), "select r_regionkey, case when r_regionkey = 2 then 'ATLANTIS' else r_name end as r_name from region"),
    "delete_many_null": (_write("customer", lambda t: W.delete_many(_without_building(t), {"c_acctbal": {"$gt": 0}}), "c_custkey"), "with t as (select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_acctbal end as b from customer) select c_custkey from t where not coalesce(b > 0, false)"),
    "delete_one": (_write("orders", lambda t: W.delete_one(t, {"o_orderstatus": "F"}, order_by={"o_orderkey": 1}), "o_orderkey"), "select o_orderkey from orders where o_orderkey <> (select min(o_orderkey) from orders where o_orderstatus = 'F')"),
    "insert_many": (_write("nation", lambda t: W.insert(t, [{"n_nationkey": 100, "n_name": "X", "n_regionkey": 1}, {"n_nationkey": 101, "n_name": "Y", "n_regionkey": 2}])), "select n_nationkey, n_name, n_regionkey from nation union all values (100, 'X', 1), (101, 'Y', 2)"),
    "batch_mixed": (batch_mixed, "select r_regionkey, case when r_regionkey = 1 then 'NEW' else r_name end as r_name from region where r_regionkey <> 0 union all select 50, 'ADDED'"),
}

QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items()}
