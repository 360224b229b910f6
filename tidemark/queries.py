"""One query for each operator of the engine over the given tables, with SQL for its rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import decoding
from tidemark.operators.compile import compile_query, unnested
from tidemark.plans import ast
from tidemark.plans.builder import Registry, any_of, compare, hop
from tidemark.sources.catalog import Catalog
from tidemark.storage import new_path
from tidemark.streaming import cdc, patches
from tidemark.streaming.changelog import ChangeLog, Reset
from tidemark.streaming.views import Replica, changes

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "labels": "doc_id"}
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog.parquet(spark, sf_dir, KEYS | {"lineitem": LINE})
    nullable = lambda: c["events"].load().select("event_id", F.expr("nullif(event_type, 'error')").alias("kind"), "value", "user_id")
    c.add("happenings", nullable, "event_id")  # events whose kind may be null: the tables have no nulls
    c["region"].relate("nations", hop("r_regionkey", "nation", "n_regionkey"))
    c["nation"].relate("region", hop("n_regionkey", "region", "r_regionkey", one=True))
    c["nation"].relate("customers", hop("n_nationkey", "customer", "c_nationkey")).relate("suppliers", hop("n_nationkey", "supplier", "s_nationkey"))
    c["customer"].relate("orders", hop("c_custkey", "orders", "o_custkey")).relate("nation", hop("c_nationkey", "nation", "n_nationkey", one=True))
    c["customer"].relate("neighbours", hop(("c_nationkey", "c_custkey"), "supplier", ("s_nationkey", "s_suppkey")))
    c["orders"].relate("lines", hop("o_orderkey", "lineitem", "l_orderkey"))
    c["supplier"].relate("parts", hop("s_suppkey", "lineitem", "l_suppkey"), hop("l_partkey", "part", "p_partkey"))
    return c


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, columns: str | None = None):
    """Registers fn(from_) -> builder, whose result is compared, or its `columns`."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            c = catalog(spark, sf_dir)
            tree = ast.query(json.dumps(fn(Registry(c).from_).build().to_json()))  # by way of the JSON form
            out = compile_query(tree, c)
            return out.select(*columns.split()) if columns else out

        QUERIES[name], ORACLE[name] = run, sql
        return fn

    return put


def plain(name: str, sql: str):
    """Registers fn(spark, catalog) -> DataFrame."""

    def put(fn):
        QUERIES[name], ORACLE[name] = (lambda spark, sf_dir: fn(spark, catalog(spark, sf_dir))), sql
        return fn

    return put


def simple(name: str, sql: str, build, columns: str | None = None) -> None:
    query(name, sql, columns)(build)


HAPPENINGS = "(select event_id, nullif(event_type, 'error') as kind, value, user_id from events)"

simple("scan_pk_order", "select * from nation", lambda t: t("nation"))
for _name, _op, _value, _sql in (
    ("eq", "=", "F", "o_orderstatus = 'F'"),
    ("ne", "!=", "F", "o_orderstatus <> 'F'"),
    ("in", "IN", ["F", "P"], "o_orderstatus in ('F', 'P')"),
    ("not_in", "NOT IN", ["F", "P"], "o_orderstatus not in ('F', 'P')"),
):
    simple(f"filter_{_name}", f"select * from orders where {_sql}", lambda t, o=_op, v=_value: t("orders").where("o_orderstatus", o, v))
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    simple(f"filter_{_name}", f"select * from happenings_ where value {_op} 50.0".replace("happenings_", HAPPENINGS), lambda t, o=_op: t("happenings").where("value", o, 50.0))
simple("filter_range", "select * from orders where o_totalprice >= 100000 and o_totalprice < 200000", lambda t: t("orders").where("o_totalprice", ">=", 100000).where("o_totalprice", "<", 200000))
for _name, _op, _value, _sql in (
    ("in_empty", "IN", [], "false"),
    ("not_in_empty_null", "NOT IN", [], "kind is not null"),
    ("like", "LIKE", "%ck", "kind like '%ck'"),
    ("not_like", "NOT LIKE", "_iew", "kind not like '_iew'"),
    ("ilike", "ILIKE", "VI%", "kind ilike 'VI%'"),
    ("not_ilike", "NOT ILIKE", "VI%", "kind not ilike 'VI%'"),
    ("like_backslash", "NOT LIKE", "v\\%", "kind is not null"),
    ("is_null", "IS", None, "kind is null"),
    ("is_not_null", "IS NOT", None, "kind is not null"),
    ("is_value", "IS", "click", "kind is not distinct from 'click'"),
    ("is_not_value", "IS NOT", "click", "kind is distinct from 'click'"),
    ("eq_null", "=", None, "false"),
    ("type_mismatch_eq", "=", 5, "false"),
    ("type_mismatch_ne", "!=", 5, "kind is not null"),
    ("type_mismatch_gt", ">", 5, "kind is not null"),
):
    simple(f"filter_{_name}", f"select * from {HAPPENINGS} where {_sql}", lambda t, o=_op, v=_value: t("happenings").where("kind", o, v))
simple(
    "filter_and_or",
    "select * from orders where o_orderstatus = 'F' and (o_totalprice > 300000 or o_orderpriority = '1-URGENT')",
    lambda t: t("orders").where("o_orderstatus", "F").where(any_of(compare("o_totalprice", ">", 300000), compare("o_orderpriority", "1-URGENT"))),
)
simple("filter_empty_or", "select * from nation where false", lambda t: t("nation").where(any_of()))
simple("order_multi", "select * from customer order by c_mktsegment desc, c_acctbal, c_custkey limit 50", lambda t: t("customer").order_by("c_mktsegment", "desc").order_by("c_acctbal").limit(50))
TOPK = "select * from orders where o_orderstatus = 'F' and o_totalprice >= 100000 order by o_totalprice desc nulls last, o_orderkey limit 10"
simple("topk", TOPK, lambda t: t("orders").where("o_orderstatus", "F").where("o_totalprice", ">=", 100000).order_by("o_totalprice", "desc").limit(10))
simple("one", "select * from orders order by o_totalprice desc, o_orderkey limit 1", lambda t: t("orders").order_by("o_totalprice", "desc").one())
simple("limit_zero", "select * from nation limit 0", lambda t: t("nation").limit(0))
simple("cursor_inclusive", "select * from customer where c_custkey >= 100", lambda t: t("customer").start({"c_custkey": 100}))
simple("cursor_exclusive", "select * from customer where c_custkey > 100", lambda t: t("customer").start({"c_custkey": 100}, True))
simple(
    "cursor_desc",
    "select * from orders where o_totalprice < 200000.0 or (o_totalprice = 200000.0 and o_orderkey >= 5) order by o_totalprice desc, o_orderkey limit 20",
    lambda t: t("orders").order_by("o_totalprice", "desc").start({"o_totalprice": 200000.0, "o_orderkey": 5}).limit(20),
)
simple(
    "cursor_mixed_null",
    f"select * from {HAPPENINGS} where kind is not null or value < 50.0 or (value = 50.0 and event_id > 100) order by kind nulls first, value desc nulls last, event_id limit 25",
    lambda t: t("happenings").order_by("kind").order_by("value", "desc").start({"kind": None, "value": 50.0, "event_id": 100}, True).limit(25),
)


@plain("reverse", "select * from orders order by o_totalprice desc nulls last, o_orderkey desc limit 15")
def _reverse(spark, c):
    return compile_query(Registry(c).from_("orders").order_by("o_totalprice").limit(15).build(), c, reverse=True)


@plain("lookup", "select * from orders where o_orderkey = 7")
def _lookup(spark, c):
    return c.lookup("orders", (7,))


LARGE = lambda o: o.where("o_totalprice", ">", 450000)
simple("exists", "select * from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)", lambda t: t("customer").where_exists("orders", LARGE))
simple("not_exists", "select * from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)", lambda t: t("customer").where_exists("orders", LARGE, negated=True))
simple(
    "exists_or",
    "select * from customer where c_mktsegment = 'BUILDING' or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)",
    lambda t: t("customer").where(any_of(compare("c_mktsegment", "BUILDING"), t("customer").exists("orders", LARGE))),
)
simple(
    "exists_or_not_exists",
    "select * from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)",
    lambda t: t("customer").where(any_of(t("customer").exists("orders", lambda o: o.where("o_orderstatus", "P"), negated=True), t("customer").exists("orders", LARGE))),
)
simple(
    "exists_nested",
    "select * from customer where exists (select 1 from orders where o_custkey = c_custkey and not exists (select 1 from lineitem where l_orderkey = o_orderkey))",
    lambda t: t("customer").where_exists("orders", lambda o: o.where_exists("lines", negated=True)),
)
simple("exists_compound_key", "select * from customer where exists (select 1 from supplier where s_nationkey = c_nationkey and s_suppkey = c_custkey)", lambda t: t("customer").where_exists("neighbours"))
simple(
    "exists_inner_where",
    "select * from nation where exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9000 and c_mktsegment = 'MACHINERY')",
    lambda t: t("nation").where_exists("customers", lambda x: x.where("c_acctbal", ">", 9000).where("c_mktsegment", "MACHINERY")),
)
simple("exists_limit_zero", "select * from nation where false", lambda t: t("nation").where_exists("customers", lambda x: x.limit(0)))
simple("exists_junction", "select * from supplier where exists (select 1 from lineitem join part on p_partkey = l_partkey where l_suppkey = s_suppkey and p_size > 49)", lambda t: t("supplier").where_exists("parts", lambda p: p.where("p_size", ">", 49)))


def flattened(name: str, sql: str, build, related: str, columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalog(spark, sf_dir)
        return unnested(compile_query(build(Registry(c).from_).build(), c), related).select(*columns.split())

    QUERIES[name], ORACLE[name] = run, sql


flattened(
    "related_flat",
    "select r_regionkey, r_name, row_number() over (partition by r_regionkey order by n_name desc, n_nationkey) as ord, n_nationkey, n_name from region left join nation on n_regionkey = r_regionkey",
    lambda t: t("region").related("nations", lambda n: n.order_by("n_name", "desc")),
    "nations",
    "r_regionkey r_name ord n_nationkey n_name",
)
flattened(
    "related_limit_per_parent",
    "select c_custkey, ord, o_orderkey from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as ord from orders) on o_custkey = c_custkey and ord <= 3",
    lambda t: t("customer").related("orders", lambda o: o.order_by("o_totalprice", "desc").limit(3)),
    "orders",
    "c_custkey ord o_orderkey",
)
flattened(
    "related_where_limit",
    "select c_custkey, c_nationkey, ord, o_orderkey, o_totalprice from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as ord from orders where o_orderstatus = 'F') on o_custkey = c_custkey and ord <= 3 where c_nationkey = 1",
    lambda t: t("customer").where("c_nationkey", 1).related("orders", lambda o: o.where("o_orderstatus", "F").order_by("o_totalprice", "desc").limit(3)),
    "orders",
    "c_custkey c_nationkey ord o_orderkey o_totalprice",
)
flattened(
    "related_empty",
    "select o_orderkey, null::integer as ord, null::bigint as l_partkey from orders",
    lambda t: t("orders").related("lines", lambda x: x.where("l_quantity", "<", 0)),
    "lines",
    "o_orderkey ord l_partkey",
)
flattened(
    "junction_flat",
    "select s_suppkey, row_number() over (partition by s_suppkey order by l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as ord, p_partkey, p_name from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where s_nationkey = 3",
    lambda t: t("supplier").where("s_nationkey", 3).related("parts"),
    "parts",
    "s_suppkey ord p_partkey p_name",
)
flattened(
    "junction_flat_all",
    "select s_suppkey, row_number() over (partition by s_suppkey order by l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as ord, p_partkey, p_name from supplier left join (lineitem join part on p_partkey = l_partkey) on l_suppkey = s_suppkey",
    lambda t: t("supplier").related("parts"),
    "parts",
    "s_suppkey ord p_partkey p_name",
)
flattened(
    "visible_exists_flat",
    "select c_custkey, row_number() over (partition by c_custkey order by o_orderkey) as ord, o_orderkey from customer join orders on o_custkey = c_custkey where o_totalprice > 450000",
    lambda t: t("customer").where_exists("orders", LARGE, visible=True),
    "orders",
    "c_custkey ord o_orderkey",
)


@plain("related_nested_flat", "select r_regionkey, n_nationkey, s_suppkey from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey where s_acctbal > 0")
def _nested(spark, c):
    out = compile_query(Registry(c).from_("region").related("nations", lambda n: n.related("suppliers", lambda s: s.where("s_acctbal", ">", 0))).build(), c)
    out = unnested(out, "nations").drop("ord").where("n_nationkey is not null")
    return unnested(out, "suppliers").where("s_suppkey is not null").select("r_regionkey", "n_nationkey", "s_suppkey")


@plain("related_singular", "select c_custkey, n_name from customer left join nation on n_nationkey = c_nationkey")
def _singular(spark, c):
    return compile_query(Registry(c).from_("customer").related("nation").build(), c).select("c_custkey", "nation.n_name")


@plain("named_query_window", "select * from customer where c_custkey >= 50 and c_custkey < 90 and c_acctbal >= 0")
def _named(spark, c):
    registry = Registry(c)

    @registry.query("window", check=lambda low, high: None if low <= high else (_ for _ in ()).throw(ValueError("empty window")))
    def window(from_, low, high):
        return from_("customer").where("c_custkey", ">=", low).where("c_custkey", "<", high).where("c_acctbal", ">=", 0)

    return compile_query(registry.resolve("window", 50, 90), c)


# Changes for the table of orders, derived from the table itself: every order with o_orderkey % 10 = 1 is
# deleted, = 2 gets another status and keeps the rest, = 3 moves to the key -o_orderkey, = 4 is deleted and
# inserted again, = 5 comes in a transaction without a commit.
def order_events(spark, c) -> DataFrame:
    o = c["orders"].load()
    k = F.col("o_orderkey")
    text = lambda *cols: F.to_json(F.struct(*cols))
    row = lambda *cols: F.array(*(F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), r.alias("row"), old.alias("old_row")) for n, (kind, r, old) in enumerate(cols)))
    none, own = F.lit(None).cast("string"), text(k.alias("o_orderkey"))
    steps = (
        F.when(k % 10 == 1, row(("delete", none, own)))
        .when(k % 10 == 2, row(("update", text(k.alias("o_orderkey"), F.lit("X").alias("o_orderstatus")), none)))
        .when(k % 10 == 3, row(("update", text((-k).alias("o_orderkey")), own)))
        .when(k % 10 == 4, row(("delete", none, own), ("insert", text(k.alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice")), none)))
        .when(k % 10 == 5, row(("delete", none, own)))
    )
    ev = o.where(k % 10 <= 5).select(k.alias("k"), F.explode(steps).alias("s"))
    ev = ev.select((F.when(F.col("k") % 10 == 5, 10**12).otherwise(0) + F.col("k") * 10 + F.col("s.n")).cast("long").alias("pos"), F.col("s.kind").alias("kind"), F.lit("orders").alias("table"), "s.row", "s.old_row")
    commit = spark.createDataFrame([(10**11, "commit")], "pos long, kind string")
    return ev.unionByName(commit, allowMissingColumns=True).withColumns({"tables": F.lit(None).cast("array<string>")})


FOLDED = """select case when o_orderkey % 10 = 3 then -o_orderkey else o_orderkey end as o_orderkey, case when o_orderkey % 10 = 4 then null else o_custkey end as o_custkey,
  case o_orderkey % 10 when 2 then 'X' when 4 then 'N' else o_orderstatus end as o_orderstatus, case when o_orderkey % 10 = 4 then 1.5 else o_totalprice end as o_totalprice,
  case when o_orderkey % 10 = 4 then null else o_orderpriority end as o_orderpriority from orders where o_orderkey % 10 <> 1"""


def folded(spark, c) -> DataFrame:
    base = c["orders"].load().drop("o_orderdate")
    return cdc.fold(base, cdc.complete(order_events(spark, c)), "orders", ("o_orderkey",))


plain("cdc_fold_insert_update_delete", FOLDED)(folded)


@plain("cdc_pk_change", "select -o_orderkey as o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 10 = 3")
def _moved(spark, c):
    return folded(spark, c).where("o_orderkey < 0").select("o_orderkey", "o_custkey", "o_totalprice")


@plain("cdc_truncate", "select o_orderkey, o_orderstatus from (select o_orderkey, 'X' as o_orderstatus from orders where o_orderkey % 10 = 2 and o_orderkey > 1000)")
def _truncated(spark, c):
    ev = order_events(spark, c).where("kind = 'update' and old_row is null or kind = 'commit'")
    cut = spark.createDataFrame([(10_005, "truncate", ["orders"])], "pos long, kind string, tables array<string>")
    ev = ev.drop("tables").unionByName(cut, allowMissingColumns=True)
    base = c["orders"].load().drop("o_orderdate")
    return cdc.fold(base, cdc.complete(ev), "orders", ("o_orderkey",)).select("o_orderkey", "o_orderstatus")


@plain("cdc_evolve", "select r_regionkey::varchar as r_regionkey, r_name as title, null::double as size from region")
def _evolved(spark, c):
    renamed = cdc.evolved(c["region"].load(), [("r_regionkey", "string"), ("title", "string")])  # one goes, one comes: a rename
    return cdc.evolved(renamed, [("r_regionkey", "string"), ("title", "string"), ("size", "double")])


@plain(
    "view_diff_add_remove_edit",
    f"""with n as ({FOLDED}) select case when o.o_orderkey is null then 'add' when n.o_orderkey is null then 'remove' else 'edit' end as op, coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey
  from orders o full join n on n.o_orderkey = o.o_orderkey where o.o_orderkey is null or n.o_orderkey is null or o.o_orderstatus is distinct from n.o_orderstatus or o.o_totalprice is distinct from n.o_totalprice or o.o_custkey is distinct from n.o_custkey""",
)
def _diff(spark, c):
    out = changes(c["orders"].load().drop("o_orderdate"), folded(spark, c), ("o_orderkey",))
    return out.select("op", F.coalesce("new.o_orderkey", "old.o_orderkey").alias("o_orderkey"))


def tree_rows(spark, c) -> dict[str, DataFrame]:
    r = Registry(c)
    one = r.from_("region").related("nations", lambda n: n.where("n_nationkey", "<", 15)).build()
    two = r.from_("nation").where("n_nationkey", ">", 9).build()
    return {"a": patches.flat(compile_query(one, c), one, c), "b": patches.flat(compile_query(two, c), two, c)}


@plain("row_patches", "select 'region' as \"table\", '{\"r_regionkey\":' || r_regionkey || '}' as row_id from region union all select 'nation', '{\"n_nationkey\":' || n_nationkey || '}' from nation where n_nationkey < 15")
def _rows(spark, c):
    return tree_rows(spark, c)["a"].select("table", "row_id")


@plain("refcount_union", "select 'region' as \"table\", '{\"r_regionkey\":' || r_regionkey || '}' as row_id, 1::bigint as refs from region union all select 'nation', '{\"n_nationkey\":' || n_nationkey || '}', (n_nationkey < 15)::bigint + (n_nationkey > 9)::bigint from nation")
def _refs(spark, c):
    return patches.referenced(tree_rows(spark, c)).select("table", "row_id", "refs")


@plain("resume_delta", "select 'del' as op, 'region' as \"table\", '{\"r_regionkey\":' || r_regionkey || '}' as row_id from region union all select case when n_nationkey < 10 then 'del' else 'put' end, 'nation', '{\"n_nationkey\":' || n_nationkey || '}' from nation where n_nationkey < 10 or n_nationkey > 14")
def _resume(spark, c):
    sets = tree_rows(spark, c)
    return patches.patches(sets["a"], sets["b"]).select("op", "table", "row_id")


@plain("overlay_effective_rows", "select n_nationkey, case when n_nationkey = 3 then 'renamed' else n_name end as n_name from nation where n_nationkey <> 4 union all select 99, 'new'")
def _overlay(spark, c):
    ops = [{"op": "update", "table": "nation", "row": {"n_nationkey": 3, "n_name": "renamed"}}, {"op": "delete", "table": "nation", "row": {"n_nationkey": 4}}, {"op": "upsert", "table": "nation", "row": {"n_nationkey": 99, "n_name": "new"}}]
    rows = [(o["pos"], o["kind"], o["table"], o["row"], o["old_row"], None) for o in cdc.from_operations(ops)]
    pending = spark.createDataFrame(rows, "pos long, kind string, table string, row string, old_row string, tables array<string>")
    return cdc.overlaid(c["nation"].load(), pending, "nation", ("n_nationkey",)).select("n_nationkey", "n_name")


# More changes for the table of orders: steps that depend on each other within one batch.
def dependent_events(spark, c, steps, extra: str | None = None) -> DataFrame:
    """Events of every order with o_orderkey % 10 = 1, its steps in turn; steps: (kind, row, old row) of JSON columns."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), (none if row is None else F.to_json(F.struct(*row(k)))).alias("row"), (none if old is None else F.to_json(F.struct(*old(k)))).alias("old_row")) for n, (kind, row, old) in enumerate(steps)))
    ev = c["orders"].load().where(k % 10 == 1).select(k.alias("k"), F.explode(rows).alias("s"))
    ev = ev.select((F.col("k") * 10 + F.col("s.n")).alias("pos"), F.col("s.kind").alias("kind"), F.lit("orders").alias("table"), "s.row", "s.old_row")
    more = [(10**11, "commit", None)] + ([(5, "truncate", ["orders"])] if extra == "truncate" else [])
    return ev.unionByName(spark.createDataFrame(more, "pos long, kind string, tables array<string>"), allowMissingColumns=True)


def key_of(expr):
    return lambda k: [expr(k).alias("o_orderkey")]


def dependent(name: str, sql: str, steps, extra: str | None = None) -> None:
    @plain(name, sql)
    def run(spark, c):
        base = c["orders"].load().select("o_orderkey", "o_custkey", "o_orderstatus")
        return cdc.fold(base, cdc.complete(dependent_events(spark, c, steps, extra)), "orders", ("o_orderkey",))


SAME, MINUS, FAR = (lambda k: k), (lambda k: -k), (lambda k: k + 10**9)
OTHERS = "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 10 <> 1 union all "
dependent(
    "cdc_update_then_move",
    OTHERS + "select -o_orderkey, o_custkey, 'X' from orders where o_orderkey % 10 = 1",
    [("update", lambda k: [k.alias("o_orderkey"), F.lit("X").alias("o_orderstatus")], None), ("update", key_of(MINUS), key_of(SAME))],
)
dependent(
    "cdc_move_chain",
    OTHERS + "select o_orderkey + 1000000000, o_custkey, o_orderstatus from orders where o_orderkey % 10 = 1",
    [("update", key_of(MINUS), key_of(SAME)), ("update", key_of(FAR), key_of(MINUS))],
)
dependent(
    "cdc_insert_then_move",
    "select o_orderkey, o_custkey, o_orderstatus from orders union all select o_orderkey + 1000000000, 5, 'N' from orders where o_orderkey % 10 = 1",
    [("insert", lambda k: [(-k).alias("o_orderkey"), F.lit(5).alias("o_custkey"), F.lit("N").alias("o_orderstatus")], None), ("update", key_of(FAR), lambda k: [(-k).alias("o_orderkey"), F.lit(5).alias("o_custkey"), F.lit("N").alias("o_orderstatus")])],
)
dependent(
    "cdc_truncate_then_move",
    "select -o_orderkey as o_orderkey, null::bigint as o_custkey, 'q' as o_orderstatus from orders where o_orderkey % 10 = 1",
    [("update", lambda k: [(-k).alias("o_orderkey"), F.lit("q").alias("o_orderstatus")], key_of(SAME))],
    "truncate",
)


def row_events(df: DataFrame, table: str, pos, kind: str, row, old=None) -> DataFrame:
    """An event for each row; row and old: columns of their JSON objects."""
    none = F.lit(None).cast("string")
    text = lambda own: none if own is None else F.to_json(F.struct(*own))
    return df.select(pos.cast("long").alias("pos"), F.lit(kind).alias("kind"), F.lit(table).alias("table"), text(row).alias("row"), text(old).alias("old_row"))


def in_one_transaction(spark, *events: DataFrame) -> DataFrame:
    every = spark.createDataFrame([(10**12, 10**12, "commit", None, None, None, None, None, None)], cdc.EVENTS)
    for e in events:
        every = every.unionByName(e, allowMissingColumns=True)
    return every


def live(spark, c, tables, build, name: str = "view") -> Replica:
    """A replica with the given tables and one query."""
    keys = {t: c[t].key for t in tables}
    r = Replica(spark, new_path(spark, "replica"), keys)
    r.load({t: c[t].load() for t in tables}, 0)
    r.subscribe(name, build(Registry(c).from_).build())
    return r


def nation_renamed(spark, c) -> DataFrame:
    k = F.col("n_nationkey")
    return in_one_transaction(spark, row_events(c["nation"].load().where("n_nationkey < 5"), "nation", k + 1, "update", [k.alias("n_nationkey"), F.lit("new").alias("n_name")]))


@plain("view_child_push", "select 'child' as op, c_custkey, case when c_nationkey < 5 then 'new' end as n_name from customer where c_nationkey < 5")
def _child_push(spark, c):
    r = live(spark, c, ["customer", "nation"], lambda f: f("customer").related("nation"))
    return r.apply(nation_renamed(spark, c))["view"].select("op", "new.c_custkey", "new.nation.n_name")


@plain(
    "view_parent_push",
    "select 'edit' as op, c_custkey, (c_nationkey + 1) % 25 as c_nationkey, n_name from customer join nation on n_nationkey = (c_nationkey + 1) % 25 where c_custkey % 7 = 0",
)
def _parent_push(spark, c):
    r = live(spark, c, ["customer", "nation"], lambda f: f("customer").related("nation"))
    k = F.col("c_custkey")
    ev = row_events(c["customer"].load().where("c_custkey % 7 = 0"), "customer", k + 1, "update", [k, ((F.col("c_nationkey") + 1) % 25).alias("c_nationkey")])
    out = r.apply(in_one_transaction(spark, ev))["view"]
    return out.select("op", "new.c_custkey", "new.c_nationkey", "new.nation.n_name")


@plain(
    "view_exists_push",
    f"""with n as ({FOLDED}), old as (select distinct o_custkey from orders where o_totalprice > 400000 and o_custkey is not null), new as (select distinct o_custkey from n where o_totalprice > 400000 and o_custkey is not null)
  select 'remove' as op, o_custkey as c_custkey from old where o_custkey not in (select o_custkey from new) union all select 'add', o_custkey from new where o_custkey not in (select o_custkey from old)""",
)
def _exists_push(spark, c):
    c.add("orders", c["orders"].load().drop("o_orderdate"), "o_orderkey")
    r = live(spark, c, ["customer", "orders"], lambda f: f("customer").where_exists("orders", lambda o: o.where("o_totalprice", ">", 400000)))
    return r.apply(order_events(spark, c))["view"].select("op", F.coalesce("new.c_custkey", "old.c_custkey").alias("c_custkey"))


WINDOW = "(select * from {} order by o_totalprice desc nulls last, o_orderkey limit 50)"


@plain(
    "view_take_push",
    f"""with n as ({FOLDED}), o as {WINDOW.format("orders")}, w as {WINDOW.format("n")}
  select case when o.o_orderkey is null then 'add' when w.o_orderkey is null then 'remove' else 'edit' end as op, coalesce(w.o_orderkey, o.o_orderkey) as o_orderkey from o full join w on w.o_orderkey = o.o_orderkey
  where o.o_orderkey is null or w.o_orderkey is null or o.o_orderstatus is distinct from w.o_orderstatus""",
)
def _take_push(spark, c):
    c["orders"] = Catalog().add("orders", c["orders"].load().drop("o_orderdate"), "o_orderkey")
    r = live(spark, c, ["orders"], lambda f: f("orders").order_by("o_totalprice", "desc").limit(50))
    return r.apply(order_events(spark, c))["view"].select("op", F.coalesce("new.o_orderkey", "old.o_orderkey").alias("o_orderkey"))


@plain("cdc_rename_midstream", "select n_nationkey, case when n_nationkey < 5 then 'old name' when n_nationkey >= 20 then 'new name' else n_name end as title, n_regionkey from nation union all select 99, 'late', null")
def _rename(spark, c):
    """Rows under the old column, the column's new name, the table's new name, rows under both."""
    r = Replica(spark, new_path(spark, "replica"), {"nation": c["nation"].key})
    r.load({"nation": c["nation"].load()}, 0)
    k, rows = F.col("n_nationkey"), c["nation"].load()
    columns = [("n_nationkey", "int"), ("title", "string"), ("n_regionkey", "int")]
    relations = spark.createDataFrame([(1000, 1000, "relation", "nation", None, None, None, columns, None), (2000, 2000, "relation", "country", None, None, None, columns, "nation"), (9000, 9000, "insert", "country", '{"n_nationkey": 99, "title": "late"}', None, None, None, None)], cdc.EVENTS)
    before = row_events(rows.where("n_nationkey < 5"), "nation", k + 1, "update", [k, F.lit("old name").alias("n_name")])
    behind = row_events(rows.where("n_nationkey >= 20"), "country", k + 3000, "update", [k, F.lit("new name").alias("title")])
    r.apply(in_one_transaction(spark, relations, before, behind))
    return r.table("country")


def two_queries(spark, c) -> Replica:
    r = live(spark, c, ["nation", "region"], lambda f: f("region").related("nations", lambda n: n.where("n_nationkey", "<", 15)), "a")
    r.subscribe("b", Registry(c).from_("nation").where("n_nationkey", ">", 9).build())
    return r


@plain("query_retraction", "select 'del' as op, 'nation' as \"table\", '{\"n_nationkey\":' || n_nationkey || '}' as row_id from nation where n_nationkey >= 15")
def _retraction(spark, c):
    return two_queries(spark, c).unsubscribe("b").select("op", "table", "row_id")


@plain("cvr_resume", "select 'put' as op, 'nation' as \"table\", '{\"n_nationkey\":' || n_nationkey || '}' as row_id from nation where n_nationkey < 5 union all select 'del', 'nation', '{\"n_nationkey\":' || n_nationkey || '}' from nation where n_nationkey >= 15")
def _resume_client(spark, c):
    """A client takes both queries, and later, from a replica opened anew, one: changed rows and those it loses."""
    r = two_queries(spark, c)
    _, cookie = r.sync("client", ["a", "b"])
    r.apply(nation_renamed(spark, c))
    again = Replica(spark, r.folder)
    return again.sync("client", ["a"], cookie)[0].select("op", "table", "row_id")


@plain("lmid_table", "select user_id::varchar as client_id, max(event_id) as last_mutation_id from events group by 1")
def _lmid(spark, c):
    """Acknowledgements of mutations as an ordinary table: each event acknowledges its user's mutation."""
    ev = row_events(c["events"].load(), cdc.MUTATIONS, F.col("event_id"), "insert", [F.col("user_id").cast("string").alias("client_id"), F.col("event_id").alias("last_mutation_id")])
    base = spark.createDataFrame([], cdc.MUTATIONS_SCHEMA)
    return cdc.fold(base, cdc.complete(in_one_transaction(spark, ev)), cdc.MUTATIONS, cdc.MUTATIONS_KEY)


@plain("decode_timestamps", "select o_orderkey, epoch_ms(o_orderdate)::double as at, epoch_ms(date_trunc('day', o_orderdate)::timestamp)::double as day, epoch_ms(o_orderdate)::double - 7200000 as zoned from orders")
def _timestamps(spark, c):
    at = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    o = c["orders"].load().select("o_orderkey", at.alias("t"))
    return o.select("o_orderkey", decoding.decoded(F.col("t"), "timestamp").alias("at"), decoding.decoded(F.substring("t", 1, 10), "date").alias("day"), decoding.decoded(F.concat("t", F.lit("+02")), "timestamptz").alias("zoned"))


@plain("decode_arrays", "select n_nationkey, '[' || n_nationkey || ',null,' || n_regionkey || ']' as numbers, '[\"' || n_name || '\",\"a,b\",null]' as words from nation")
def _arrays(spark, c):
    n = c["nation"].load()
    numbers, words = F.format_string("{%s,NULL,%s}", "n_nationkey", "n_regionkey"), F.concat(F.lit("{"), "n_name", F.lit(',"a,b",NULL}'))
    return n.select("n_nationkey", decoding.decoded(numbers, "int4[]").alias("numbers"), decoding.decoded(words, "text[]").alias("words"))


@plain("changelog_gap_reset", "select 'read' as state, count(*) as events from events where event_id > (select min(event_id) + 9 from events) union all select 'reset', 0")
def _changelog(spark, c):
    """A log of all events in two segments: a reader within it reads on, one behind what was pruned starts over."""
    first = c["events"].load().agg(F.min("event_id")).first()[0]
    ev = row_events(c["events"].load(), "events", F.col("event_id"), "insert", [F.col("event_id")])
    log = ChangeLog(spark, new_path(spark, "log"))
    log.append(cdc.shaped(ev.where(F.col("pos") < first + 10)))
    log.append(cdc.shaped(ev))
    log.prune_before(first + 10)
    try:
        state = f"{log.read_after(first).count()} read"
    except Reset:
        state = "reset"
    read = log.read_after(first + 9).groupBy().count().select(F.lit("read").alias("state"), F.col("count").alias("events"))
    return read.union(spark.createDataFrame([(state, 0)], "state string, events long"))


@plain("client_patches", "select 'nation' as \"table\", '{\"n_nationkey\":' || n_nationkey || '}' as row_id, '{\"n_name\":\"' || case when n_nationkey < 5 then 'new' else n_name end || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' as row from nation where n_nationkey < 20")
def _applied(spark, c):
    """Rows that a client holds after puts, updates of one column and deletes."""
    q = ast.query({"table": "nation"})
    rows = patches.flat(compile_query(q, c), q, c)
    n = F.get_json_object("row_id", "$.n_nationkey").cast("int")
    put = rows.select(F.lit(1).cast("long").alias("n"), F.lit("put").alias("op"), "table", "row_id", "row")
    update = rows.where(n < 5).select(F.lit(2).cast("long"), F.lit("update"), "table", "row_id", F.lit('{"n_name":"new"}'))
    gone = rows.where(n >= 20).select(F.lit(3).cast("long"), F.lit("del"), "table", "row_id", F.lit(None).cast("string"))
    return patches.applied(rows.select("table", "row_id", "row").limit(0), put.union(update).union(gone))
