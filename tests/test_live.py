"""Replicas over many batches: what is kept current, handed over, resumed and ended."""

import json
import random

import pytest

from tests.test_streaming import TREE, events, rows
from tidemark.operators.compile import compile_query
from tidemark.plans import ast
from tidemark.plans.builder import Registry, any_of, compare, hop
from tidemark.sources.catalog import Catalog
from tidemark.streaming import cdc, generations, patches
from tidemark.streaming.changelog import ChangeLog, Reset, catch_up
from tidemark.streaming.manager import QueryManager, name_of, seconds
from tidemark.streaming.views import Replica

KEYS = {"issue": "id", "comment": "id"}


def replica(spark, folder, **more):
    r = Replica(spark, f"file://{folder}", KEYS, **more)
    issues = spark.createDataFrame([(str(k), f"t{k}", k % 3) for k in range(6)], "id string, title string, prio long")
    comments = spark.createDataFrame([(f"c{k}", str(k % 4), f"b{k}") for k in range(8)], "id string, issueId string, body string")
    r.load({"issue": issues, "comment": comments}, 0)
    return r


def batch(spark, first, *ops):
    return events(spark, *((first + n, *o) for n, o in enumerate(ops)), (first + len(ops), "commit"))


def catalog_of(r):
    c = r.catalog()
    c["issue"].relate("comments", hop("id", "comment", "issueId"))
    c["comment"].relate("issue", hop("issueId", "issue", "id", one=True))
    return c


def test_queries_stay_as_if_computed_anew(spark, tmp_path, monkeypatch):
    """Random batches: narrowed recomputation, its generations and their merging against the whole query."""
    monkeypatch.setattr(generations, "MOST", 2)
    r = replica(spark, tmp_path / "r")
    f = Registry(catalog_of(r)).from_
    trees = {
        "tree": f("issue").related("comments", lambda c: c.order_by("body", "desc").limit(2)).build(),
        "deep": f("comment").related("issue", lambda i: i.related("comments")).build(),
        "some": f("issue").where(any_of(compare("prio", 2), f("issue").exists("comments", lambda c: c.where("body", ">", "b4")))).build(),
        "none": f("issue").where_exists("comments", negated=True).build(),
        "top": f("issue").order_by("title", "desc").limit(3).build(),
    }
    for name, q in trees.items():
        r.subscribe(name, q)
    draw, first = random.Random(3), 1
    for _ in range(3):
        ops = []
        for _ in range(draw.choice([1, 2, 5])):
            if draw.random() < 0.5:
                k = str(draw.randrange(8))
                ops.append(draw.choice([("insert", "issue", {"id": k, "title": f"n{draw.randrange(9)}"}), ("delete", "issue", None, {"id": k}), ("update", "issue", {"id": k, "prio": draw.randrange(4)}), ("update", "issue", {"id": str(draw.randrange(8))}, {"id": k})]))
            else:
                k = f"c{draw.randrange(10)}"
                ops.append(draw.choice([("insert", "comment", {"id": k, "issueId": str(draw.randrange(6)), "body": f"b{draw.randrange(9)}"}), ("delete", "comment", None, {"id": k}), ("update", "comment", {"id": k, "issueId": draw.choice([None, "1", "5"])})]))
        old = {n: {x["id"]: x for x in r.view(n).collect()} for n in trees}
        out = r.apply(batch(spark, first, *ops))
        first += 50
        for name, q in trees.items():
            now = compile_query(q, r.catalog()).collect()
            assert sorted(map(repr, r.view(name).collect())) == sorted(map(repr, now)), (name, ops)
            if name in out:
                held = dict(old[name])
                for x in out[name].collect():
                    held.pop((x.new or x.old)["id"], None)
                    if x.op != "remove":
                        held[x.new["id"]] = x.new
                assert sorted(map(repr, held.values())) == sorted(map(repr, now))
            else:
                assert sorted(map(repr, old[name].values())) == sorted(map(repr, now))
    assert [x.id for x in r.snapshot("top").collect()] == [x.id for x in compile_query(trees["top"], r.catalog()).collect()]


def test_untouched_queries_are_left_alone(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.subscribe("issues", ast.query({"table": "issue"}))
    before = r.state["views"]
    assert r.apply(batch(spark, 1, ("insert", "comment", {"id": "z"}))) == {}
    assert r.apply(batch(spark, 9, ("update", "issue", {"id": "1", "title": "t1"}))) == {}  # nothing differs
    assert r.state["views"] == before and r.state["pos"] == 10


def test_a_failing_sink_gets_the_changes_again(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.subscribe("all", ast.query({"table": "issue"}))
    got, fail = [], [True]

    def sink(name, df, number):
        if fail:
            fail.clear()
            raise RuntimeError("not now")
        got.append((number, rows(df.select("op", "new.id"))))

    batch(spark, 1, ("insert", "issue", {"id": "9"})).write.parquet(f"{tmp_path}/in/1")
    stream = lambda: spark.readStream.schema(cdc.EVENTS).parquet(f"{tmp_path}/in/*")
    with pytest.raises(Exception, match="not now"):
        r.follow(stream(), f"{tmp_path}/cp", sink).awaitTermination()
    again = Replica(spark, f"file://{tmp_path}/r")
    again.follow(stream(), f"{tmp_path}/cp", sink).awaitTermination()
    assert got == [(0, [("add", "9")])] and not again.state["pending"]
    assert rows(again.table("issue").where("id = '9'").select("id")) == [("9",)]


def test_subscriptions_outlast_a_restart(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.subscribe("all", ast.query(TREE))
    again = Replica(spark, f"file://{tmp_path}/r")
    assert again.queries == {"all": ast.query(TREE)}
    out = again.apply(batch(spark, 1, ("update", "comment", {"id": "c1", "body": "new"})))
    assert [(x.op, x.new.id) for x in out["all"].collect()] == [("child", "1")]


def columns(*names):
    return [(n, "long" if n == "prio" else "string") for n in names]


def test_columns_change_within_a_batch(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.subscribe("all", ast.query({"table": "issue"}))
    ev = events(
        spark,
        (1, "insert", "issue", {"id": "8", "title": "before"}),
        dict(pos=2, kind="relation", table="issue", columns=columns("id", "name", "prio")),
        (3, "update", "issue", {"id": "1", "name": "behind"}),
        dict(pos=4, kind="relation", table="issue", columns=columns("id", "name", "prio", "fresh")),
        (5, "update", "issue", {"id": "2", "fresh": "f"}),
        (6, "commit"),
    )
    out = r.apply(ev)["all"].collect()
    now = {x.id: x for x in r.table("issue").collect()}
    assert now["8"].name == "before" and now["1"].name == "behind" and now["2"].fresh == "f" and now["3"].name == "t3"
    assert {(x.op, (x.new or x.old).id) for x in out} == {("add", "8")}  # what both results have differs nowhere else
    assert r.view("all").columns == ["id", "name", "prio", "fresh"]
    out = r.apply(batch(spark, 10, ("delete", "issue", None, {"id": "1"})))["all"].collect()
    assert [(x.op, x.old.name) for x in out] == [("remove", "behind")]


def test_a_table_changes_its_name(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.subscribe("all", ast.query({"table": "issue"}))
    one = spark.createDataFrame([(1, 1, "relation", "ticket", None, None, None, None, "issue"), (2, 2, "insert", "ticket", '{"id": "9"}', None, None, None, None), (3, 3, "commit", None, None, None, None, None, None)], cdc.EVENTS)
    assert rows(r.apply(one)["all"].select("op", "new.id")) == [("add", "9")]
    again = Replica(spark, f"file://{tmp_path}/r")
    again.apply(batch(spark, 4, ("delete", "ticket", None, {"id": "9"}), ("update", "ticket", {"id": "1", "title": "x"})))
    assert rows(again.table("ticket").where("id in ('1', '9')").select("id", "title")) == [("1", "x")]
    again.apply(events(spark, dict(pos=20, kind="truncate", tables=["ticket"]), (21, "commit")))
    assert again.view("all").isEmpty()


def test_limits(spark, tmp_path):
    r = replica(spark, tmp_path / "r", max_rows=6, max_queries=1)
    with pytest.raises(ValueError, match="more than 6 rows"):
        r.subscribe("comments", ast.query({"table": "comment"}))
    r.subscribe("issues", ast.query({"table": "issue"}))
    with pytest.raises(ValueError, match="more than 1 queries"):
        r.subscribe("more", ast.query({"table": "issue", "limit": 1}))
    assert r.apply(batch(spark, 1, ("insert", "issue", {"id": "77"}))) == {} and r.queries == {}


def test_clients(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.subscribe("few", ast.query({"table": "issue", "where": {"type": "simple", "op": "<", "left": {"type": "column", "name": "id"}, "right": {"type": "literal", "value": "3"}}}))
    r.subscribe("tree", ast.query(TREE))
    first, cookie = r.sync("one", ["few", "tree"], now=100.0)
    ops = [(x.op, x.table) for x in first.collect()]
    assert ops.count(("clear", None)) == 1 and ops.count(("put", "issue")) == 6 and ops.count(("put", "comment")) == 8
    r.apply(batch(spark, 1, ("update", "issue", {"id": "1", "title": "x"}), ("delete", "comment", None, {"id": "c0"})))
    again = Replica(spark, f"file://{tmp_path}/r")
    more, newer = again.sync("one", ["few", "tree"], cookie, now=200.0)
    assert sorted((x.op, x.row_id) for x in more.collect()) == [("del", '{"id":"c0"}'), ("put", '{"id":"1"}')]
    gone, _ = again.sync("one", ["few"], newer, now=200.0)
    assert {x.op for x in gone.collect()} == {"del"} and gone.count() == 3 + 7
    stale, _ = again.sync("one", ["few"], cookie, now=200.0)  # an old cookie: the client starts over
    assert sorted({x.op for x in stale.collect()}) == ["clear", "put"] and stale.count() == 4
    again.sync("two", ["few"], now=500.0)
    assert again.forget_clients(300.0) == ["one"] and list(Replica(spark, f"file://{tmp_path}/r").state["clients"]) == ["two"]
    assert {x.row_id for x in again.unsubscribe("few").collect()} == set()  # the tree holds them all
    assert again.unsubscribe("tree").count() == 6 + 7


def test_patches_are_applied_in_order(spark):
    held = spark.createDataFrame([("t", "1", '{"a":1,"b":"x"}'), ("t", "2", '{"a":2}')], "table string, row_id string, row string")
    shape = "n long, op string, table string, row_id string, row string"
    steps = [(1, "update", "t", "1", '{"b":null}'), (2, "del", "t", "2", None), (3, "update", "t", "2", '{"a":5}'), (4, "put", "t", "3", '{"a":[1,{"z":2}]}'), (5, "update", "t", "3", '{"c":1.5}')]
    now = {x.row_id: json.loads(x.row) for x in patches.applied(held, spark.createDataFrame(steps, shape)).collect()}
    assert now == {"1": {"a": 1, "b": None}, "3": {"a": [1, {"z": 2}], "c": 1.5}}
    cleared = spark.createDataFrame([*steps, (6, "clear", None, None, None), (7, "put", "t", "9", '{"a":0}')], shape)
    assert {x.row_id for x in patches.applied(held, cleared).collect()} == {"9"}


def test_query_manager(spark, tmp_path):
    assert [seconds(x) for x in ("30s", "5m", "1h", "none", "forever", 12, -1, "odd")] == [30, 300, 600, 0, float("inf"), 12, 0, 300]
    r, now = replica(spark, tmp_path / "r"), [0.0]
    m = QueryManager(r, clock=lambda: now[0])
    q = ast.query({"table": "issue"})
    name, release = m.add(q, "1m")
    assert m.add(ast.query({"table": "issue"}))[0] == name == name_of(q) and list(r.queries) == [name]
    release()
    release()
    assert m.wanted[name].count == 1
    m.wanted[name].count -= 1
    m.wanted[name].since = 0.0
    now[0] = 299.0
    assert m.collect() == [] and name in r.queries  # the longer time to live counts
    now[0] = 300.0
    assert m.collect() == [name] and r.queries == {}
    _, release = m.add(q, "none")
    release()
    assert r.queries == {} and m.active() == {}


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    assert log.head == -1 and log.read_after(-1).isEmpty()
    every = [(n, "insert", "issue", {"id": f"i{n}"}) if n % 3 else (n, "commit") for n in range(1, 13)]
    assert log.append(events(spark, *every[:6])) == 6
    assert log.append(events(spark, *every[3:12])) == 12  # sent again in part
    assert log.append(events(spark, *every[:2])) == 12
    with pytest.raises(ValueError, match="hole"):
        log.append(events(spark, (14, "commit")))
    assert [x.pos for x in log.read_after(5).orderBy("pos").collect()] == list(range(6, 13))
    r = replica(spark, tmp_path / "r")
    r.subscribe("all", ast.query({"table": "issue"}))
    assert catch_up(r, log)["all"].count() == 8 and r.state["pos"] == 12
    assert catch_up(r, log) == {}
    log.prune_before(8)
    assert log.read_after(6).count() == 6
    for pos in (2, 99):
        with pytest.raises(Reset):
            log.read_after(pos)
    late = replica(spark, tmp_path / "late")
    late.subscribe("all", ast.query({"table": "issue"}))
    snapshot = lambda: ({n: r.table(n) for n in KEYS}, 9)
    assert catch_up(late, log, snapshot) == {} and late.state["pos"] == 12
    assert rows(late.view("all")) == rows(r.view("all"))


def test_acknowledgements_never_go_back(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.keys[cdc.MUTATIONS] = cdc.MUTATIONS_KEY
    r.load({cdc.MUTATIONS: spark.createDataFrame([], cdc.MUTATIONS_SCHEMA)})
    write = lambda k, text: {"op": "update", "table": "issue", "row": {"id": str(k), "title": text}}
    sent = [{"client": "a", "id": 1, "operations": [write(1, "one")]}, {"client": "a", "id": 2, "operations": [write(1, "two")]}, {"client": "b", "id": 7, "operations": [write(2, "b")]}]

    def apply(mutations):
        own = cdc.from_mutations(mutations, r.last_mutations(), r.state["pos"] + 1)
        r.apply(spark.createDataFrame([(e["pos"], e["pos"], e["kind"], e["table"], e["row"], e["old_row"], None, None, None) for e in own], cdc.EVENTS))
        return len(own)

    assert apply(sent) == 12 and r.last_mutations() == {"a": 2, "b": 7}
    assert apply([sent[0]]) == 0  # sent again, late
    assert r.last_mutations() == {"a": 2, "b": 7} and rows(r.table("issue").where("id = '1'").select("title")) == [("two",)]


def test_related_children_are_narrowed_to_their_parents(spark):
    c = Catalog()
    c.add("p", spark.range(100).selectExpr("id", "id % 10 as g"), "id").relate("kids", hop("id", "k", "p"))
    c.add("k", spark.range(1000).selectExpr("id", "id % 100 as p"), "id")
    f = Registry(c).from_
    joins = lambda q: compile_query(q, c)._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi")
    assert joins(f("p").where("g", 3).related("kids", lambda k: k.limit(2)).build()) == 1
    assert joins(f("p").related("kids", lambda k: k.limit(2)).build()) == 0


def test_snapshots(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    r.apply(batch(spark, 1, ("insert", "issue", {"id": "9", "title": "late"})))
    r.export(f"file://{tmp_path}/shot")
    ev = batch(spark, 5, ("delete", "issue", None, {"id": "0"}))
    r.apply(ev)
    own = Replica.restored(spark, f"file://{tmp_path}/own", f"file://{tmp_path}/shot")
    assert own.state["pos"] == 2 and own.keys["issue"] == ("id",)
    own.apply(ev)
    assert rows(own.table("issue")) == rows(r.table("issue")) and rows(own.table("comment")) == rows(r.table("comment"))


def test_steps_of_a_client(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    m = QueryManager(r, clock=lambda: 0.0)
    put = lambda h, **q: {"op": "put", "hash": h, "query": {"table": "issue"} | q, "ttl": "none"}
    m.patch([put("a"), put("b", limit=1), put("a")])
    assert len(r.queries) == 2 and sum(w.count for w in m.wanted.values()) == 2
    m.patch([{"op": "del", "hash": "a"}, {"op": "del", "hash": "zz"}])
    assert [q.limit for q in r.queries.values()] == [1]
    m.patch([{"op": "clear"}])
    assert r.queries == {}


def test_named_mutations_and_context(spark, tmp_path):
    r = replica(spark, tmp_path / "r")
    reg = Registry(r.catalog())

    @reg.query("mine")
    def mine(from_, least, ctx):
        return from_("issue").where("prio", ">=", least).where("id", ctx["user"])

    @reg.mutator("rename", check=lambda i, title: None if title else (_ for _ in ()).throw(ValueError("no title")))
    def rename(i, title, ctx):
        return [{"op": "update", "table": "issue", "row": {"id": i, "title": f"{title} by {ctx}"}}]

    reg.mutator("wrong")(lambda: [{"op": "update", "table": "issue", "row": {"title": "x"}}])
    assert [x.id for x in compile_query(reg.resolve("mine", 1, ctx={"user": "4"}), r.catalog()).collect()] == ["4"]
    ops = reg.mutate("rename", "4", "new", ctx="me")
    own = cdc.from_mutations([{"client": "c", "id": 1, "operations": ops}], {}, 1)
    r.apply(spark.createDataFrame([(e["pos"], e["pos"], e["kind"], e["table"], e["row"], e["old_row"], None, None, None) for e in own], cdc.EVENTS))
    assert rows(r.table("issue").where("id = '4'").select("title")) == [("new by me",)]
    for bad in (lambda: reg.mutate("rename", "4", ""), lambda: reg.mutate("wrong"), lambda: reg.mutate("none")):
        with pytest.raises(ValueError):
            bad()


def test_indexed_files_are_skipped(spark, tmp_path):
    from tidemark.sources.layout import write_indexed

    import pyarrow.parquet as pq

    write_indexed(spark.range(1000).selectExpr("id", "id % 7 as g"), f"{tmp_path}/t", ("id",), 4)
    spans = sorted((s.min, s.max) for p in tmp_path.glob("t/*.parquet") for s in [pq.ParquetFile(p).metadata.row_group(0).column(0).statistics])
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert spark.read.parquet(f"{tmp_path}/t").where("id = 500").count() == 1
