import json

import pytest

from tidemark.plans import ast
from tidemark.sources.catalog import Catalog
from tidemark.streaming import cdc, patches
from tidemark.streaming.views import Replica, changes


def event(pos, kind, table=None, row=None, old=None, tables=None, columns=None):
    return (pos, pos, kind, table, row and json.dumps(row), old and json.dumps(old), tables, columns, None)


def events(spark, *rows):
    return spark.createDataFrame([event(*r) if isinstance(r, tuple) else event(**r) for r in rows], cdc.EVENTS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fold(spark):
    base = spark.createDataFrame([("a", "big", 1), ("b", None, 2), (None, "n", 3), ("m", "stay", 4)], "id string, big string, n long")
    ev = events(
        spark,
        (1, "insert", "t", {"id": "c", "big": "x", "n": 9}),
        (2, "update", "t", {"id": "a", "n": 5}),  # big is left out: unchanged
        (3, "update", "t", {"id": "b", "big": None, "n": 7}),
        (4, "delete", "t", None, {"id": None}),
        (5, "delete", "t", None, {"id": "zz"}),
        (6, "update", "t", {"id": "m2", "n": 8}, {"id": "m"}),  # the key moves, big goes along
        (7, "update", "t", {"id": "new", "n": 1}),
        (8, "delete", "t", None, {"id": "c"}),
        (9, "insert", "t", {"id": "c", "n": 2}),
        (10, "insert", "other", {"id": "q"}),
    )
    assert rows(cdc.fold(base, ev, "t", ("id",))) == sorted([("a", "big", 5), ("b", None, 7), ("m2", "stay", 8), ("new", None, 1), ("c", None, 2)], key=repr)
    ev = ev.union(events(spark, dict(pos=20, kind="truncate", tables=["t"]), (21, "insert", "t", {"id": "z", "n": 0})))
    assert rows(cdc.fold(base, ev, "t", ("id",))) == [("z", None, 0)]


def test_unfinished_and_repeated(spark):
    ev = events(spark, (1, "insert", "t", {"id": "a"}), (2, "commit"), (2, "commit"), (3, "insert", "t", {"id": "b"}))
    assert [r.pos for r in cdc.complete(ev).orderBy("pos").collect()] == [1, 2]
    assert cdc.complete(ev, 2).isEmpty()


def test_evolved(spark):
    df = spark.createDataFrame([("1", True, "x")], "n string, f boolean, old string")
    assert rows(cdc.evolved(df, [("n", "double"), ("f", "string"), ("fresh", "string")])) == [(1.0, "true", "x")]
    assert rows(cdc.evolved(df, [("n", "boolean"), ("f", "double")])) == [(True, 1.0)]
    assert rows(cdc.evolved(df, [("n", "string"), ("f", "boolean"), ("fresh", "string")], rename=False)) == [("1", True, None)]


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    ops = cdc.from_operations([{"op": "update", "table": "t", "row": {"id": "a", "n": 5}}, {"op": "delete", "table": "t", "row": {"id": "b"}}, {"op": "upsert", "table": "t", "row": {"id": "c", "n": 3}}], 1)
    pending = spark.createDataFrame([event(o["pos"], o["kind"], "t", o["row"] and json.loads(o["row"]), o["old_row"] and json.loads(o["old_row"])) for o in ops], cdc.EVENTS)
    assert rows(cdc.overlaid(base, pending, "t", ("id",))) == [("a", 5), ("c", 3)]
    assert rows(cdc.overlaid(base, pending, "t", ("id",), 2)) == [("a", 1), ("b", 2), ("c", 3)]


TREE = {"table": "issue", "orderBy": [["title", "asc"]], "related": [{"correlation": {"parentField": ["id"], "childField": ["issueId"]}, "subquery": {"table": "comment", "alias": "comments"}}]}


def test_live_queries(spark, tmp_path):
    r = Replica(spark, f"file://{tmp_path}/r", {"issue": "id", "comment": "id"})
    r.load({"issue": spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string"), "comment": spark.createDataFrame([("c1", "1", "x")], "id string, issueId string, body string")}, 0)
    r.subscribe("all", ast.query(TREE))
    ev = events(spark, (1, "insert", "issue", {"id": "3", "title": "c"}), (2, "update", "comment", {"id": "c1", "issueId": "2"}), (3, "update", "issue", {"id": "1", "title": "z"}), (4, "commit"), (5, "delete", "issue", None, {"id": "2"}))
    ev.write.parquet(f"{tmp_path}/in/1")
    got = {}
    sink = lambda name, df, n: got.setdefault(name, []).append(sorted((x.op, (x.new or x.old)["id"]) for x in df.collect()))
    stream = lambda: spark.readStream.schema(cdc.EVENTS).parquet(f"{tmp_path}/in/*")
    r.follow(stream(), f"{tmp_path}/cp", sink).awaitTermination()
    assert got == {"all": [[("add", "3"), ("child", "2"), ("edit", "1")]]}
    events(spark, (6, "commit")).write.parquet(f"{tmp_path}/in/2")
    again = Replica(spark, f"file://{tmp_path}/r", {"issue": "id", "comment": "id"})
    again.queries["all"] = ast.query(TREE)
    again.follow(stream(), f"{tmp_path}/cp", sink).awaitTermination()
    assert got["all"][1:] == [[("remove", "2")]]
    from tidemark.operators.compile import compile_query

    assert rows(again.view("all")) == rows(compile_query(ast.query(TREE), again.catalog()))
    assert again.apply(ev) == {}


def test_patches(spark):
    c = Catalog()
    c.add("issue", spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string"), "id")
    c.add("comment", spark.createDataFrame([("c1", "1", None)], "id string, issueId string, body string"), "id")
    from tidemark.operators.compile import compile_query

    q = ast.query(TREE)
    one = patches.flat(compile_query(q, c), q, c)
    assert {(r.table, r.row_id) for r in one.collect()} == {("issue", '{"id":"1"}'), ("issue", '{"id":"2"}'), ("comment", '{"id":"c1"}')}
    only = ast.query({"table": "issue", "where": {"type": "simple", "op": "=", "left": {"type": "column", "name": "id"}, "right": {"type": "literal", "value": "1"}}})
    two = patches.flat(compile_query(only, c), only, c)
    refs = patches.referenced({"a": one, "b": two})
    assert {(r.row_id, r.refs) for r in refs.collect()} == {('{"id":"1"}', 2), ('{"id":"2"}', 1), ('{"id":"c1"}', 1)}
    assert rows(patches.patches(refs, two).select("op", "row_id")) == [("del", '{"id":"2"}'), ("del", '{"id":"c1"}')]
    stale = refs.withColumn("fingerprint", patches.F.lit("old"))
    assert {r.op for r in patches.patches(stale, refs).collect()} == {"put"}


def test_changes_match_null_keys(spark):
    old = spark.createDataFrame([(None, 1), ("a", 2)], "id string, n long")
    new = spark.createDataFrame([(None, 3), ("b", 2)], "id string, n long")
    assert sorted(r.op for r in changes(old, new, ("id",)).collect()) == ["add", "edit", "remove"]


@pytest.mark.parametrize("bad", [{"table": "t", "limit": -1}, {"table": "t", "where": {"type": "not"}}])
def test_bad_trees(bad):
    with pytest.raises(ast.QueryError):
        ast.query(bad)


def plainly(state, ops):
    """The rows of `state` (by id) after events, one after the other."""
    state = {k: dict(v) for k, v in state.items()}
    for o in ops:
        if o[1] == "truncate":
            state = {}
        elif o[1] == "delete":
            state.pop(o[4]["id"], None)
        else:
            new, old = o[3], o[4]
            if old and old["id"] != new["id"] and old["id"] in state:
                state[new["id"]] = state.pop(old["id"])
            state[new["id"]] = {"b": None, "n": None} | state.get(new["id"], {}) | new
    return sorted(((k, v["b"], v["n"]) for k, v in state.items()), key=repr)


def test_moved_rows_keep_what_the_batch_wrote(spark):
    import random

    draw = random.Random(4)
    base = {k: {"id": k, "b": f"b{k}", "n": n} for n, k in enumerate("abcd")}
    stored = spark.createDataFrame([(v["id"], v["b"], v["n"]) for v in base.values()], "id string, b string, n long")
    up, ins = "update", "insert"
    batches = [
        [(1, up, "t", {"id": "a", "n": 9}, None), (2, up, "t", {"id": "x"}, {"id": "a"})],
        [(1, ins, "t", {"id": "k", "b": "new", "n": 1}, None), (2, up, "t", {"id": "x", "n": 2}, {"id": "k"}), (3, "delete", "t", None, {"id": "k"})],
        [(n, up, "t", {"id": f"k{n}"} | ({"n": 70} if n == 3 else {}), {"id": f"k{n - 1}" if n > 1 else "a"}) for n in range(1, 12)],
        [(1, "truncate", None, None, None), (2, ins, "t", {"id": "a"}, None), (3, up, "t", {"id": "x"}, {"id": "a"})],
        [(1, up, "t", {"id": "x"}, {"id": "a"}), (2, up, "t", {"id": "a"}, {"id": "b"}), (3, up, "t", {"id": "b"}, {"id": "x"})],  # two keys swapped
    ]
    for _ in range(4):
        keys = "abcdefg"
        row = lambda: {"id": draw.choice(keys)} | {c: v for c, v in (("b", f"v{draw.random()}"), ("n", draw.randrange(99))) if draw.random() < 0.4}
        one = lambda n: draw.choice([(n, up, "t", row(), {"id": draw.choice(keys)})] * 6 + [(n, up, "t", row(), None), (n, ins, "t", row(), None), (n, "delete", "t", None, {"id": draw.choice(keys)})])
        batches.append([one(n) for n in range(1, 40)])
    for ops in batches:
        ev = events(spark, *(dict(pos=o[0], kind="truncate", tables=["t"]) if o[1] == "truncate" else o for o in ops))
        assert rows(cdc.fold(stored, ev, "t", ("id",))) == plainly(base, ops)
