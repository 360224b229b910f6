"""Live results: a versioned replica, registered queries, and what each batch changes in them.

A batch is applied in full or not at all: what it changes in tables and results is written beside what
is there, and a manifest, written last, makes it current together with the queries, the position and the
changes that are still to be handed over. A batch that is run again finds its position in the manifest
and does nothing but hand those over.

Tables and results are a base and small generations (see `generations`), so a batch writes in proportion
to what it changes. A query is recomputed for the rows only that changed rows can reach; one with a
cursor or limit of its own, or over a table whose columns changed or that was emptied, in full.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.compile import Compiler, bounded, compile_query, matching
from tidemark.plans import ast
from tidemark.plans.ast import Query
from tidemark.sources.catalog import Catalog
from tidemark.streaming import cdc, generations, patches


def changes(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(op, old, new) between two results: add, remove, edit, or child where only related rows differ.

    Columns that only one of the results has make no difference by themselves.
    """
    both_have = [f.name for f in new.schema.fields if f.name in old.columns and old.schema[f.name].dataType == f.dataType]
    nested = [c for c in both_have if isinstance(new.schema[c].dataType, T.ArrayType | T.StructType)]
    plain = [c for c in both_have if c not in nested]
    on = F.expr(" and ".join(f"o.old.`{k}` <=> n.new.`{k}`" for k in key))
    both = old.select(F.struct(*old.columns).alias("old")).alias("o").join(new.select(F.struct(*new.columns).alias("new")).alias("n"), on, "full_outer")
    differ = lambda own: F.lit(False) if not own else ~F.struct(*(F.col(f"old.{c}") for c in own)).eqNullSafe(F.struct(*(F.col(f"new.{c}") for c in own)))
    retyped = [c for c in new.columns if c in old.columns and c not in both_have]
    edited = differ(plain) | (F.lit(True) if retyped else F.lit(False))
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(edited, "edit").when(differ(nested), "child")
    return both.select(op.alias("op"), "old", "new").where("op is not null")


class Replica:
    """Tables and results under one folder, which executors share.

    State, in the manifest: tables and views (name -> base and generations), queries, names that tables
    were given later, the position, changes not handed over yet, events of unfinished transactions, clients.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]] | None = None, max_rows: int | None = None, max_queries: int = 200):
        """max_rows: of a query's result; a subscription of more is refused, one that grows beyond is ended.
        max_queries: subscriptions at most."""
        self.spark, self.folder, self.max_rows, self.max_queries = spark, folder.rstrip("/"), max_rows, max_queries
        self.state = {"version": 0, "pos": -1, "tables": {}, "views": {}, "queries": {}, "names": {}, "keys": {}, "pending": {}, "held": None, "clients": {}} | (self._latest() or {})
        self.keys = {k: tuple(v) for k, v in self.state["keys"].items()} | {k: (v,) if isinstance(v, str) else tuple(v) for k, v in (keys or {}).items()}
        self.queries: dict[str, Query] = {n: ast.query(q) for n, q in self.state["queries"].items()}

    # the manifest: one small file for each version; the highest complete one counts
    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> dict | None:
        path, fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        found = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not found:
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifest-{found[-1]}.json", wholetext=True).collect()))

    def _commit(self, **changed) -> None:
        """The next version: the present state with what changed."""
        state = self.state | changed | {"version": self.state["version"] + 1, "keys": self.keys, "queries": {n: q.to_json() for n, q in self.queries.items()}}
        path, fs = self._fs()
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        own = jpath(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(own)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(own, jpath(f"{self.folder}/manifest-{state['version']}.json")):
            raise RuntimeError("another writer has committed this version")
        text, self.state = json.dumps([self.state, state]), state
        for name in [f.getPath().getName() for f in fs.listStatus(path)]:  # what the last two versions use stays
            version = name.rpartition("-v")[2].partition("-")[0] if "-v" in name else name.removeprefix("manifest-").removesuffix(".json")
            if version.isdigit() and int(version) < state["version"] - 1 and f'"{name}"' not in text:
                fs.delete(jpath(f"{self.folder}/{name}"), True)

    def _write(self, df: DataFrame, name: str) -> str:
        own = f"{name}-v{self.state['version'] + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/{own}")
        return own

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(self._write(df, name)))

    def _read(self, at: dict, key: tuple[str, ...]) -> DataFrame:
        return generations.read(self.spark, self._path(at["base"]), list(map(self._path, at["deltas"])), key)

    def _added(self, at: dict, name: str, key: tuple[str, ...], more: DataFrame) -> dict:
        """A table with one more generation, or written anew where there are many."""
        new = {"base": at["base"], "deltas": [*at["deltas"], self._write(more, f"{name}_changes")]}
        return {"base": self._write(self._read(new, key), name), "deltas": []} if len(new["deltas"]) > generations.MOST else new

    def table(self, name: str) -> DataFrame:
        name = self.state["names"].get(name, name)
        return self._read(self.state["tables"][name], self.keys[name])

    def view(self, name: str) -> DataFrame:
        """A query's present rows, as they come; `snapshot` has them in order."""
        return self._read(self.state["views"][name], self.keys[self.queries[name].table])

    def snapshot(self, name: str) -> DataFrame:
        from tidemark.functions.ordering import sort_columns, total_order

        rows, q = self.view(name), self.queries[name]
        return rows.orderBy(*sort_columns(total_order(q, self.keys[q.table], rows.columns)))

    def catalog(self, tables: dict[str, dict] | None = None) -> Catalog:
        found = Catalog()
        for name, at in (tables or self.state["tables"]).items():
            found.add(name, lambda name=name, at=at: self._read(at, self.keys[name]), self.keys[name])
        return found

    def load(self, tables: dict[str, DataFrame], pos: int | None = None) -> None:
        """Initial contents; tables that are stored already stay, so it also fills in new ones."""
        new = {n: {"base": self._write(df, n), "deltas": []} for n, df in tables.items() if n not in self.state["tables"]}
        self._commit(pos=self.state["pos"] if pos is None else pos, tables=self.state["tables"] | new)

    def replace(self, tables: dict[str, DataFrame], pos: int) -> None:
        """Starts over from a snapshot: all tables anew, and all queries in full."""
        own = {n: {"base": self._write(df, n), "deltas": []} for n, df in tables.items()}
        catalog = self.catalog(own)
        views = {n: {"base": self._write(compile_query(q, catalog, ordered=False), f"view_{n}"), "deltas": []} for n, q in self.queries.items()}
        self._commit(pos=pos, tables=own, views=views, names={}, held=None)

    def export(self, path: str) -> None:
        """A snapshot of all tables with their position, in a folder of its own: what `restored` starts from."""
        for name in self.state["tables"]:
            self.table(name).write.mode("overwrite").parquet(f"{path}/{name}")
        about = json.dumps({"pos": self.state["pos"], "keys": {n: self.keys[n] for n in self.state["tables"]}})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def restored(cls, spark: SparkSession, folder: str, path: str, **more) -> Replica:
        """A new replica from a snapshot; events behind its position bring it up to date."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        own = cls(spark, folder, about["keys"], **more)
        own.load({n: spark.read.parquet(f"{path}/{n}") for n in about["keys"]}, about["pos"])
        return own

    def subscribe(self, name: str, query: Query) -> DataFrame:
        """Registers a query, stores its present result and keeps it current, also after a restart."""
        if name not in self.queries and len(self.queries) >= self.max_queries:
            raise ValueError(f"more than {self.max_queries} queries")
        result = compile_query(query, self.catalog(), ordered=False)
        if self.max_rows is not None:
            bounded(result, self.max_rows)
        at = {"base": self._write(result, f"view_{name}"), "deltas": []}
        self.queries[name] = query
        self._commit(views=self.state["views"] | {name: at})
        return self.view(name)

    def unsubscribe(self, name: str) -> DataFrame:
        """Ends a query; what a client that follows all queries must delete: (op, table, row_id, row) of the
        rows that no other query holds."""
        gone = self._stored(patches.patches(self.rows([name]), self.rows([n for n in self.queries if n != name])).where("op = 'del'"), f"retracted_{name}")
        self.queries.pop(name)
        self._commit(views={k: v for k, v in self.state["views"].items() if k != name})
        return gone

    def rows(self, names) -> DataFrame:
        """Rows of queries' results, each once, with the number of queries that hold it."""
        sets = {n: patches.flat(self.view(n), self.queries[n], self.catalog()) for n in names}
        return patches.referenced(sets) if sets else self.spark.createDataFrame([], "table string, row_id string, row string, fingerprint string, refs long")

    def apply(self, events: DataFrame, number: int | None = None) -> dict[str, DataFrame]:
        """Applies the complete transactions of a batch; the changes of each query that it can affect.

        With `number`, the changes are kept in the manifest until `deliver` has handed them over, and
        events of unfinished transactions (all behind the last commit) until the next batch.
        """
        events = self._stored(cdc.complete(cdc.shaped(events), self.state["pos"], all_of=True), "batch")
        batch = cdc.complete(events, self.state["pos"])
        pos = batch.agg(F.max("pos")).first()[0]
        rest = {}
        if number is not None:
            left = events.where(F.col("pos") > (self.state["pos"] if pos is None else pos))
            rest = {"held": None if left.isEmpty() else self._write(left, "held")}
        if pos is None:
            if rest and (rest["held"] or self.state["held"]):
                self._commit(**rest)
            return {}
        names = cdc.renames(batch, self.state["names"], self.state["tables"])
        batch = cdc.under_stored_names(batch, names)
        moved = cdc.touched(batch) & set(self.state["tables"])
        has_rows = cdc.touched(batch.where("kind <> 'relation'"))
        tables, changed, whole = dict(self.state["tables"]), {}, set()
        for name in sorted(moved):
            key, now = self.keys[name], self.table(name)
            new = cdc.reshaped(now, batch, name, key, lambda df, name=name: self._stored(df, name))
            if new is None and name not in has_rows:
                continue
            cleared, moves = (-2, False) if new is not None else cdc.facts(now, batch, name, key)
            if new is not None or cleared >= 0:
                whole.add(name)
                tables[name] = {"base": self._write(cdc.folded(now, batch, name, key, cleared, moves)[1] if new is None else new, name), "deltas": []}
                continue
            keys, rows = cdc.folded(now, batch, name, key, cleared, moves)
            delta = generations.delta(keys, rows, key)
            tables[name] = self._added(self.state["tables"][name], name, key, delta)
            if tables[name]["deltas"]:
                delta = self.spark.read.parquet(self._path(tables[name]["deltas"][-1]))
            after = delta.where("not gone").select("row.*")
            changed[name] = matching(now, delta.select("row.*"), key, "left_semi").unionByName(after)
        views, out, catalog = dict(self.state["views"]), {}, self.catalog(tables)
        for name in [n for n, q in self.queries.items() if q.tables() & (changed.keys() | whole)]:
            found = self._maintained(name, catalog, changed, whole)
            if found is not None:
                views[name], at = found
                out[name] = at
            if self.max_rows is not None and self._read(views[name], self.keys[self.queries[name].table]).limit(self.max_rows + 1).count() > self.max_rows:
                views.pop(name)  # too large to be kept: its last changes are not handed over, and it ends
                out.pop(name, None)
                self.queries.pop(name)
        pending = {"pending": {"number": number, "changes": out}} if number is not None and out else {}
        self._commit(pos=pos, tables=tables, views=views, names=names, **pending, **rest)
        return {n: self.spark.read.parquet(self._path(at)) for n, at in out.items()}

    def _maintained(self, name: str, catalog: Catalog, changed: dict[str, DataFrame], whole: set[str]) -> tuple[dict, str] | None:
        """A query's new state and the path of its changes; None if nothing changes in it."""
        query, stored = self.queries[name], self.state["views"][name]
        key, old = self.keys[query.table], self.view(name)
        if query.tables() & whole or query.limit is not None or query.start is not None:
            new = self._write(compile_query(query, catalog, ordered=False), f"view_{name}")
            found = self._write(changes(old, self.spark.read.parquet(self._path(new)), key), f"changes_{name}")
            same = old.columns == self.spark.read.parquet(self._path(new)).columns
            state = {"base": new, "deltas": []}
            return None if same and self.spark.read.parquet(self._path(found)).isEmpty() else (state, found)
        only = Compiler(catalog).reached(query, {t: d for t, d in changed.items() if t in query.tables()})
        only = self._stored(only, "reached")
        rows = self._stored(compile_query(query, catalog, ordered=False, only=only), "recomputed")
        found = self._write(changes(matching(old, only, key, "left_semi"), rows, key), f"changes_{name}")
        if self.spark.read.parquet(self._path(found)).isEmpty():
            return None
        return self._added(stored, f"view_{name}", key, generations.delta(only, rows, key)), found

    def deliver(self, sink) -> None:
        """Hands over the changes that are pending, sink(name, changes, batch number); each stays pending until the sink returns."""
        while self.state["pending"]:
            number, left = self.state["pending"]["number"], dict(self.state["pending"]["changes"])
            name = sorted(left)[0]
            at = left.pop(name)
            if sink:
                sink(name, self.spark.read.parquet(self._path(at)), number)
            self._commit(pending={"number": number, "changes": left} if left else {})

    def follow(self, events: DataFrame, checkpoint: str, sink=None):
        """A streaming query over events (readStream); sink(name, changes, batch number) gets each query's changes.

        What a batch holds of an unfinished transaction joins the next batch. A sink that fails gets the
        same changes with the same number again.
        """

        def work(batch: DataFrame, number: int) -> None:
            self.deliver(sink)
            held = self.state["held"]
            every = batch.unionByName(self.spark.read.parquet(self._path(held)), allowMissingColumns=True) if held else batch
            self.apply(every, number)
            self.deliver(sink)

        return events.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def sync(self, client: str, names, cookie: int | None = None, now: float | None = None) -> tuple[DataFrame, int]:
        """What a client of these queries must put and delete, and the cookie of the view that it then holds.

        A client that shows the cookie of the view stored for it gets the difference; any other starts over:
        `clear` comes first, then all rows. What the client holds is kept as fingerprints, with the cookie,
        and outlasts a restart.
        """
        stored = self.state["clients"].get(client)
        current = self._stored(self.rows(names), "current")
        if stored and cookie == stored["cookie"]:
            out = patches.patches(self.spark.read.parquet(self._path(stored["rows"])), current)
        else:
            clear = self.spark.createDataFrame([("clear", None, None, None)], "op string, table string, row_id string, row string")
            out = clear.union(current.select(F.lit("put"), "table", "row_id", "row"))
        out = self._stored(out, "patches")
        view = {"cookie": (stored or {"cookie": 0})["cookie"] + 1, "pos": self.state["pos"], "seen": time.time() if now is None else now, "queries": sorted(names), "rows": self._write(current.select("table", "row_id", "fingerprint"), "client")}
        self._commit(clients=self.state["clients"] | {client: view})
        return out, view["cookie"]

    def forget_clients(self, before: float) -> list[str]:
        """Drops what is stored for clients not seen since `before`; such a client starts over."""
        old = [c for c, v in self.state["clients"].items() if v["seen"] < before]
        if old:
            self._commit(clients={c: v for c, v in self.state["clients"].items() if c not in old})
        return sorted(old)

    def last_mutations(self) -> dict[str, int]:
        """The last mutation acknowledged to each client."""
        if cdc.MUTATIONS not in self.state["tables"]:
            return {}
        return dict(self.table(cdc.MUTATIONS).select("client_id", "last_mutation_id").collect())  # a row for each client
