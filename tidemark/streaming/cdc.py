"""Change events folded into tables.

An event has pos (its place in the stream), kind (begin, commit, insert, update, delete, truncate,
relation), table, row and old_row (JSON objects; in row, an absent column is unchanged, which is not
null), tables (of a truncate) and columns (of a relation). A batch of events is one aggregation by
row over the keys that it names: their stored rows join in as events before all others; the rest of the
table passes through. Rows are followed through the batch's moves of keys first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.compile import matching
from tidemark.storage import drop_written, written

EVENTS = "pos long, lsn long, kind string, table string, row string, old_row string, tables array<string>, columns array<struct<name:string,type:string>>, renamed_from string"
# fixed values: texts that are true when a column becomes boolean
TRUE_TEXTS = ("t", "true", "TRUE", "yes", "on", "1")


def shaped(events: DataFrame) -> DataFrame:
    """Events with all columns of EVENTS, null where they have none."""
    return events.sparkSession.createDataFrame([], EVENTS).unionByName(events, allowMissingColumns=True)


def complete(events: DataFrame, after: int = -1, all_of: bool = False) -> DataFrame:
    """Events behind `after`, each once, of transactions whose commit is here; later ones wait, unless `all_of` are asked for."""
    new = events.where(F.col("pos") > after)
    if not all_of:
        last = events.where("kind = 'commit'").agg(F.max("pos")).first()[0]
        new = new.where(F.col("pos") <= F.lit(-1 if last is None else last))
    return new.dropDuplicates(["pos"])


def touched(events: DataFrame) -> set[str]:
    """Tables that a batch changes."""
    named = events.where("kind in ('insert', 'update', 'delete', 'relation')").select("table")
    cleared = events.where("kind = 'truncate'").select(F.explode("tables"))
    return {r[0] for r in named.union(cleared).distinct().collect()}


def _key(row, key: tuple[str, ...]) -> list:
    return [row[k].alias(f"__k{n}") for n, k in enumerate(key)]


def _timelines(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries with `live` (the key has a row just before), `line`, the row that they write or remove, and
    `replaced` (a row that comes next takes the key).

    A row starts at a write of a key without one, or where a move brings one along: `root`, if not null,
    is the row that comes. Removals of missing keys are left out.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    entries = entries.withColumn("live", F.coalesce(~F.lag("gone").over(w), F.lit(False)))
    start = ~F.col("gone") & (~F.col("live") | F.col("root").isNotNull())
    own = F.struct(F.col("pos"), *keys, F.lit(False).alias("moved"))
    line = F.last(F.when(start, F.coalesce("root", own)), ignorenulls=True).over(w)
    entries = entries.withColumn("start", start).withColumn("line", line).withColumn("replaced", ~F.col("gone") & F.coalesce(F.lead("start").over(w), F.lit(False)))
    return entries.where("not gone or live")


def _roots(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(pos, root) of the moves that bring a row along: the row's first entry, through all its moves."""
    alive = _timelines(entries, keys).where("leaving and live").select("pos")
    came = F.struct(F.col("pos"), *keys, F.lit(True).alias("moved"))  # not known yet where this one started
    arrivals = entries.where("arriving").drop("root").join(alive.withColumn("came", F.lit(True)), "pos", "left")
    marked = entries.where("not arriving").unionByName(arrivals.withColumn("root", F.when(F.col("came"), came)).drop("came"))
    links = written(_timelines(marked, keys).where("leaving and live").select("pos", F.col("line").alias("root")), "moves")
    while not links.where("root.moved").isEmpty():  # twice as far each time
        up = links.select(F.col("pos").alias("at"), F.col("root").alias("above"))
        further = links.where("root.moved").join(up, F.col("root.pos") == F.col("at")).select("pos", F.col("above").alias("root"))
        last, links = links, written(links.where("not root.moved").union(further), "moves")
        drop_written(last)
    return links


def _moved(key: tuple[str, ...]):
    """Does an event, parsed by `_parsed`, move its row to another key?"""
    differ = lambda k: F.array_contains("had", k) & F.array_contains("has", k) & ~F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}"))
    return reduce(lambda a, b: a | b, (F.coalesce((F.col("kind") == "update") & differ(k), F.lit(False)) for k in key))


def _parsed(events: DataFrame, table: str, shape: T.StructType) -> DataFrame:
    """A table's row events with their rows as columns, and the columns that are there."""
    own = events.where((F.col("table") == table) & F.col("kind").isin("insert", "update", "delete"))
    return own.select("pos", "kind", F.from_json("row", shape).alias("r"), F.from_json("old_row", shape).alias("o"), F.json_object_keys("row").alias("has"), F.json_object_keys("old_row").alias("had"))


def facts(base: DataFrame, events: DataFrame, table: str, key: tuple[str, ...]) -> tuple[int, bool]:
    """The position of the last truncate of a table, -2 without any, and whether any row changes its key: one pass over the events."""
    cuts = events.where((F.col("kind") == "truncate") & F.array_contains("tables", table)).select("pos", F.lit(False).alias("moves"))
    moves = _parsed(events, table, base.schema).where(_moved(key)).select(F.lit(-2).cast("long").alias("pos"), F.lit(True).alias("moves"))
    cleared, moves = cuts.union(moves).agg(F.max("pos"), F.max("moves")).first()
    return -2 if cleared is None else cleared, bool(moves)


def fold(base: DataFrame, events: DataFrame, table: str, key: tuple[str, ...]) -> DataFrame:
    """The table after the events: inserts and updates write, deletes and truncates remove.

    An insert of a stored key is an update, an update of a missing key an insert, a delete of a missing
    key nothing. An update that moves a key removes the old one; columns that it leaves out keep what the
    row under the old key has just before, from the table or from events before, through any number of
    moves; a row under the new key is replaced. Null parts of keys are values like others. Rows whose keys
    no event names pass through as they are.
    """
    cleared, moves = facts(base, events, table, key)
    touched, rows = folded(base, events, table, key, cleared, moves)
    return rows if cleared >= 0 else matching(base, touched, key, "left_anti").unionByName(rows)


def folded(base: DataFrame, events: DataFrame, table: str, key: tuple[str, ...], cleared: int, moves: bool) -> tuple[DataFrame, DataFrame]:
    """The keys that the events name, and the rows that these keys have after them; cleared and moves as by `facts`."""
    names = base.columns
    keys = [f"__k{n}" for n in range(len(key))]
    own, moved = _parsed(events, table, base.schema), _moved(key)
    nothing = F.lit(None).cast("array<string>")
    target = F.when(F.col("kind") == "delete", F.coalesce("o", "r")).otherwise(F.struct(*(F.when(F.array_contains("has", c), F.col(f"r.{c}")).otherwise(F.col(f"o.{c}") if c in key else F.lit(None)).alias(c) for c in names)))
    off = F.lit(False)
    writes = own.select("pos", (F.col("kind") == "delete").alias("gone"), target.alias("v"), F.when(F.col("kind") != "delete", F.col("has")).alias("has"), off.alias("leaving"), moved.alias("arriving"))
    leaving = own.where(moved).select("pos", F.lit(True).alias("gone"), F.col("o").alias("v"), nothing.alias("has"), F.lit(True).alias("leaving"), off.alias("arriving"))
    touched = writes.union(leaving).select(*(F.col(f"v.{k}").alias(k) for k in key)).distinct()
    stored = matching(base, touched, key, "left_semi")  # the other rows take no part
    before = stored.select(F.lit(-1).cast("long").alias("pos"), off.alias("gone"), F.struct(*names).alias("v"), F.array(*map(F.lit, names)).alias("has"), off.alias("leaving"), off.alias("arriving"))
    root = f"struct<pos:bigint,{','.join(f'{n}:{base.schema[k].dataType.simpleString()}' for n, k in zip(keys, key, strict=True))},moved:boolean>"
    entries = lambda df: df.where(F.col("pos") > cleared).select("*", *_key(F.col("v"), key), F.lit(None).cast(root).alias("root"))
    every = entries(before.union(writes).union(leaving))
    if not moves:
        return touched, _merged_by_key(every, keys, key, names)
    # keys that moves leave or reach are followed; no row goes from them to other keys, or comes from there
    ends = written(entries(writes.where("arriving").union(leaving)).select(*(F.col(k).alias(f"{k}m") for k in keys)).distinct(), "ends")
    on = F.expr(" and ".join(f"{k} <=> {k}m" for k in keys))
    own_lines = every.join(ends, on, "left_semi")
    roots = _roots(own_lines.select("pos", "gone", "leaving", "arriving", *keys, "root"), keys)
    arrivals = entries(writes.where("arriving")).drop("root").join(roots, "pos", "left")
    own_lines = own_lines.where("not arriving").unionByName(arrivals)
    # state of a row: what its entries wrote, the latest for each column; a row that leaves a key goes on elsewhere
    merged = _timelines(own_lines, keys).where("not leaving").groupBy("line").agg(
        F.max_by(F.struct((F.col("gone") | F.col("replaced")).alias("gone"), *keys), "pos").alias("last"),
        *(F.max_by(F.struct(F.col(f"v.{c}").alias("v")), F.when(F.array_contains("has", c), F.col("pos"))).alias(f"__c{n}") for n, c in enumerate(names)),
    )
    moved_rows = merged.where("not last.gone").select(*((F.col(f"last.{keys[key.index(c)]}") if c in key else F.col(f"__c{n}.v")).alias(c) for n, c in enumerate(names)))
    return touched, _merged_by_key(every.join(ends, on, "left_anti"), keys, key, names).unionByName(moved_rows)


def _merged_by_key(entries: DataFrame, keys: list[str], key: tuple[str, ...], names: list[str]) -> DataFrame:
    """The rows of keys that no move touches: what was written behind the last removal, the latest for each column."""
    cut = F.max(F.when(F.col("gone"), F.col("pos"))).over(Window.partitionBy(*keys))
    alive = entries.select("pos", "gone", "v", "has", *keys, cut.alias("cut")).where("not gone and (cut is null or pos > cut)")
    latest = {c: F.max_by(F.struct(F.col(f"v.{c}").alias("v")), F.when(F.array_contains("has", c), F.col("pos"))).alias(f"__c{n}") for n, c in enumerate(names) if c not in key}
    merged = alive.groupBy(*keys).agg(F.count("*").alias("__n"), *latest.values())
    return merged.select(*((F.col(keys[key.index(c)]) if c in key else F.col(f"__c{n}.v")).alias(c) for n, c in enumerate(names)))


def converted(column, old: T.DataType, new: str):
    """A column under another type; what has no meaning there becomes null."""
    if new == "boolean":
        if isinstance(old, T.NumericType):
            return column != 0
        return column.isin(*TRUE_TEXTS) if isinstance(old, T.StringType) else column.cast("boolean")
    if isinstance(old, T.BooleanType) and new in ("double", "long", "bigint", "int"):
        return column.cast("int").cast(new)
    return column.try_cast(new)


def evolved(df: DataFrame, columns: list[tuple[str, str]], rename: bool = True) -> DataFrame:
    """The table under new columns (name, type): kept ones are converted, new ones null, others dropped.

    One column that goes and one that comes, of the same type, are a rename, unless `rename` is off.
    """
    old = {f.name: f.dataType for f in df.schema.fields}
    new = dict(columns)
    out, come = [n for n in old if n not in new], [n for n in new if n not in old]
    source = {n: n for n in new if n in old}
    if rename and len(out) == len(come) == 1 and old[out[0]].simpleString() == T._parse_datatype_string(new[come[0]]).simpleString():
        source[come[0]] = out[0]
    return df.select(*((converted(F.col(source[n]), old[source[n]], t) if n in source else F.lit(None).cast(t)).alias(n) for n, t in columns))


def reshaped(df: DataFrame, events: DataFrame, table: str, key: tuple[str, ...], write) -> DataFrame | None:
    """The table after a batch in which its columns change, None if none does: events up to a relation count
    under the old columns, those behind it under the new ones. write: stores a step's rows and reads them back."""
    shapes = events.where((F.col("kind") == "relation") & (F.col("table") == table)).orderBy("pos").select("pos", "columns").collect()  # changes of schema
    own = events.where(F.col("kind") != "relation")
    last, changed = -1, False
    for pos, columns in shapes:
        new = [(c.name, c.type) for c in columns or ()]
        if not new or [(f.name, f.dataType) for f in df.schema.fields] == [(n, T._parse_datatype_string(t)) for n, t in new]:
            continue
        df = write(evolved(fold(df, own.where((F.col("pos") > last) & (F.col("pos") < pos)), table, key), new))
        last, changed = pos, True
    return write(fold(df, own.where(F.col("pos") > last), table, key)) if changed else None


def renames(events: DataFrame, known: dict[str, str], tables) -> dict[str, str]:
    """`known` with the names that relations give to stored tables: new name -> the name they are stored under."""
    found = dict(known)
    for name, was in events.where("kind = 'relation' and renamed_from is not null").orderBy("pos").select("table", "renamed_from").collect():  # changes of schema
        stored = found.get(was, was)
        if name not in tables and name not in found and stored in tables:
            found[name] = stored
    return found


def under_stored_names(events: DataFrame, names: dict[str, str]) -> DataFrame:
    """Events with tables by the names they are stored under."""
    if not names:
        return events
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    of = lambda c: F.coalesce(F.try_element_at(table, c), c)
    return events.withColumn("table", of(F.col("table"))).withColumn("tables", F.transform("tables", of))


#: An ordinary table in which each client's last mutation is acknowledged, with the rows that it wrote.
MUTATIONS, MUTATIONS_KEY, MUTATIONS_SCHEMA = "client_mutations", ("client_id",), "client_id string, last_mutation_id long"


def from_mutations(mutations: list[dict], last: dict[str, int], first: int = 0) -> list[dict]:
    """Mutations {client, id, operations} as events, each a transaction with its acknowledgement.

    last: the ids acknowledged so far, by client. An id that is not larger was applied before and is left
    out, so a mutation that is sent again changes nothing and an acknowledgement never goes back.
    """
    import json

    last, out = dict(last), []
    add = lambda **e: out.append({"pos": first + len(out), "table": None, "row": None, "old_row": None} | e)
    for m in mutations:
        if m["id"] <= last.get(m["client"], 0):
            continue
        last[m["client"]] = m["id"]
        add(kind="begin")
        for o in from_operations(m["operations"]):
            o.pop("pos")
            add(**o)
        add(kind="insert", table=MUTATIONS, row=json.dumps({"client_id": m["client"], "last_mutation_id": m["id"]}))
        add(kind="commit")
    return out


def from_operations(operations: list[dict], first: int = 0) -> list[dict]:
    """Row operations (insert, upsert, update, delete) as events. update keeps what it leaves out."""
    import json

    kinds = {"insert": "insert", "upsert": "insert", "update": "update", "delete": "delete"}
    out = []
    for n, o in enumerate(operations):
        text = json.dumps(o["row"])
        out.append({"pos": o.get("pos", first + n), "kind": kinds[o["op"]], "table": o["table"], "row": None if o["op"] == "delete" else text, "old_row": text if o["op"] == "delete" else None})
    return out


def overlaid(base: DataFrame, pending: DataFrame, table: str, key: tuple[str, ...], confirmed: int = -1) -> DataFrame:
    """A table with operations on top that are not confirmed yet (their pos is behind `confirmed`)."""
    return fold(base, pending.where(F.col("pos") > confirmed), table, key)
