"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens goes down a tree, here domain, language, source, by weight. No node gets more than
its documents give in the allowed epochs; what one cannot take goes to its siblings, and only what a
whole family cannot take goes to its parent's siblings. A leaf's budget is so many whole epochs and a
prefix of one more: documents in the order of a seeded hash, different in each epoch.

The prefix is found by sums over ranges of the hash, narrowed twice, so no leaf's documents are sorted
or gathered, however many they are; what is left is one threshold a leaf. Neither leaves nor documents
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, table, written

#: Plans of up to so many leaves, some MB, are sent to all tasks; larger ones are joined.
SENT_LEAVES = 100_000
#: Hashes have 60 bits; each narrowing looks at 10 of them.
BITS, STEP = 60, 10

KEYS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 2.0, "domain2": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {}}


def shares(amount: float, children: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Splits `amount` over children (weight, most) by weight; the surplus of full ones goes to the others."""
    given = dict.fromkeys(children, 0.0)
    open_ = {k: w for k, (w, most) in children.items() if w > 0 and most > 0}
    while open_ and amount > 1e-9:
        total = sum(open_.values())
        full = {k for k, w in open_.items() if amount * w / total >= children[k][1]}
        for k in full or open_:
            given[k] = children[k][1] if k in full else amount * open_[k] / total
        if not full:
            break
        amount -= sum(children[k][1] for k in full)
        open_ = {k: w for k, w in open_.items() if k not in full}
    return given


def allocate(amount: float, tokens: dict[tuple, int], weights: dict[str, dict[str, float]], keys: tuple, epochs: float) -> dict[tuple, float]:
    """Tokens of each leaf: top down, each family sharing what its parent got. The rule in plain Python, for
    trees at hand; `budgets` is the same rule for those of a table."""
    most: dict[tuple, float] = {}
    for leaf, n in tokens.items():
        for k in range(len(keys) + 1):
            most[leaf[:k]] = most.get(leaf[:k], 0.0) + n * epochs
    below: dict[tuple, list[tuple]] = {}
    for node in most:
        if node:
            below.setdefault(node[:-1], []).append(node)
    given = {(): min(amount, most.get((), 0.0))}
    for depth, key in enumerate(keys):
        for node in [x for x in given if len(x) == depth]:
            family = {c[-1]: (weights.get(key, {}).get(c[-1], 1.0), most[c]) for c in sorted(below.get(node, ()))}
            given |= {(*node, k): v for k, v in shares(given[node], family).items()}
    return {leaf: given[leaf] for leaf in tokens}


def order(seed: int, epoch, id_col) -> "F.Column":
    """The place of a document in an epoch, as a 60-bit number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), id_col.cast("string")), 64 - BITS)


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], keys: tuple, names: list[str], budget: float, epochs: float) -> DataFrame:
    """`leaves` (names, n) with `given`, the tokens of each leaf: `allocate` as joins and windows, a level at a time.

    In a family, children in order of capacity by weight are full up to the first whose share of what is
    left is less than it takes; it and those behind it share by weight. No level comes to the driver.
    """
    total = leaves.agg(F.sum("n")).first()[0] or 0
    above = leaves.sparkSession.createDataFrame([(float(min(budget, epochs) * total),)], "amount double")
    for depth, key in enumerate(keys):
        own = names[: depth + 1]
        weight = F.lit(1.0)
        if table_of := weights.get(key):
            weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, w in table_of.items() for x in (k, float(w)))), F.col(own[-1])), weight)
        nodes = leaves.groupBy(*own).agg((F.sum("n") * F.lit(float(epochs))).alias("most")).withColumn("w", weight)
        nodes = nodes.join(above, own[:-1]) if depth else nodes.join(F.broadcast(above))  # one row
        takes = (F.col("w") > 0) & (F.col("most") > 0)
        family = Window.partitionBy(*own[:-1], "takes").orderBy("ratio", own[-1])
        before, behind = family.rowsBetween(Window.unboundedPreceding, -1), family.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("takes", takes).withColumn("ratio", F.when(takes, F.try_divide("most", "w")).otherwise(0.0))
        nodes = nodes.withColumn("level", F.try_divide(F.col("amount") - F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.sum("w").over(behind)))
        nodes = nodes.withColumn("full", F.col("level") >= F.col("ratio"))
        level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(family.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        got = F.when(~F.col("takes"), 0.0).when(F.col("full"), F.col("most")).otherwise(F.greatest(F.lit(0.0), level * F.col("w")))
        above = nodes.select(*own, got.alias("amount"))
    return leaves.join(above, names).withColumnRenamed("amount", "given")


def sent(small: DataFrame, rows: int) -> DataFrame:
    """`small` for a join: sent to all tasks if it has few rows, else dealt by key, where hot keys are split."""
    return F.broadcast(small) if rows <= SENT_LEAVES else small


def thresholds(rows: DataFrame, plan: DataFrame, count: int) -> DataFrame:
    """(leaf, below): documents with a smaller hash are the longest prefix of at most `rest` tokens.

    rows: leaf, h, n. plan: leaf, rest, of `count` rows. A leaf whose documents all fit has no row.
    """
    left, was = plan.select("leaf", "rest", F.lit(0).cast("long").alias("low")), BITS
    for bits in (BITS - STEP, BITS - 2 * STEP, 0):
        inside = rows.join(sent(left, count), "leaf")
        inside = inside.where(F.shiftright("h", was) == F.shiftright("low", was))
        sums = inside.groupBy("leaf", "rest", F.shiftright("h", bits).alias("r")).agg(F.sum("n").alias("n"))
        run = sums.withColumn("sum", F.sum("n").over(Window.partitionBy("leaf").orderBy("r"))).where("sum > rest")
        first = run.groupBy("leaf").agg(F.min(F.struct("r", (F.col("rest") - F.col("sum") + F.col("n")).alias("rest"))).alias("f"))
        left, was = written(first.select("leaf", "f.rest", F.shiftleft("f.r", bits).alias("low")), "mix-level"), bits
    return left.select("leaf", F.col("low").alias("below"))


def mixing_plan(docs: DataFrame, keys: dict, weights: dict, budget: float, epochs: float, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(k0.., leaf, whole, below), for each leaf its whole epochs and the threshold of the next one; and their number."""
    names = [f"k{k}" for k in range(len(keys))]
    parts = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(keys.values(), names, strict=True)]
    n = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    slim = written(docs.select(*parts, F.col(id_col).cast("string").alias("i"), n.alias("n")), "mix-rows")
    totals = written(slim.groupBy(*names).agg(F.sum("n").alias("n")), "mix-totals")
    own = budgets(totals, weights, tuple(keys), names, budget, epochs)
    rest = F.when(F.col("n") > 0, F.col("given") % F.col("n")).otherwise(0.0)
    whole = F.when(F.col("n") > 0, F.round((F.col("given") - rest) / F.col("n"))).otherwise(0.0)
    leaves = written(own.select(*names, F.monotonically_increasing_id().alias("leaf"), whole.cast("long").alias("whole"), F.floor(rest).cast("long").alias("rest")), "mix-leaves")
    count = leaves.count()
    of_leaf = slim.join(sent(leaves, count), names).where("rest > 0")
    rows = of_leaf.select("leaf", order(seed, F.col("whole"), F.col("i")).alias("h"), "n")
    found = thresholds(rows, leaves.where("rest > 0").select("leaf", "rest"), count)
    return written(leaves.join(found, "leaf", "left").withColumn("below", F.coalesce("below", F.lit(0)))[[*names, "leaf", "whole", "below"]], "mix-plan"), count


def with_copies(docs: DataFrame, keys: dict, weights: dict, budget: float = 1.0, epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", copies_col: str = "copies") -> DataFrame:
    """`docs` and a column with how often each row is in the mix (0: not at all).

    keys: name -> column, from the top of the tree to its leaves; weights: key -> value -> weight (1
    where none is given); budget: tokens of the mix, as a share of all; epochs: how often a document may
    occur. Tokens are words here. A leaf gets its budget less at most its next document.

    Null keys count as ''. Null and empty texts have no tokens and follow their hash; rows of one id
    stand at one place of the order and are taken together; a null id is a place of its own. An empty
    table gives an empty table. Columns of `docs` may have any names; one named as `copies_col` is replaced.
    """
    plan, count = mixing_plan(docs, keys, weights, budget, epochs, seed, id_col, text_col)
    names = [f"k{k}" for k in range(len(keys))]
    leaf, found = free_name(docs, "leaf"), free_name(docs, "plan")
    tree = plan.select(F.struct(*names).alias(leaf), F.struct("whole", "below").alias(found))
    own = docs.withColumn(leaf, F.struct(*(F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(keys.values(), names, strict=True))))
    joined = own.join(sent(tree, count), leaf, "left")
    whole = F.coalesce(f"{found}.whole", F.lit(0))
    more = order(seed, whole, F.col(id_col)) < F.coalesce(f"{found}.below", F.lit(0))
    return joined.select(*(docs[c] for c in docs.columns if c != copies_col), (whole + more.cast("long")).alias(copies_col))


def mixed(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """`docs`, all columns, each row as often as the mix has it, by the rules of `with_copies`.

    Null, empty and repeated rows are taken as stated there; an empty table stays empty; columns may have
    any names.
    """
    copies = free_name(docs, "copies")
    again = free_name(docs, f"{copies}_again")
    own = with_copies(docs, *args, copies_col=copies, **kwargs)
    return own.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def domain_of(source) -> "F.Column":
    """`documents` has no domains: three groups of sources stand in for them."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 3).cast("string"))


def document_keys() -> dict:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`with_copies` of all of `documents` under WEIGHTS; cases as stated there."""
    docs = table(spark, sf_dir, "documents")
    out = with_copies(docs, document_keys(), WEIGHTS)
    return out.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "copies")
