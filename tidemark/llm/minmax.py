"""Near-duplicate groups by min-max hashing.

Each permutation of a document's shingles leaves two values, its minimum and its maximum, so 200
values take 100 hash evaluations a shingle. Bands of five values are the buckets: at similarity 0.8
a pair shares none of 40 bands with probability 1.2e-7.

Nothing lists all pairs of a bucket. Documents with equal shingle sets are one node. In every bucket
the nodes are compared with one centre; what the confirmed links leave apart is then compared
across, and only across, the groups that still meet in a bucket, a pair once, in the first bucket that
it shares. Parities of 1024 bins of each set rule out pairs before any text travels: sets differ in at
least as many shingles as bins differ in parity, so no pair that is similar enough is lost. Links are
confirmed on full sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, free_name, hashed, kept, slices, table, words_of, written

PERMUTATIONS, ROWS, BANDS = 100, 5, 40
#: Pairs whose 64-bit sketches differ in more bits are not confirmed: at similarity 0.8 the mean is 6.4, the deviation 2.4.
SKETCH_RADIUS = 24
#: Longs that hold the parities of a set's bins.
PARITIES = [f"o{k}" for k in range(16)]
BLOCK = 4096

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words; of the whole sequence if it is shorter."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hashed(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out ^ h[k : k + n])
    return np.unique(out)


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    a = draw.integers(0, 2**64, PERMUTATIONS, np.uint64) | np.uint64(1)
    return a[:, None], draw.integers(0, 2**64, PERMUTATIONS, np.uint64)[:, None]


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The minima under all permutations, then the maxima; blocks bound the memory for long texts."""
    a, b = permutations()
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(shingles), BLOCK):
        v = shingles[None, k : k + BLOCK] * a + b
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in values.reshape(BANDS, ROWS).T:
        keys = mixed(keys * MIX ^ column)
    return keys


def sketch(values: np.ndarray) -> int:
    return int(np.packbits((values[:64] * MIX >> np.uint64(63)).astype(np.uint8)).view(np.int64)[0])


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each bin, chosen by the leading bits of the hash, has an odd number of shingles."""
    bins = 64 * len(PARITIES)
    count = np.bincount((shingles >> np.uint64(65 - bins.bit_length())).astype(np.int64), minlength=bins)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, d1, d2, sketch, bands, parities) of each row; n = 0 and no bands without words."""

    def work(batches):
        kept("near-duplicates", dict)  # lets go of what other stages kept
        for b in slices(batches):
            out = {k: [] for k in ("n", "d1", "d2", "sketch", "bands")}
            odd = []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, size)
                v = min_max(s) if len(s) else None
                out["n"].append(len(s))
                out["d1"].append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                out["d2"].append(int(mixed(s * STEP).sum(dtype=np.uint64).view(np.int64)))
                out["sketch"].append(0 if v is None else sketch(v))
                out["bands"].append([] if v is None else bands(v).view(np.int64).tolist())
                odd.append(parities(s))
            columns = [*(pa.array(out[k], pa.int64()) for k in ("n", "d1", "d2", "sketch")), pa.array(out["bands"], pa.list_(pa.int64())), *map(pa.array, np.array(odd).T.copy())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", *out, *PARITIES])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(work, "id long, n long, d1 long, d2 long, sketch long, bands array<long>" + "".join(f", {o} long" for o in PARITIES))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose full shingle sets are similar enough. Texts travel, once a pair, not sets."""

    def work(batches):
        kept("near-duplicates", dict)
        last, own = None, None
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if x != last:
                    last, own = x, shingle_set(x, size)
                other = shingle_set(y, size)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    full = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return full.mapInArrow(work, "a long, b long").distinct()


def alike(x: str, y: str, percent: int) -> "F.Column":
    """May rows x and y be linked, by set sizes (exact) and sketches?"""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    differ = F.bit_count(F.col(f"{x}.sketch").bitwiseXOR(F.col(f"{y}.sketch")))
    return (100 * small >= percent * large) & (differ <= SKETCH_RADIUS)


def near_enough(x: str, y: str, percent: int) -> "F.Column":
    """False only for rows x and y whose sets certainly differ in too many shingles."""
    differ = sum(F.bit_count(F.col(f"{x}.{o}").bitwiseXOR(F.col(f"{y}.{o}"))) for o in PARITIES)
    return differ * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star steps, each a pre-aggregated minimum and a join, until the
    edges are stars around their minima; a written table after each round ends the lineage. Minima are
    written before they are joined, so that nothing ties the join to the aggregation's partitions and a
    node with very many partners is split over tasks.
    """
    now = written(edges.where("a <> b").distinct(), "edges")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"), F.col("m").alias("a"))
        small = small.union(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).where("a <> b").distinct()
        new = written(small.select("a", "b"), "edges")
        drop_written(now, low, large, least)
        now = new
        # stars: every node has one edge to a smaller one, which has none
        if now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and now.groupBy("b").count().where("count > 1").isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of `docs`, by whole texts.

    Documents are linked if their sets of distinct shingles of `size` words (the whole sequence, if
    shorter) have a Jaccard similarity of `percent` / 100 or more. component_id is the smallest id
    reachable over links; kept marks the row of that id.

    A null text, or one without words, has an empty set and is linked with nothing. Rows of one id are
    one document, linked by any of its texts. A row without id stands alone: its component is null and
    it is kept. An empty table gives an empty table. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(signatures(docs, id_col, text_col, size), "signatures")
    known = rows.where("n > 0 and id is not null")
    # equal sets are one node, named by the smallest id
    classes = written(known.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "classes")
    nodes = known.join(classes.select(F.col("rep").alias("id"), "n", "d1", "d2"), ["id", "n", "d1", "d2"], "left_semi")
    in_bands = written(nodes.select("id", "n", "sketch", F.xxhash64("id").alias("rank"), F.explode("bands").alias("key")), "bands")
    odd = written(nodes.select("id", "n", "bands", *PARITIES).dropDuplicates(), "parities")

    # in every bucket, all with one centre; the centres are written, so that hot buckets are split over tasks
    centres = in_bands.groupBy("key").agg(F.min(F.struct("rank", "id", "n", "sketch")).alias("c"), F.count("*").alias("size")).where("size > 1")
    centres = written(centres.select("key", "c"), "centres")
    met = in_bands.alias("x").join(centres.alias("y").select("key", "c.*").alias("c"), "key").where(F.col("x.id") != F.col("c.id"))
    met = met.where(alike("x", "c", percent)).select(*pair("x.id", "c.id")).distinct()
    near = met.join(odd.drop("bands").alias("x"), F.col("a") == F.col("x.id")).join(odd.drop("bands").alias("y"), F.col("b") == F.col("y.id"))
    tested = written(near.where(near_enough("x", "y", percent)).select("a", "b").distinct(), "tested")
    links = written(confirmed(tested, texts, size, percent), "links")
    # an id with several different texts holds their classes together
    same = known.join(classes, ["n", "d1", "d2"]).groupBy("id").agg(F.min("rep").alias("a"), F.count_distinct("rep").alias("k")).where("k > 1")
    many = known.join(classes, ["n", "d1", "d2"]).select("id", "rep").distinct().join(same.select("id", "a"), "id").select("a", F.col("rep").alias("b"))
    links = links.union(written(many.where("a <> b"), "ids"))
    groups = written(components(links), "groups")

    # what is apart after the centres, in buckets of three and more, is compared across groups, a pair in
    # the first bucket that it shares
    placed = in_bands.select("id", "n", "sketch", "key").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("size > 2 and low < high")
    open_keys = written(open_keys.select("key"), "open")
    rest = written(placed.join(open_keys, "key", "left_semi").join(odd, ["id", "n"]), "rest")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
    first = F.col("x.key") == F.array_min(F.array_intersect("x.bands", "y.bands"))
    across = rest.alias("x").join(rest.alias("y"), meet & alike("x", "y", percent) & near_enough("x", "y", percent) & first)
    untested = written(across.select(*pair("x.id", "y.id")).distinct().join(tested, ["a", "b"], "left_anti"), "untested")
    drop_written(in_bands, odd, centres, open_keys, rest)
    more = written(confirmed(untested, texts, size, percent), "more")
    if not more.isEmpty():
        groups = written(components(links.union(more)), "groups")

    of_row = rows.join(classes, ["n", "d1", "d2"], "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = of_row.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """`docs`, all columns, with one row of each group of near-duplicates: that of the smallest id.

    Rows of one id count as one document: the row with the smallest text (null first) stays. Rows
    without id stay, and so does one row of each document without text or words. An empty table stays
    empty; columns may have any names.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent)
    own = free_name(docs, "own_id")
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias(own)).distinct()
    left = docs.join(gone, docs[id_col] == F.col(own), "left_anti")
    repeated = written(docs.groupBy(F.col(id_col).alias(own)).agg(F.count("*").alias("rows")).where(f"rows > 1 and {own} is not null").select(own), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left[id_col] == F.col(own), "left_anti")
    again = left.join(repeated, left[id_col] == F.col(own), "left_semi")
    # the smallest text of an id by a pre-aggregated minimum: rows of one id, however many, never meet in a task
    row = F.struct(*docs.columns)
    first = again.groupBy(id_col).agg(F.min_by(row, F.struct(text_col, F.to_json(row))).alias(own)).select(f"{own}.*")
    return once.unionByName(first)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`near_duplicates` of all of `documents`, by two-word shingles; cases as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


OP5_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as s from w
), n as (select doc_id, count(*) as n from s group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)
), e as (select a, b from l union all select b, a from l
), reach as (
  select doc_id as node, doc_id as at from w
  union
  select r.node, e.b from reach r join e on e.a = r.at
)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reach.at) as component_id, w.doc_id = min(reach.at) as kept
from w join reach on reach.node = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id
"""
