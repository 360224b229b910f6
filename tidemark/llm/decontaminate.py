"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item is a window of its own length. For each length, all windows of a document with so
many shingles of items of that length that similarity LEAST is possible get 64-bit SimHash
fingerprints, in whatever order the shingles stand; others are less similar, so none is missed.
Hamming blocks find all items within RADIUS bits of a fingerprint: two fingerprints that differ in at
most RADIUS bits differ in at most RADIUS / BLOCKS bits in some block. Similarity of weighted shingles
decides.

Documents are not shuffled and are read once. The benchmark lies in the shared folder in blocks of
bounded size; a task holds a batch of documents and a few blocks at a time, however large either is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hashed, kept, new_path, slices, table, type_of
from tidemark.llm.minmax import mixed

SHINGLE, LEAST = 5, 0.8
#: At similarity 0.8 fingerprints differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS, BLOCKS = 23, 6
BLOCK_ITEMS, BLOCK_CHARS = 2000, 4_000_000
#: Blocks that a worker process keeps, and documents that are compared with all blocks in turn.
KEPT_BLOCKS, ROWS_AT_ONCE = 4, 1024
WORDS = re.compile(r"\w+")


def hashes_of(text: str | None) -> np.ndarray:
    """Hashes of a text's words: lower-cased runs of letters, digits and underscores."""
    return hashed(WORDS.findall(text.lower()) if text else [])


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out ^ h[k : k + n])
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: a shingle weighs as often as it occurs."""
    both = sum(min(n, b[x]) for x, n in a.items())
    return both / (a.total() + b.total() - both)


def fingerprints(rows: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes."""
    bits = np.unpackbits(np.ascontiguousarray(mixed(rows)).view(np.uint8).reshape(*rows.shape, 8), axis=-1).reshape(*rows.shape, 64)
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > rows.shape[1], axis=-1).view(">u8").ravel().astype(np.uint64)


class HammingBlocks:
    """All of some fingerprints within `radius` of a given one."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, blocks + 1).astype(int)
        self.cuts = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.tables: list[dict[int, list[int]]] = [{} for _ in self.cuts]
        for k, p in enumerate(prints.tolist()):
            for own, (at, width) in zip(self.tables, self.cuts, strict=True):
                own.setdefault((p >> at) & ((1 << width) - 1), []).append(k)
        self.masks = [[sum(1 << b for b in c) for n in range(radius // blocks + 1) for c in combinations(range(width), n)] for _, width in self.cuts]

    def near(self, p: int) -> list[int]:
        found: set[int] = set()
        for own, (at, width), masks in zip(self.tables, self.cuts, self.masks, strict=True):
            value = (p >> at) & ((1 << width) - 1)
            if len(own) < len(masks):
                most = max(map(int.bit_count, masks))
                for v, at_v in own.items():
                    if (v ^ value).bit_count() <= most:
                        found.update(at_v)
            else:
                for m in masks:
                    found.update(own.get(value ^ m, ()))
        return sorted(k for k in found if (int(self.prints[k]) ^ p).bit_count() <= self.radius)


def dense(at: list[int], length: int, need: int, starts: int) -> list[int]:
    """Of the first `starts` windows of a length, by start, those with `need` or more of the ascending places `at`."""
    out, done = [], 0
    for first, last in zip(at, at[need - 1 :], strict=False):
        if last - first < length:
            found = range(max(done, last - length + 1), min(first + 1, starts))
            out.extend(found)
            done = max(done, found.stop)
    return out


class Items:
    """A block of the benchmark: shingles to lengths of items, fingerprints, weights."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.lengths, self.weights, prints = [], [], [], []
        places: dict[tuple[int, int], set[int]] = {}
        for i, text in items:
            h = hashes_of(text)
            if not len(h):
                continue
            size = min(SHINGLE, len(h))
            s = shingles(h, size)
            for x in s.tolist():
                places.setdefault((size, x), set()).add(len(h))
            self.ids.append(i)
            self.lengths.append(len(h))
            self.weights.append(Counter(s.tolist()))
            prints.append(int(fingerprints(s[None])[0]))
        self.sizes = sorted({size for size, _ in places})
        self.places = {size: {x: sorted(p) for (s, x), p in places.items() if s == size} for size in self.sizes}
        self.sorted = {size: np.array(sorted(self.places[size]), np.uint64) for size in self.sizes}
        self.index = HammingBlocks(np.array(prints, np.uint64))

    def leaks(self, text: str | None) -> dict[int, float]:
        return self.leaks_in(hashes_of(text))

    def leaks_in(self, h: np.ndarray) -> dict[int, float]:
        """Items found in a text's words, with the best similarity of a window."""
        found: dict[int, float] = {}
        for size in self.sizes:
            s, known = shingles(h, size), self.sorted[size]
            if not len(s):
                continue
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s)
            shared: dict[int, list[int]] = {}
            for p in at.tolist():
                for length in self.places[size][int(s[p])]:
                    shared.setdefault(length, []).append(p)
            for length, places in shared.items():
                n = min(length, len(h)) - size + 1
                # both / (n + length - size + 1 - both) is LEAST or more
                need = max(1, math.ceil(LEAST * (n + length - size + 1) / (1 + LEAST) - 1e-9))
                order = dense(places, n, need, len(s) - n + 1)
                for k in range(0, len(order), 1024):
                    rows = np.stack([s[a : a + n] for a in order[k : k + 1024]])
                    for row, p in zip(rows, fingerprints(rows).tolist(), strict=True):
                        own = None
                        for item in self.index.near(p):
                            if self.lengths[item] == length:
                                own = own or Counter(row.tolist())
                                score = similarity(own, self.weights[item])
                                if score >= LEAST:
                                    found[item] = max(score, found.get(item, 0.0))
        out: dict[int, float] = {}
        for k, score in found.items():
            out[self.ids[k]] = max(score, out.get(self.ids[k], 0.0))
        return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Files in the shared folder with the benchmark in blocks of at most BLOCK_ITEMS items and about BLOCK_CHARS characters."""
    own = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    count, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    path = new_path(own.sparkSession, "benchmark")
    own.repartition(max(1, -(-count // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))).write.option("maxRecordsPerFile", BLOCK_ITEMS).parquet(path)
    return sorted(own.sparkSession.read.parquet(path).inputFiles())


class Blocks:
    """The benchmark's blocks in a worker process: KEPT_BLOCKS of them stay, others are read again."""

    def __init__(self, paths: list[str]):
        self.paths, self.made = paths, {}

    def __iter__(self):
        for path in self.paths:
            if (own := self.made.get(path)) is None:
                store, at = fs.FileSystem.from_uri(path)
                rows = pq.read_table(at, filesystem=store)
                own = Items(list(zip(rows["i"].to_pylist(), rows["t"].to_pylist(), strict=True)))
                if len(self.made) < KEPT_BLOCKS:
                    self.made[path] = own
            yield own


def leaks_of(texts: list[str | None], blocks: Blocks) -> list[dict[int, float]]:
    """The items found in each text. A text's words are hashed once for all blocks."""
    hashes, found = [hashes_of(t) for t in texts], [{} for _ in texts]
    for items in blocks:
        for h, own in zip(hashes, found, strict=True):
            own |= {i: max(score, own.get(i, 0.0)) for i, score in items.leaks_in(h).items()}
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, items array<bigint>, similarity), one row for each row of `docs`, whole texts.

    items: those of which some window of the item's length has a weighted five-word shingle similarity
    of LEAST or more, ascending; similarity: the best, null without any. Items of fewer than five words
    are one shingle; items with null id or without words are found nowhere; equal items are each found,
    rows of one item id count as one item, found by any of its texts. Null and empty texts have no items;
    a null id stays null; repeated rows are each answered; an empty table gives an empty table, an empty
    benchmark no items; other columns are not read.
    """
    paths = blocks_of(benchmark, item_col, item_text_col)

    def work(batches):
        blocks = kept(("decontaminate", *paths), lambda: Blocks(paths))
        for b in slices(batches, ROWS_AT_ONCE):
            found = leaks_of(b.column(1).to_pylist(), blocks)
            items, best = [sorted(x) for x in found], [max(x.values(), default=None) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=[id_col, "items", "similarity"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {type_of(docs, id_col)}, items array<bigint>, similarity double")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, in whose text no benchmark item is found.

    Null and empty texts stay, and so do rows without id; repeated rows are each judged; an empty table
    stays empty; with an empty benchmark all rows stay. Other columns pass through, whatever their names.
    """
    at, paths = docs.columns.index(text_col), blocks_of(benchmark, item_col, item_text_col)

    def work(batches):
        blocks = kept(("decontaminate", *paths), lambda: Blocks(paths))
        for b in slices(batches, ROWS_AT_ONCE):
            yield b.filter(pa.array([not x for x in leaks_of(b.column(at).to_pylist(), blocks)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find_leaks` of all of `benchmark` in all of `documents`; cases as stated there."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.round("similarity", 6).alias("similarity"))
