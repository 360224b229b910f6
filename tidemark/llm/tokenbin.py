"""Token ids as flat binary files.

A data set is a folder. Each part has four flat little-endian files: `.ids` (unsigned ids of all its
documents, one after the other, of 16 bits if the vocabulary and the end id allow, else of 32), `.off` (signed 64-bit: where each document begins in the
part, and the part's length at the end), `.doc` (signed 64-bit document ids) and `.has` (a byte for
each document: 1 if its id is not null). Parts follow each other in ascending order of document id;
`manifest.json` lists them with their bases, the prefix sums of their lengths. A reader maps the
files into memory and addresses any document without reading others.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
import zlib
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, new_path, slices, table

END_ID = 1
#: What a worker process keeps: about 110 MB.
CACHED_CHUNKS, CACHED_PARTS = 700_000, 450_000
#: Bytes of text that a part has on average, at most.
PART_BYTES = 256_000_000
#: Names of files that are being written begin with this.
UNFINISHED = ".writing-"
#: Python's split() takes these for white space, the tokenizers' patterns don't.
ODD_SPACES = re.compile("[\x1c-\x1f]")


class Encoder:
    """Ids of whole texts by a tokenizer file.

    A tokenizer that splits at white space and drops it gives a text the ids of its chunks between white
    space in turn; closing punctuation behind a letter or digit is a part of its own. Each different part is
    encoded once and then kept, up to a bound. Words of letters are encoded many at a time and told apart
    by the vocabulary's word ends: if there are as many ends as words, each word has one. Tokenizers of
    another kind, and texts with characters whose standing as white space is in dispute, are not cut.
    """

    CLOSING, GROUP = ".,;:!?", 256

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        largest = max(end_id, *vocabulary.values())
        self.dtype = "<u2" if largest < 1 << 16 else "<u4"
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(largest + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        probe = self.encode(["One two, (three).\n Four", "One", "two", ",", "(three", ").", "Four"])
        self.cuts = bool(suffix) and probe[0] == b"".join(probe[1:])
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def part_of(self, chunk: str) -> tuple[str, str]:
        """A chunk without its closing punctuation, and that."""
        if not chunk.isascii():
            return chunk, ""
        word = chunk.rstrip(self.CLOSING)
        if not word[-1:].isalnum():
            return chunk, ""
        return word.lower() if self.lower else word, chunk[len(word) :]

    def learn(self, chunks: list[str]) -> None:
        """Adds chunks that are not kept yet."""
        cut = [self.part_of(c) for c in chunks]
        new = {p for pair in cut for p in pair if p}.difference(self.parts)
        words = [p for p in new if p.isalpha()]
        rest = [p for p in new if not p.isalpha()]
        groups = [words[k : k + self.GROUP] for k in range(0, len(words), self.GROUP)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, self.dtype)
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) == len(group) and to[-1] == len(ids):
                raw, width, at = ids.tobytes(), ids.itemsize, 0
                for word, end in zip(group, (to * width).tolist(), strict=True):
                    self.parts[word] = raw[at:end]
                    at = end
            else:
                rest += group
        self.parts.update(zip(rest, self.encode(rest), strict=True))
        self.chunks.update((c, self.parts[p] + (self.parts[q] if q else b"")) for c, (p, q) in zip(chunks, cut, strict=True))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, as wide as `dtype`, without an end id."""
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        split = [None if not t else [t] if not self.cuts or ODD_SPACES.search(t) else t.split() for t in texts]
        if self.cuts and (new := {c for own in split if own for c in own}.difference(self.chunks)):
            odd = {own[0] for t, own in zip(texts, split, strict=True) if own and own[0] is t}
            self.chunks.update(zip(odd, self.encode(list(odd)), strict=True))
            self.learn(list(new - odd))
        elif not self.cuts:
            whole = [own[0] for own in split if own]
            self.chunks = dict(zip(whole, self.encode(whole), strict=True))
        return [b"".join(map(self.chunks.__getitem__, own)) if own else b"" for own in split]


def encoder_of(path: str, end_id: int) -> Encoder:
    """One for each worker process, so that chunks stay known from task to task."""
    return kept(("tokens", path, end_id), lambda: Encoder(path, end_id))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@contextmanager
def put(path: str):
    """A stream whose file appears under its name when all is written: a second attempt at a task replaces whole files only."""
    store, at = store_of(path)
    folder, _, name = at.rpartition("/")
    own = f"{folder}/{UNFINISHED}{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(own) as f:
        yield f
    store.move(own, at)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where the folder is mounted, else read."""
    store, at = store_of(path)
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.getsize(at):
            return np.empty(0, dtype)
        with open(at, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, partitions: int | None = None) -> dict:
    """Writes all rows of `docs` in ascending order of id; returns the manifest.

    The files are written as the rows come, so a task holds a few texts at a time; a part's share of the
    texts is PART_BYTES at most on average, unless `partitions` says how many there are. Null ids come
    first; rows with equal ids stand in order of their text (null first). A null or
    empty text is its end id alone. An empty table gives a data set without parts. Other columns are
    not read. The tokenizer file is opened on each executor from `tokenizer_path`.
    """
    spark = docs.sparkSession
    if partitions is None:
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    store, at = store_of(out_dir)
    store.create_dir(at, recursive=True)

    def work(batches):
        encoder, part = encoder_of(tokenizer_path, end_id), TaskContext.get().partitionId()
        width, end = np.dtype(encoder.dtype).itemsize, np.array([end_id], encoder.dtype).tobytes()
        first = next(batches, None)
        if first is None:
            return
        name, docs, tokens = f"{out_dir}/part-{part:06d}", 0, 0
        with put(f"{name}.ids") as ids, put(f"{name}.off") as off, put(f"{name}.doc") as doc, put(f"{name}.has") as has:
            for b in slices(chain([first], batches), 64):  # written as they come
                pieces = [x + end for x in encoder.ids(b.column(1).to_pylist())]
                for x in pieces:
                    ids.write(x)
                lengths = np.fromiter((len(x) // width for x in pieces), np.int64, len(pieces))
                ends = tokens + np.cumsum(lengths)
                off.write((ends - lengths).astype("<i8").tobytes())
                doc.write(np.asarray(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), "<i8").tobytes())
                has.write(np.asarray(b.column(0).is_valid().to_numpy(zero_copy_only=False), "u1").tobytes())
                docs, tokens = docs + b.num_rows, int(ends[-1]) if len(ends) else tokens
            off.write(np.array([tokens], "<i8").tobytes())
        if docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "tokens": [tokens]})

    dtype = Encoder(tokenizer_path, end_id).dtype
    dealt = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    # a text's beginning parts rows of equal id and keeps their order; whole texts would be sampled into the driver
    dealt = dealt.repartitionByRange(partitions, "i", F.substring("t", 1, 32)).sortWithinPartitions("i", "t")
    rows = sorted(dealt.mapInArrow(work, "part bigint, docs bigint, tokens bigint").collect())  # a row for each partition
    for f in store.get_file_info(fs.FileSelector(at)):  # of attempts that were lost
        if f.base_name.startswith(UNFINISHED):
            store.delete_file(f.path)
    parts, base, first = [], 0, 0
    for part, count, tokens in rows:
        parts.append({"name": f"part-{part:06d}", "docs": count, "tokens": tokens, "base": base, "first": first})
        base, first = base + tokens, first + count
    manifest = {"format": "flat", "dtype": dtype, "end_id": end_id, "docs": first, "tokens": base, "parts": parts}
    with put(f"{out_dir}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files, a row for each document."""
    store, at = store_of(f"{out_dir}/manifest.json")
    with store.open_input_file(at) as f:
        manifest = json.loads(f.read())
    parts, dtype = manifest["parts"], manifest["dtype"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    if not parts:
        return spark.createDataFrame([], schema)

    def work(batches):
        kept("tokens-read", dict)  # the encoder goes
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, off = mapped(f"{out_dir}/{name}.ids", dtype), mapped(f"{out_dir}/{name}.off", "<i8")
                doc, has = mapped(f"{out_dir}/{name}.doc", "<i8"), mapped(f"{out_dir}/{name}.has", "u1")
                for k in range(0, len(doc), 4096):
                    o = off[k : k + 4097]
                    cut = [ids[a:e] for a, e in zip(o[:-1], o[1:], strict=True)]
                    out = {"doc_id": pa.array(doc[k : k + 4096], mask=has[k : k + 4096] == 0), "start": base + o[:-1], "n_tokens": np.diff(o), "ids_crc32": pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([c.astype("i8") for c in cut], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    listed = spark.createDataFrame([(p["name"], p["base"]) for p in parts], "name string, base bigint")
    return listed.repartition(len(parts)).mapInArrow(work, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` written by `write_tokens` and read back from the files; cases as stated there."""
    out_dir = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out_dir, default_tokenizer())
    return read_tokens(spark, out_dir)
