"""What the training-data operators share: word splitting, hashes of words, caches and held-out rows."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import drop_written, new_path, shared_dir, written  # noqa: F401

#: Words are runs of characters other than these.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: Rows of an Arrow batch that are worked on at once.
SLICE = 256
#: Word hashes that a worker process keeps; about 15 MB.
HASHES_KEPT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one, that is no column of `df`."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def held_out(column) -> "F.Column":
    """Documents whose labels no model may learn from: a fifth, by checksum of the id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes methods treat exactly these letters and spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_array(text) -> "F.Column":
    """The words of a text column as an array; empty for null and for texts without words."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return F.filter(parts, lambda w: w != "")


def slices(batches, rows: int = SLICE):
    """Arrow batches cut small, so that what Python makes of one at a time is small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class WordHashes(dict):
    """Hashes of words, kept up to HASHES_KEPT."""

    def __missing__(self, word) -> int:
        if len(self) >= HASHES_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


KNOWN = WordHashes()

#: What this worker process keeps from task to task, and of which operator.
_kept: dict = {"of": None, "what": None}


def kept(name, make):
    """What `make()` gave when this process first worked for `name`.

    Worker processes serve one stage after another. What was kept for another name is let go first and its
    memory returned, so that the caches of a pipeline's stages never add up.
    """
    if _kept["of"] != name:
        _kept["of"], _kept["what"] = None, None
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        _kept["what"] = make()
        _kept["of"] = name
    return _kept["what"]


def hashed(words: list) -> np.ndarray:
    """64-bit hashes of words, str or bytes."""
    return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))
