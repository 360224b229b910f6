"""A durable log of change events: parquet segments by ranges of positions, in a folder that all share.

Positions are dense: each event's is one more than the last one's. A reader that is within what the log
keeps reads on from its own position; one that is not must start over from a snapshot (`Reset`).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.cdc import EVENTS

SEGMENT = re.compile(r"segment-(\d{20})-(\d{20})")


class Reset(Exception):
    """The position cannot be read on from: pruned, ahead of the log, or behind a hole."""


class ChangeLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[tuple[int, int, str]]:
        """(first, last, path) of each segment, in order."""
        path, fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(m[1]), int(m[2]), f"{self.folder}/{n}") for n in names if (m := SEGMENT.fullmatch(n)))

    @property
    def head(self) -> int:
        """The last position; -1 in an empty log."""
        found = self.segments()
        return found[-1][1] if found else -1

    def append(self, events: DataFrame) -> int:
        """Adds the events behind the head, each once, and returns the new head.

        An event that is sent again is left out. A hole, between the head and the events or among them, is
        an error and nothing is written.
        """
        head = self.head
        new = events.where(F.col("pos") > head).dropDuplicates(["pos"]).persist()
        try:
            first, last, n = new.agg(F.min("pos"), F.max("pos"), F.count("*")).first()
            if not n:
                return head
            if last - first + 1 != n or (head >= 0 and first != head + 1):
                raise ValueError(f"positions {first} to {last} leave a hole behind {head}")
            own = f"{self.folder}/.segment-{uuid.uuid4().hex}"
            new.write.parquet(own)
        finally:
            new.unpersist()
        jpath, (_, fs) = self.spark._jvm.org.apache.hadoop.fs.Path, self._fs()
        if not fs.rename(jpath(own), jpath(f"{self.folder}/segment-{first:020d}-{last:020d}")):
            raise RuntimeError("another writer has appended these positions")
        return last

    def read_after(self, pos: int) -> DataFrame:
        """Events behind `pos`. Raises Reset where some of them are not in the log any more, or `pos` is ahead of it."""
        found = self.segments()
        if not found:
            if pos > -1:
                raise Reset(f"{pos} is ahead of the log")
            return self.spark.createDataFrame([], EVENTS)
        if pos > found[-1][1]:
            raise Reset(f"{pos} is ahead of the log")
        wanted = [s for s in found if s[1] > pos]
        at = pos
        for first, last, _ in wanted:
            if first > at + 1:
                raise Reset(f"nothing is kept of the positions from {at + 1} to {first - 1}")
            at = max(at, last)
        if not wanted:
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(*(p for *_, p in wanted)).where(F.col("pos") > pos)

    def prune_before(self, pos: int) -> None:
        """Drops segments all of whose events are before `pos`; the newest stays, so that the head is known."""
        jpath, (_, fs) = self.spark._jvm.org.apache.hadoop.fs.Path, self._fs()
        for _, last, path in self.segments()[:-1]:
            if last < pos:
                fs.delete(jpath(path), True)


def catch_up(replica, log: ChangeLog, snapshot=None) -> dict[str, DataFrame]:
    """Applies to a replica what the log has behind its position; the changes of its queries.

    Where the log cannot serve that position, `snapshot()` gives (tables, position) to start over from.
    """
    try:
        return replica.apply(log.read_after(replica.state["pos"]))
    except Reset:
        if snapshot is None:
            raise
        replica.replace(*snapshot())
        return replica.apply(log.read_after(replica.state["pos"]))
