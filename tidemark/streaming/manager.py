"""Who wants which query: equal queries are one, and an unwanted one is kept for a while."""

from __future__ import annotations

import hashlib
import re
import time
from dataclasses import dataclass, field

from tidemark.plans.ast import Query, query

# fixed values: seconds by unit, the usual time to live and the longest
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
USUAL, LONGEST = 300.0, 600.0
FOREVER = float("inf")


def seconds(ttl) -> float:
    """A time to live as seconds: a number of them, '30s', '5m', '1h', '2d', 'none' or 'forever'; the usual one for anything else."""
    if ttl == "forever":
        return FOREVER
    if ttl == "none":
        return 0.0
    if isinstance(ttl, int | float):
        own = max(0.0, float(ttl))
    else:
        m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhd])", ttl)
        own = float(m[1]) * UNITS[m[2]] if m else USUAL
    return own if own == FOREVER else min(own, LONGEST)


def name_of(query: Query) -> str:
    """The name under which equal queries are one."""
    return "q" + hashlib.sha256(query.dumps().encode()).hexdigest()


@dataclass
class Wanted:
    query: Query
    count: int
    ttl: float
    since: float | None = None  # when the last release was


@dataclass
class QueryManager:
    """Subscribes a replica to what is wanted. `collect` ends what nobody has wanted for its time to live."""

    replica: object
    clock: object = time.time
    wanted: dict[str, Wanted] = field(default_factory=dict)
    released: dict = field(default_factory=dict)  # a client's name for a query -> what releases it

    def add(self, query: Query, ttl="5m"):
        """Registers interest; the name of the query and a function that releases it, once."""
        name = name_of(query)
        own = self.wanted.get(name)
        if own is None:
            if name not in self.replica.queries:
                self.replica.subscribe(name, query)
            own = self.wanted[name] = Wanted(query, 0, 0.0)
        own.count, own.ttl, own.since = own.count + 1, max(own.ttl, seconds(ttl)), None
        open_ = [True]

        def release() -> None:
            if open_:
                open_.clear()
                own.count -= 1
                if not own.count:
                    own.since = self.clock()
                    self.collect()

        return name, release

    def patch(self, steps: list[dict]) -> None:
        """Steps {op: put, hash, query, ttl?}, {op: del, hash} and {op: clear} that a client sends; `hash` is its own name for a query."""
        for s in steps:
            if s["op"] == "put":
                if s["hash"] not in self.released:
                    self.released[s["hash"]] = self.add(query(s["query"]), s.get("ttl", "5m"))[1]
            elif s["op"] == "del":
                self.released.pop(s["hash"], lambda: None)()
            elif s["op"] == "clear":
                while self.released:
                    self.released.popitem()[1]()
            else:
                raise ValueError(f"unknown step {s['op']}")

    def collect(self) -> list[str]:
        """Ends queries whose time is over; their names."""
        now = self.clock()
        over = sorted(n for n, w in self.wanted.items() if not w.count and w.ttl != FOREVER and now - w.since >= w.ttl)
        for name in over:
            del self.wanted[name]
            if name in self.replica.queries:
                self.replica.unsubscribe(name)
        return over

    def active(self) -> dict[str, Query]:
        return {n: w.query for n, w in self.wanted.items()}
