"""Secret scans: fixed forms, and random strings told from ordinary identifiers by Markov models.

Candidate strings are compared under first-order character models: one for ordinary identifiers,
one for each kind of random string. The log-likelihood ratio decides. The models are tables of
68 x 68 numbers, so what every task receives has a fixed size.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, slices, table, type_of
from tidemark.llm.pii import SPANS, joined

#: Kinds in order of report. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"(?:{'|'.join(map(either_case, NAMES))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Every name contains one of these; texts without any need no search.
NAME_PARTS = ("pass", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST = 20  # of candidates
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}(?![A-Za-z0-9+/_=-])")

SYMBOLS = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_.=-"
CODE = np.zeros(128, np.int64)
CODE[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
ALPHABETS = {"hex": string.digits + "abcdef", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "upper": string.ascii_uppercase + string.digits}


def transitions(samples) -> np.ndarray:
    """Counts of neighbouring symbols over all samples."""
    n = len(SYMBOLS)
    counts = np.zeros(n * n)
    for s in samples:
        x = CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        if len(x) > 1:
            counts += np.bincount(x[:-1] * n + x[1:], minlength=n * n)
    return counts.reshape(n, n)


def random_samples(alphabet: str, count: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(alphabet, k=draw.randint(20, 64))) for _ in range(count)]


def log_model(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    c = counts + smooth
    return np.log(c / c.sum(axis=1, keepdims=True))


#: Symbols of identifiers by byte (a dot ends one), and which of them are digits and letters.
IDENTIFIER_CODE = np.full(256, -1, np.int64)
IDENTIFIER_CODE[[ord(c) for c in SYMBOLS if c != "."]] = [k for k, c in enumerate(SYMBOLS) if c != "."]
IS_DIGIT = np.array([c.isdigit() for c in SYMBOLS])
IS_LETTER = np.array([c.isalpha() for c in SYMBOLS])
UPPER = np.array([SYMBOLS.index(c.upper()) for c in SYMBOLS])
LOWER = np.array([SYMBOLS.index(c.lower()) for c in SYMBOLS])


def ordinary_transitions(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbouring symbols in a text's ordinary identifiers, and of the first two of each.

    Runs of three symbols and more are identifiers. Labelled as ordinary are those too short for a
    candidate, and those without a digit or without a letter: random strings have both.
    """
    n = len(SYMBOLS)
    x = IDENTIFIER_CODE[np.frombuffer(text + b" ", np.uint8)]
    inside = x >= 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(n * n, np.int64), np.zeros(n * n, np.int64)
    mixed = np.logical_or.reduceat(inside & IS_DIGIT[x], begin) & np.logical_or.reduceat(inside & IS_LETTER[x], begin)
    good = (end - begin >= 3) & ((end - begin < SHORTEST) | ~mixed)
    pairs = x[:-1] * n + x[1:]
    taken = np.repeat(good, end - begin)
    at = np.flatnonzero(inside)[taken]
    at = at[inside[at + 1]]
    return np.bincount(pairs[at], minlength=n * n), np.bincount(pairs[begin[good]], minlength=n * n)


def with_cases(every: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts (n, n) with those of the same identifiers in upper and in capitalized form, so that shouting alone is not taken for randomness."""
    out = every.astype(float)
    upper, rest = np.ix_(UPPER, UPPER), every - first
    np.add.at(out, upper, every)
    np.add.at(out, np.ix_(UPPER, LOWER), first)
    np.add.at(out, np.ix_(LOWER, LOWER), rest)
    return out


def identifier_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Transition counts of the ordinary identifiers of all texts, without base finds.

    Tasks emit counts by pair of symbols, and Spark sums them: the driver receives 68 x 68 rows at most.
    """
    n = len(SYMBOLS)

    def count(batches):
        kept("secrets", dict)  # lets go of what other stages kept
        every, first = np.zeros(n * n, np.int64), np.zeros(n * n, np.int64)
        for b in slices(batches):
            pieces = []
            for t in b.column(0).to_pylist():
                if t:
                    at = 0
                    for _, s, e in base_spans(t):
                        pieces.append(t[at:s])
                        at = max(at, e)
                    pieces.append(t[at:])
            more = ordinary_transitions(" ".join(pieces).encode("utf-8", "surrogatepass"))
            every, first = every + more[0], first + more[1]
        own = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(every[own]), pa.array(first[own])], names=["pair", "n", "first"])

    rows = docs.select(text_col).mapInArrow(count, "pair bigint, n bigint, first bigint").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).collect()  # one row a pair of symbols
    every, first = np.zeros(n * n), np.zeros(n * n)
    for r in rows:
        every[r["pair"]], first[r["pair"]] = r["n"], r["first"]
    return with_cases(every.reshape(n, n), first.reshape(n, n))


def ratios(ordinary: np.ndarray, samples: int = 3000, seed: int = 11) -> np.ndarray:
    """For each kind of random string, log P(random) - log P(ordinary) of each transition."""
    usual = log_model(ordinary)
    return np.stack([log_model(transitions(random_samples(a, samples, seed + k))) - usual for k, a in enumerate(ALPHABETS.values())])


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    if not text:
        return []
    spans = []
    low = text.lower()
    if any(x in low for x in NAME_PARTS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str | None, models: np.ndarray, margin: float) -> list[tuple[str, int, int]]:
    """Candidates of which some random model is better than the ordinary one by `margin` a symbol."""
    spans = []
    for m in CANDIDATE.finditer(text or ""):
        x = CODE[np.frombuffer(m[0].encode("ascii"), np.uint8)]
        if models[:, x[:-1], x[1:]].sum(axis=1).max() > margin * (len(x) - 1):
            spans.append(("random", *m.span()))
    return spans


def spans_of(text: str | None, models: np.ndarray, margin: float) -> list[tuple[str, int, int]]:
    """Base spans, and random ones that no base span touches, as (kind, start, end) by start, then kind."""
    base = base_spans(text)
    more = [r for r in random_spans(text, models, margin) if all(r[2] <= s or r[1] >= e for _, s, e in base)]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.5) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row for each row of `docs`, whole texts.

    The ordinary model learns from the identifiers of all texts, labelled by rule; every text is scanned,
    whole, with memory in proportion to a few texts. Ties between a random kind and the ordinary one count
    as ordinary. A null or empty text has no spans and teaches nothing; a null id stays null; repeated rows are each answered; an empty table gives an
    empty table; other columns are not read, so their names cannot clash.
    """
    models = ratios(identifier_counts(docs, text_col))

    def work(batches):
        for b in slices(batches):
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, models, margin)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, SPANS)], names=[id_col, "spans"])

    schema = f"`{id_col}` {type_of(docs, id_col)}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find_secrets` on all of `documents`, with counts and digests of the spans; cases as stated there."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(of("random")).cast("long").alias("n_random"),
        F.size("spans").cast("long").alias("n_spans"),
    )
