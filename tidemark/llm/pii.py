"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, address schemes and
identifier cues. A deterministic local parser for each kind of anchor then expands to the
boundaries of the value and validates it. The automaton has a fixed size, a text is read once, and
each row is worked on alone: no shuffle, and a lost executor costs its own rows only.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, slices, table, type_of

#: Kinds in order of report. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "address")
BASE = KINDS[:4]

SCHEMES = tuple(form(s) for s in ("http://", "https://", "ftp://") for form in (str.lower, str.upper, str.capitalize))
IBAN_CUES = ("IBAN", "iban", "Iban")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "Kontonummer", "cuenta", "Cuenta", "compte", "Compte")
STREET_CUES = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive", " Square", " Court", " Terrace", " Way", " St.", " Ave.", " Rd.", " Blvd.", " Dr.")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
RUN = re.compile(r"[0-9]+")
DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_TAIL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
URL_HOST = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::[0-9]{1,5})?(?=[/?#]|$)")
IBAN_TAIL = re.compile(r"[\x20:#-]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT_TAIL = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|num\.?))?[\x20:#-]{1,3}([0-9](?:-?[0-9]){5,16})(?![0-9A-Za-z])")
HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?$")
#: Words of a street's name at most.
NAME_WORDS = 3


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> "ahocorasick.Automaton":
    found = ahocorasick.Automaton()
    anchors = [("@", "email"), ("+", "phone"), *((str(d), "digit") for d in range(10))]
    anchors += [(x, "url") for x in SCHEMES] + [(x, "iban") for x in IBAN_CUES]
    anchors += [(x, "account") for x in ACCOUNT_CUES] + [(x, "address") for x in STREET_CUES]
    for text, kind in anchors:
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


def small_parts(dotted: str) -> bool:
    """Every part at most 255. Leading zeros and very long parts are settled without big numbers."""
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in dotted.split(".")))


def spans_of(text: str | None, found: "ahocorasick.Automaton") -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end) in code points, by kind, then start."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    past = dict.fromkeys(KINDS, 0)  # of each kind, where its last candidate ended: matches don't overlap
    run_end = 0
    for last, (anchor, size) in found.iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at < run_end:
                continue
            run_end = RUN.match(text, at).end()
            if at >= past["ip"] and (m := DOTTED.match(text, at)):
                past["ip"] = m.end()
                if small_parts(m[0]):
                    spans.append(("ip", at, m.end()))
            if at >= past["card"] and (m := DIGITS.match(text, at)):
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, m.end()))
        elif anchor == "email":
            start = at
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                past["email"] = m.end()
                spans.append(("email", start, m.end()))
        elif anchor == "phone":
            if at >= past["phone"] and (m := DIAL.match(text, at)):
                past["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, m.end()))
        elif anchor == "url":
            if at >= past["url"] and (m := URL_TAIL.match(text, last + 1)):
                tail = m[0].rstrip(".,;:!?'")
                while tail.endswith(")") and tail.count("(") < tail.count(")"):
                    tail = tail[:-1]
                if URL_HOST.match(tail.rpartition("@")[2] if "/" not in tail.rpartition("@")[0] else tail):
                    past["url"] = last + 1 + len(tail)
                    spans.append(("url", at, past["url"]))
        elif anchor == "iban":
            if at >= past["iban"] and (m := IBAN_TAIL.match(text, last + 1)) and mod97(m[1].replace(" ", "")):
                past["iban"] = m.end(1)
                spans.append(("iban", m.start(1), m.end(1)))
        elif anchor == "account":
            if at >= past["account"] and (m := ACCOUNT_TAIL.match(text, last + 1)):
                past["account"] = m.end(1)
                spans.append(("account", m.start(1), m.end(1)))
        elif not text[last + 1 : last + 2].isalpha():
            if (start := house_before(text, past["address"], at)) is not None:
                past["address"] = last + 1
                spans.append(("address", start, last + 1))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def house_before(text: str, low: int, end: int) -> int | None:
    """Where a house number begins, not before `low`, that one to NAME_WORDS capitalized words up to `end` follow."""
    at = end
    for _ in range(NAME_WORDS):
        last = at
        while at > low and "a" <= text[at - 1] <= "z":
            at -= 1
        if at == last or at < low + 2 or not "A" <= text[at - 1] <= "Z" or text[at - 2] != " ":
            return None
        at -= 2
        if m := HOUSE.search(text, max(low, at - 6), at):
            return m.start()
    return None


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row for each row of `docs`, whole texts.

    A null or empty text has no spans; a null id stays null; repeated rows are each answered; an
    empty table gives an empty table; other columns are not read, so their names cannot clash.
    Spans of one kind never overlap; spans of different kinds may. Very long texts are read in one
    pass with memory in proportion to the text.
    """

    def work(batches):
        found = kept("pii", automaton)
        for b in slices(batches):
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, found)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, SPANS)], names=[id_col, "spans"])

    schema = f"`{id_col}` {type_of(docs, id_col)}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(work, schema)


def joined(spans) -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`find_pii` on all of `documents`, with counts and digests of the spans; cases as stated there."""
    found = find_pii(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[4:]),
        F.size("spans").cast("long").alias("n_spans"),
    )
