import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def valid(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and valid(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


PIECES = st.sampled_from(["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "25", "255", "256", "4111111111111111", "b.com", "x_y%", "\n", "🙂", "0005", "+49 30 123456", "IBAN "])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    found = [s for s in pii.spans_of(text, pii.automaton()) if s[0] in pii.BASE]
    assert found == brute(text)


def test_expanded_kinds():
    text = "See (https://www.example.org/a(b)?q=1). IBAN: DE89 3704 0044 0532 0130 00, account no. 1234-5678-90; 221 Baker Street. http://nothing accountant 7"
    found = [(k, text[s:e]) for k, s, e in pii.spans_of(text, pii.automaton())]
    assert ("url", "https://www.example.org/a(b)?q=1") in found
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found
    assert ("account", "1234-5678-90") in found
    assert ("address", "221 Baker Street") in found
    assert len([x for x in found if x[0] in pii.KINDS[4:]]) == 4


def test_rows(spark, tmp_path):
    long = "x" * 300_000 + " me@a.org"
    rows = [(1, "me@a.org 10.0.0.1", "z", 1), (2, None, None, None), (None, "", "z", 2), (1, "me@a.org 10.0.0.1", "z", 1), (3, long, "z", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int").write.parquet(f"{tmp_path}/documents.parquet")
    out = {(r.doc_id, r.n_email, r.spans): r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    assert set(out) == {(1, 1, "email:0:8,ip:9:17"), (2, 0, ""), (None, 0, ""), (3, 1, "email:300001:300009")}
    assert out[1, 1, "email:0:8,ip:9:17"].base_sha256 == hashlib.sha256(b"email:0:8,ip:9:17").hexdigest()
    assert pii.op1_pii(spark, str(tmp_path)).count() == 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(empty).count() == 0


ADDRESS = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?(?: [A-Z][a-z]+){1,3}? (?:Street|Lane)(?![A-Za-z])")
PLACES = st.sampled_from(["12", "7b", "123456", " ", " ", "Baker", "High", "Of", "x", " Street", " Lane", "(", "\n", "é", "A", "Streets"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PLACES, max_size=14).map("".join))
def test_addresses_equal_their_pattern(text):
    found = [s[1:] for s in pii.spans_of(text, pii.automaton()) if s[0] == "address"]
    assert found == [m.span() for m in ADDRESS.finditer(text)]


def test_long_street_names():
    name = "A" + "b" * 500
    assert pii.spans_of(f"at 5 {name} Street", pii.automaton()) == [("address", 3, 3 + 2 + 501 + 7)]
