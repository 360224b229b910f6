import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import secrets

ASSIGN = re.compile(r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


PIECES = st.sampled_from(["token", "Secret", "api_key", "APIKEY", "passwd", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH", "0123456789", "abcdef", "é", "\n", ".", "İ", "zz"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=20).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert secrets.base_spans(text) == brute(text)


def test_random_strings_and_identifiers(spark, tmp_path):
    words = "the tionality internationalization_of_configuration GetElementsByClassNameAndAttribute ungkeitenverpflichtungen " * 30
    rows = [(k, words, "z") for k in range(20)] + [(50, "key Zk3q9XvT7LmB2wRcYp8sQ4nD6h done", "z"), (51, None, None), (None, "", "z"), (52, "token = 0123456789ab", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in secrets.op2_secrets(spark, str(tmp_path)).collect()}
    assert out[50].spans == f"random:4:{4 + len('Zk3q9XvT7LmB2wRcYp8sQ4nD6h')}" and out[50].n_random == 1
    assert out[52].spans == "assign:0:20" and out[52].n_assign == 1
    assert out[51].spans == out[None].spans == ""
    assert all(out[k].spans == "" for k in range(20))
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_counts(text):
    """Transitions of a text's ordinary identifiers, one identifier after the other."""
    n = len(secrets.SYMBOLS)
    counts = {}
    for x in re.findall("[A-Za-z0-9+/_=-]{3,}", text):
        if len(x) >= 20 and re.search("[0-9]", x) and re.search("[A-Za-z]", x):
            continue
        for form in (x, x.upper(), x.capitalize()):
            for a, b in zip(form, form[1:]):
                pair = secrets.SYMBOLS.index(a) * n + secrets.SYMBOLS.index(b)
                counts[pair] = counts.get(pair, 0) + 1
    return counts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "Xyz", "a_b", "9", "0123456789", "abcdefghij", " ", ".", "é", "\n", "-", "Q"]), max_size=25).map("".join))
def test_transitions_equal_a_plain_loop(text):
    n = len(secrets.SYMBOLS)
    every, first = secrets.ordinary_transitions(text.encode())
    found = secrets.with_cases(every.reshape(n, n), first.reshape(n, n)).ravel()
    want = plain_counts(text)
    assert {k: found[k] for k in found.nonzero()[0]} == want


def test_precision_and_recall_of_random_strings(spark):
    """Labelled strings among a corpus's own texts: random ones are found, identifiers are left alone."""
    import random

    draw = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    parts = sorted({w.strip(".,;:!?").lower() for r in docs.limit(300).collect() for w in (r.text or "").split() if w.isascii() and w.strip(".,;:!?").isalpha() and 3 < len(w) < 9})
    join = (lambda w: "_".join(w), lambda w: "".join(x.capitalize() for x in w), lambda w: "/".join(w), lambda w: "-".join(w), lambda w: "_".join(w).upper())
    plain = [x for _ in range(600) if len(x := draw.choice(join)(draw.choices(parts, k=draw.randint(4, 6)))) >= 20]
    secret = ["".join(draw.choices(a, k=draw.randint(20, 48))) for a in secrets.ALPHABETS.values() for _ in range(150) if a != secrets.ALPHABETS["hex"]]
    rows = [(10**6 + k, f"see {x} there") for k, x in enumerate(plain + secret)]
    found = secrets.find_secrets(docs.union(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 1000000").collect()
    hit = {r.doc_id - 10**6 for r in found if any(s.kind == "random" for s in r.spans)}
    recall, wrong = sum(k >= len(plain) for k in hit) / len(secret), sum(k < len(plain) for k in hit)
    print("random strings found", recall, "identifiers marked", wrong, "of", len(plain))
    assert recall >= 0.97 and wrong <= 0.02 * len(plain)
