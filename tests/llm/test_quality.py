import random

from tidemark.llm import quality


def brute(text):
    text = text or ""
    import re

    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    hit = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark):
    draw = random.Random(1)
    rows = [(k, "".join(draw.choices(["a", "b", "ab ", " ", "\n", "é", "🙂", "#", "\t", "\x0b", "\xa0", "\x85"], k=draw.choice([0, 3, 20, 80, 400]))), f"h{k % 5}") for k in range(300)]
    rows += [(900, None, "h"), (901, "", None), (902, "one two three four five " * 20_000, "h"), (None, " ", "h"), (903, "x" * 500_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", quality.F.lit(1)).withColumn("failed", quality.F.lit("z"))
    found = quality.judge_quality(docs).collect()
    assert len(found) == len(rows)
    want = {i: brute(t) for i, t, _ in rows}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_bad_hosts_and_clean_ones(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    rows = [(k, clean if k % 10 else "bad", "good") for k in range(100)] + [(100 + k, "bad" if k else clean, "poor") for k in range(60)] + [(200, clean, "new"), (201, clean, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judge_quality(docs).where("kept").collect()}
    assert kept == {k for k in range(100) if k % 10} | {200, 201}
