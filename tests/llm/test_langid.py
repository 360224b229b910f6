import math

from tidemark.llm import langid
from tidemark.llm.common import held_out

DIR = "/root/testdata/sf0.01"


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = langid.op8_langid(spark, DIR).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 150 and right >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_word_first_then_longest_grams():
    m = langid.WordBackoff({"a": {"foo": 3, "bar": 1}, "b": {"foo": 1, "quux": 4}}, longest=3)
    known = sorted({"foo", "bar", "quux"})
    logs = [[math.log((c.get("foo", 0) + 0.5) / (sum(c.values()) + 0.5 * (len(known) + 1))) for c in ({"foo": 3, "bar": 1}, {"foo": 1, "quux": 4})]][0]
    mean = sum(logs) / 2
    assert all(abs(x - (y - mean)) < 1e-9 for x, y in zip(m.of_word("foo"), logs))
    assert m.of_word("quu")[1] > m.of_word("quu")[0]  # unseen: its trigrams are of b
    assert m.of_word("zzz").tolist() == (m.of_word("zzz") * 1).tolist()
    assert m.predict("foo foo")[0] == "a" and m.predict("12 !?") == ("und", 0.0) and m.predict(None) == ("und", 0.0)


def test_rows(spark):
    rows = [(k, t, g, 1, "z") for k, (t, g) in enumerate([("der die das", "de"), ("the and of", "en")] * 20)]
    rows += [(100, None, "de", 0, "z"), (101, "", None, 0, "z"), (None, "the", "en", 0, "z"), (102, "42", "en", None, None), (103, "the " * 100_000, None, 0, "z"), (0, "der die das", "de", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    model = langid.learn(docs)
    out = langid.predict(docs, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und"
    assert by[None].lang_pred == by[103].lang_pred == "en" and by[0].lang_pred == "de"
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = docs.limit(0)
    assert langid.predict(none, langid.learn(none)).count() == 0
    assert langid.predict(docs, langid.learn(none)).where("lang_pred <> 'und'").count() == 0


def test_no_held_out_label_is_learned(spark):
    rows = [(k, f"word{chr(97 + k % 26)}{chr(97 + k // 26)}", "de") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    out = {r.text for r in docs.where(held_out(docs.doc_id)).collect()}
    assert out and not out & set(model.words) and len(model.words) + len(out) >= 299


def plainly(model, text):
    """The same score, word by word."""
    total, words = [0.0] * len(model.langs), []
    word = ""
    for c in f"{(text or '').lower()} ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    for w in words:
        row = None
        if w in model.words:
            logs = model.logs[model.words[w]]
            row = [float(x) for x in logs]
        else:
            for n in range(model.longest, 0, -1):
                padded, t = f"^{w}$", model.grams[n - 1]
                known = [padded[k : k + n] for k in range(len(padded) - n + 1) if padded[k : k + n] in t.row]
                if known:
                    row = [(sum(float(t.logs[t.row[x]][g]) for x in known) - model.penalty * (model.longest - n)) / n for g in range(len(model.langs))]
                    break
            row = row or [0.0] * len(model.langs)
            row = [x - sum(row) / len(row) for x in row]
        total = [a + b for a, b in zip(total, row)]
    best = max(range(len(total)), key=lambda g: (total[g], -g))
    return model.langs[best], 1 / sum(math.exp(max(x - total[best], -700)) for x in total)


def test_scores_equal_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    for r in langid.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        lang, score = plainly(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6


def test_letters_in_mixed_runs():
    assert langid.words_in("m²x 3kg a_b Straße's") == ["m", "x", "kg", "a", "b", "straße", "s"]
    m = langid.WordBackoff({"a": {"foo": 3}, "b": {"bar": 4}})
    assert all(m.predict(t)[0] != "und" for t in ("x²", "²m", "1x", "ª")) and m.predict("²³ 4_5")[0] == "und"


def test_equal_scores_give_the_first_by_name():
    m = langid.WordBackoff({"b": {"foo": 2, "y": 1}, "a": {"foo": 2, "x": 1}})
    assert m.predict("foo foo") == ("a", 0.5)


def test_rare_languages_are_learned(spark):
    rows = [(k, f"the word number{k}", "en") for k in range(3000)] + [(5000 + k, "egy szo az", "hu") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, max_docs=100)
    assert model.langs == ["en", "hu"] and model.predict("az egy")[0] == "hu"
    assert 30 < sum(w.startswith("number") for w in model.words) + 30 < 250


def test_old_caches_go(spark):
    from tidemark.llm import common

    made = []
    assert common.kept("one", lambda: made.append(1) or "a") == "a" == common.kept("one", lambda: made.append(2))
    assert common.kept("two", lambda: "b") == "b" and common.kept("one", lambda: "c") == "c" and made == [1]
