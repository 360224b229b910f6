import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontaminate, test_minmax
from tidemark.llm import tokenbin
from tidemark.llm.common import table, written

DIR = "/root/testdata/sf0.001"


def test_stages_and_files_equal_brute_force(spark):
    docs = table(spark, DIR, "documents")
    names, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], DIR), name))
        assert kept[-1].columns == names
    start, known, apart, clean, mixed = ([(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()] for df in kept)
    assert all(any(c.isalpha() for c in t) for _, t in known) and len(known) >= 0.98 * len(start)
    root, _ = test_minmax.brute(known, 5, 80)
    assert apart == [r for r in known if root[r[0]] == r[0]]
    items = [tuple(r) for r in table(spark, DIR, "benchmark").select("item_id", "text").collect()]
    assert clean == [r for r in apart if not test_decontaminate.brute(r[1], items)]
    assert {*mixed} <= {*clean} and max(mixed.count(r) for r in mixed) <= 2
    whole, want, at = Tokenizer.from_file(tokenbin.default_tokenizer()), [], 0
    for i, t in mixed:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in corpus_pipeline.run(spark, DIR).orderBy("start").collect()] == want


def test_odd_rows_through_every_stage(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs along the river bank until night comes"
    item = "which of these rivers runs through the old town before it meets the sea at last"
    learned = [(1000 + k, f"{text} {' '.join(f'word{k}x{j}' for j in range(30))}", "en", "src0", 1, "l") for k in range(40)]
    rows = [(1, f"{text} one", "en", "src0", 1, None), (2, f"{text} one", "en", None, 2, "a"), (3, None, "en", "src1", 3, "a"), (4, "", None, "src1", 4, "a"), (None, f"{text} alone and without id but with many more words of its own to tell", "en", "src1", None, "a"), (5, "42 !?", "en", "src2", 5, "a")]
    rows += [(6, "the of and to in", "en", "src2", 1, "b"), (6, "the of and to in", "en", "src2", 1, "b"), (6, f"{text} {'many other words follow here ' * 3}", "en", "src2", 1, "c"), (7, f"{text} so {item} as they say", "en", "src0", 1, "a"), (8, "the night and the river " * 30_000, "en", "src0", 1, "a")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, copies string"
    docs = spark.createDataFrame(rows + learned, shape).withColumn("items", docs_one := test_minmax.minmax.F.lit(1)).withColumn("kept", docs_one).withColumn("own_id", docs_one)
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/some/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    for folder in ("some", "none"):
        now, seen = table(spark, f"{tmp_path}/{folder}", "documents"), []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, f"{tmp_path}/{folder}"), name)
            assert now.columns == docs.columns, name
            seen.append(sorted((r.doc_id for r in now.collect()), key=repr))
        out = corpus_pipeline.STAGES[-1][1](spark, now, f"{tmp_path}/{folder}")
        assert sorted((r.doc_id for r in out.collect()), key=repr) == seen[-1]
        if folder == "none":
            assert seen == [[], [], [], []]
            continue
        known, apart, clean = ({k for k in s if k is None or k < 1000} for s in seen[:3])
        assert known == {1, 2, None, 6, 7, 8} and apart == {1, None, 6, 7, 8} and clean == {1, None, 6, 8}
        assert seen[1].count(6) == 1 and len(seen[0]) == 7 + 40 + 1
