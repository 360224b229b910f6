import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokenbin

DIR = "/root/testdata/sf0.001"
WHOLE = Tokenizer.from_file(tokenbin.default_tokenizer())
CHUNKED = tokenbin.Encoder(tokenbin.default_tokenizer())


def brute(rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*WHOLE.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents_round_trip(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = [tuple(r) for r in tokenbin.op9_tokens(spark, DIR).orderBy("start").collect()]
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["don't", "'s", " ", "　", "\x1c", "\x85", "é", "̸", "<|endoftext|>", "İ", "ΑΣ", "​", "\n", "12"])), max_size=12).map("".join))
def test_chunks_give_the_ids_of_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(CHUNKED.ids([text])[0], CHUNKED.dtype).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_rows(spark, tmp_path):
    rows = [(3, "the end", "z", 0), (None, "no id", "z", 1), (1, None, "z", 2), (1, "", "z", 3), (2, "word " * 200_000, None, 4), (3, "the end", "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    out = f"file://{tmp_path}/x"
    manifest = tokenbin.write_tokens(docs, out, tokenbin.default_tokenizer())
    found = [tuple(r)[:4] for r in tokenbin.read_tokens(spark, out, with_ids=True).orderBy("start").collect()]
    assert found == brute([r[:2] for r in rows])
    assert manifest["docs"] == 6 and manifest["tokens"] == sum(r[2] for r in found)
    empty = f"file://{tmp_path}/y"
    assert tokenbin.write_tokens(docs.limit(0), empty, tokenbin.default_tokenizer())["parts"] == []
    assert tokenbin.read_tokens(spark, empty).count() == 0
