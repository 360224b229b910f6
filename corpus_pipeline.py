"""A corpus from raw documents: known languages, no near-duplicates, no benchmark items, target mix, token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns
of documents; the last returns what its token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, langid, minmax, mixing, tokenbin
from tidemark.llm.common import drop_written, new_path, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from the labelled ones among them.

    Null and empty texts, and those without a letter, go. Rows without id and repeated rows are each judged;
    an empty table stays empty; other columns pass through.
    """
    return langid.keep_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles: the one of the smallest id.

    Rows of one id are one document, of which the row with the smallest text stays; rows without id stay,
    and so do texts without words. An empty table stays empty; other columns pass through.
    """
    return minmax.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items.

    Null and empty texts and rows without id stay; repeated rows are each judged; an empty table stays
    empty, and an empty benchmark leaves all; other columns pass through.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them: as many words as there are, each at most twice.

    Null languages and sources are a leaf of their own; texts without words cost nothing and follow their
    hash; rows of one id are taken together; an empty table stays empty; other columns pass through.
    """
    return mixing.mixed(docs, mixing.document_keys(), mixing.WEIGHTS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files.

    Null and empty texts are their end id alone; rows without id come first; repeated rows are each
    written, in order of their text; an empty table gives no rows; other columns are not read.
    """
    out = new_path(spark, "corpus")
    tokenbin.write_tokens(docs, out, tokenbin.default_tokenizer())
    return tokenbin.read_tokens(spark, out)


STAGES = [("language", language), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("tokens", token_files)]

#: Learned models, groups and a tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's rows are written, and removed once the next one's are."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            drop_written(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
