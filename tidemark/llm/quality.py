"""Quality rules: rules of a document, then a verdict on its host. DataFrame functions only.

The counts of a document are taken inside its row: no words are exploded and nothing is shuffled for
them. They are written once, slim, and read twice: summed by host (pre-aggregated, so that a hot host
costs each task one row), and joined with the host's verdict, which goes to where the documents are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, WORD_BREAK, table, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Rules beyond the base: per cent of symbols in all word characters, per cent of repeated lines, mean word length.
MOST_SYMBOLS, MOST_LINES, WORD_LENGTHS = 10, 30, (2, 25)
#: A host fails if more than this share of its documents is expected to fail, after shrinking.
MOST_FAILED = 0.5
#: The prior's weight in documents, where the hosts' rates don't tell it.
DEFAULT_WEIGHT = 10.0
#: So many hosts' verdicts, some MB, are sent to all tasks; more are joined.
SENT_HOSTS = 100_000


def measured(docs: DataFrame, keys: list, text) -> DataFrame:
    """`keys` and the counts of each row. Projections follow each other so that each array is made once."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.select(
        *keys,
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    names = [n for n in out.columns if n not in ("words", "lines")]
    n = F.size("words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    repeated_lines = F.size("lines") - F.size(F.array_distinct("lines"))
    out = out.select(*names, n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), repeated_lines.cast("long").alias("n_dup_lines"), grams.alias("grams"))
    names += ["n_words", "n_lines", "n_dup_lines"]
    # windows by hash, then place; only texts in which some window returns
    ordered = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    out = out.select(*names, ordered.alias("ordered"))
    like = lambda x, k: F.coalesce(F.get("ordered", k)["g"] == x["g"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("ordered", lambda x, k: like(x, k - 1) | like(x, k + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate(places, start, lambda s, x: F.struct(x.alias("last"), (s["total"] + F.least(F.lit(WINDOW), x - s["last"])).alias("total")))["total"]
    return out.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_rules(counts: DataFrame) -> DataFrame:
    """base_failed and failed (any rule) of each row."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    low, high = WORD_LENGTHS
    more = (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_LINES * F.col("n_lines"))
    more |= (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words"))
    return counts.withColumn("base_failed", base).withColumn("failed", base | more)


def host_verdicts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(host, host_rate), each host's expected share of failed documents, shrunk to the rates of all hosts;
    and the number of hosts.

    The beta prior is fitted by moments to the hosts' own rates; where they are too few or too much
    alike or apart for that, its weight is DEFAULT_WEIGHT documents. Hosts are written, so that a join
    with them isn't tied to the aggregation's partitions.
    """
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f")), "hosts")
    rate = F.col("f") / F.col("n")
    mean, var, count = hosts.agg(F.avg(rate), F.var_samp(rate), F.count("*")).first()
    weight = mean * (1 - mean) / var - 1 if count > 2 and var else DEFAULT_WEIGHT
    weight = weight if weight > 0 else DEFAULT_WEIGHT
    return hosts.select("host", F.round((F.col("f") + F.lit((mean or 0.0) * weight)) / (F.col("n") + F.lit(weight)), 6).alias("host_rate")), count


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, counts, base_failed, failed, host_rate, kept), one row for each row of `docs`, whole texts.

    kept: no base rule failed and the host's rate is at most MOST_FAILED. A null text has no words and
    fails; rows without host share the host ''; a null id stays null; repeated rows are each judged and
    counted; an empty table gives an empty table; other columns are not read. Verdicts of up to
    SENT_HOSTS hosts go to the documents; of more hosts, both are dealt by host and a hot one is split.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    counts = measured(docs, [F.col(id_col).alias("id"), host.alias("host")], F.col(text_col))
    rows = with_rules(written(counts, "quality"))
    verdicts, hosts = host_verdicts(rows)
    out = rows.join(F.broadcast(verdicts) if hosts <= SENT_HOSTS else verdicts, "host")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= MOST_FAILED)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "host_rate", kept.alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`judge_quality` on all of `documents`, sources standing in for hosts; cases as stated there."""
    return judge_quality(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
with d as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), g as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)
), r as (
  select doc_id, count(distinct i + k) as n from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g), range(0, 5) as t(k) where c > 1 group by 1
), m as (
  select d.doc_id, host, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines) as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r using (doc_id)
), b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from m
), f as (
  select *, base_failed or 100 * n_symbols > {MOST_SYMBOLS} * word_chars or 100 * n_dup_lines > {MOST_LINES} * n_lines
    or word_chars < {WORD_LENGTHS[0]} * n_words or word_chars > {WORD_LENGTHS[1]} * n_words as failed from b
), h as (select host, count(*) as n, count(*) filter (failed) as f from f group by 1
), p as (select avg(f / n) as mean, var_samp(f / n) as var, count(*) as c from h
), q as (select mean, case when c > 2 and var > 0 and mean * (1 - mean) / var - 1 > 0 then mean * (1 - mean) / var - 1 else {DEFAULT_WEIGHT} end as weight from p
), v as (select host, round((f + mean * weight) / (n + weight), 6) as host_rate from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, host_rate, not base_failed and host_rate <= {MOST_FAILED} as kept
from f join v using (host)
"""
