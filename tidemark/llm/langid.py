"""Language identification, word first.

Known words score by their log frequency in each language; an unseen word backs off to its longest
known character n-grams. The model comes from a bounded sample of the labelled documents of each
language and is sent to every task; scoring reads each whole text once, without a shuffle: a text's
score is the sum of its words' rows in one table.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, kept, slices, table, type_of

RUNS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 4
#: Unseen words whose scores a worker process keeps.
CACHED_WORDS = 100_000
#: Words of texts that are scored together, unless one text has more.
WORDS_AT_ONCE = 50_000


def words_in(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. What else a run of word characters holds parts it."""
    if not text:
        return []
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def add_grams(words: dict[str, int], longest: int) -> list[dict[str, int]]:
    """Counts of the n-grams of counted words, for each n from 1."""
    found: list[dict[str, int]] = [{} for _ in range(longest)]
    for w, k in words.items():
        for n, own in enumerate(found, 1):
            for x in grams_of(w, n):
                own[x] = own.get(x, 0) + k
    return found


class Table:
    """Log frequencies of keys in each language, a row a key."""

    def __init__(self, by: list[dict[str, int]]):
        """by: counts of keys, by language in order."""
        self.row = {x: k for k, x in enumerate(sorted({x for c in by for x in c}))}
        counts = np.zeros((len(self.row), len(by)))
        for g, c in enumerate(by):
            counts[[self.row[x] for x in c], g] = list(c.values())
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(self.row) + 1)))


class WordBackoff:
    """Log frequencies of words and of n-grams for each language."""

    def __init__(self, counts: dict[str, dict[str, int]], longest: int = LONGEST, penalty: float = 1.0, grams: dict[str, list[dict[str, int]]] | None = None):
        """counts: of words by language. longest: n of the longest n-gram. penalty: added log cost of backing
        off. grams: counts of n-grams by language, from n = 1; made of the words where they are not given."""
        self.langs = sorted(counts)
        self.longest, self.penalty, self.name = longest, penalty, uuid.uuid4().hex
        words = Table([counts[g] for g in self.langs])
        self.words, self.logs = words.row, words.logs - words.logs.mean(axis=1, keepdims=True) if self.langs else words.logs
        own = [grams[g] if grams else add_grams(counts[g], longest) for g in self.langs]
        self.grams = [Table([x[n] for x in own]) for n in range(longest)]

    def of_word(self, word: str) -> np.ndarray:
        """Log score of a word for each language, less their mean: only differences decide."""
        if (row := self.words.get(word)) is not None:
            return self.logs[row]
        score = np.zeros(len(self.langs))
        for n in range(self.longest, 0, -1):
            known = self.grams[n - 1]
            if found := [r for x in grams_of(word, n) if (r := known.row.get(x)) is not None]:
                score = (known.logs[found].sum(axis=0) - self.penalty * (self.longest - n)) / n
                break
        return score - score.mean()

    def predict(self, text: str | None) -> tuple[str, float]:
        return Scorer(self).predict([text])[0]


class Scorer:
    """A model at work: the rows of its words, and of unseen words up to a bound."""

    def __init__(self, model: WordBackoff):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.unseen: dict[str, int] = {}
        self.rows = self.model.logs

    def learn(self, words: list[str]) -> None:
        """Adds rows for words that have none."""
        n = len(self.model.words) + len(self.unseen)
        if n + len(words) > len(self.rows):  # grows by halves, so that few copies are made
            room = max(len(words), len(self.unseen) // 2, 1024)
            self.rows = np.concatenate([self.rows[:n], np.empty((room, len(self.model.langs)))])
        for k, w in enumerate(words):
            self.rows[n + k] = self.model.of_word(w)
        self.unseen.update(zip(words, range(n, n + len(words)), strict=True))

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """The summed scores of texts, none of them without words."""
        if len(self.unseen) > CACHED_WORDS:
            self.forget()
        flat = [w for t in texts for w in t]
        known, unseen = self.model.words, self.unseen
        rows = [known.get(w, -1) for w in flat]
        if -1 in rows:
            self.learn(list({w for w, r in zip(flat, rows, strict=True) if r < 0}.difference(unseen)))
            rows = [unseen[w] if r < 0 else r for w, r in zip(flat, rows, strict=True)]
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        return np.add.reduceat(self.rows[np.array(rows)], starts, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The best language of each text (the first by name among equals) and its posterior over the learned ones."""
        out, group, places, size = [(UNKNOWN, 0.0)] * len(texts), [], [], 0
        for k, t in enumerate(texts):
            if (words := words_in(t)) and self.model.langs:
                group.append(words)
                places.append(k)
                size += len(words)
            if group and (size > WORDS_AT_ONCE or k == len(texts) - 1):
                total = self.sums(group)
                best = total.argmax(axis=1)
                share = 1 / np.exp(np.clip(total - total[np.arange(len(best)), best][:, None], -700, 0)).sum(axis=1)
                for at, b, s in zip(places, best.tolist(), share.tolist(), strict=True):
                    out[at] = self.model.langs[b], s
                group, places, size = [], [], 0
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 2000) -> WordBackoff:
    """A model from about `max_docs` labelled documents of each language, none of them held out.

    A language's documents are those whose hash of the id is below a threshold that its number of
    labelled documents sets; a language with fewer is learned in full, so that rare ones are learned
    too. All words of the sample count, whole texts. The driver receives its counts alone. Null
    languages, null texts and rows without id teach nothing; repeated rows count each; an empty table
    gives a model that knows no language.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g"))
    labelled = labelled.where(F.col("g").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    sizes = labelled.groupBy("g").count().collect()  # a row for each language
    rate = [(r["g"], min(1.0, max_docs / r["count"])) for r in sizes]
    rates = docs.sparkSession.createDataFrame(rate, "g string, rate double")
    place = F.shiftrightunsigned(F.xxhash64("i"), 11) / F.lit(float(1 << 53))
    sample = labelled.join(F.broadcast(rates), "g").where(place < F.col("rate")).select("t", "g")  # a row for each language

    def count(batches):
        kept("langid-learn", dict)  # lets go of what other stages kept
        found: dict[str, dict[str, int]] = {}
        for b in slices(batches):
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = found.setdefault(g, {})
                for w in words_in(t):
                    own[w] = own.get(w, 0) + 1
        for g, words in found.items():
            for n, own in enumerate([words, *add_grams(words, LONGEST)]):
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.string()), pa.array([n] * len(own), pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["g", "n", "x", "k"])

    counts = sample.mapInArrow(count, "g string, n int, x string, k bigint").groupBy("g", "n", "x").agg(F.sum("k").alias("k"))
    # a language's counts as parallel arrays would be one row; as rows they arrive partition by partition
    by: dict[str, list[dict[str, int]]] = {}
    for g, n, x, k in counts.toLocalIterator(prefetchPartitions=True):
        by.setdefault(g, [{} for _ in range(LONGEST + 1)])[n][x] = k
    return WordBackoff({g: c[0] for g, c in by.items()}, grams={g: c[1:] for g, c in by.items()})


def scorer_of(sent) -> Scorer:
    """This process's scorer, kept from task to task of the same model."""
    return kept(("langid", sent.value.name), lambda: Scorer(sent.value))


def predict(docs: DataFrame, model: WordBackoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row for each row of `docs`, from whole texts alone.

    A null text, one without letters, or a model that learned nothing gives `und` with score 0. A null
    id stays null; repeated rows are each answered; an empty table gives an empty table; other columns
    are not read. Equal scores give the language that is first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        own = scorer_of(sent)
        for b in slices(batches):
            out = own.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {type_of(docs, id_col)}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: WordBackoff, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, whose language is known with a posterior of `least` or more.

    Null texts and texts without letters go, and all rows if the model learned nothing. Rows without id
    and repeated rows are each judged by their text; an empty table stays empty; other columns pass
    through, whatever their names.
    """
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        own = scorer_of(sent)
        for b in slices(batches):
            found = own.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([g != UNKNOWN and s >= least for g, s in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`predict` on all of `documents`, learned from its own rows that are not held out; cases as stated there."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
