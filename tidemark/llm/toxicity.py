"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector and the scaled sum of the vectors of its character n-grams. Overlapping windows
cover every word of a text, a long one or a short one; a text's score is that of its worst window, in
training too: the label of a text is learned through the window that scores highest. Training takes
a bounded sample on the driver; the network has a fixed size and is sent to every task; scoring
reads each text once, without a shuffle.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, kept, slices, table, type_of, words_of

WINDOW, STRIDE = 32, 16
HIDDEN, SIZE, ATTENTION = 8, 8, 8
WORD_ROWS, GRAM_ROWS, GRAMS = 16_384, 16_384, (3, 6)
#: Words whose projected inputs a worker process keeps: about 60 MB.
WORDS_KEPT = 200_000
STRIP = b".,;:!?\"'()[]{}#*$%&|<>"


def starts(n: int) -> range | list[int]:
    """Where the windows of a text of n words begin; together they cover all words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def word_row(word: bytes) -> int:
    return zlib.crc32(word) % WORD_ROWS


def gram_rows(word: bytes) -> list[int]:
    """Of a word's character n-grams, short and long ones."""
    w = b"^" + word + b"$"
    return [zlib.crc32(w[k : k + n]) % GRAM_ROWS for n in GRAMS for k in range(max(1, len(w) - n + 1))]


def plain_words(text: str | None) -> list[bytes]:
    """Words without punctuation at their ends; a lone mark where nothing is left, so that no text is empty."""
    return [w.strip(STRIP) or b"." for w in words_of(text)] or [b"."]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction over inputs that are projected already: (windows, steps, 3 * HIDDEN)."""

    @staticmethod
    def forward(xs: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: bool = False):
        n, steps, _ = xs.shape
        h, out, kept = np.zeros((n, HIDDEN), xs.dtype), np.empty((n, steps, HIDDEN), xs.dtype), []
        for t in range(steps):
            x, hu = xs[:, t], h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hn)
            new = c + z * (h - c)
            if mask is not None:
                new *= mask[:, t, None]
            if keep:
                kept.append((h, z, r, c, hn))
            h = out[:, t] = new
        return out, kept

    @staticmethod
    def backward(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list):
        n, steps, _ = d_out.shape
        dx, du, dh = np.empty((n, steps, 3 * HIDDEN)), np.zeros_like(u), np.zeros((n, HIDDEN))
        for t in range(steps - 1, -1, -1):
            h, z, r, c, hn = kept[t]
            d = (dh + d_out[:, t]) * mask[:, t, None]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * hn * r * (1 - r)
            dx[:, t] = np.concatenate([dz, dr, dc], axis=1)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ dhu
            dh = d * z + dhu @ u.T
        return dx, du


class Network:
    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        w = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"words": draw.normal(0, 0.1, (WORD_ROWS, SIZE)), "grams": draw.normal(0, 0.1, (GRAM_ROWS, SIZE)), "a": w(2 * HIDDEN, ATTENTION), "ab": np.zeros(ATTENTION), "v": w(ATTENTION), "o": w(2 * HIDDEN), "ob": np.zeros(1)}
        for side in ("f", "b"):
            self.p |= {f"w{side}": w(2 * SIZE, 3 * HIDDEN), f"u{side}": w(HIDDEN, 3 * HIDDEN), f"s{side}": np.zeros(3 * HIDDEN)}
        self.shift = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """(words, 2 * SIZE): a word's own vector and the sum of its n-grams' vectors over the root of their number."""
        grams = [gram_rows(w) for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = self.p["grams"][np.fromiter((g for own in grams for g in own), np.int64, int(sizes.sum()))]
        chars = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / np.sqrt(sizes)[:, None].astype(flat.dtype)
        return np.concatenate([self.p["words"][[word_row(w) for w in words]], chars], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both directions."""
        return np.concatenate([x @ self.p[f"w{s}"] + self.p[f"s{s}"] for s in ("f", "b")], axis=-1)

    def pooled(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows of projected inputs (windows, steps, 6 * HIDDEN)."""
        cut = 3 * HIDDEN
        f, kf = Gru.forward(x[:, :, :cut], mask, self.p["uf"], keep)
        b, kb = Gru.forward(x[:, ::-1, cut:], None if mask is None else mask[:, ::-1], self.p["ub"], keep)
        h = np.concatenate([f, b[:, ::-1]], axis=2)
        a = np.tanh(h @ self.p["a"] + self.p["ab"])
        e = a @ self.p["v"]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        if mask is not None:
            e = e * mask
        att = e / e.sum(axis=1, keepdims=True)
        pool = np.einsum("nt,nth->nh", att, h)
        return pool @ self.p["o"] + self.p["ob"], (h, a, att, pool, kf, kb)

    def gradients(self, words: list[list[bytes]], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over one window each, of at most WINDOW words."""
        n = len(words)
        mask = np.zeros((n, WINDOW))
        for k, w in enumerate(words):
            mask[k, : len(w)] = 1
        flat = [x for w in words for x in w]
        at = mask.astype(bool)
        x = np.zeros((n, WINDOW, 2 * SIZE))
        x[at] = self.inputs(flat)
        logit, (h, a, att, pool, kf, kb) = self.pooled(self.projected(x), mask, True)
        d = (sigmoid(logit) - labels) / n
        g = {"o": pool.T @ d, "ob": d.sum(keepdims=True)}
        dpool = d[:, None] * self.p["o"]
        dh = att[:, :, None] * dpool[:, None]
        datt = np.einsum("nth,nh->nt", h, dpool)
        de = att * (datt - (att * datt).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nta,nt->a", a, de)
        da = de[:, :, None] * self.p["v"] * (1 - a * a)
        g["a"], g["ab"] = np.einsum("nth,nta->ha", h, da), da.sum(axis=(0, 1))
        dh += da @ self.p["a"].T
        dx = np.zeros_like(x)
        for s, part, kept, turn in (("f", dh[:, :, :HIDDEN], kf, 1), ("b", dh[:, :, HIDDEN:], kb, -1)):
            dp, g[f"u{s}"] = Gru.backward(part[:, ::turn], mask[:, ::turn], self.p[f"u{s}"], kept)
            dp = dp[:, ::turn] * mask[:, :, None]
            g[f"w{s}"], g[f"s{s}"] = np.einsum("nti,ntj->ij", x, dp), dp.sum(axis=(0, 1))
            dx += dp @ self.p[f"w{s}"].T
        dx = dx[at]
        g["words"], g["grams"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["grams"])
        np.add.at(g["words"], [word_row(w) for w in flat], dx[:, :SIZE])
        grams = [gram_rows(w) for w in flat]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        np.add.at(g["grams"], np.concatenate(grams), np.repeat(dx[:, SIZE:] / np.sqrt(sizes)[:, None], sizes, axis=0))
        return g


class Scorer:
    """Logits of whole texts. Projected inputs of words are kept, up to a bound."""

    def __init__(self, net: Network):
        self.net = net
        self.small = Network.__new__(Network)
        self.small.p = {k: v.astype(np.float32) for k, v in net.p.items()}
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.empty((1024, 6 * HIDDEN), np.float32)

    def learn(self, new: list[bytes]) -> None:
        x = self.small.projected(self.small.inputs(new))
        n = len(self.rows)
        if n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty((max(len(self.table), len(new)), 6 * HIDDEN), np.float32)])
        self.table[n : n + len(new)] = x
        self.rows.update(zip(new, range(n, n + len(new)), strict=True))

    def windows(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """For all windows of some texts, in turn: the text's place and the logit."""
        if len(self.rows) > WORDS_KEPT:
            self.forget()
        if new := list({w for own in words for w in own}.difference(self.rows)):
            self.learn(new)
        owner, begin, length, flat, base = [], [], [], [], 0
        for k, own in enumerate(words):
            at = starts(len(own))
            owner += [k] * len(at)
            begin += [base + s for s in at]
            length += [min(WINDOW, len(own))] * len(at)
            flat += map(self.rows.__getitem__, own)
            base += len(own)
        rows, begin, length, out = np.array(flat), np.array(begin), np.array(length), np.empty(len(owner), np.float32)
        for full in (True, False):
            which = np.flatnonzero((length == WINDOW) == full)
            for k in range(0, len(which), 2048):
                own = which[k : k + 2048]
                steps = np.arange(WINDOW if full else int(length[own].max()))
                mask = None if full else (steps < length[own, None]).astype(np.float32)
                at = np.minimum(begin[own, None] + steps, len(rows) - 1)
                out[own] = self.small.pooled(self.table[rows[at]], mask)[0]
        return np.array(owner), out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The worst window's logit of each text; texts are taken together by number of words."""
        out, group, size, first = np.empty(len(texts)), [], 0, 0
        for k, t in enumerate(texts):
            group.append(plain_words(t))
            size += len(group[-1])
            if size > 50_000 or k == len(texts) - 1:
                owner, logit = self.windows(group)
                out[first : k + 1] = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(len(group))))
                group, size, first = [], 0, k + 1
        return out + self.net.shift


def train(texts: list[str], labels: list[int], share: float, rounds: int = 5, batch: int = 64, rate: float = 0.01, decay: float = 0.5, least: int = 10, seed: int = 5) -> Network:
    """A network from texts and labels; `share`: of ones among all labels, to which the scores are set.

    Rows of words and n-grams that fewer than `least` texts have stay at zero, so that single texts
    aren't learned by heart. A row's first number starts at its log odds. A fifth of the texts only
    tells after which round to stop.
    """
    net, y = Network(seed), np.array(labels, float)
    draw = np.random.default_rng(seed)
    check = draw.random(len(y)) < 0.2
    if len(y) < 50 or len({*y[check]}) < 2 or len({*y[~check]}) < 2:
        check = np.zeros(len(y), bool)
    if not len(y) or y.min() == y.max():
        net.p["o"][:] = 0
        net.p["ob"][:] = -8.0 if not len(y) or y.max() == 0 else 8.0
        return net
    words = [plain_words(t) for t in texts]
    own_y = y[~check]
    known = {}
    for name, rows_of, rows in (("words", lambda w: [word_row(w)], WORD_ROWS), ("grams", gram_rows, GRAM_ROWS)):
        seen = np.zeros((2, rows))
        for own, label, apart in zip(words, y, check, strict=True):
            if not apart:
                seen[int(label), list({r for w in {*own} for r in rows_of(w)})] += 1
        share_of = own_y.mean()  # odds are shrunk as by ten texts more, of usual labels
        odds = np.log((seen[1] + 10 * share_of) / own_y.sum()) - np.log((seen[0] + 10 * (1 - share_of)) / (len(own_y) - own_y.sum()))
        known[name] = seen.sum(axis=0) >= min(least, len(own_y) // 4)
        net.p[name][~known[name]] = 0
        net.p[name][:, 0] = np.where(known[name], np.clip(odds, -3, 3), 0)
    begun = {k: net.p[k].copy() for k in ("words", "grams")}
    mean, square, step, best = {}, {}, 0, (np.inf, None)
    for _ in range(rounds):
        order = draw.permutation(np.flatnonzero(~check))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            owner, logit = Scorer(net).windows([words[i] for i in own])
            picked = []
            for j, i in enumerate(own):
                at = starts(len(words[i]))[int(np.argmax(logit[owner == j]))]
                picked.append(words[i][at : at + WINDOW])
            step += 1
            for name, g in net.gradients(picked, y[own]).items():
                if name in known:
                    g[~known[name]] = 0
                m = mean[name] = 0.9 * mean.get(name, 0.0) + 0.1 * g
                s = square[name] = 0.99 * square.get(name, 0.0) + 0.01 * g * g
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
                if name in ("words", "grams"):  # towards where they began: only what many texts ask for stays
                    net.p[name] += rate * decay * (begun[name] - net.p[name])
        if check.any():
            logit = Scorer(net).logits([texts[i] for i in np.flatnonzero(check)])
            loss = np.logaddexp(0, -logit * (2 * y[check] - 1)).mean()
            if loss < best[0]:
                best = loss, {k: v.copy() for k, v in net.p.items()}
    if best[1]:
        net.p = best[1]
    share = min(max(share, 1e-3), 1 - 1e-3)
    net.shift = float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return net


def condensed(text: str, max_words: int) -> str:
    """A text as it is learned from: one of more than `max_words` words by as many whole windows, spread evenly from its first to its last."""
    words = words_of(text)
    if len(words) > max_words:
        every = list(starts(len(words)))
        own = [every[k] for k in np.linspace(0, len(every) - 1, max(2, max_words // WINDOW)).round().astype(int)]
        words = [w for s in own for w in words[s : s + WINDOW]]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_each: int = 1500, max_words: int = 8000) -> Network:
    """A network from at most `max_each` labelled texts of either label, picked by hash of the id whatever
    their length, none of them held out.

    A text of more than `max_words` words is learned from windows of it, spread evenly over all of it, so
    that the driver receives a bounded amount. A document labelled twice has its larger label; one with
    several texts is learned by the smallest; null labels, null ids and null texts teach nothing. Without
    labels of both kinds all texts score alike.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    usable = known.join(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i")), "i", "left_semi")
    share = known.agg(F.avg("y")).first()[0] or 0.0
    picked = None
    for y in (0, 1):
        own = usable.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(max_each)
        picked = own if picked is None else picked.union(own)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(picked), "i")  # at most 2 * max_each rows

    def work(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([condensed(t, max_words) for t in b.column(1).to_pylist()], pa.string()), b.column(2)], names=["i", "t", "y"])

    sample = {}
    for r in rows.select("i", "t", "y").mapInArrow(work, f"i {type_of(docs, id_col)}, t string, y int").toLocalIterator():
        sample[r.i] = min((r.t, r.y), sample.get(r.i, (r.t, r.y)))
    sample = [sample[i] for i in sorted(sample)]
    return train([t for t, _ in sample], [y for _, y in sample], share)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row for each row of `docs`, from whole texts alone.

    Null and empty texts are scored as a lone full stop. A null id stays null; repeated rows are each
    answered; an empty table gives an empty table; other columns are not read.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def work(batches):
        own = kept(("toxicity", name), lambda: Scorer(sent.value))
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(own.logits(b.column(1).to_pylist())), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {type_of(docs, id_col)}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score` of all of `documents`, learned from `labels` that are not held out; cases as stated there."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
