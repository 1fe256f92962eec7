"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the embedding of its hash plus the mean embedding of its hashed character 4-grams. Windows of `STEPS`
words start every `STRIDE` words, so that neighbours overlap and every word of a text is in one. In each window two gated
recurrent passes run over the words, attention weighs their states, and the weighted mean gives the window's logit. A
text's score is a logistic function of its highest window logits and of its number of windows, fitted on labelled texts
that the network was not fitted to.

The network is fitted in one task to a bounded sample: up to `SAMPLE` labelled texts of each class, by a hash of doc_id,
with every window of each. A label says that a text is toxic somewhere, so a toxic text's windows are weighted by how
toxic the network takes them to be. The final function is fitted to features of whole texts too, and scoring reads every
window of every text.

A null text counts as empty. A text without words has the score of no windows, which is low. Null labels are no labels;
without labels of both classes all scores are 0.25. Rows that share a doc_id share its labels, and each is scored by its own
text; an empty table gives no rows, and further columns of docs are not read.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, lower_words, read_table

STEPS, STRIDE = 32, 24
SAMPLE, EPOCHS, BATCH = 1200, 6, 64
WORD_BITS, GRAM_BITS, EMBED, HIDDEN = 13, 14, 16, 12
#: Bytes of a word that are looked at together; a longer word is cut so that each 4-gram is in one piece.
PIECE = 24
TOKENS = 200_000
#: Windows whose states are held at once where no gradient is needed.
SLICE = 8192
f32 = np.float32


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; and of each piece of a word: its word and its 4-gram buckets (-1: none)."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & ((1 << WORD_BITS) - 1)
    marked = [b"^" + w + b"$" for w in words]
    owner, pieces, step = list(range(len(words))), [w[:PIECE] for w in marked], PIECE - 3
    for i, w in enumerate(marked):
        for at in range(step, len(w) - 3, step) if len(w) > PIECE else ():
            owner.append(i)
            pieces.append(w[at : at + PIECE])
    raw = np.array(pieces, f"S{PIECE}").view(np.uint8).reshape(-1, PIECE) if pieces else np.zeros((0, PIECE), np.uint8)
    b = raw.astype(np.uint32)
    code = b[:, :-3] | b[:, 1:-2] << np.uint32(8) | b[:, 2:-1] << np.uint32(16) | b[:, 3:] << np.uint32(24)
    grams = ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
    there = raw[:, 3:] != 0
    there[:, 0] = True  # words of one letter
    return bucket, np.array(owner, np.int64), np.where(there, grams, -1)


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(f32)
        h = HIDDEN
        self.p = {
            "word": n(1 << WORD_BITS, EMBED, s=0.05), "gram": n(1 << GRAM_BITS, EMBED, s=0.2),
            "w": n(EMBED, 6 * h, s=0.3), "b": np.zeros(6 * h, f32), "u0": n(h, 3 * h, s=0.3), "u1": n(h, 3 * h, s=0.3),
            "a": n(2 * h, s=0.3), "o": n(2 * h, s=0.3), "c": np.zeros(1, f32),
        }
        self.final: np.ndarray | None = None

    def inputs(self, codes) -> np.ndarray:
        bucket, owner, grams = codes
        total, count = np.zeros((len(bucket), EMBED), f32), np.zeros((len(bucket), 1), f32)
        n = len(bucket)
        for part in (slice(0, n), slice(n, None)):
            for j in range(grams.shape[1]):
                k = np.flatnonzero(grams[part, j] >= 0)
                if len(k):
                    to, g = owner[part][k], grams[part][k, j]
                    if part.start == 0:
                        total[to] += self.p["gram"][g]
                        count[to] += 1
                    else:  # several pieces of a word
                        np.add.at(total, to, self.p["gram"][g])
                        np.add.at(count, to, 1)
        return self.p["word"][bucket] + total / np.maximum(1, count)

    def forward(self, gates: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: gates of each word (with a zero row last), word of each place, whether the place is a word."""
        n, h = len(idx), HIDDEN
        states = np.zeros((2, STEPS, n, h), f32)
        saved = []
        for d in (0, 1):
            u, own = self.p[f"u{d}"], gates[:, 3 * h * d : 3 * h * (d + 1)]
            now = np.zeros((n, h), f32)
            for t in range(STEPS) if d == 0 else range(STEPS - 1, -1, -1):
                g, hu = own[idx[:, t]], now @ u
                z = sigmoid(g[:, :h] + hu[:, :h])
                r = sigmoid(g[:, h : 2 * h] + hu[:, h : 2 * h])
                c = np.tanh(g[:, 2 * h :] + r * hu[:, 2 * h :])
                z = np.where(mask[:, t, None], z, f32(1))
                after = (1 - z) * c + z * now
                if keep:
                    saved.append((d, t, now, z, r, c, hu[:, 2 * h :]))
                now = after
                states[d, t] = now
        s = np.concatenate([states[0], states[1]], axis=2)
        e = np.where(mask.T, s @ self.p["a"], f32(-1e9))
        e = np.exp(e - e.max(axis=0))
        attention = e / e.sum(axis=0)
        pooled = (attention[:, :, None] * s).sum(axis=0)
        logits = pooled @ self.p["o"] + self.p["c"]
        return (logits, s, attention, pooled, saved) if keep else logits

    def logits(self, codes, idx: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """forward() of any number of windows, SLICE at a time."""
        gates = self.gates(self.inputs(codes))
        return np.concatenate([self.forward(gates, idx[i : i + SLICE], mask[i : i + SLICE]) for i in range(0, len(idx), SLICE)]) if len(idx) else np.zeros(0, f32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.vstack([x @ self.p["w"] + self.p["b"], np.zeros((1, 6 * HIDDEN), f32)])

    def learn(self, x: np.ndarray, codes, idx: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of Adagrad on weighted cross-entropy of windows; x: inputs of the words of codes."""
        p, h, n = self.p, HIDDEN, len(idx)
        logits, s, attention, pooled, saved = self.forward(self.gates(x), idx, mask, keep=True)
        d_logit = ((sigmoid(logits) - target) * weight / max(1e-6, float(weight.sum()))).astype(f32)
        grad = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["o"]
        d_s = attention[:, :, None] * d_pooled
        d_att = (s * d_pooled).sum(axis=2)
        d_e = attention * (d_att - (attention * d_att).sum(axis=0))
        grad["a"] = np.einsum("tn,tnk->k", d_e, s)
        d_s += d_e[:, :, None] * p["a"]
        d_gates = np.zeros((n, STEPS, 6 * h), f32)
        grad["u0"], grad["u1"] = np.zeros_like(p["u0"]), np.zeros_like(p["u1"])
        d_now, last = np.zeros((n, h), f32), 1
        for d, t, before, z, r, c, hn in reversed(saved):
            if d != last:
                d_now, last = np.zeros((n, h), f32), d
            d_now = d_now + d_s[t, :, d * h : (d + 1) * h]
            m = mask[:, t, None]
            d_c = d_now * (1 - z) * (1 - c * c)
            d_z = np.where(m, d_now * (before - c) * z * (1 - z), f32(0))
            d_r = d_c * hn * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_gates[:, t, 3 * h * d : 3 * h * (d + 1)] = np.concatenate([d_z, d_r, d_c], axis=1)
            grad[f"u{d}"] += before.T @ d_hu
            d_now = d_now * z + d_hu @ p[f"u{d}"].T
        flat = idx.reshape(-1)
        order = np.argsort(flat, kind="stable")
        at = np.concatenate(([0], np.flatnonzero(np.diff(flat[order])) + 1))
        of_word = np.add.reduceat(d_gates.reshape(-1, 6 * h)[order], at)
        used = flat[order][at]
        of_word, used = of_word[used < len(x)], used[used < len(x)]
        grad["w"], grad["b"] = x[used].T @ of_word, of_word.sum(axis=0)
        d_x = of_word @ p["w"].T
        if not hasattr(self, "speed"):
            self.speed = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        for k, g in grad.items():
            self.speed[k] += g * g
            p[k] -= rate * g / np.sqrt(self.speed[k])
        bucket, owner, grams = codes
        self.rows("word", bucket[used], d_x, rate)
        place = np.full(len(bucket), -1)
        place[used] = np.arange(len(used))
        count = np.bincount(owner, (grams >= 0).sum(axis=1), len(bucket))
        piece = np.flatnonzero(place[owner] >= 0)
        i, j = np.nonzero(grams[piece] >= 0)
        to = owner[piece[i]]
        self.rows("gram", grams[piece[i], j], d_x[place[to]] / count[to, None].astype(f32), rate)

    def rows(self, name: str, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        order = np.argsort(at, kind="stable")
        first = np.concatenate(([0], np.flatnonzero(np.diff(at[order])) + 1))
        rows, total = at[order][first], np.add.reduceat(g[order], first)
        self.speed[name][rows] += total * total
        self.p[name][rows] -= rate * total / np.sqrt(self.speed[name][rows])


def starts_of(n: int) -> np.ndarray:
    """First words of a text's windows."""
    return np.arange(0, max(1, -(-max(0, n - STEPS) // STRIDE) + 1)) * STRIDE if n else np.zeros(0, np.int64)


def windows(texts: list[list[bytes]]):
    """words, index of each place (len(words): none), mask, text of each window."""
    number: dict[bytes, int] = {}
    flat = [np.array([number.setdefault(w, len(number)) for w in t], np.int64) for t in texts]
    first = [starts_of(len(t)) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(x) for x in first])
    joined = np.concatenate([*flat, np.full(STEPS, len(number))])
    begin = np.cumsum([0, *(len(x) for x in flat)])
    at = (np.concatenate([*first, np.zeros(0, np.int64)]) + begin[of]).astype(np.int64)[:, None] + np.arange(STEPS)
    mask = at < begin[1:][of][:, None] if len(of) else np.zeros((0, STEPS), bool)
    return list(number), np.where(mask, joined[np.minimum(at, len(joined) - 1)], len(number)), mask, of


def text_features(logits: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Of each text: its highest logit, the mean of its highest four, log of 1 + windows, 1. No windows: -8."""
    top, mean4 = np.full(n, -8.0), np.full(n, -8.0)
    order = np.lexsort((-logits, of))
    of, logits = of[order], logits[order]
    at = np.searchsorted(of, np.arange(n))
    count = np.bincount(of, minlength=n)
    some = count > 0
    top[some] = logits[at[some]]
    rank = np.arange(len(of)) - at[of]
    first = rank < 4
    mean4[some] = (np.bincount(of[first], logits[first], n) / np.maximum(1, np.minimum(4, count)))[some]
    return np.stack([np.clip(top, -8, 8), np.clip(mean4, -8, 8), np.log1p(count), np.ones(n)], axis=1)


def features(net: Network, texts: list[list[bytes]]) -> np.ndarray:
    words, idx, mask, of = windows(texts)
    logits = net.logits(word_codes(words), idx, mask)
    return text_features(logits.astype(float), of, len(texts))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method for weighted ridge logistic regression."""
    weight = weight / weight.mean()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = sigmoid(x @ w)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (weight * (y - q)) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, held_out=None, column: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """doc_id, words, label, share of the bounded sample; texts are whole.

    share: labelled texts of the class for each one in the sample.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(column).cast("int").alias("label")).filter("label is not null")
    if held_out is not None:
        known = known.withColumn("doc_id", F.col("__id")).filter(~held_out).drop("doc_id")
    picked = None
    for y in (0, 1):
        # The smallest hashes: each task keeps its own `most` before they meet.
        own = known.filter(F.col("label") == y)
        one = own.orderBy(F.xxhash64("__id"), "__id").limit(most).withColumn("share", F.lit(max(1.0, own.count() / most)))
        picked = one if picked is None else picked.union(one)
    # At most two times `most` rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))

    def worded(batches):
        for pdf in batches:
            out = [(d, b" ".join(lower_words(t)), y) for d, t, y in zip(pdf["doc_id"], pdf["text"], pdf["label"], strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "words", "label"]).assign(share=pdf["share"].to_numpy())

    return rows.mapInPandas(worded, "doc_id long, words binary, label int, share double")


def fit_sample(rows: DataFrame, **options) -> Network | None:
    """fit() of a sample, in one task: the sample is bounded, and so is what comes back."""

    def run(batches):
        got = pd.concat([*batches, pd.DataFrame({"doc_id": [], "words": [], "label": [], "share": []})]).sort_values(["doc_id", "label", "words"], kind="stable")
        fold = np.array([zlib.crc32(b"fold%d" % d) % 4 for d in got["doc_id"]], np.int64)
        net = fit([bytes(x).split() for x in got["words"]], got["label"].to_numpy(float), fold, got["share"].to_numpy(float), **options)
        yield pd.DataFrame({"net": [pickle.dumps(net)]})

    # A shuffle, so that the scan of docs behind the sample stays in many tasks.
    return pickle.loads(rows.repartition(1).mapInPandas(run, "net binary").first()["net"])


def fit(texts: list[list[bytes]], y: np.ndarray, fold: np.ndarray, share: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network | None:
    """The network from folds 1 to 3; from fold 0 its final logistic function, with texts weighted as their class is among all."""
    if len(set(y)) < 2:
        return None
    own = fold != 0 if len(set(y[fold == 0])) == 2 and len(set(y[fold != 0])) == 2 else np.ones(len(y), bool)
    apart = ~own if not own.all() else own
    net, rng = Network(seed), np.random.default_rng(seed)
    words, idx, mask, of = windows([t for t, k in zip(texts, own, strict=True) if k])
    label, codes = y[own][of], word_codes(words)
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    size = np.diff(np.append(begin, len(of)))
    many = np.sqrt(np.repeat(size, size))  # a text of many windows weighs more, but not as much as they
    weight = 1 / many
    for epoch in range(epochs):
        if epoch:
            logits = net.logits(codes, idx, mask)
            e = np.exp(2 * (logits - np.repeat(np.maximum.reduceat(logits, begin), size)))
            part = e / np.repeat(np.add.reduceat(e, begin), size)
            weight = np.where(label > 0, part * many, 1 / many)
        # Both classes weigh the same.
        weight = weight / np.where(label > 0, weight[label > 0].sum(), weight[label == 0].sum())
        order = rng.permutation(len(idx))
        for at in range(0, len(order), BATCH):
            k = order[at : at + BATCH]
            used, back = np.unique(idx[k], return_inverse=True)
            inside = used[used < len(words)]
            local = back.reshape(idx[k].shape)
            some = sub_codes(codes, inside)
            net.learn(net.inputs(some), some, local, mask[k], label[k].astype(f32), weight[k].astype(f32), 0.12)
    del net.speed
    x = np.concatenate([features(net, group) for group in groups(t for t, k in zip(texts, apart, strict=True) if k)])
    net.final = logistic(x, y[apart], share[apart])
    return net


def sub_codes(codes, words: np.ndarray):
    """Codes of some words, in their order."""
    bucket, owner, grams = codes
    place = np.full(len(bucket), -1)
    place[words] = np.arange(len(words))
    more = np.flatnonzero(place[owner[len(bucket) :]] >= 0) + len(bucket) if len(owner) > len(bucket) else np.zeros(0, np.int64)
    k = np.concatenate([words, more])
    return bucket[words], place[owner[k]], grams[k]


def groups(texts):
    """Lists of whole texts that together have about TOKENS words."""
    held, size = [], 0
    for words in texts:
        held.append(words)
        size += len(words)
        if size >= TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def score_texts(net: Network | None, texts: list[str | None]) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.25)
    out = [sigmoid(features(net, held) @ net.final) for held in groups(map(lower_words, texts))]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs' doc_id and the score of its text."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(net, list(texts)))

    return docs.select("doc_id", of(F.coalesce("text", F.lit(""))).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = id_bucket("doc_id", 5) == 0
    net = fit_sample(sample(docs, read_table(spark, sf_dir, "labels"), held))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
