"""N-gram language model in an Elias-Fano trie, learnt from and applied to whole texts.

Tokens are words (A-Z lower-cased) and one end for each text. Words are ranked by their 64-bit hash. The trie's nodes are
word -> next word -> third word, dealt to shards by ranges of (word, next word), so that a very frequent word lies in
several shards. A shard is one memory-mapped file in the shared folder:

- level 1: for each word of the shard's range where its next words begin (monotone pointers, Elias-Fano coded) and its
  back-off weight;
- level 2: next words, ascending in each run and bit-packed, with their probability, where their own next words begin
  (Elias-Fano coded) and their back-off weight;
- level 3: third words and their probability.

Probabilities and back-off weights are quantised to 16 bits on a log scale, so small weights keep their precision. A
lookup is relative to its context: the pointers give the run of the context's node, and the successor of the word is
searched in that run. Every gram of the training texts is kept, and

    P(w | u v) = (c(u v w) - d3) / c(u v) + b(u v) P(w | v),   b(u v) = d3 * (different words after u v) / c(u v),
    P(w | v)   = (c(v w) - d2) / c(v)     + b(v) P(w),         b(v)   = d2 * (different words after v) / c(v),
    P(w)       = (c(w) + 1) / (N + V + 1),

where a term of a gram that is not there is 0, and a context that is not there hands all its mass on. Each conditional
distribution sums to 1 over the vocabulary and one unknown word.

Counting takes three reads of the training texts: their bytes, words, then (word, next word, third word) triples, from which
the owner of a shard derives level 2 as well. What travels are sorted arrays of counts. The number of owners of words follows
from the bytes and that of shards from the tokens, so what an owner holds doesn't grow with the corpus; the driver holds a
row for each and the few words that fill a large part of one. Null texts count as empty: they are one end. A text of any
length is read whole. Repeated rows count, and are scored, each on its own. Words are told apart by 64-bit hashes. Without
any training text every token is unknown and has P = 1; an empty table to score gives no rows. Further columns of either
table are not read.
"""

from __future__ import annotations

import functools
import json
import math
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, local_view, lower_words, materialize, parts, read_table, run_dir, write_whole
from .eliasfano import Sequence, encode, pack, successor, unpack

U64 = np.uint64
#: No word holds white space, so this is nobody else's hash but by chance.
END = U64(xxhash.xxh64_intdigest(b"\n"))
#: Tokens that a task counts or scores at once; tokens of a shard.
CHUNK, SHARD = 1_500_000, 2_000_000
#: Bytes of training texts for each owner of words.
SLICE = 1 << 28
#: Quantised values: code c stands for 10 ** (-RANGE * c / 65535).
RANGE = 12.0
LEVELS = 10.0 ** (-RANGE * np.arange(65536) / 65535)
LOW32 = U64(0xFFFFFFFF)


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of values above 0 and up to 1."""
    return np.clip(np.round(-np.log10(p) / RANGE * 65535), 0, 65535).astype("<u2")


# files


def save(place: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: length of a JSON list of (name, type, bytes, place), the list, the arrays."""
    body, listed, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        listed.append([name, a.dtype.str, len(raw), at])
        body.append(raw + bytes(-len(raw) % 8))
        at += len(body[-1])
    head = json.dumps(listed).encode()
    head += b" " * (-(len(head) + 8) % 8)
    write_whole(place, b"".join([struct.pack("<Q", len(head)), head, *body]))


class Shard:
    """The arrays of one file, mapped."""

    def __init__(self, place: str):
        raw = local_view(place)
        (n,) = struct.unpack("<Q", raw[:8].tobytes())
        self.arrays = {name: np.asarray(raw[8 + n + at : 8 + n + at + size]).view(kind) for name, kind, size, at in json.loads(raw[8 : 8 + n].tobytes())}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def sequence(self, name: str) -> Sequence:
        return Sequence(*(self.arrays[f"{name}.{x}"] for x in ("head", "low", "upper", "ones")))


@functools.lru_cache(4096)
def shard_file(place: str) -> Shard:
    return Shard(place)


def coded(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in encode(values.astype(U64), universe).items()}


# packed counts, as they travel


def planes(a: np.ndarray) -> bytes:
    """The first bytes of all elements, then all second ones, and so on: small numbers make runs of zeros."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


PACKED = "bucket int, keys binary, nexts binary, counts binary"


def packed(bucket: np.ndarray, keys: np.ndarray, nexts: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Rows of keys that are sorted and grow with their bucket, one a bucket: differences of keys, nexts, counts less 1."""
    at = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    nexts, counts = nexts.astype("<u4"), (counts - 1).astype("<u4")
    rows = [(int(bucket[i]), planes(np.diff(keys[i:j], prepend=U64(0))), planes(nexts[i:j]), planes(counts[i:j])) for i, j in zip(at[:-1], at[1:], strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "keys", "nexts", "counts"])


def by_bucket(batches):
    """(bucket, keys, nexts, counts) of each bucket of a task whose rows are sorted by bucket."""
    now, held = None, []

    def whole():
        got = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        return now, *got

    for pdf in batches:
        for b, k, n, c in zip(pdf["bucket"], pdf["keys"], pdf["nexts"], pdf["counts"], strict=True):
            if b != now and held:
                yield whole()
            now = int(b)
            held.append((np.cumsum(from_planes(k, "<u8"), dtype=U64), from_planes(n, "<u4"), from_planes(c, "<u4") + np.uint32(1)))
    if held:
        yield whole()


def dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionById(n, "bucket").sortWithinPartitions("bucket")


# tokens


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def chunks(batches):
    """(rows, hashes, codes, first): documents of about CHUNK tokens, the hashes of their different tokens (first that of the end), each token's code, and where each document begins."""
    for pdf in batches:
        number, held, first, at, begin = Numbers({b"\n": 0}), [], [], 0, 0
        for i, text in enumerate(pdf["text"]):
            words = lower_words(text)
            words.append(b"\n")
            held.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            first.append(at)
            at += len(words)
            if at >= CHUNK or i == len(pdf) - 1:
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), U64, len(number))
                yield pdf.iloc[begin : i + 1], hashes, np.concatenate(held), np.array(first)
                number, held, first, at, begin = Numbers({b"\n": 0}), [], [], 0, i + 1


class Model:
    """Where a model's files are and the numbers that every lookup needs.

    Ranks: words have 0 to words - 1, the beginning of a text (a context only) has `words`, and `words + 1` stands for no
    word at all, behind a text's end.
    """

    def __init__(self, place: str, word_shards: int, d2: float, d3: float):
        self.place, self.word_shards, self.d2, self.d3 = place, word_shards, d2, d3
        self.tokens = self.words = self.docs = 0
        self.rank_base = np.zeros(word_shards + 1, np.int64)
        self.shards = 1
        self.bounds = np.zeros(0, U64)  # first (word, next word) keys of the shards but the first
        self.back_of_split: dict[int, float] = {}  # back-off weights of words that lie in several shards

    @property
    def span(self) -> np.uint64:
        return U64(self.words + 2)

    def word_file(self, s: int) -> Shard:
        return shard_file(f"{self.place}/words-{s:05d}")

    def trie_file(self, s: int) -> Shard:
        return shard_file(f"{self.place}/trie-{s:05d}")

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> U64(40)) * U64(self.word_shards) >> U64(24)).astype(np.int64)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ranks (-1: unknown) of hashes."""
        order = np.argsort(hashes)
        own, counts, ranks = hashes[order], np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        edges = np.searchsorted(self.word_shard(own), np.arange(self.word_shards + 1))
        for s in range(self.word_shards):
            i, j = edges[s], edges[s + 1]
            if i < j and self.rank_base[s] < self.rank_base[s + 1]:
                keys = self.word_file(s)["keys"]
                at = np.minimum(np.searchsorted(keys, own[i:j]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == own[i:j])
                counts[order[i + hit]] = self.word_file(s)["counts"][at[hit]]
                ranks[order[i + hit]] = self.rank_base[s] + at[hit]
        return counts, ranks

    def context_counts(self, low: int, high: int) -> np.ndarray:
        """How often the words of ranks low to high are contexts; the beginning of a text is so once a document."""
        out = np.zeros(high - low + 1, np.int64)
        for s in np.flatnonzero((self.rank_base[1:] > low) & (self.rank_base[:-1] <= high)).tolist():
            a, b = max(low, int(self.rank_base[s])), min(high + 1, int(self.rank_base[s + 1]))
            if a < b:
                out[a - low : b - low] = self.word_file(s)["counts"][a - self.rank_base[s] : b - self.rank_base[s]]
        if high == self.words:
            out[-1] = self.docs
        return out

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, side="right")

    def shard_edges(self, keys: np.ndarray) -> np.ndarray:
        """Where each shard's keys begin among sorted ones, and the end."""
        return np.concatenate(([0], np.searchsorted(keys, self.bounds), [len(keys)]))

    def back_off(self, words: np.ndarray) -> np.ndarray:
        """b of context words of ascending ranks."""
        out = np.ones(len(words))
        edges = self.shard_edges(words.astype(U64) * self.span)
        for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            f = self.trie_file(s)
            at = words[edges[s] : edges[s + 1]] - int(f["low"][0])
            inside = np.flatnonzero((at >= 0) & (at < len(f["back1"])))
            out[edges[s] + inside] = LEVELS[f["back1"][at[inside]]]
        for w, b in self.back_of_split.items():
            out[words == w] = b
        return out


def ranked(model: Model, hashes: np.ndarray, codes: np.ndarray, first: np.ndarray):
    """counts and ranks of the different tokens; rank of each token and of the one before it."""
    counts, ranks = model.lookup(hashes)
    rank = ranks[codes]
    before = np.concatenate(([-1], rank[:-1]))
    before[first] = model.words
    return counts, ranks, rank, before


# training


def count_words(docs: DataFrame, model: Model) -> None:
    """Write the words' hashes and counts, and set the model's numbers and the bounds of its shards."""
    place, n = model.place, model.word_shards

    def count(batches):
        for _, hashes, codes, _ in chunks(batches):
            order = np.argsort(hashes)
            keys = hashes[order]
            yield packed(model.word_shard(keys), keys, np.zeros(len(keys)), np.bincount(codes, minlength=len(hashes))[order])

    def merge(batches):
        for s, keys, _, counts in by_bucket(batches):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[at], np.add.reduceat(counts, at, dtype=np.int64)
            save(f"{place}/words-{s:05d}", {"keys": keys, "counts": counts})
            follow = np.where(keys == END, 0, counts)  # an end is no context
            large = np.flatnonzero((follow * 64 >= follow.sum()) & (follow > 0))  # 64 at most
            yield pd.DataFrame({"s": [s], "words": [len(keys)], "tokens": [int(counts.sum())], "ends": [int(counts.sum() - follow.sum())], "large": [large.tolist()], "large_n": [follow[large].tolist()]})

    rows = dealt(docs.mapInPandas(count, PACKED), n).mapInPandas(merge, "s int, words long, tokens long, ends long, large array<long>, large_n array<long>")
    stats = materialize(rows, f"{place}/words.stats").orderBy("s").collect()
    model.tokens, model.words, model.docs = (sum(r[k] for r in stats) for k in ("tokens", "words", "ends"))
    if model.words >= 1 << 31:
        raise ValueError("the vocabulary has more than 2**31 words")
    sizes = np.zeros(n, np.int64)
    for r in stats:
        sizes[r["s"]] = r["words"]
    model.rank_base = np.concatenate(([0], np.cumsum(sizes)))
    model.shards = max(1, -(-model.tokens // SHARD))
    model.bounds = cuts(model, stats)


def cuts(model: Model, stats: list) -> np.ndarray:
    """Cut the keys (word, next word) into shards of about equal counts.

    A word shard's frequent words are points whose next words are cut evenly, as they are ranked by their hash; the rest
    of its words lie evenly.
    """
    pieces: list[tuple[float, float, float]] = []  # from, to, weight on the axis of word ranks
    for r in stats:
        base, n = int(model.rank_base[r["s"]]), r["words"]
        large = dict(zip(r["large"], r["large_n"], strict=True))
        rest = (r["tokens"] - r["ends"] - sum(large.values())) / max(1, n - len(large))
        at = 0
        for w in [*sorted(large), n]:
            if w > at:
                pieces.append((base + at, base + w, rest * (w - at)))
            if w < n:
                pieces.append((base + w, base + w + 1, large[w]))
            at = w + 1
    pieces.append((model.words, model.words + 1, model.docs))
    each, got, bounds = sum(p[2] for p in pieces) / model.shards, 0.0, []
    for lo, hi, weight in sorted(pieces):
        while len(bounds) < model.shards - 1 and weight and got + weight >= each * (len(bounds) + 1):
            x = lo + (hi - lo) * (each * (len(bounds) + 1) - got) / weight
            word = min(int(x), math.ceil(hi) - 1)
            inner = int((x - word) * model.words) if hi - lo == 1 else 0
            bounds.append(word * int(model.span) + inner)
        got += weight
    return np.array(sorted(bounds), U64)


def build_trie(docs: DataFrame, model: Model) -> None:
    """Count triples and write each shard."""
    no_word = model.words + 1

    def count(batches):
        for _, hashes, codes, first in chunks(batches):
            _, _, rank, before = ranked(model, hashes, codes, first)
            pair, back = np.unique(before.astype(U64) * model.span + rank.astype(U64), return_inverse=True)
            following = np.append(rank[1:], no_word)
            following[first[1:] - 1] = no_word
            key = np.sort(back.astype(U64) << U64(32) | following.astype(U64))
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            pair = pair[(key[at] >> U64(32)).astype(np.int64)]
            yield packed(model.shard_of(pair), pair, key[at] & LOW32, np.diff(np.append(at, len(key))))

    def merge(batches):
        for s, *grams in by_bucket(batches):
            made = write_shard(model, s, *grams)
            grams.clear()
            yield made

    shape = "s int, low long, high long, low_n long, high_n long, low_of long, high_of long"
    done = dealt(docs.mapInPandas(count, PACKED), model.shards).mapInPandas(merge, shape)
    rows = materialize(done, f"{model.place}/trie.stats").collect()
    followed: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        for end in ("low", "high")[: 1 + (r["low"] < r["high"])]:
            followed.setdefault(r[end], []).append((r[f"{end}_n"], r[f"{end}_of"]))
    model.back_of_split = {w: model.d2 * sum(n for n, _ in x) / x[0][1] for w, x in followed.items() if len(x) > 1}
    for s in set(range(model.shards)) - {r["s"] for r in rows}:
        write_shard(model, s, *(np.zeros(0, x) for x in (U64, np.uint32, np.int64)))


def write_shard(model: Model, s: int, keys: np.ndarray, nexts: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Code and write one shard of the grams (key: word and next word, third word, count)."""
    pairs, back = np.unique(keys, return_inverse=True)
    key = back.astype(U64) << U64(32) | nexts.astype(U64)
    del keys, nexts, back
    order = np.argsort(key)
    key, counts = key[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    key, counts = key[at], np.add.reduceat(counts, at, dtype=np.int64) if len(at) else counts
    del order, at
    node, third = (key >> U64(32)).astype(np.int64), (key & LOW32).astype(np.int64)
    total = np.bincount(node, counts, len(pairs))  # exact below 2**53
    word, following = (pairs // model.span).astype(np.int64), pairs % model.span
    low, high = (int(word[0]), int(word[-1])) if len(pairs) else (0, -1)
    begin = np.searchsorted(word, np.arange(low, high + 2))
    context = model.context_counts(low, high) if len(pairs) else np.zeros(0, np.int64)
    n1 = np.diff(begin)
    there = third <= model.words
    node, third, counts = node[there], third[there], counts[there]
    begin3 = np.searchsorted(node, np.arange(len(pairs) + 1))
    n2 = np.diff(begin3)
    bits = int(model.words + 1).bit_length()
    save(f"{model.place}/trie-{s:05d}", {
        "low": np.array([low], "<i8"), **coded("next1", begin, len(pairs) + 1), "back1": quantise(np.where(n1 > 0, model.d2 * np.maximum(1, n1) / np.maximum(1, context), 1.0)),
        "words2": pack(following, bits), "prob2": quantise((total - model.d2) / context[word - low]), **coded("next2", begin3, len(third) + 1),
        "back2": quantise(np.where(n2 > 0, model.d3 * np.maximum(1, n2) / total, 1.0)), "words3": pack(third, bits), "prob3": quantise((counts - model.d3) / total[node]),
    })
    ends = [0, 0, 1, 1] if not len(pairs) else [int(n1[0]), int(n1[-1]), int(context[0]), int(context[-1])]
    return pd.DataFrame([[s, low, high, *ends]], columns=["s", "low", "high", "low_n", "high_n", "low_of", "high_of"])


def train(docs: DataFrame, d2: float = 0.8, d3: float = 0.9) -> Model:
    """Count the words, then the triples of docs, and write the trie. Three reads of the texts, two shuffles of counts."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(run_dir(spark, "lm"), max(1, parts(spark), -(-size // SLICE)), d2, d3)
    count_words(docs, model)
    build_trie(docs, model)
    return model


# scoring


def token_log10(model: Model, hashes: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its count, log10 of its add-one probability, log10 of the model's probability."""
    counts, ranks, rank, before = ranked(model, hashes, codes, first)
    base = (counts + 1.0) / (model.tokens + model.words + 1.0)
    # P(w) times the weight of the context.
    known = np.flatnonzero(ranks >= 0)
    known = known[np.argsort(ranks[known])]
    weight = np.ones(len(hashes))
    weight[known] = model.back_off(ranks[known])
    p = base[codes]
    p[1:] *= np.where(before[1:] == model.words, 1.0, weight[codes[:-1]])
    if model.tokens:
        p[first] *= model.back_off(np.array([model.words]))[0]
    # Pairs of known words, in order; tokens of one pair lie together.
    i = np.flatnonzero((before >= 0) & (rank >= 0)) if model.tokens else np.zeros(0, np.int64)
    key = before[i].astype(U64) * model.span + rank[i].astype(U64)
    order = np.argsort(key)
    i, key = i[order], key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    pair, upto = key[at], np.append(at[1:], len(key))
    starts = np.zeros(len(rank) + 1, bool)
    starts[first] = starts[-1] = True
    weight2, p3 = np.ones(len(rank) + 1), np.zeros(len(rank) + 1)
    bits = int(model.words + 1).bit_length()
    edges = model.shard_edges(pair)
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        f, a, b = model.trie_file(s), edges[s], edges[s + 1]
        word = (pair[a:b] // model.span).astype(np.int64) - int(f["low"][0])
        inside = np.flatnonzero((word >= 0) & (word < len(f["back1"])))
        lo, hi = f.sequence("next1").runs(word[inside])
        x = pair[a:b][inside] % model.span
        node = successor(f["words2"], bits, lo, hi, x)
        there = np.flatnonzero(node < hi)
        there = there[unpack(f["words2"], bits, node[there]) == x[there]]
        node, found = node[there], a + inside[there]
        if not len(found):
            continue
        lo, hi = f.sequence("next2").runs(node)
        # Tokens of the pairs that were found, and the tokens behind them, whose context the pairs are.
        n = upto[found] - at[found]
        of = np.repeat(np.arange(len(found)), n)
        token = i[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[found], n)]
        p[token] += LEVELS[f["prob2"][node]][of]
        inner = np.flatnonzero(~starts[token + 1])
        token, of = token[inner] + 1, of[inner]
        weight2[token] = LEVELS[f["back2"][node]][of]
        inner = np.flatnonzero(rank[token] >= 0)
        token, of = token[inner], of[inner]
        x = rank[token].astype(U64)
        third = successor(f["words3"], bits, lo[of], hi[of], x)
        there = np.flatnonzero(third < hi[of])
        there = there[unpack(f["words3"], bits, third[there]) == x[there]]
        p3[token[there]] = LEVELS[f["prob3"][third[there]]]
    return counts[codes], np.log10(base)[codes], np.log10(p3[:-1] + weight2[:-1] * p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""

    def run(batches):
        for rows, hashes, codes, first in chunks(batches):
            counts, base, own = token_log10(model, hashes, codes, first)
            sums = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            yield pd.DataFrame({
                "doc_id": rows["doc_id"].to_numpy(), "n_tokens": np.diff(np.append(first, len(codes))), "n_known": sums((counts > 0).astype(np.int64)),
                "train_tokens": np.full(len(first), model.tokens), "base_score": sums(base), "score": sums(own),
            })

    # doc_id travels as text: a column of integers with nulls would reach pandas as floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = id_bucket("doc_id", 7) == 2
    out = score(docs, train(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
