"""Training-data operators against brute-force versions, on the smallest tables and on odd rows."""

import collections
import hashlib
import html.parser
import io
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywork.llm import components as cc
from tallywork.llm import eliasfano, exact_dedup, fingerprints, jaccard_join, mixing, ngram_lm, packing, quality, sstable, tokens, toxicity, warc
from tallywork.llm.common import materialize, run_dir

BIG = (1 << 60) + 1
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
#: Null and empty texts, repeated rows, copies, near copies, white space, long texts, large and null identifiers.
ODD = [
    (None, "no id here at all", "en", "a"), (1, None, None, None), (2, "", "en", None), (3, " \t\n", "en", "a"), (4, "One  two\tthree", "en", "a"), (5, "One two three", "en", "b"), (6, "one two three", "en", "b"),
    (7, " ".join(WORDS * 3), "en", "b"), (8, " ".join([*WORDS * 3, "extra"]), "en", "b"), (9, "x" * 5000, "en", "c"), (9, "x" * 5000, "en", "c"), (10, "É́ naïve ﬁ <|endoftext|> 𝒳 \x00 z", "fr", "c"), (BIG, "big id", "en", "a"),
    (11, " ".join(f"w{i}" for i in range(30_000)), "en", "a"), (12, "a", "en", "d"), (13, "a b  c", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    # Columns whose names the operators use inside.
    return rows.select("*", *(F.lit(0).alias(x) for x in ("size", "h", "bucket", "label", "stats", "key", "rid", "sid", "sha", "norm", "owner", "target", "position", "fp", "held_out")))


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def pandas(df):
    return df.toPandas()


def words_of(t):
    return (t or "").encode().lower().split()


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 packing


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = packing.hilbert_index(grid, 3)
    assert sorted(h) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = packing.pack(df, path).orderBy("sequence_id", "offset").collect()
    t, ids = tokens.tokenizer(path), collections.Counter()
    for d, text in texts_of(df):
        ids[d, tuple([*t.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    at, seen, now = 0, collections.Counter(), []
    for r in got:
        piece = np.frombuffer(r["ids"], "<u4")
        assert r["sequence_id"] * 2048 + r["offset"] == at and r["length"] == len(piece) and r["offset"] + r["length"] <= 2048
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
        at += len(piece)
        assert r["start"] == len(now)
        now += piece.tolist()
        if len(now) == r["doc_tokens"]:
            seen[r["doc_id"], tuple(now)] += 1
            now = []
    assert seen == ids and not now


def test_packing_keeps_the_order_of_windows(docs):
    rows = packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), window=F.col("doc_id") % 4).collect()
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r["doc_id"] % 4].append(r["sequence_id"] * 2048 + r["offset"])
    assert all(max(spans[i]) < min(spans[i + 1]) for i in range(3))


def test_packing_nothing(none):
    assert packing.pack(none, tokens.vocabulary("byte_bpe_50k.json")).count() == 0


# tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,'\n\t Éé́1'<|>İ 　B$#_-2\rß~"), max_size=40), max_size=8))
def test_words_once_is_whole_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.encoder(tokens.vocabulary(name))
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [x.ids for x in e.t.encode_batch(texts, add_special_tokens=False)]


# 2 toxicity


def test_gradients():
    net = toxicity.Network(1)
    words, idx, mask, of = toxicity.windows([b"the quick brown fox jumps over a lazy dog".split(), b"bad words here".split()])
    codes, y = toxicity.word_codes(words), np.array([0.0, 1.0])[of]
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    before, w = {k: v.copy() for k, v in net.p.items()}, np.ones(len(of))

    def loss():
        z = net.forward(net.gates(net.inputs(codes)), idx, mask).astype(float)
        return float((np.logaddexp(0, z) - y * z).mean())

    net.speed = {k: np.full_like(v, 1e12) for k, v in net.p.items()}
    net.learn(net.inputs(codes), codes, idx, mask, y, w, 1e6)
    grad = {k: before[k] - net.p[k] for k in before}
    net.p = {k: v.copy() for k, v in before.items()}
    for k, g in grad.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][i] += 1e-3
        a = loss()
        net.p[k][i] -= 2e-3
        b = loss()
        net.p[k][i] += 1e-3
        assert g[i] == pytest.approx((a - b) / 2e-3, rel=0.02, abs=1e-5), k


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        at = toxicity.starts_of(n)
        assert {j for s in at for j in range(s, min(n, s + toxicity.STEPS))} == set(range(n)) and all(s < n for s in at)


def test_toxicity_learns(spark, odd, none):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(200):
        w = rng.choice(WORDS, 60).tolist()
        if i % 2:
            for j in rng.integers(0, 60, 5):
                w[j] = "vequ" + WORDS[rng.integers(0, 19)]
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.col("doc_id") >= 150
    net = toxicity.fit_sample(toxicity.sample(docs, lab, held), epochs=10)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in range(150, 200)) >= 46
    out = toxicity.score(odd, net).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out) and {r["score"] < 0.5 for r in out if r["doc_id"] in (1, 2, 3)} == {True}
    assert toxicity.score(none, net).count() == 0
    assert toxicity.fit_sample(toxicity.sample(docs, lab.filter("toxic = 0"))) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.25}


def test_forward_is_the_plain_network():
    """Each gate, state and weight of each window by loops over single numbers."""
    net = toxicity.Network(4)
    texts = [[f"w{i % 7}".encode() for i in range(n)] for n in (1, 5, 40)] + [[b"x" * 60, b"y"]]
    words, idx, mask, of = toxicity.windows(texts)
    codes, p, h = toxicity.word_codes(words), {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    got = net.logits(codes, idx, mask)
    sig = lambda x: 1 / (1 + math.exp(-x))
    bucket, owner, grams = codes
    vector = []
    for i in range(len(words)):
        own = [p["gram"][g] for k in range(len(owner)) if owner[k] == i for g in grams[k] if g >= 0]
        vector.append(p["word"][bucket[i]] + sum(own) / len(own))
    for n in range(len(idx)):
        places = [t for t in range(toxicity.STEPS) if mask[n, t]]
        states = {t: [] for t in places}
        for d, order in ((0, places), (1, places[::-1])):
            now = [0.0] * h
            for t in order:
                gate = [sum(vector[idx[n, t]][e] * p["w"][e, 3 * h * d + k] for e in range(toxicity.EMBED)) + p["b"][3 * h * d + k] for k in range(3 * h)]
                held = [sum(now[e] * p[f"u{d}"][e, k] for e in range(h)) for k in range(3 * h)]
                z = [sig(gate[k] + held[k]) for k in range(h)]
                r = [sig(gate[h + k] + held[h + k]) for k in range(h)]
                c = [math.tanh(gate[2 * h + k] + r[k] * held[2 * h + k]) for k in range(h)]
                now = [(1 - z[k]) * c[k] + z[k] * now[k] for k in range(h)]
                states[t] = states[t] + now
        e = {t: math.exp(sum(x * y for x, y in zip(states[t], p["a"], strict=True))) for t in places}
        pooled = [sum(e[t] * states[t][k] for t in places) / sum(e.values()) for k in range(2 * h)]
        assert got[n] == pytest.approx(sum(x * y for x, y in zip(pooled, p["o"], strict=True)) + p["c"][0], abs=1e-4)


def test_toxicity_sample_is_whole(spark):
    rows = [(1, " ".join(f"W{i}" for i in range(20_000)), 1), (2, "a  b", 0), (3, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: bytes(r["words"]).split() for r in toxicity.sample(df.drop("toxic"), df.drop("text")).collect()}
    assert got == {d: words_of(t) for d, t, _ in rows}


def test_toxicity_epochs_are_fixed(monkeypatch):
    steps = []
    learn = toxicity.Network.learn
    monkeypatch.setattr(toxicity.Network, "learn", lambda self, *a: (steps.append(1), learn(self, *a))[1])
    texts, y = [words_of(WORDS[i % 9] + " bad" * (i % 2)) for i in range(20)], np.arange(20) % 2.0
    assert toxicity.fit(texts, y, np.ones(20, int), np.ones(20), epochs=3) is not None and len(steps) == 3
    # In slices of windows the features are the same.
    net = toxicity.Network()
    whole = toxicity.features(net, texts)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    assert np.allclose(toxicity.features(net, texts), whole)


# 3 sorted-string tables


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_shards(request, spark, which):
    df = request.getfixturevalue(which)
    path, place = tokens.vocabulary("word_bpe_49k.json"), run_dir(spark, "sst")
    shards = materialize(sstable.write_shards(df, path, place), f"{place}/shards")
    got = sstable.read_shards(shards).collect()
    t = tokens.tokenizer(path)
    want = collections.Counter((d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, x in texts_of(df))
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    readers = [sstable.ShardReader(r["file"]) for r in shards.collect()]
    n = collections.Counter(d for d, _ in texts_of(df))
    for d in [*n, 999_999_999, -5]:
        assert sum(len(r.get(d)) for r in readers) == n[d]


def test_blocks_share_keys():
    out = io.BytesIO()
    w = sstable.ShardWriter(out, 2, block=64)
    for i in range(500):
        w.add(sstable.key_of(i * 3), b"ab" * (i % 5))
    w.finish()
    assert len(w.index) > 10 and len(out.getvalue()) < 500 * 20


def test_shards_go_on_in_further_files(spark, docs):
    path, place = tokens.vocabulary("word_bpe_49k.json"), run_dir(spark, "sst")
    shards = materialize(sstable.write_shards(docs, path, place, limit=50_000), f"{place}/shards")
    assert shards.agg(F.max("piece")).first()[0] > 0
    whole = materialize(sstable.write_shards(docs, path, f"{place}-whole"), f"{place}-whole/shards")
    assert sorted(map(tuple, sstable.read_shards(shards).collect())) == sorted(map(tuple, sstable.read_shards(whole).collect()))


# 4 language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 40) - 1), max_size=300), st.integers(0, 39))
def test_elias_fano(values, shift):
    v = np.array(sorted(x >> shift for x in values), np.uint64)
    s = eliasfano.Sequence(*eliasfano.encode(v, 1 << (40 - shift)).values())
    assert (s.get(np.arange(len(v))) == v).all()
    i = np.repeat(np.arange(max(0, len(v) - 1)), 2)
    lo, hi = s.runs(i)
    assert (lo == v[i]).all() and (hi == v[i + 1]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 22) - 1), min_size=1, max_size=200), st.integers(22, 57), st.integers(0, 10**6))
def test_successor_in_packed_runs(values, bits, seed):
    cut = np.sort(np.random.default_rng(seed).integers(0, len(values) + 1, 5))
    v = np.concatenate([np.sort(x) for x in np.split(np.array(values, np.uint64), cut)])
    raw = eliasfano.pack(v, bits)
    assert (eliasfano.unpack(raw, bits, np.arange(len(v))) == v).all()
    lo, hi = np.repeat([0, *cut], 3), np.repeat([*cut, len(v)], 3)
    x = np.tile(np.array([0, values[0], values[-1] + 1], np.uint64), 6)
    assert eliasfano.successor(raw, bits, lo, hi, x).tolist() == [a + int(np.searchsorted(v[a:b], y)) for a, b, y in zip(lo, hi, x, strict=True)]


def dictionary_model(texts):
    """Probability of a word after up to two others, from plain dictionaries: training token lists [begin, ..., end]."""
    c1, c2, c3 = (collections.Counter() for _ in range(3))
    for s in texts:
        c1.update(s[:-1])
        c2.update(zip(s, s[1:], strict=False))
        c3.update(zip(s, s[1:], s[2:], strict=False))
    count = collections.Counter(w for s in texts for w in s[1:])
    n1, n2 = collections.Counter(u for u, _ in c2), collections.Counter((u, v) for u, v, _ in c3)
    n, v = sum(count.values()), len(count)

    def p(before, w):
        out = (count[w] + 1) / (n + v + 1)
        u = before[-1]
        if c1[u]:
            out = max(0, c2[u, w] - 0.8) / c1[u] + 0.8 * n1[u] / c1[u] * out
        if len(before) > 1 and n2[tuple(before[-2:])]:
            pair = tuple(before[-2:])
            out = max(0, c3[*pair, w] - 0.9) / c2[pair] + 0.9 * n2[pair] / c2[pair] * out
        return out

    return p, count, n, v


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_language_model(request, monkeypatch, which):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(ngram_lm, "SHARD", 1_000)  # frequent words lie in several shards
    keep = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    model = ngram_lm.train(df.filter(keep))
    assert model.shards > 3 and (model.back_of_split or which == "odd")
    got = collections.defaultdict(list)
    for r in ngram_lm.score(df, model).collect():
        got[r["doc_id"], r["n_tokens"]].append(r)
    rows = texts_of(df)
    p, count, n, v = dictionary_model([[b"\r", *words_of(t), b"\n"] for d, t in rows if d is None or d % 7 != 2])
    for d, t in rows:
        s = [b"\r", *words_of(t), b"\n"]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s[1:])
        own = sum(math.log10(p(s[max(0, j - 2) : j], s[j])) for j in range(1, len(s)))
        r = got[d, len(s) - 1][0]
        assert r["train_tokens"] == n and r["n_known"] == sum(count[w] > 0 for w in s[1:])
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(own, abs=3e-4 * len(s))


def test_language_model_query(spark, tmp_path):
    rng = np.random.default_rng(11)
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2]
    texts = {d: " ".join(rng.choice(WORDS, 40)) + f" only{d}" for d in range(200)}
    source = next(d for d in range(200) if d not in held)
    texts[held[0]] = texts[source]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = ngram_lm.op4_ngram_lm(spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = {r["doc_id"]: r for r in df.collect()}
    grams = {d: [b"\r", *words_of(t), b"\n"] for d, t in texts.items()}
    p, _, n, _ = dictionary_model([s for d, s in grams.items() if d not in held])
    for d, s in grams.items():
        own = sum(math.log10(p(s[max(0, j - 2) : j], s[j])) for j in range(1, len(s)))
        assert got[d]["held_out"] == (d in held) and got[d]["train_tokens"] == n and got[d]["score"] == pytest.approx(own, abs=3e-4 * len(s))
    # Grams seen once count: a held-out text that copies a training text scores as it.
    assert got[held[0]]["score"] == got[source]["score"]


def test_language_model_of_a_certain_context(spark):
    # Ten thousand times the same follower: the back-off weight is small, but not lost.
    rows = [(i, "all rights reserved") for i in range(10_000)] + [(-1, "b c")]
    model = ngram_lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    p, _, _, _ = dictionary_model([[b"\r", *words_of(t), b"\n"] for _, t in rows])
    probe = ["all c", "all rights c", "all rights reserved", "zz", "all zz"]
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(probe):
        s = [b"\r", *words_of(t), b"\n"]
        assert got[i] == pytest.approx(sum(math.log10(p(s[max(0, j - 2) : j], s[j])) for j in range(1, len(s))), abs=2e-3) and got[i] > -25


def test_language_model_sums_to_one(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 12))) for _ in range(60)]
    model = ngram_lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for context in ("alpha", "alpha beta", texts[3], "unknown", "unknown alpha"):
        # Each word, then any unknown one, then the end behind the context.
        held = [w.encode() for w in context.split()]
        total = 0.0
        for last in [*(w.encode() for w in WORDS), b"nobody", b"\n"]:
            words = [*held, last, *([b"\n"] if last != b"\n" else [])]
            number = ngram_lm.Numbers({b"\n": 0})
            codes = np.array([number[w] for w in words], np.int32)
            hashes = np.array([ngram_lm.xxhash.xxh64_intdigest(w) for w in number], np.uint64)
            total += 10 ** ngram_lm.token_log10(model, hashes, codes, np.array([0]))[2][len(held)]
        assert total == pytest.approx(1, abs=2e-3)


def test_language_model_of_nothing(none, odd):
    model = ngram_lm.train(none)
    assert {(r["score"], r["n_known"]) for r in ngram_lm.score(odd, model).collect()} == {(0.0, 0)}
    assert ngram_lm.score(none, model).count() == 0


# 5 mixing


def fill(sizes, weights, cap=3):
    """Targets by setting aside what is above its cap, over and over."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i] + 1e-9]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.remove(i)
    return target


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    got = mixing.plan(df).collect()
    rows = texts_of(df)
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in df.select("source", "text").collect():
        size[r["source"]] += len((r["text"] or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(names, fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in names)
    copies = mixing.curriculum(mixing.plan(df)).collect()
    assert "rangepartitioning" in mixing.curriculum(mixing.plan(df))._jdf.queryExecution().toString()
    assert [r["position"] for r in copies] == sorted(r["position"] for r in copies) and sum(r["words"] for r in copies) == sum(taken.values())
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    assert sum(len(r["text"].encode().split()) for r in mixed.select("text").collect()) == sum(taken.values())


def test_mixing_rows_that_share_an_id(spark):
    rows = [(None if i % 3 == 0 else 1 if i % 3 == 1 else i, " ".join([f"t{i}"] * (3 + i % 5)), "abc"[i % 7 % 3]) for i in range(90)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned, mixed = mixing.plan(df).collect(), mixing.mix_documents(df).collect()
    words = collections.Counter()
    for r in mixed:
        assert (r["doc_id"], r["source"]) in {(d, s) for d, t, s in rows if t.split()[0] == r["text"].split()[0]}
        words[r["text"].split()[0]] += len(r["text"].split())
    assert sum(words.values()) == sum(r["taken"] for r in planned)
    assert len(mixed) == sum(math.ceil(r["taken"] / r["size"]) for r in planned)
    size = collections.Counter()
    for _, t, _ in rows:
        size[t.split()[0]] += len(t.split())
    assert all(n <= 3 * size[t] for t, n in words.items())


def test_schedule_inverts(spark):
    """position() against the summed weight schedule."""
    target, steps = 700.0, 200_000
    t = (np.arange(steps) + 0.5) / steps
    for slope in mixing.SLOPES:
        demand = np.concatenate(([0.0], np.cumsum(target * (1 + slope * (2 * t - 1)) / steps)))
        assert demand[-1] == pytest.approx(target)
        words = [0, 1, 100, 350, 699, 700, 900]
        got = spark.createDataFrame([(w,) for w in words], "w long").select(mixing.position(F.col("w"), F.lit(target), F.lit(slope)).alias("p")).collect()
        want = [min(1.0, float(np.interp(w, demand, np.linspace(0, 1, steps + 1)))) for w in words]
        assert [r["p"] for r in got] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_schedule_gives_rows(request, which):
    df = request.getfixturevalue(which)
    got = mixing.scheduled(df).collect()
    planned = mixing.plan(df).collect()
    key = lambda r: (r["doc_id"] or 0, r["size"], r["taken"], r["first_position"] or 0)
    assert sorted(map(key, got)) == sorted(map(key, planned))
    assert all(r["passes"] == (math.ceil(r["taken"] / r["size"]) if r["size"] else 0) for r in got)


def test_mix_query_runs_the_schedule(spark, sf, monkeypatch):
    whole = mixing.curriculum
    monkeypatch.setattr(mixing, "curriculum", lambda taken: whole(taken).filter("pass_no = 0"))
    rows = mixing.op5_curriculum_mix(spark, sf).collect()
    assert any(r["taken"] for r in rows) and all(r["taken"] <= r["size"] for r in rows)


def test_mixing_nothing(none):
    assert mixing.plan(none).count() == 0 and mixing.mix_documents(none).count() == 0


# 6 exact copies


def normal(t):
    out, gap = [], False
    for ch in t or "":
        if ch in " \t\n\x0b\x0c\r":
            gap or out.append(" ")
            gap = True
        else:
            out.append(ch)
            gap = False
    return "".join(out)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_exact(request, which):
    df = request.getfixturevalue(which)
    groups = collections.defaultdict(list)
    for d, t in texts_of(df):
        groups[normal(t)].append(d)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        want.update((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids)
    got = exact_dedup.resolve(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert collections.Counter(map(tuple, got)) == want
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(w[0] for w in want.elements() if w[3])


def test_copies_go_by_text(spark):
    rows = [(1, "a b", 0), (2, "a  b", 0), (2, "other", 0), (None, None, 0), (3, "", 0), (None, "a b", 0)]
    left = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, sha int"))
    assert sorted(map(tuple, left.collect())) == [(1, "a b", 0), (2, "other", 0), (3, "", 0)]


def test_one_row_of_each_text_stays(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d e"), (None, "d  e"), (None, "f"), (3, "f"), ((1 << 63) - 1, "g"), (None, None), (5, "")]
    kept = exact_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 6 and {(r["doc_id"], r["text"]) for r in kept} - {(None, "d e"), (None, "d  e")} == {(1, "a b"), (1, "c"), (3, "f"), ((1 << 63) - 1, "g"), (5, "")}


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (None, c), (None, c + " end"), (None, "alone here"), (7, "x y"), (7, "x y"), (8, None), (8, "")]
    kept = jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((r["doc_id"], r["text"]) for r in kept)
    assert sum(n for (_, t), n in got.items() if t and t.startswith("c0")) == 1
    assert {k: n for k, n in got.items() if not (k[1] or "").startswith("c0")} == {(1, a): 1, (2, b): 1, (None, "alone here"): 1, (7, "x y"): 1, (8, None): 1, (8, ""): 1}


def test_index_splits_and_chains(tmp_path):
    rng, index, ref = np.random.default_rng(1), exact_dedup.HashIndex(4), {}
    hash_of = lambda t: int.from_bytes(hashlib.sha256(t[:3]).digest()[:8], "big")  # noqa: E731  collides
    sha_of = lambda t: hashlib.sha256(t).digest()
    for i, t in enumerate(sorted((str(x).encode() for x in rng.integers(0, 2000, 3000)), key=hash_of)):
        index.add(hash_of(t), sha_of(t), t, 5000 - i, 1)
        a = ref.get(t, (5000 - i, 0))
        ref[t] = (min(a[0], 5000 - i), a[1] + 1)
    (tmp_path / "x.index").write_bytes(index.to_bytes())
    file = exact_dedup.IndexFile(str(tmp_path / "x.index"))
    assert index.depth > 5 and index.n == len(ref) and all(file.find(hash_of(t), sha_of(t)) == v for t, v in ref.items())
    assert max(len(file.chained(hash_of(t))) for t in ref) == 11 and file.find(hash_of(b"nope"), sha_of(b"nope")) is None


def test_index_goes_on_in_further_files(spark, docs, monkeypatch):
    place = run_dir(spark, "exact")
    whole = sorted(map(tuple, exact_dedup.resolve(docs).collect()))
    monkeypatch.setattr(exact_dedup, "FILE", 10)
    assert materialize(exact_dedup.build_index(docs, place), f"{place}/files").count() > 8
    assert sorted(map(tuple, exact_dedup.resolve(docs).collect())) == whole


# 7 WARC


URI = "http://x/\r\nWARC-Type: request"


def test_warc(spark, sf):
    own = [(-1, None, None), (-2, URI, "<a href='/y&amp;z'>t</a><script>var t='</p>';</script><p>1 &lt; 2<br>3<!-- x"), (-2, URI, ""), (None, "u", "<p>n")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(20).union(spark.createDataFrame(own, "page_id long, url string, html string"))
    records = warc.derive(warc.responses(pages), keep=("page_id",))
    rows = records.collect()
    assert len(rows) == 2 * pages.count()
    src = {(r["page_id"], r["payload_digest"]): r for r in warc.responses(pages).collect()}
    for r in rows:
        s = src[r["page_id"], r["source_digest"]]
        assert r["refers_to"] == s["record_id"] and r["source_digest"] == "sha256:" + hashlib.sha256(s["payload"].encode()).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
        assert r["headers"].count("WARC-Type: ") == 1 + 2 * (r["page_id"] == -2) and r["headers"].count("\nWARC-Type: ") == 1
        assert all(re.fullmatch(r"[A-Za-z_-]+: [^\r\n]+", x) for x in r["headers"].split("\r\n")[1:-1])
    own = {r["warc_type"]: r["block"] for r in rows if r["page_id"] == -2 and "1 &lt;" in src[-2, r["source_digest"]]["payload"]}
    assert own["conversion"] == "t\n1 < 2\n3" and "outlink: /y&z\r\n" in own["metadata"] and "source-http: Content-Type: text/html" in own["metadata"]
    assert {r["target_uri"] for r in rows if r["page_id"] == -2} == {"http://x/%0D%0AWARC-Type: request"}
    place = run_dir(spark, "warc")
    files = materialize(warc.write_warc(records, place), f"{place}/files")
    back = warc.fields(warc.read_warc(files), page_id="long")
    assert collections.Counter(back.collect()) == collections.Counter(records.select(*back.columns).collect())


def test_warc_query(spark, sf, tmp_path):
    got = warc.op7_warc_derivatives(spark, sf)
    want = warc.derive(warc.responses(spark.read.parquet(f"{sf}/pages.parquet")), keep=("page_id",))
    assert collections.Counter(got.collect()) == collections.Counter(want.select(*got.columns).collect())
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op7_warc_derivatives(spark, str(tmp_path)).count() == 0
    clash = spark.createDataFrame([(1, "u", "<p>a", "k", "b")], "page_id long, url string, html string, keep string, block string")
    assert {r["block"] for r in warc.derive(warc.responses(clash)).select("block", "warc_type").filter("warc_type = 'conversion'").collect()} == {"a"}


def parsed_page(page):
    """Text, links and title by the standard library's parser, of well-formed pages."""

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.links, self.title, self.hidden, self.inside = [], [], None, 0, False

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template", "svg")
            self.inside = tag == "title"
            if warc.BLOCK.fullmatch(f"<{tag}>"):
                self.out.append("\n")
            if tag == "a" and not self.hidden and dict(attrs).get("href"):
                self.links.append(" ".join(dict(attrs)["href"].split()))

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template", "svg")
            self.inside = False
            if warc.BLOCK.fullmatch(f"</{tag}>"):
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)
                if self.inside and self.title is None:
                    self.title = " ".join(data.split())

    r = Reader()
    r.feed(page)
    r.close()
    text = "\n".join(x for x in (" ".join(y.split()) for y in "".join(r.out).split("\n")) if x)
    return text, list(dict.fromkeys(r.links)), r.title


def test_warc_extracts_what_a_parser_does(spark, sf):
    same = n = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        text, links, title = parsed_page(r["html"])
        lines = warc.fields_of(r["html"]).split("\r\n")
        n += 1
        same += warc.text_of(r["html"]).split() == text.split() and [x[9:] for x in lines if x.startswith("outlink: ")] == links and (title is None or f"title: {title}" in lines)
    assert n and same >= 0.95 * n


def test_warc_titles_take_linear_time():
    began = time.time()
    assert "title" not in warc.fields_of("<title>" * 200_000)
    assert time.time() - began < 5


def test_warc_hidden_parts_end():
    page = "<p>a</p><svg viewBox='0 0 1 1'/><p>b <a href='/x'>l</a></p><SVG><title>no</title></SVG><p>c</p>"
    assert warc.text_of(page) == "a\nb l\nc" and "outlink: /x" in warc.fields_of(page)
    for name in ("noscript", "template", "svg"):
        page = f"<p>a</p><{name} class=k><p>b <a href='/y'>l</a></p><{name}><p>c</p>"
        assert warc.text_of(page) == "a\nb l\nc" and "outlink: /y" in warc.fields_of(page)
    for hidden in ("<script>b", "<style>b", "<!-- b", "<script>x</script><style>b</p>", "<!-->b"):
        assert warc.text_of(f"<p>a</p>{hidden}<p>c</p>") == "a"
    assert warc.text_of("a<noscript>b</noscript>c<script>d</script >e<!-- f -->g") == "a c e g"


# 8 Jaccard join


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    both = collections.Counter((a, b) for ids in inverted.values() for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def variants(n, seed):
    rng = np.random.default_rng(seed)
    rows, base = [], [f"w{x}" for x in rng.integers(0, 500, 90)]
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 500, rng.integers(1, 90))] if i % 4 == 0 else list(base)[: 90 - int(rng.integers(0, 12))]
        for j in rng.integers(0, len(w), rng.integers(0, 4)):
            w[j] = f"v{rng.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("which", ["docs", "odd", "none", "variants"])
def test_jaccard(request, spark, which):
    df = spark.createDataFrame(variants(160, 2), "doc_id long, text string") if which == "variants" else request.getfixturevalue(which)
    got = [tuple(r) for r in jaccard_join.join_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute_components(texts_of(df))
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {g[0] for g in got if g[0] == g[2]}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.integers(0, 80), st.integers(0, 80), st.integers(0, 10**6))
def test_linked_sets_share_a_tile(n, only_a, only_b, seed):
    rng = np.random.default_rng(seed)
    both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, min(k, n // 4), dtype=np.uint64)])) for k in (only_a, only_b))
    differ = np.bitwise_count(np.frombuffer(jaccard_join.bitmap(a), np.uint8) ^ np.frombuffer(jaccard_join.bitmap(b), np.uint8)).sum()
    if jaccard_join.linked(a, b):
        assert set(jaccard_join.tiles_of(a).tolist()) & set(jaccard_join.tiles_of(b).tolist())
        assert jaccard_join.may_link(len(a), len(b), int(differ))


def test_pairs_of_small_and_large_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    rows, sets = [], {}
    for tile in range(40):
        base = np.unique(rng.integers(0, 1 << 62, 40, dtype=np.uint64))
        for i in range(int(rng.integers(1, 12))):
            s = np.unique(np.concatenate([base[int(rng.integers(0, 6)) :], rng.integers(0, 1 << 62, int(rng.integers(0, 6)), dtype=np.uint64)]))
            sid = tile * 100 + i
            sets[sid] = s
            few = np.sort(np.concatenate([rng.choice(40, 3, replace=False), np.full(5, jaccard_join.NO_TILE)]))
            rows.append((tile, 0, 0, sid, sid if i % 3 else tile * 100, len(s), jaccard_join.bitmap(s), few))
    pdf = jaccard_join.pd.DataFrame(rows, columns=["tile", "lo", "hi", "sid", "root", "n", "bits", "few"])
    want = set()
    for t, _, _, a, ra, na, ba, fa in rows:
        for u, _, _, b, rb, nb, bb, fb in rows:
            differ = int(np.bitwise_count(np.frombuffer(ba, np.uint8) ^ np.frombuffer(bb, np.uint8)).sum())
            if t == u and a < b and ra != rb and 5 * min(na, nb) >= 4 * max(na, nb) and jaccard_join.may_link(na, nb, differ) and not {x for x in fa if x < t} & set(fb):
                want.add((a, b))
    assert len(want) > 50
    for small in (48, 4, 0):
        monkeypatch.setattr(jaccard_join, "FEW_CLASSES", small)
        assert {tuple(map(int, r)) for r in jaccard_join.pairs_within(pdf).itertuples(index=False)} == want


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    got = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(pairs, "a long, b long"), run_dir(spark, "cc")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert all(got.get(x, x) == find(x) for x in parent)


# 9 fingerprints


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sketches(request, spark, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = fingerprints.with_next(rows.withColumn("fp", fingerprints.sketch(F.col("text")))).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    out = got.select("doc_id", "text", "next_text", "edited", "fp", fingerprints.resemblance(F.col("fp"), fingerprints.sketch(F.col("edited"))).alias("near")).collect()
    assert len(out) == df.count()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"]) for r in out)
    following = collections.defaultdict(set)
    for i, (d, t) in enumerate(order):
        following[d, t].add(order[(i + 1) % len(order)][1])
    error = []
    for r in out:
        assert r["next_text"] in following[(r["doc_id"] is not None, r["doc_id"] or 0), r["text"]]
        n = len(r["text"])
        assert r["edited"] == r["text"][: n - n // 4] + r["next_text"][: n // 4]
        if which == "docs":
            sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in (x.lower().split() for x in (r["text"], r["edited"]))]
            error.append(abs(r["near"] - len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))))
    assert not error or np.mean(error) < 0.04


def test_fingerprints_query(spark, tmp_path, odd, none):
    for name, df in (("odd", odd), ("none", none), ("one", odd.limit(1))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = fingerprints.op9_fingerprints(spark, f"{tmp_path}/{name}").collect()
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in df.collect())
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        same = collections.defaultdict(set)
        for r in got:
            same[r["doc_id"], r["n_chars"]].add(r["fingerprint"])
        assert all(len(x) == 1 for x in same.values())


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(1, text), (1, " ".join(f"w{i}" for i in range(1000, 3000))), (2, "")], "k int, text string").withColumn("fp", fingerprints.sketch(F.col("text")))
    merged = fingerprints.merge_parts(df, "k", "fp")
    both = " ".join(f"w{i}" for i in range(3000))
    r = merged.filter("k = 1").select("fp", fingerprints.distinct_shingles(F.col("fp")).alias("n"), fingerprints.resemblance(F.col("fp"), fingerprints.sketch(F.lit(both))).alias("j"), fingerprints.containment(fingerprints.sketch(F.lit(text)), F.col("fp")).alias("c")).first()
    assert abs(r["n"] - 2996) < 900 and r["j"] > 0.9 and r["c"] > 0.8
    assert merged.filter("k = 2").first()["fp"] == []
    s = fingerprints.sketch
    assert spark.range(1).select(fingerprints.resemblance(s(F.lit("")), s(F.lit(None).cast("string")))).first()[0] == 1.0


# 10 quality


def test_isotonic():
    y = np.array([0.1, 0.5, 0.3, 0.2, 0.9, 0.8])
    out = quality.pool_violators(y, np.ones(6))
    assert (np.diff(out) >= 0).all() and out.sum() == pytest.approx(y.sum()) and out[1] == pytest.approx(1 / 3)


def test_quality(spark, docs, sf, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.col("doc_id") % 3 == 1
    model, stats = quality.train(docs, labels, held)
    got = {r["doc_id"]: r["s"] for r in stats.select("doc_id", quality.score_column(model, F.col("stats")).alias("s")).collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] % 3 == 1]
    assert np.mean([(got[d] >= 0.5) == bool(q) for d, q in known]) > 0.85
    # The same sums and scores without Spark.
    lab = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {d: quality.statistics(t) for d, t in texts_of(docs)}
    for d, s in list(got.items())[:50]:
        assert model.score(x[d][None])[0] == pytest.approx(s)
    train = [d for d in lab if d % 3 != 1]
    assert model.mean == pytest.approx(np.mean([x[d] for d in train], axis=0))
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert quality.keep_good(none, labels).count() == 0 and quality.train(none, labels)[1].count() == 0
    empty = quality.Model(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)), 1)
    assert empty.score(np.zeros((2, len(quality.NAMES)))).tolist() == [0.5, 0.5]


def test_quality_solves_the_normal_equations(spark):
    rng = np.random.default_rng(8)
    x = rng.random((300, len(quality.NAMES)))
    y = (x[:, 0] + x[:, 20] > 1).astype(float)
    fold = np.arange(300) % 5
    rows = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "stats array<double>, label double, fold int").repartition(3)
    model = quality.fit(rows, ridge=1e-3, seed=11)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -4, 4)
    r = np.random.default_rng(11)
    w, b = r.standard_normal((z.shape[1], 256)) / np.sqrt(z.shape[1]), r.uniform(0, 2 * np.pi, 256)
    phi = np.hstack([np.sqrt(2 / 256) * np.cos(z @ w + b), np.ones((300, 1))])
    f = phi[fold != 0]
    # Ridge as least squares over rows added for the penalty; the constant has none to speak of.
    penalty = np.sqrt(np.append(np.full(256, 1e-3 * len(f) / 256 + 1e-6 + 1e-9), 1e-9))
    want = np.linalg.lstsq(np.vstack([f, np.diag(penalty)]), np.append(y[fold != 0], np.zeros(257)), rcond=None)[0]
    assert phi @ model.weights == pytest.approx(phi @ want, abs=1e-6)
    # The features' products approximate the Gaussian kernel.
    d = ((z[:40, None] - z[None, :40]) ** 2).sum(axis=2)
    assert np.abs(phi[:40, :256] @ phi[:40, :256].T - np.exp(-d / 2 / z.shape[1])).mean() < 0.06


CONTRACTS = {
    "op1_hilbert_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset: bigint bigint bigint bigint bigint bigint bigint",
    "op2_toxicity": "doc_id held_out score predicted: bigint boolean double int",
    "op3_sstable_shards": "doc_id start n_tokens ids_crc32: bigint bigint bigint bigint",
    "op4_ngram_lm": "doc_id held_out n_tokens n_known train_tokens base_score score: bigint boolean bigint bigint bigint double double",
    "op5_curriculum_mix": "doc_id size source_size target taken: bigint bigint bigint double bigint",
    "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256: bigint bigint bigint boolean string",
    "op8_jaccard_join": "doc_id n_shingles component_id: bigint bigint bigint",
    "op9_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next: bigint bigint string string string double double",
    "op10_quality_classifier": "doc_id held_out score predicted: bigint boolean double int",
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_contract(spark, sf, name):
    """Columns, types, rows and held-out splits of the queries."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from tallywork.llm import queries

    df = queries.QUERIES[name](spark, sf)
    names, types = (x.split() for x in CONTRACTS[name].split(":"))
    assert df.dtypes[: len(names)] == list(zip(names, types, strict=True))
    rows = df.collect()
    texts = dict(texts_of(spark.read.parquet(f"{sf}/documents.parquet")))
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert set(ids) == set(texts) and (name == "op1_hilbert_packing" or max(ids.values()) == 1)
    split = {"op2_toxicity": (5, 0), "op4_ngram_lm": (7, 2), "op10_quality_classifier": (3, 1)}.get(name)
    if split:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % split[0] == split[1]) for r in rows)
    if "predicted" in df.columns:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name in ("op1_hilbert_packing", "op3_sstable_shards"):
        t = Tokenizer.from_file(path("byte_bpe_50k.json" if name[2] == "1" else "word_bpe_49k.json"))
        tokens_of = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts.items()}
        at = 0
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]) if "offset" in df.columns else r["doc_id"]):
            own = tokens_of[r["doc_id"]]
            if name[2] == "1":
                own = own[r["start"] : r["start"] + r["length"]]
                assert r["doc_tokens"] == len(tokens_of[r["doc_id"]]) and r["sequence_id"] * 2048 + r["offset"] == at
            else:
                assert r["start"] == at and r["n_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += len(own)


def test_special_tokens_are_the_librarys():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.encoder(tokens.vocabulary(name))
        texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z <|startoftext|>", "a <| b"]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [e.t.encode(x, add_special_tokens=False).ids for x in texts]
    assert tokens.tokenizer(tokens.vocabulary("byte_bpe_50k.json")).encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


@pytest.mark.parametrize("name", ["op5_curriculum_mix", "op6_exact_dedup"])
def test_sql(spark, sf, name):
    from tallywork.llm import queries

    c = duckdb.connect()
    c.sql(f"create view documents as from '{sf}/documents.parquet'")
    a = queries.QUERIES[name](spark, sf)
    b = c.sql(queries.SQL[name])
    order = sorted(a.columns)
    assert sorted(tuple(r[k] for k in order) for r in a.collect()) == sorted(tuple(r[b.columns.index(k)] for k in order) for r in b.fetchall())
