"""The dealt methods of packing and fingerprints, recomputed apart from the code's own path."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywork.llm import fingerprints, packing, tokens

from .test_operators import docs, none, odd, texts_of  # noqa: F401


def test_the_stream_ascends_by_hilbert_key(spark, sf):
    """The documents' order in the sequences is that of the keys of the library's own ids, then of doc_id."""
    path = tokens.vocabulary("byte_bpe_50k.json")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    t = tokens.tokenizer(path)
    ids = {d: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1]) for d, text in texts_of(table)}
    keys = dict(zip(ids, packing.curve_keys(list(ids.values()), tokens.encoder(path).size).tolist(), strict=True))
    got = packing.op1_hilbert_packing(spark, sf).filter("start = 0").orderBy("sequence_id", "offset").collect()
    stream = [r["doc_id"] for r in got]
    assert stream == sorted(ids, key=lambda d: (keys[d], d)) and len(set(keys.values())) > len(ids) / 2
    # Documents that follow one another are nearer than documents at random.
    dim_of, signs = packing.projection(tokens.encoder(path).size)
    v = {d: np.sqrt(np.bincount(dim_of[x], minlength=packing.WIDTH)) for d, x in ids.items()}
    v = {d: x / np.linalg.norm(x) for d, x in v.items()}
    near = np.mean([v[a] @ v[b] for a, b in zip(stream, stream[1:], strict=False)])
    other = np.mean([v[a] @ v[b] for a, b in zip(sorted(ids, key=str), sorted(ids), strict=True) if a != b])
    assert near > other + 0.05


def shingle_hash(words):
    """The hash of an array of texts: each element's XXH64 with the one before as its seed, from 42 on."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def sketch(text, k=fingerprints.K):
    w = [x.decode() for x in (text or "").lower().encode().split()]
    return sorted({shingle_hash(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())[:k]


def likeness(a, b, k=fingerprints.K):
    if not a or not b:
        return float(not a and not b)
    union = sorted({*a, *b})[:k]
    return len([h for h in union if h in set(a) and h in set(b)]) / len(union)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fingerprints_are_bottom_k_sketches(request, spark, tmp_path, which):
    df = request.getfixturevalue(which)
    df = df.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted((d, t or "") for d, t in texts_of(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    got = {r["doc_id"]: r for r in fingerprints.op9_fingerprints(spark, str(tmp_path)).collect()}
    text = lambda hashes: "".join(f"{h & ((1 << 64) - 1):016x}" for h in hashes)
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        own, other = sketch(t), sketch(edited)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == text(own) and r["edited_fingerprint"] == text(other)
        assert r["near_edited"] == pytest.approx(likeness(own, other)) and r["near_next"] == pytest.approx(likeness(own, sketch(following)))
    assert len(got) == len(rows)


def test_merging_and_containment_follow_the_sets(spark):
    """Small sets: sketches hold all hashes, so merging, containment and counts are exact."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(30, 90))
    s = fingerprints.sketch
    df = spark.range(1).select(s(F.lit(a)).alias("a"), s(F.lit(b)).alias("b"))
    r = df.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("a")).alias("n"), fingerprints.resemblance(F.col("a"), F.col("b")).alias("j")).first()
    both, shared = {*sketch(a), *sketch(b)}, {*sketch(a)} & {*sketch(b)}
    assert r["m"] == sorted(both) and r["n"] == 56 and r["c"] == pytest.approx(len(shared) / 56) and r["j"] == pytest.approx(len(shared) / len(both))
