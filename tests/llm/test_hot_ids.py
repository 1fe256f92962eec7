"""Rows of which half have no doc_id and a sixth share one: no range, file or window holds them all. Owners of words by bytes."""

import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import fingerprints, ngram_lm, sstable, tokens
from tallywork.llm.common import materialize, run_dir

N = 3000


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(None if i % 2 else 7 if i % 6 == 0 else i, f"text {i % 1000} of some {i * 7919 % 13} words") for i in range(N)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def even(counts, n):
    assert len(counts) >= n and max(counts) <= 4 * statistics.median(counts)


def test_shards_of_hot_ids(spark, hot):
    path, place = tokens.vocabulary("word_bpe_49k.json"), run_dir(spark, "sst")
    shards = materialize(sstable.write_shards(hot, path, place), f"{place}/shards")
    even([r["n_docs"] for r in shards.groupBy("shard").agg(F.sum("n_docs").alias("n_docs")).collect()], 4)
    got = sorted(sstable.read_shards(shards).collect(), key=lambda r: r["start"])
    t = tokens.tokenizer(path)
    rows = hot.withColumn("h", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    ids = [[*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in rows]
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r["doc_id"], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids, strict=True)]
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([len(x) for x in ids])[:-1])).tolist()
    readers = [sstable.ShardReader(r["file"]) for r in shards.collect()]
    for d in (None, 7, 2, 5):
        values = [v for r in readers for v in r.get(d)]
        assert len(values) == sum(r["doc_id"] == d for r in rows)


def test_windows_of_hot_ids(hot):
    at = hot.withColumn("h", F.xxhash64("text")).withColumn("bucket", fingerprints.order_buckets(hot))
    counts = {r["bucket"]: r["count"] for r in at.groupBy("bucket").count().collect()}
    assert max(counts.values()) < N / 20  # of 36 ranges
    rows = sorted(at.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    buckets = [r["bucket"] for r in rows]
    assert buckets == sorted(buckets)
    got = fingerprints.with_next(hot.withColumn("fp", F.array(F.xxhash64("text")))).collect()
    following = {}
    for i, r in enumerate(rows):
        following.setdefault((r["doc_id"], r["text"]), []).append(rows[(i + 1) % N]["text"])
    assert len(got) == N
    seen = {}
    for r in got:
        seen.setdefault((r["doc_id"], r["text"]), []).append(r["next_text"])
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in following.items()}


def test_owners_of_words_by_bytes(monkeypatch, hot):
    plain = ngram_lm.train(hot)
    monkeypatch.setattr(ngram_lm, "SLICE", 4_000)
    sliced = ngram_lm.train(hot)
    assert plain.word_shards == 4 and sliced.word_shards > 10
    assert (plain.tokens, plain.words, plain.docs) == (sliced.tokens, sliced.words, sliced.docs)
    a, b = (sorted(tuple(r)[1:] for r in ngram_lm.score(hot, m).collect()) for m in (plain, sliced))
    assert np.allclose(a, b, rtol=1e-4)
