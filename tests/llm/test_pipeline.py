"""Each stage of the pipeline against a brute-force version over what its predecessor kept."""

import collections

import numpy as np

import corpus_pipeline as pipe
from tallywork.llm import mixing, quality, tokens

from .test_operators import ODD, brute_components, normal, texts_of


def test_stages(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(pipe, "WINDOW_ROWS", 16)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    for i, (_, stage) in enumerate(pipe.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(df.columns == columns for df in kept[:-1])
    texts = [texts_of(df) for df in kept[:-1]]
    model, _ = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {d for d, _ in texts[1]} == {d for d, t in texts[0] if model.score(quality.statistics(t)[None])[0] >= 0.5}
    groups = collections.defaultdict(list)
    for d, t in texts[1]:
        groups[normal(t)].append(d)
    assert sorted(d for d, _ in texts[2]) == sorted(min(g) for g in groups.values())
    assert {d for d, _ in texts[3]} == {d for d, _, c in brute_components(texts[2]) if d == c}
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan(kept[3]).collect()}
    words = collections.Counter()
    for d, t in texts[4]:
        words[d] += len(t.encode().split())
    assert words == collections.Counter({d: n for d, n in plan.items() if n})
    t = tokens.tokenizer(tokens.vocabulary("byte_bpe_50k.json"))
    ids = sorted((d, *t.encode(x, add_special_tokens=False).ids, 1) for d, x in texts[4])
    made, now = [], []
    for r in kept[5].orderBy("sequence_id", "offset").collect():
        now += np.frombuffer(r["ids"], "<u4").tolist()
        if len(now) == r["doc_tokens"]:
            made.append((r["doc_id"], *now))
            now = []
    assert sorted(made) == ids
    # The curriculum's order holds among its windows, of which there are several: none begins before the one ahead of it has ended.
    copies = collections.Counter(d for d, _ in texts[4])
    window = {r["doc_id"]: (r["file_name"], r["row_index"] // 16) for r in kept[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()}
    spans = collections.defaultdict(list)
    for r in kept[5].collect():
        if copies[r["doc_id"]] == 1:
            spans[window[r["doc_id"]]].append(r["sequence_id"] * 2048 + r["offset"])
    ordered = [spans[k] for k in sorted(spans)]
    assert len(ordered) >= 4 and all(max(a) < min(b) for a, b in zip(ordered, ordered[1:], strict=False))


def test_windows_follow_the_positions(spark, sf, tmp_path):
    """The files' row order is the curriculum's, however many files there are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pipe.mix_sources(spark, docs, sf).write.parquet(f"{tmp_path}/mixed")
    first = {r["doc_id"]: (r["first_position"], r["last_position"]) for r in mixing.scheduled(docs).collect()}
    rows = spark.read.parquet(f"{tmp_path}/mixed").select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    rows.sort(key=lambda r: (r["file_name"], r["row_index"]))
    at = [first[r["doc_id"]] for r in rows]
    # A document's copies lie between its first and its last position.
    low = 0.0
    for a, b in at:
        assert b >= low - 1e-12
        low = max(low, a)


def test_runs_leave_each_others_results(spark, sf):
    a = pipe.run(spark, sf)
    n = a.count()
    pipe.drop_low_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count()
    b = pipe.run(spark, sf)
    assert a.count() == b.count() == n > 0 and pipe.ORACLE_SQL is None


def test_which_odd_rows_stay(spark, sf, tmp_path):
    """Rows without or with shared identifiers, by their texts: one of each equal text, one of each component, the mix's words of each row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(*r, None) for r in ODD], docs.schema)
    df = docs.limit(40).unionByName(odd).unionByName(odd)
    kept = [texts_of(df)]
    for i, f in enumerate((pipe.drop_exact_copies, pipe.drop_near_copies, pipe.mix_sources)):
        f(spark, df, sf).write.parquet(f"{tmp_path}/{i}")
        df = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(texts_of(df))
    least = {}
    for d, t in kept[0]:
        least[normal(t)] = min(least.get(normal(t), (2, 0)), (d is None, d or 0))
    assert sorted((normal(t), (d is None, d or 0)) for d, t in kept[1]) == sorted(least.items())
    component = {t or "": c for (_, t), (_, _, c) in zip(kept[1], sorted(brute_components([(i, t) for i, (_, t) in enumerate(kept[1])])), strict=True)}
    assert sorted(component[t or ""] for _, t in kept[2]) == sorted(set(component.values()))
    # Of each text that stays, the mix has whole passes and one cut one.
    words = collections.Counter()
    whole = {tuple((t or "").encode().split()): len((t or "").encode().split()) for _, t in kept[2]}
    for _, t in kept[3]:
        w = tuple(t.encode().split())
        assert w in whole or any(x[: len(w)] == w for x in whole)
        words[next((x for x in whole if x == w), None)] += 1
    plan = mixing.plan(spark.read.parquet(f"{tmp_path}/1")).collect()
    assert sum(len(t.encode().split()) for _, t in kept[3]) == sum(r["taken"] for r in plan)


def test_odd_rows_and_empty_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(*r, None) for r in ODD], docs.schema)
    for name, df in (("odd", docs.limit(50).unionByName(odd).unionByName(odd)), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = pipe.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd")
        held = collections.Counter()
        for r in rows:
            held[r["sequence_id"]] += r["length"]
        assert all(held[s] == 2048 for s in held if s != max(held))
    # Rows that don't come from files have no windows, and are packed all the same.
    assert pipe.position_window(docs) is not None and pipe.position_window(odd) is None
    assert pipe.pack_sequences(spark, odd, sf).agg({"length": "sum"}).first()[0] > 0
