"""The Merkle manifest against a recursion over lists, and its paths by themselves."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallywork.llm import merkle

from .test_operators import docs, none, odd  # noqa: F401


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """(root, for each leaf its runs and its place in them)."""
    paths, groups = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, wider = [], []
        for at in range(0, len(hashes), 3):
            run = hashes[at : at + 3]
            for slot, group in enumerate(groups[at : at + 3]):
                for i in group:
                    paths[i].append((run, slot))
            above.append(digest("".join(run)))
            wider.append(sum(groups[at : at + 3], []))
        hashes, groups = above, wider
    return hashes[0], paths


def brute(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: tree([leaf_of(r) for r in by[s]]) for s in sources}
    root, upper = tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, above in zip(sources, upper, strict=True):
        for r, own in zip(by[s], trees[s][1], strict=True):
            path = own + above
            others = "".join(x for run, slot in path for i, x in enumerate(run) if i != slot)
            cut = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf_of((*r[:4], r[4].replace("\n", "")) if cut else r)
            for run, slot in path:
                now = digest("".join([*run[:slot], now, *run[slot + 1 :]]))
            out.append((r[0], leaf_of(r), trees[s][0], root, digest(others), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_manifest(request, spark, tmp_path, which):
    df = request.getfixturevalue(which)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute([tuple(r) for r in df.select(*merkle.FIELDS).collect()])
    assert which != "docs" or len({r[6] for r in got}) == 2


def test_heights(spark):
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 729, 730, 3**20, 3**20 + 1]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", merkle.height(F.col("n")).alias("h"))
    assert [h for _, h in sorted(rows.collect())] == [0, 1, 1, 2, 2, 3, 3, 4, 6, 7, 20, 21]


@pytest.mark.parametrize("n", [1, 728, 729, 730, 2188])
def test_paths_over_several_rounds(spark, n):
    """Trees whose last run is short at the ends of blocks, and one of more than one round."""
    rows = [(None if i % 2 else "s", i, digest(str(i))) for i in range(n)]
    out = merkle.manifest(spark.createDataFrame(rows, "source string, doc_id long, leaf string")).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(out) == n and all(r["again"] == r["root"] for r in out)
    for s in (None, "s"):
        own = [leaf for source, _, leaf in rows if source == s]
        if own:
            root, paths = tree(own)
            got = {r["doc_id"]: r for r in out if (r["doc_id"] % 2 == 1) == (s is None)}
            assert {r["subroot"] for r in got.values()} == {root}
            # The source's own levels come first, then those over the sources.
            want = {d: [("".join(run), slot) for run, slot in path] for d, path in zip(sorted(got), paths, strict=True)}
            assert all([(x["preimage"], x["slot"]) for x in got[d]["path"]][: len(p)] == p for d, p in want.items())


def test_stored_preimages_hash_to_the_nodes_above(spark, tmp_path):
    nodes = spark.createDataFrame([("t", 7, i, digest(str(i)), None) for i in range(1000)], "tree string, levels int, idx long, hash string, carry string")
    rounds, roots = merkle.build(nodes, f"file://{tmp_path}")
    first = sorted(rounds[0].collect(), key=lambda r: r["block"])
    assert len(rounds) == 2 and [len(r["kids"]) for r in first] == [729, 271]
    for r in first:
        assert [digest(p) for p in r["pre5"]] == [p[i : i + 64] for p in r["pre6"] for i in range(0, len(p), 64)]
        assert digest(r["pre6"][0]) == r["top"]
    assert roots.first()["hash"] == tree([digest(str(i)) for i in range(1000)])[0]
