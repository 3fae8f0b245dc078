import os

import numpy as np
import pytest

from colloquy.llm import forest as N

DATA = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, score double, vector string, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.0, "v", 1) for i, v in rows], SCHEMA)


def brute(rows, k, every):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    found = []
    for q, a in usable:
        if q % every == 0:
            a = np.array(a)
            scores = {}
            for i, b in usable:
                if i != q and len(b) == len(a):
                    s = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
                    scores[i] = max(s, scores.get(i, -2.0))
            best = sorted(scores.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
            found += [(q, n, i, round(s, 9)) for n, (i, s) in enumerate(best, 1)]
    return sorted(found)


def rounded(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


def test_all_of_a_block_is_exact(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, vectors[i % 40].tolist()) for i in range(90)]  # copies of many
    rows += [(100, None), (105, []), (110, [0.0] * 8), (115, [float("nan")] * 8), (120, [None] * 8), (125, [float("inf")] + [1.0] * 7), (None, vectors[0].tolist())]
    rows += [(5, vectors[5].tolist()), (130, [1.0, 2.0]), (135, [2.0, 4.0]), (140, [-1.0, 0.5])]
    got = rounded(N.nearest(frame(spark, rows), every=5, share=1.0, block_rows=16, trees=4, bits=8))
    assert got == brute(rows, 5, 5)


def test_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(2000)] + [(5000 + i, rng.normal(size=4).tolist()) for i in range(50)]
    got = rounded(N.nearest(frame(spark, rows), every=500, share=1.0))
    own = {q: [i for p, _, i, _ in got if p == q] for q in (0, 500, 1500)}
    assert own == {0: [1, 2, 3, 4, 5], 500: [0, 1, 2, 3, 4], 1500: [0, 1, 2, 3, 4]}


def test_few_or_no_candidates(spark):
    assert rounded(N.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]))) == [(0, 1, 1, round(0.5**0.5, 9))]
    assert N.nearest(frame(spark, [(0, [1.0, 0.0])])).count() == 0
    assert N.nearest(frame(spark, [])).count() == 0


def test_queries_in_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_ROWS", 3)
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(50, 6)).tolist())]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    assert rounded(N.nearest(frame(spark, rows), every=2, share=1.0, block_rows=20)) == brute(rows, 5, 2)


def test_candidates_share_prefixes():
    rng = np.random.default_rng(3)
    own = N.Forest(rng.normal(size=(300, 16)), trees=6, bits=12)
    queries = rng.normal(size=(10, 16))
    mine, theirs = N.strings(queries, own.normals, 6, 12), N.strings(own.vectors, own.normals, 6, 12)
    for q, at in enumerate(own.search(queries, 60)):
        # Those that share the first bits in some tree, for the greatest depth that gives enough.
        by_depth = [np.flatnonzero((theirs >> 12 - d == mine[:, q : q + 1] >> 12 - d).any(axis=0)) for d in range(13)]
        assert len(at) >= 60 and any(at.tolist() == b.tolist() for b in by_depth)
    assert [len(at) for at in own.search(queries, 10_000)] == [300] * 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_recall(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = N.nearest(vectors).toPandas()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hit, total = np.array([i for i, _ in rows]), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        best = {int(ids[i]) for i in np.lexsort((ids, -s.round(12)))[:5]}
        hit, total = hit + len(best & set(got[got.query_id == ids[q]].vec_id)), total + 5
    assert hit / total >= 0.9


def test_large_and_tiny_components(spark):
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(40, 4))
    sizes = [1e200, 1e-200, 1.0, 1e308 / 8, 1e-310]
    doubles = "vec_id long, embedding array<double>"
    rows = [(i, (v * sizes[i % 5]).tolist()) for i, v in enumerate(plain)] + [(100, [1e200, 1e-200, 0.0, 0.0]), (101, [1e-200, 0.0, -1e-200, 0.0]), (102, [1e200, 5e199, 0.0, 0.0])]
    got = N.nearest(spark.createDataFrame(rows, doubles), every=2, share=1.0).collect()
    assert len(got) == 5 * sum(i % 2 == 0 for i, _ in rows) and all(np.isfinite(r.score) for r in got)
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in sorted(got)] == [(q, n, i, round(s, 6)) for q, n, i, s in brute(scaled, 5, 2)]
    assert round(next(r.score for r in got if r.query_id == 100 and r.vec_id == 102), 6) == round(2 / 5**0.5, 6)
