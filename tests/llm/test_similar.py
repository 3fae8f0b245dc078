import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from colloquy.llm import similar as J
from colloquy.llm import simhash as S
from tests.llm.helpers import none, with_clashes
from tests.llm.test_simhash import slow_fingerprint


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def slow_kept(rows):
    sets, root = [slow_shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if jaccard(a, b) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    return sorted((min((rows[k] for k in range(len(rows)) if root[k] == r), key=lambda x: (x[0] is None, x[0]))[0] for r in set(root)), key=str)


def texts():
    source = random.Random(8)
    rows = []
    for i in range(25):
        words = [f"w{source.randrange(4000)}" for _ in range(source.choice((6, 20, 60, 300)))]
        rows.append((1000 - i, " ".join(words)))
        for k in range(6):  # chains of edits, and cuts
            words = words[source.randrange(3) :]
            for _ in range(source.randrange(1 + len(words) // 90)):
                words[source.randrange(len(words))] = "zz"
            rows.append((2000 + 10 * i + k, " ".join(words)))
    return [*rows, (7, rows[0][1]), (7, rows[0][1]), (None, rows[20][1]), (1, ""), (2, None), (None, "Lonely words here"), (9, "lonely  words here")]


def test_against_brute_force(spark, tmp_path):
    with_clashes(spark, texts()).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = J.keep_dissimilar(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == slow_kept(texts())


def test_edited_copies_of_one_text_meet_a_few_times_each(spark, tmp_path, monkeypatch):
    source = random.Random(4)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(400):  # similarities of 0.4 to 0.97 among all pairs
        words = list(base)
        for _ in range(source.choice((1, 2, 3, 4, 5, 6))):
            words[source.randrange(150)] = f"x{source.random()}"
        rows.append((i, " ".join(words)))
    with_clashes(spark, rows).write.parquet(str(tmp_path / "d"))
    met, verified = [], J.verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(J, "verified", counted)
    kept = J.keep_dissimilar(spark.read.parquet(str(tmp_path / "d")))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == slow_kept(rows)
    assert sum(met) < 40 * len(rows)  # one a key at most; all pairs would be 200 a row


def test_pipeline_finds_copies_of_more_than_three_bits(spark, tmp_path):
    words, source = [f"w{i}" for i in range(100)], random.Random(3)
    while True:
        copy = list(words)
        for k in (20, 70):
            copy[k] = f"x{source.random()}"
        rows = [(1, " ".join(words)), (2, " ".join(copy))]
        if (slow_fingerprint(rows[0][1]) ^ slow_fingerprint(rows[1][1])).bit_count() > 3:
            break
    assert jaccard(*(slow_shingles(t) for _, t in rows)) >= 0.8
    with_clashes(spark, rows).write.parquet(str(tmp_path / "d"))
    assert [r.doc_id for r in P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()] == [1]


def test_simhash_links_what_no_band_has_in_common(spark, tmp_path, monkeypatch):
    words, source = [f"w{i}" for i in range(400)], random.Random(5)
    rows = [(1, " ".join(words))]
    while len(rows) < 4:
        copy = list(words)
        copy[source.randrange(400)] = f"x{source.random()}"
        if (slow_fingerprint(rows[0][1]) ^ slow_fingerprint(" ".join(copy))).bit_count() <= 3:
            rows.append((1 + len(rows), " ".join(copy)))
    far = " ".join(f"y{i}" for i in range(400))
    rows += [(8, far), (9, far + " z")]
    # The same words with repeats, but other sets of five: SimHash links them, the exact check does not.
    loop = ["a", "b", "c"] * 3000
    rows += [(20, " ".join(loop)), (21, " ".join([*loop, *(f"n{i}" for i in range(30))]))]
    assert (slow_fingerprint(rows[-2][1]) ^ slow_fingerprint(rows[-1][1])).bit_count() <= 3
    assert jaccard(*(slow_shingles(t) for _, t in rows[-2:])) < 0.8
    signatures = J.signatures
    monkeypatch.setattr(J, "signatures", lambda *a: signatures(*a).withColumn("keys", F.array(F.col("row"))))
    with_clashes(spark, rows).write.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()) == [1, 8, 20, 21]


def test_every_pair_at_the_threshold_meets():
    rng = np.random.default_rng(1)
    for tenth in (1, 10, 100):
        for _ in range(100):
            x = rng.integers(0, 1 << 63, 10 * tenth, np.uint64)
            a, b = x[: 9 * tenth], x[tenth:]  # 8 of 10 tenths are in both
            assert (J.band_keys(np.unique(a)) == J.band_keys(np.unique(b))).any()


def test_empty_table(spark, tmp_path):
    none(spark).write.parquet(str(tmp_path / "d"))
    assert J.keep_dissimilar(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def test_no_links_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(J, "components", lambda links: 1 / 0)
    roots, none = spark.createDataFrame([(2, 1)], "node long, root long"), spark.createDataFrame([], "u long, v long")
    assert J.joined(roots, none) is roots


def test_no_join_is_broadcast(spark, tmp_path, monkeypatch):
    plans, write = [], J.materialise

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    for module in (J, S):
        monkeypatch.setattr(module, "materialise", written)
    with_clashes(spark, texts()).write.parquet(str(tmp_path / "d"))
    kept = J.keep_dissimilar(spark.read.parquet(str(tmp_path / "d")))
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not any("Broadcast" in p for p in plans)
