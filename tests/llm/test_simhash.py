import random
import re

import numpy as np
import xxhash

from colloquy.llm import simhash as S
from tests.llm.helpers import none, with_clashes


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted(((i, f"{prints[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(rows)), key=str)


def test_fingerprints():
    for text in ["", None, "A b", "Ärger  A\tB\x0bc\x1cd É", "one two three four", "x " * 70_000, "\x00 a b c"]:
        assert S.fingerprint(None if text is None else text.encode()) & (1 << 64) - 1 == slow_fingerprint(text)


def test_every_close_pair_meets():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit)).astype(np.int64)
    (row, key), _ = S.keys(a)
    left = set(zip(row.tolist(), key.tolist(), strict=True))
    _, (row, key) = S.keys(b)
    assert {r for r, k in zip(row.tolist(), key.tolist(), strict=True) if (r, k) in left} == set(range(len(a)))


def test_golay_code_is_perfect():
    own, near = S.golay()
    assert (own >= 0).all()
    words = np.random.default_rng(1).integers(0, 1 << 23, 1000)
    assert (S.syndrome(words ^ own[S.syndrome(words)]) == 0).all()


def texts():
    random.seed(4)
    base = [" ".join(random.choices("abcdefghijklmnop", k=60)) for _ in range(12)]
    rows = [(100 - i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        words = t.split()
        for k in range(6):
            words[random.randrange(len(words))] = "zz"
            rows.append((200 + 10 * i + k, " ".join(words)))
    return [*rows, (7, base[3]), (7, base[3]), (None, base[4]), (1, ""), (2, None), (3, " \n"), (None, "lonely words here now"), (9, "a"), (8, "A")]


def test_against_brute_force(spark):
    rows = texts()
    got = S.near_duplicates(with_clashes(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_components(rows)


def test_long_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (100, 102)]
    random.Random(2).shuffle(chain)
    links = spark.createDataFrame(chain, "u long, v long")
    assert {r.node: r.root for r in S.components(links).collect()} == {**{i: 1 for i in range(2, 61)}, 101: 100, 102: 100}


def test_large_copy_groups(spark):
    rows = [(i, "the same old story again") for i in range(3000)] + [(5000 + i, f"another story number {i} of many told") for i in range(20)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(with_clashes(spark, rows)).collect()}
    assert {got[i] for i in range(3000)} == {0}


def test_empty_table(spark):
    assert S.near_duplicates(none(spark)).count() == 0
    assert S.keep_one_of_each(none(spark)).count() == 0


def test_one_of_each_stays(spark, tmp_path):
    rows = texts()
    with_clashes(spark, rows).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    groups = slow_components(rows)
    distinct = {c for _, _, c in groups if c is not None} | {f for _, f, c in groups if c is None}
    found = kept.collect()
    assert len(found) == len(distinct)
    assert {r.doc_id for r in found if r.doc_id is not None} == {c for _, _, c in groups if c is not None}


def test_rounds_broadcast_nothing_and_count_while_writing(spark, monkeypatch):
    plans, write = [], S.materialise

    def written(df):
        plans.append(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))
        return write(df)

    links = write(spark.createDataFrame([(k + 1, k) for k in range(9)] + [(21, 20)], "u long, v long"))
    monkeypatch.setattr(S, "materialise", written)
    assert {(r.node, r.root) for r in S.components(links).collect()} == {(k, 0) for k in range(1, 10)} | {(21, 20)}
    assert plans and all("CollectMetrics" in p and "Broadcast" not in p for p in plans)


def test_no_join_is_broadcast(spark, monkeypatch):
    plans, write = [], S.materialise

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(S, "materialise", written)
    rows = texts()
    got = S.near_duplicates(with_clashes(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_components(rows)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInArrow" in p and "SortMergeJoin" in p for p in plans) == 1  # the keys' join
    assert not any("Broadcast" in p for p in plans)
