import hashlib
import random

import numpy as np
import pytest

from colloquy.llm.repeats import BASES, SEGMENT, Rolling, anchors, cut_repeats, merged, sliding_least, word_hashes, word_segments
from tests.llm.helpers import DOCS, none, with_clashes


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in split:
        if i is not None:
            for a in range(len(ws) - window + 1):
                key = tuple(ws[a : a + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, ws in split:
        gone = set()
        if i is not None:
            for a in range(len(ws) - window + 1):
                if first[tuple(ws[a : a + window])] < i:
                    gone |= set(range(a, a + window))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_words", "spans", "n_removed", "kept_sha256", "kept"]
    rows = df.collect()
    for r in rows:
        assert r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"])
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in rows), key=str)


def text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def rows_of(seed, window):
    rng = random.Random(seed)
    passages = [text(rng, window + k) for k in (-1, 0, 1, 7, 3 * window)]
    rows = [(None, None), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (-7, passages[4])]
    for i in range(40):
        parts = [text(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(passages), text(rng, rng.randrange(0, 3))]
        rows.append((10 + i, rng.choice([" ", "\n", "\x0b\t "]).join(parts)))
    # Whole copies, with other white space too; rows of one id; null ids; a text that repeats itself.
    rows += [(100 + k, rows[20][1]) for k in range(5)] + [(9, rows[20][1].replace(" ", "  ")), (100, rows[20][1]), (None, rows[20][1]), (None, passages[4])]
    rows += [(200, "a " * (3 * window)), (201, "b a " * window), (202, passages[3] + " x " + passages[3]), (200, "a " * (2 * window)), (203, "a b\x00c é " * window)]
    return rows


@pytest.mark.parametrize(("seed", "window"), [(1, 50), (2, 5), (3, 1), (4, 21)])
def test_against_brute_force(spark, seed, window):
    rows = rows_of(seed, window)
    assert got(cut_repeats(with_clashes(spark, rows).repartition(3), window=window)) == brute(rows, window)


def test_without_texts(spark):
    rows = rows_of(5, 50)
    found = cut_repeats(spark.createDataFrame(rows, DOCS), keep_text=False)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()), key=str) == [r[:4] for r in brute(rows, 50)]


def test_many_copies_of_one_id_and_one_text(spark):
    rng = random.Random(6)
    rows = [(7, text(rng, 60)) for _ in range(300)] + [(8, "the same " * 40)] * 300 + [(9, "the same " * 40)] * 300
    assert got(cut_repeats(spark.createDataFrame(rows, DOCS))) == brute(rows, 50)


def test_very_long_text(spark):
    rng = random.Random(7)
    long = text(rng, 600_000, 10**6)
    rows = [(1, long[3_000_000:3_010_000]), (2, long), (3, "x" * (2 * SEGMENT) + " " + long[:5000])]
    assert got(cut_repeats(spark.createDataFrame(rows, DOCS))) == brute(rows, 50)


def test_empty_table(spark):
    assert got(cut_repeats(none(spark))) == []


def test_words_and_hashes():
    data = ("ab  c\td e\n" * 200_000 + "z" * (3 * SEGMENT)).encode()
    assert [w for s in word_segments(data) for w in s] == data.split()
    words = word_hashes(iter([[b"a", b"b", b"a", b"b", b"c"]]))
    for i, base in enumerate(BASES):
        x = [int(v) for v in words[:, i]]
        want = [sum(v * base ** (2 - k) for k, v in enumerate(x[a : a + 3])) % 2**64 for a in range(3)]
        assert Rolling(words[:, i], base).windows(3).tolist() == want and len(Rolling(words[:, i], base).windows(6)) == 0
    values = np.array([5, 3, 4, 9, 1, 7, 8], np.uint64)
    for width in range(1, 8):
        assert sliding_least(values, width).tolist() == [min(values[i : i + width].tolist()) for i in range(8 - width)]
    assert merged(np.array([9, 0, 3, 2, 3]), 2) == [(0, 2 + 3), (9, 11)] and merged(np.array([], int), 2) == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    b[100:180] = a[40:120]
    left, right = (anchors(Rolling(x, BASES[0]), 50) for x in (a, b))
    assert (left[40:71] == right[100:131]).all() and len(np.unique(left)) < 30
