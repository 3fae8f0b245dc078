import math
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm.ranked import SEGMENT, planned, rank_items, term_counts
from tests.llm.helpers import CLASHING, DOCS, none, with_clashes

ITEMS = "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, c.total()) for i, c in found if c]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c, size in found:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


DOC_ROWS = [
    (1, "The cat sat on the mat; the CAT ran."), (2, "the cat"), (3, "the cat"), (4, None), (5, ""), (6, "-- !! \u0000\t"), (7, "Ärger mit der Katze und x9"), (8, "dog dog dog the"),
    (2, "the cat"), (None, "the cat"), (None, "mat"), (9, "a " * 5000 + "zebra"), (-3, "zebra mat the the"), (10, "λόγος 漢字 Ärger"),
]
ITEM_ROWS = [(1, "the cat on the mat"), (2, "the cat on the zebra"), (3, "CAT cat cat dog"), (4, None), (5, ""), (6, "nothing here known"), (1, "the cat on the mat"), (1, "dog"), (None, "Ärger 漢字"), (7, "x9 a a a a")]


@pytest.mark.parametrize("limits", [{}, {"most_terms": 0}, {"plan_literals": 3}, {"k": 2}])
def test_against_all_pairs(spark, limits):
    items = spark.createDataFrame([(*r, 1.0, "xx", 1, "f", 1, 1, 1, 1, 1) for r in ITEM_ROWS], ITEMS + CLASHING)
    assert got(rank_items(with_clashes(spark, DOC_ROWS), items, **limits)) == brute(DOC_ROWS, ITEM_ROWS, limits.get("k", 20))


def test_many_documents_and_ties(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(rng.choice(words[: 5 + i % 55], 1 + i % 40))) for i in range(3000)] + [(i + 5000, "w1 w2 w3") for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(70)] + [(99, "w1 w2 w3")]
    found = rank_items(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS), plan_literals=300)
    assert got(found) == brute(docs, items)


def test_empty_tables(spark):
    some, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert got(rank_items(none(spark), items)) == [] and got(rank_items(some, spark.createDataFrame([], ITEMS))) == []
    assert got(rank_items(spark.createDataFrame([(1, None)], DOCS), items)) == []


def test_terms_of_long_texts_are_whole():
    text = ("Ab1é " * 300_000) + "x" * (2 * SEGMENT) + " End"
    assert {t.decode(): n for t, n in term_counts(text.encode()).items()} == Counter(terms(text)) and term_counts(None) == {}


def test_shared_sets_are_summed_once():
    common = list(range(40))
    items = [common + [100 + i] for i in range(30)] + [common[:20] + [200 + i] for i in range(30)]
    rows = [(i, t, 1 + (t == 5)) for i, ts in enumerate(items) for t in ts]
    plan = planned(*(np.array([r[c] for r in rows]) for c in range(3)), np.array([7] * len(rows)))
    assert plan.additions() < 0.1 * sum(r[2] for r in rows)
    # Every item is its literals again.
    sums = [Counter() for _ in range(plan.sets)]
    for t, s, n in zip(plan.literal_term, plan.literal_set, plan.literal_times, strict=True):
        sums[s][int(plan.terms[t])] += int(n)
    for a, b in zip(plan.left, plan.right, strict=True):
        sums.append(sums[a] + sums[b])
    ends = [*plan.first[1:], len(plan.parts)]
    for i, item in enumerate(plan.items):
        assert sum((sums[x] for x in plan.parts[plan.first[i] : ends[i]]), Counter()) == {t: 1 + (t == 5) for t in items[item]}


@pytest.mark.parametrize("seed", range(20))
def test_random_plans(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(t), int(rng.integers(1, 4))) for i in range(25) for t in np.unique(rng.zipf(1.3, 15) % 40)]
    plan = planned(*(np.array([r[c] for r in rows]) for c in range(3)), np.array([7] * len(rows)))
    sums = [Counter() for _ in range(plan.sets)]
    for t, s, n in zip(plan.literal_term, plan.literal_set, plan.literal_times, strict=True):
        sums[s][int(plan.terms[t])] += int(n)
    done = set(range(plan.sets))
    for level in plan.levels:
        assert {*plan.left[level].tolist(), *plan.right[level].tolist()} <= done
        done |= {plan.sets + x for x in level.tolist()}
    for a, b in zip(plan.left, plan.right, strict=True):
        sums.append(sums[a] + sums[b])
    ends = [*plan.first[1:], len(plan.parts)]
    for i, item in enumerate(plan.items):
        assert sum((sums[x] for x in plan.parts[plan.first[i] : ends[i]]), Counter()) == {t: n for j, t, n in rows if j == item}
