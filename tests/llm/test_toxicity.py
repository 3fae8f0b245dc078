import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import toxicity as X
from tests.llm.helpers import none, with_clashes

DATA = "/root/testdata/sf0.1"


def words(text):
    return re.findall("[0-9a-z'\x80-\U0010ffff]+", text.lower())


def grams(text):
    w = words(text)
    return len(w) + max(0, len(w) - 1) + 2 * max(0, len(w) - 2)


def test_features_are_the_n_grams_of_each_text():
    texts = ["", "One two three two", "Un é, deux\n", "a", "one TWO three two", "x y"]
    slot, owner = X.slots(texts)
    by_text = [sorted(slot[owner == k].tolist()) for k in range(len(texts))]
    assert [len(b) for b in by_text] == [grams(t) for t in texts]
    assert by_text[1] == by_text[4]
    # The same whatever is around it.
    for k, t in enumerate(texts):
        assert sorted(X.slots([t])[0].tolist()) == by_text[k]
    assert set(X.slots(["one two"])[0].tolist()) <= set(by_text[1])
    assert set(X.slots(["two one"])[0].tolist()) - set(X.slots(["one two"])[0].tolist())


def slow_ftrl(rows, labels, order, alpha, beta, l1, l2):
    z, n = {}, {}

    def weight(i):
        own = 0.0 if i == "bias" else l1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= own else (np.sign(zi) * own - zi) / ((beta + np.sqrt(n.get(i, 0.0))) / alpha + l2)

    for k in order:
        w = {i: weight(i) for i in [*rows[k], "bias"]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - labels[k]
        for i, wi in w.items():
            z[i] = z.get(i, 0.0) + g - (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / alpha * wi
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_training_against_the_formula():
    sample = [(1, "bad word here"), (0, "good word here"), (1, "so bad"), (0, "very good thing")] * 5
    m = X.train(sample, epochs=2, alpha=0.5, l1=0.2, l2=0.1, seed=9)
    rows = [set(X.slots([t])[0].tolist()) for _, t in sample]
    rng = np.random.default_rng(9)
    order = [*rng.permutation(len(rows)), *rng.permutation(len(rows))]
    want = slow_ftrl(rows, [y for y, _ in sample], order, 0.5, 1.0, 0.2, 0.1)
    assert np.isclose(m.bias, want.pop("bias"))
    assert m.slot.tolist() == sorted(want) and np.allclose(m.weight, [want[i] for i in sorted(want)])


def test_scores_by_hand(monkeypatch):
    m = X.train([(1, "vile trash talk"), (0, "kind warm talk")] * 30, l1=0.5)
    weight = dict(zip(m.slot.tolist(), m.weight.tolist(), strict=True))
    texts = ["trash trash trash", "", "kind words", "vile " * 50, "neutral"]
    want = [1 / (1 + np.exp(-(m.bias + sum(weight.get(i, 0.0) for i in set(X.slots([t])[0].tolist()))))) for t in texts]
    assert np.allclose(m.score(texts), want)
    monkeypatch.setattr(X, "SLICE_BYTES", 8)
    assert np.allclose(m.score(texts), want)
    assert m.score(["vile trash"])[0] > 0.5 > m.score(["kind warm"])[0]


def test_nulls_empty_and_repeated_rows(spark):
    docs = with_clashes(spark, [(i, "vile trash talk" if i % 2 else "kind warm talk") for i in range(60)] + [(100, None), (101, ""), (None, "vile trash talk"), (3, "vile trash talk")])
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(60)] + [(1, 1, "z"), (None, 1, "z"), (5, None, "z"), (999, 1, "z")], "doc_id long, toxic int, text string")
    m = X.fit_toxicity(docs, labels, l1=0.5)
    got = X.score_toxicity(docs, m).collect()
    assert len(got) == 64
    by = {r.doc_id: r for r in got}
    assert by[1].predicted == 1 and by[0].predicted == 0 and by[None].predicted == 1 and by[100].score == by[101].score
    kept = X.drop_toxic(docs, m)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}
    assert {*range(0, 60, 2)} <= {r.doc_id for r in got if r.score < 0.5} <= {*range(0, 60, 2), 100, 101}
    assert X.score_toxicity(none(spark), m).count() == 0


def test_labels_of_other_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, "vile trash talk" if i % 2 else "kind warm talk") for i in range(400)] + [(7, "vile trash talk")] * 50, "doc_id long, text string")
    labels = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    sample = X.training_sample(docs, labels, "doc_id", "text", "toxic", 150, 120, 1000)
    assert sorted(label for label, _ in sample) == [0] * 120 + [1] * 150
    assert all((label == 1) == text.startswith("vile") for label, text in sample)
    least = X.training_sample(docs, labels, "doc_id", "text", "toxic", 5, 3, 1000)  # by hashes below a bound
    assert sorted(label for label, _ in least) == [0] * 3 + [1] * 5


def test_long_texts_come_in_alike_by_spans_from_anywhere(spark):
    text = "".join(chr(0x4E00 + k) for k in range(1000))
    docs = spark.createDataFrame([(i, text if i < 60 else "short") for i in range(120)] + [(200, None)], "doc_id long, text string")
    labels = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    sample = [t for _, t in X.training_sample(docs, labels, "doc_id", "text", "toxic", 200, 10, 50)]
    spans = [t for t in sample if t != "short"]
    assert len(sample) == 120 and len(spans) == 60 and all(len(t) == 50 and t in text for t in spans)
    places = [text.index(t) for t in spans]
    assert min(places) < 200 and max(places) > 750 and len(set(places)) > 40
    half = [t for _, t in X.training_sample(docs, labels, "doc_id", "text", "toxic", 60, 10, 50)]
    assert len(half) in (59, 60) and 15 < sum(t != "short" for t in half) < 45  # the null text may take a place; the short ones don't come first


def test_one_very_long_text_is_scored_whole():
    m = X.train([(1, "vile trash talk"), (0, "kind warm talk")] * 30, l1=0.5)
    filler = "neutral words here " * 150_000
    for end in ("vile trash talk", "kind warm talk"):
        short = m.score(["neutral words here neutral words here " + end])
        assert np.allclose(m.score(["", filler + end, ""])[1], short) and len(filler) > 2 * X.SLICE_BYTES


def test_no_labels(spark):
    m = X.fit_toxicity(none(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert m.score(["anything"])[0] == 0.5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_held_out_quality(spark):
    from colloquy.llm.registry import op10_toxicity

    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    got = op10_toxicity(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r.toxic for r in got]), np.array([r.predicted for r in got])
    # 350 toxic documents to learn from; with 1,700 (check_s) recall is 0.98.
    assert p[y == 1].mean() > 0.7 and y[p == 1].mean() > 0.95


def test_labels_are_not_broadcast(spark, tmp_path, monkeypatch):
    plans, write = [], X.materialise

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(X, "materialise", written)
    spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int").write.parquet(str(tmp_path / "l"))
    docs, labels = (spark.read.parquet(str(tmp_path / x)) for x in "dl")
    assert sorted(X.training_sample(docs, labels, "doc_id", "text", "toxic", 9, 9, 99)) == [(k % 2, f"text {k}") for k in (0, 2, 4, 1, 3, 5)]
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
