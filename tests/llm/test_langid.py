import itertools
import os
import pickle
import re
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pytest

from colloquy.llm import langid as L
from tests.llm.helpers import none, with_clashes

DATA = "/root/testdata/sf0.1"
EN, FR, DE = "the thing that was here with them and there ", "les choses qui sont avec nous dans la maison ", "und der nicht mit ihnen auf dem wege schon "


def model(epochs=4):
    return L.train([(lang, text * 12) for lang, text in (("de", DE), ("en", EN), ("fr", FR))] * 8, epochs, 1)


@pytest.fixture(scope="module")
def own():
    return model()


def slow_probabilities(scores, transitions):
    """Sums over all label sequences."""
    n, size = scores.shape
    total = np.zeros((n, size))
    for labels in itertools.product(range(size), repeat=n):
        s = sum(scores[t, k] for t, k in enumerate(labels)) + sum(transitions[a, b] for a, b in zip(labels, labels[1:], strict=False))
        # The first word is entered from a label at random.
        s += np.log(np.mean(np.exp(transitions[:, labels[0]])))
        for t, k in enumerate(labels):
            total[t, k] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward_against_all_sequences(monkeypatch):
    rng = np.random.default_rng(3)
    transitions = rng.normal(size=(3, 3))
    m = L.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.zeros(0, np.uint64), np.zeros((1, 3)), transitions)
    counts = np.array([7, 0, 1, 5, 2])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    want = np.concatenate([slow_probabilities(scores[a : a + n], transitions) for a, n in zip(np.cumsum(counts) - counts, counts, strict=True) if n])
    for segment in (1, 2, 3, 32):  # segments of any length give the same
        monkeypatch.setattr(L, "SEGMENT", segment)
        assert np.allclose(m.probabilities(scores, counts), want, atol=1e-6)


def test_words_are_runs_of_letters():
    texts = ["", "a", "It's 3 naïve-Ümläute; ét", "日本 12", "...", "x" * 300]
    found = L.find_words(texts)
    offset = np.cumsum([3, *(len(t) + 3 for t in texts)])
    words = [[] for _ in texts]
    for t, a, b in zip(found.text, found.start, found.end, strict=True):
        words[t].append(texts[t][a - offset[t] : b - offset[t]])
    assert words == [re.findall("[^\\W\\d_́](?:[^\\W\\d_]|́)*", t) for t in texts]


def test_equal_words_have_equal_hashes():
    found = L.find_words(["The cat", "cats the CAT"])
    assert found.whole[0] == found.whole[3] and found.whole[1] == found.whole[4] and len(set(found.whole.tolist())) == 3


def test_slices_do_not_change_the_result(own, monkeypatch):
    texts = [EN + FR, "", DE, "12", EN * 30, FR]
    want = own.predict(texts)
    monkeypatch.setattr(L, "SLICE_CHARS", 10)
    got = own.predict(texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_spans_of_mixed_text(own):
    text = EN * 2 + FR * 2 + DE * 2
    spans = L.word_spans(own, [text, ""])
    assert [s["lang"] for s in spans[0]] == ["en", "fr", "de"] and spans[1] == []
    assert text[spans[0][1]["start"] :].startswith("les choses")
    assert text[: spans[0][2]["end"]] == text.rstrip()


def test_nulls_empty_and_repeated_rows(spark, own):
    rows = [(1, EN), (1, EN), (2, None), (3, ""), (None, FR), (4, "123 ... !?"), (5, DE * 3000), (6, "日本語")]
    got = sorted((tuple(r) for r in L.label_languages(with_clashes(spark, rows), own).collect()), key=str)
    assert len(got) == len(rows)
    pred = {i: (lang, score) for i, lang, score in got}
    assert (pred[1][0], pred[None][0], pred[5][0]) == ("en", "fr", "de")
    assert pred[2] == pred[3] == pred[4] == ("und", 0.0)
    assert pred[6][0] in own.langs and all(0 <= s <= 1 for _, s in pred.values())
    assert L.label_languages(none(spark), own).count() == 0


def test_filter_keeps_all_columns(spark, own):
    docs = with_clashes(spark, [(1, EN), (2, None), (3, "?"), (4, FR)])
    kept = L.keep_identified(docs, own, 0.4)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    m = L.fit_languages(empty)
    assert m.langs == [] and L.label_languages(with_clashes(spark, [(1, EN)]), m).first().lang_pred == "und"
    assert L.train([("en", "123")], 1, 1).predict(["abc"])[0] == ["en"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    from colloquy.llm.registry import op2_language_id

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = op2_language_id(spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 1500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99


def test_every_language_is_learned(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = {}
    for k in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(12)]
        texts[f"l{k:02}"] = " ".join(words * 8)
    rows = [(k, text, lang) for k, (lang, text) in enumerate(texts.items()) for _ in range(1 if lang == "l69" else 2)]
    rows += [(1000 + k, EN * 400, "long") for k in range(3)]  # no document short enough
    assert len(EN * 400) > L.SAMPLE_CHARS
    m = L.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == sorted([*texts, "long"]) and m.weights.size <= L.FEATURES * L.FULL_LANGS
    ask = [*texts.values(), EN, ""]
    got = m.predict(ask)
    assert np.mean([a == b for a, b in zip(got[0], [*texts, "long", "und"], strict=True)]) > 0.95 and got[0][-2] == "long"
    monkeypatch.setattr(L, "TRANSFERS", 1)  # texts one by one give the same
    assert m.predict(ask)[0] == got[0]


def test_the_sample_is_bounded_whatever_the_languages(spark):
    rows = [(i, f"text {i} " + "x" * 300, f"l{i % 40}") for i in range(400)] + [(1000 + i, "more", "l7") for i in range(5)] + [(None, None, "l7"), (9, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = L.training_sample(docs, 250, 100, "doc_id", "text", "lang", 2000, 1000)
    assert len(every) == 405 and all(len(t) <= 100 for _, t in every)
    assert len({t.startswith("text") for _, t in every}) == 2  # spans begin anywhere
    few = L.training_sample(docs, 250, 100, "doc_id", "text", "lang", 20, 1000)
    assert len(few) == 20 and len({lang for lang, _ in few}) == 20 and "l7" in {lang for lang, _ in few}
    assert {lang for lang, _ in L.training_sample(docs, 3, 100, "doc_id", "text", "lang", 2000, 2)} == {"l7", "l0"}


def test_memory_with_many_languages():
    rng = np.random.default_rng(5)
    langs = [f"l{k:02}" for k in range(64)]
    m = L.LanguageModel(langs, rng.normal(size=(1 << 11, 64)).astype(np.float32), np.zeros(0, np.uint64), np.zeros((1, 64), np.float32), rng.normal(size=(64, 64)))
    texts = [EN * 70 for _ in range(512)]  # 3,000 characters each
    m.predict(texts[:2])
    tracemalloc.start()
    found, _ = m.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 512 and peak < 500e6


def test_long_texts_by_the_piece_are_the_whole(own, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = (EN + FR + DE).split()
    texts = [" ".join(rng.choice(vocabulary, n)) + tail for n, tail in ((3000, ""), (800, "\n\n 123 -- "), (1500, " end"))] + ["1 2 " * 2000, "x" * 5000]
    whole = own.predict(texts)
    monkeypatch.setattr(L, "SLICE_CHARS", 700)
    pieces = own.predict(texts)
    assert pieces[0] == whole[0] and pieces[0][3] == L.UNKNOWN
    assert np.allclose(pieces[1][:4], whole[1][:4], atol=1e-6)
    for text in texts:
        cuts = list(L.cut_at_spaces(text, 700))
        assert "".join(text[a:b] for a, b in cuts) == text and max(b - a for a, b in cuts) <= 1400


def test_memory_of_one_long_text(own, tmp_path):
    """A text of 10 MB in a process of its own: what is held besides the text does not grow with it."""
    (tmp_path / "model").write_bytes(pickle.dumps(own))
    script = (
        "import pickle, resource, sys\nfrom colloquy.llm import langid as L\nown = pickle.load(open(sys.argv[1], 'rb'))\n"
        "text = 'der hund und die katze sind im haus ' * (int(sys.argv[2]) // 36)\nown.predict([text])\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    short, long = (int(subprocess.run([sys.executable, "-c", script, str(tmp_path / "model"), str(size)], capture_output=True, text=True, check=True, timeout=300).stdout) for size in (2 * L.SLICE_CHARS, 10_000_000))
    assert long - short < 100


def test_a_model_without_languages_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "doc_id long, text string")
    assert L.keep_identified(docs, L.train([], 1, 1), 0.4).count() == 3
