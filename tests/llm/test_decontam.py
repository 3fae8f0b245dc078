import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import decontam as D
from tests.llm.helpers import none, with_clashes

random.seed(11)
SYLLABLES = ["an", "the", "ri", "so", "ke", "lum", "tor", "vi", "é", "ba", "qu", "ost"]


def prose(words, source=random):
    return " ".join("".join(source.choices(SYLLABLES, k=source.randint(1, 4))) for _ in range(words))


ITEMS = [(i, prose(random.randint(14, 60)).capitalize() + ".") for i in range(60)]


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=90))
def test_edit_distance(pattern, text):
    assert D.edit_distance_within(pattern, text) == slow_distance(pattern, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=30), st.text("abcd", min_size=1, max_size=150), st.text("abc", max_size=30))
def test_edit_distances_of_many_items(texts, region, start):
    index = D.PassageIndex([(i, start + t) for i, t in enumerate(texts)], most_edits=0.4)
    ranks = np.arange(len(index.texts))[:: 1 + len(region) % 3]
    got = index.edits_together(ranks, region).tolist()
    want = [slow_distance(index.texts[i], region) for i in index.order[ranks]]
    assert got == [e if e <= int(0.4 * len(index.texts[i])) else -1 for e, i in zip(want, index.order[ranks], strict=True)]


def edited(text, edits, source):
    y = list(text)
    for _ in range(edits):
        j, kind = source.randrange(len(y)), source.randrange(3)
        if kind == 0:
            y[j] = source.choice("abcdefgh ")
        elif kind == 1:
            del y[j]
        else:
            y.insert(j, source.choice("abcdefgh "))
    return "".join(y)


def test_every_exact_passage_is_found_and_nothing_else():
    index, source = D.PassageIndex(ITEMS), random.Random(5)
    texts, want = [], set()
    for k in range(200):
        parts = [prose(source.randint(0, 80), source)]
        for item in source.sample(range(len(ITEMS)), k % 3):
            parts += [ITEMS[item][1].upper() if k % 2 else ITEMS[item][1].replace(" ", " \n"), prose(source.randint(0, 40), source)]
        texts.append(" ".join(parts))
    for k, t in enumerate(texts):
        want |= {(k, i) for i, (_, p) in enumerate(ITEMS) if D.normalise(p) in D.normalise(t)}
    got = index.matches(texts)
    assert {(k, i) for k, i, e in got if e == 0} == want
    assert {(k, i) for k, i, _ in got} == want


def test_recall_of_edited_passages():
    index, source = D.PassageIndex(ITEMS), random.Random(6)
    for share, least in ((0.02, 0.97), (0.05, 0.9)):
        texts = [prose(30, source) + " " + edited(p, int(share * len(p)), source) + " " + prose(20, source) for _, p in ITEMS for _ in range(3)]
        got = {(k, i): e for k, i, e in index.matches(texts)}
        assert np.mean([(k, k // 3) in got for k in range(len(texts))]) >= least
        for (k, i), e in got.items():
            assert e == slow_distance(index.texts[i], D.normalise(texts[k])) or e <= index.most_edits * len(index.texts[i])


def test_batches_and_blocks_do_not_matter(monkeypatch):
    index, source = D.PassageIndex(ITEMS), random.Random(7)
    texts = [prose(20, source) + " " + ITEMS[k % 60][1] + " " + prose(9, source) for k in range(40)] + [None, "", " \n"]
    want = index.matches(texts)
    monkeypatch.setattr(D, "SLICE_BYTES", 300)
    monkeypatch.setattr(D, "BLOCK", 7)
    assert {m[:2] for m in index.matches(texts)} == {m[:2] for m in want}


def test_table_with_nulls_ties_and_repeated_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS] + [(97, None, "x"), (98, "", "x"), (99, "short", "x"), (None, prose(30), "x"), (5, ITEMS[5][1], "x")], "item_id long, text string, doc_id string")
    rows = [(1, ITEMS[0][1]), (1, ITEMS[0][1]), (2, None), (3, ""), (None, prose(10) + " " + ITEMS[1][1]), (4, prose(300)), (6, "short"), (7, prose(3000) + " " + ITEMS[2][1] + " " + ITEMS[3][1])]
    docs = with_clashes(spark, rows)

    def check():
        got = {(r.doc_id, r.item_id, r.edits) for r in D.find_leaks(docs, bench).collect()}
        assert got == {(1, 0, 0), (None, 1, 0), (7, 2, 0), (7, 3, 0), (6, 99, 0)}
        assert D.find_leaks(docs, bench, short=False).where("item_id = 99").count() == 0
        kept = D.drop_leaks(docs, bench)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]

    check()
    monkeypatch.setattr(D, "INDEX_BYTES", 1000)  # several passes in one operator give the same
    check()
    assert len(D.passages(bench).files) > 3
    plan = D.drop_leaks(docs, bench)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    docs = with_clashes(spark, [(1, ITEMS[0][1])])
    assert D.find_leaks(none(spark), bench).count() == 0
    assert D.find_leaks(docs, nothing).count() == 0 and D.drop_leaks(docs, nothing).count() == 1


def unsegmented(length, source):
    return "".join(chr(source.randrange(0x4E00, 0x5E00)) for _ in range(length))


def test_exact_passages_without_spaces_are_found():
    source = random.Random(9)
    items = [(i, unsegmented(source.randrange(16, 200), source)) for i in range(40)]
    items += [(40 + i, "".join(source.choices("abcdef{}();=", k=source.randrange(16, 300)))) for i in range(40)]
    index = D.PassageIndex(items)
    texts = [unsegmented(source.randrange(300), source) + p + unsegmented(source.randrange(300), source) for _, p in items]
    assert {(k, i) for k, i, e in index.matches(texts) if e == 0} >= {(k, k) for k in range(len(items))}


def test_recall_at_the_most_edits():
    source = random.Random(10)
    items = [(i, prose(source.randrange(14, 60), source)) for i in range(60)]
    index = D.PassageIndex(items)
    for share in (0.1, 0.15):
        texts = [prose(30, source) + " " + edited(p, int(share * len(p)), source) + " " + prose(20, source) for _, p in items for _ in range(4)]
        got = {(k, i) for k, i, _ in index.matches(texts)}
        assert np.mean([(k, k // 4) in got for k in range(len(texts))]) >= 0.96


def test_items_made_from_one_template():
    source = random.Random(12)
    template = prose(30, source)[:145]
    items = [(i, f"{template} {prose(18, source)[:120]}") for i in range(3000)]
    index = D.PassageIndex(items)
    plain = [f"{prose(60, source)} {template} {prose(60, source)}" for _ in range(20)]
    other = [f"{prose(60, source)} {prose(30, source)[:145]} {prose(60, source)}" for _ in range(20)]
    with_template, without = (len(index.candidates([D.normalise(t).encode() for t in texts])) for texts in (plain, other))
    assert not index.matches(plain) and with_template < 2 * without + 100  # 60,000 would be one for each item
    for share, least in ((0, 1), (0.05, 0.95), (0.15, 0.9)):
        planted = [(k, f"{prose(20, source)} {edited(items[k][1], int(share * len(items[k][1])), source)} {prose(20, source)}") for k in range(0, 3000, 30)]
        got = {(i, index.ids[k][0]) for i, k, _ in index.matches([t for _, t in planted])}
        assert np.mean([(i, k) in got for i, (k, _) in enumerate(planted)]) >= least


def test_edits_gathered_in_one_part_of_items_from_a_template():
    source = random.Random(13)
    template = prose(60, source)[:200]
    own = [(i, f"{template[:145]} {prose(18, source)[:120]}") for i in range(3000)]
    slots = [(i, f"{template[:100]} {prose(8, source)[:30]} {template[100:]}") for i in range(600)]
    for items, start, stop, changes in ((own, 146, 266, (20, 30, 38)), (slots, 101, 131, (15,))):
        index = D.PassageIndex(items)
        for edits in changes:
            texts = []
            for k in range(0, len(items), len(items) // 40):
                t = items[k][1]
                texts.append((k, f"{prose(20, source)} {t[:start]}{edited(t[start:stop], edits, source)}{t[stop:]} {prose(20, source)}"))
            got = {(i, index.ids[k][0]) for i, k, _ in index.matches([t for _, t in texts])}
            assert np.mean([(i, k) in got for i, (k, _) in enumerate(texts)]) >= 0.97


def test_one_very_long_text():
    index, source = D.PassageIndex(ITEMS), random.Random(14)
    filler = prose(5000, source)
    text = " ".join([ITEMS[0][1], filler * 100, ITEMS[1][1], filler * 100, ITEMS[2][1]])
    assert len(text) > 2 * D.SLICE_BYTES
    assert {m for m in index.matches(["", text, ITEMS[3][1]])} == {(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 3, 0)}


def test_repeated_and_short_items():
    index = D.PassageIndex([(1, ITEMS[0][1]), (2, ITEMS[0][1]), (3, "Forty two"), (4, "two"), (5, "")])
    got = {(i, tuple(index.ids[k]), e) for i, k, e in index.matches([ITEMS[0][1], "It is forty  TWO .", "twofold", None, "two"])}
    assert got == {(0, (1, 2), 0), (1, (3,), 0), (1, (4,), 0), (4, (4,), 0)}
