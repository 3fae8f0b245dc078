import json
import random

import pytest

from colloquy.sources.jsonblocks import brackets, effect, elements, read_elements
from colloquy.sources.parsed import read_parsed
from tests.test_spans import value

TRICKY = ['"', "\\", '\\"', "[", "]}", '{"', "é", "\n", "\\\\", ",", "漢字"]


def document(rng, n):
    out = []
    for i in range(n):
        text = "".join(rng.choice(TRICKY) for _ in range(rng.randrange(12)))
        out.append({"n": i, "t": text, "v": value(rng, 1), "deep": [[{"x": [text]}]]})
    return out


@pytest.mark.parametrize("seed", range(40))
def test_any_cut_gives_the_elements(seed):
    rng = random.Random(seed)
    doc = document(rng, rng.randrange(0, 7))
    text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    data = text.encode("utf-8", "surrogatepass")
    for step in (1, 2, 3, 7, 50, 10**6):
        state, depth, found = 0, 0, []
        for start in range(0, len(data), step):
            stop = min(len(data), start + step)
            found += elements(lambda a, b: data[a:b], len(data), start, stop, state, depth)
            for s in range(3):
                end, change = effect(data[start:stop], s)
                places, signs, same = brackets(data[start:stop], s)
                assert (end, change) == (same, int(signs.sum()))
            state, change = effect(data[start:stop], state)
            depth += change
        assert (state, depth) == (0, 0)
        assert [json.loads(e.decode("utf-8", "surrogatepass")) for e in found] == doc


def same_rows(spark, path, block):
    columns = ["fname", "customer_name", "g", "date", "time", "sender", "message", "src"]
    one, many = (sorted((tuple(r) for r in read_parsed(spark, str(path), block_bytes=b).select(*columns).collect()), key=str) for b in (None, block))
    assert one == many
    return len(one)


def message(rng, i, customer=None):
    found = {"date": "12/06/24", "time": f"9:{i}", "sender": "é", "message": "".join(rng.choice(TRICKY) for _ in range(8))}
    return found | ({"customer_name": customer} if customer else {})


def test_documents_are_read_as_by_one_task(spark, tmp_path):
    rng = random.Random(1)
    flat = tmp_path / "flat.json"
    flat.write_text(json.dumps([message(rng, i) for i in range(300)], indent=2, ensure_ascii=False))
    nested = tmp_path / "nested.json"
    nested.write_text(json.dumps([{"customer_name": f"c{i}", "messages": [message(rng, k, f"c{i}") for k in range(i % 9)]} for i in range(60)], indent=2, ensure_ascii=False))
    assert same_rows(spark, flat, 1000) == 300 and same_rows(spark, nested, 700) > 200
    for text in ("[]", " [ ] ", '[{"customer_name": "a", "messages": []}]'):
        (tmp_path / "e.json").write_text(text)
        assert same_rows(spark, tmp_path / "e.json", 3) == 0
    assert read_elements(spark, str(flat), 1000).select("at").orderBy("at").collect() == [(i,) for i in range(300)]


def test_many_tasks_read_one_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"n": i, "t": "x" * 50} for i in range(5000)]))
    found = read_elements(spark, str(tmp_path / "d.json"), 10_000)
    assert found.count() == 5000 and len({r["src"] for r in found.select("src").distinct().collect()}) == 1
    from colloquy.sources.jsonblocks import document_blocks

    blocks, _ = document_blocks(spark, str(tmp_path / "d.json"), 10_000)
    assert blocks.count() > 30 and blocks.rdd.getNumPartitions() > 30
    with pytest.raises(FileNotFoundError):
        read_elements(spark, str(tmp_path / "none.json"))
