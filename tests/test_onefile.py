import json
import os
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import messages as M
from colloquy.plans.extract import ReplayProvider, extract, write_insights
from colloquy.plans.profiles import INSIGHTS, ITEMS
from colloquy.sources.exports import FILES
from colloquy.sources.onefile import write_insights_document, write_parsed_document, write_text
from colloquy.sources.parsed import write_parsed
from tests.test_extract import messages, nap
from tests.test_members import text


def test_pieces_lie_in_their_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "é漢\n" * rng.randrange(0, 50) + str(i) if i % 7 else "") for i in range(2000)]
    df = spark.createDataFrame(rows, "n long, text string").repartition(13)
    size = write_text(df, ["n"], str(tmp_path / "o.txt"))
    want = "".join(t for _, t in rows).encode()
    assert (tmp_path / "o.txt").read_bytes() == want and size == len(want) and os.listdir(tmp_path) == ["o.txt"]
    assert write_text(df.where("n < 10"), [F.desc("n")], str(tmp_path / "o.txt")) == len(b"".join(t.encode() for _, t in rows[:10]))
    assert (tmp_path / "o.txt").read_text() == "".join(t for _, t in reversed(rows[:10]))
    assert write_text(df.where("n < 0"), ["n"], str(tmp_path / "o.txt")) == 0 == os.path.getsize(tmp_path / "o.txt")


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    (tmp_path / "o.txt").write_text("old")
    bad = spark.range(100).select("id", F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("text"))
    with pytest.raises(Exception, match="no"):
        write_text(bad, ["id"], str(tmp_path / "o.txt"))
    assert (tmp_path / "o.txt").read_text() == "old"


@pytest.mark.parametrize("nested", [True, False])
def test_the_parsed_document_is_the_same(spark, tmp_path, nested):
    rng = random.Random(2)
    files = [("s", f"f{i:03d}.txt", f"f{i}", text(rng, rng.randrange(0, 40))) for i in range(60)] + [("s", 'q"é.txt', 'q"é', "12/06/24, 9:16 - A: \x01\x7f  \"q\" \\")]
    for some in (files, files[:1], [], [("s", "e.txt", "e", "")]):
        found = M.customers(spark.createDataFrame(some, FILES))
        write_parsed(found, str(tmp_path / "one.json"), nested)
        size = write_parsed_document(found, str(tmp_path / "many.json"), nested)
        assert (tmp_path / "one.json").read_bytes() == (tmp_path / "many.json").read_bytes() and size == os.path.getsize(tmp_path / "one.json")


def test_the_insights_document_is_the_same(spark, tmp_path):
    for profile, answer in ((INSIGHTS, '{"action_items": [{"action": "call", "n": 5.0}, {}], "customer_enquiries": ["é", [1, 2]]}'), (ITEMS, '{"items": []}')):
        result = extract(messages(spark, 170, 3), profile, ReplayProvider(default=answer), str(tmp_path / profile.name), "in é.json", sleep=nap)
        write_insights(result, str(tmp_path / "one.json"))
        write_insights_document(result, str(tmp_path / "many.json"))
        assert (tmp_path / "one.json").read_bytes() == (tmp_path / "many.json").read_bytes()
        assert list(json.loads((tmp_path / "many.json").read_text())) == [*profile.keys, "_meta"]
