import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions.grammar import captures
from colloquy.functions.text import collapse, strip

VECTORS = [
    ("12/06/24, 15:32 - Ana: hi", ("12/06/24", "15:32 ", "Ana", "hi")),
    ("[20/06/24, 09:16:05] Ana: hi", ("20/06/24", "09:16:05", "Ana", "hi")),
    ("12/06/24, 9:16 pm - Ana: hi", ("12/06/24", "9:16 pm", "Ana", "hi")),
    ("[12/06/24, 9:16:05 PM] Ana: hi", ("12/06/24", "9:16:05 PM", "Ana", "hi")),
    ("12/06/24 9:16 Mary: hi", ("12/06/24", "9:16 M", "ary", "hi")),
    ("12/06/24, 9:16 - Mary: hi", ("12/06/24", "9:16 ", "Mary", "hi")),
    ("12/06/24, 9:16 a.m. - Ana: hi", ("12/06/24", "9:16 a", ".m. - Ana", "hi")),
    ("12/06/24, 9:16 - Ana:", None),
    ("12/06/24, 9:16 - Ana:hi", None),
    ("12/06/24, 9:16 - Ana added Bob", None),
    ("12/06/24, 9:16 - Ana: see 10:30: ok", ("12/06/24", "9:16 ", "Ana", "see 10:30: ok")),
    ("12.06.24, 9:16 - Ana: hi", None),
    ("‎[20/06/24, 09:16:05] Ana: hi", None),
    ("﻿12/06/24, 9:16 - Ana: hi", None),
    ("99/99/999, 99:99 - Ana: hi", ("99/99/999", "99:99 ", "Ana", "hi")),
    ("12/06/24, 9:165 - Ana: hi", ("12/06/24", "9:16", "5 - Ana", "hi")),
    ("12/06/24, 9:16 - http://x y", None),
    ("12/06/2024, 9:16 - Ana \U0001f600: a b", ("12/06/2024", "9:16 ", "Ana \U0001f600", "a b")),
    ("[12/06/24, 9:16 - Ana: hi", ("12/06/24", "9:16 ", "Ana", "hi")),
    ("12/06/24,\x1c9:16 - Ana: a\x01b", ("12/06/24", "9:16 ", "Ana", "a\x01b")),
]


def test_header_vectors(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(VECTORS)], "i int, line string")
    c = F.col("c")
    found = df.select("i", captures(F.col("line")).alias("c")).select("i", c[0], c[1], strip(c[2]), strip(c[3])).collect()
    got = {r[0]: None if r[1] is None else tuple(r[1:]) for r in found}
    for i, (line, want) in enumerate(VECTORS):
        assert got[i] == want, line


WHITE = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　\n\r"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=WHITE + "ab‎﻿:", max_size=12), min_size=40, max_size=40))
def test_white_space_is_that_of_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, stripped, collapsed in df.select("t", strip(F.col("t")), collapse(F.col("t"))).collect():
        assert stripped == text.strip()
        assert collapsed == " ".join(text.split())


@pytest.mark.parametrize("name,want", [("Ana.txt", "Ana"), ("a.b.TXT", "a.b"), (".txt", ".txt"), ("..txt", "..txt"), ("plain", "plain")])
def test_stem(spark, name, want):
    import os

    from colloquy.sources.exports import stem

    assert os.path.splitext(name)[0] == want
    assert spark.range(1).select(stem(F.lit(name))).first()[0] == want
