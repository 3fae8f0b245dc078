import io
import zipfile

import pytest
from pyspark.sql import functions as F

from colloquy.operators import messages as M
from colloquy.sources.exports import FILES, members, read_export, read_exports

ANN = "orphan\n12/06/24, 9:16 - Ann: one\n  two  \n\n12/06/24, 9:17 - Ann: Bob left\ntail after system\n12/06/24, 9:18 - Ann: three"


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in entries:
            z.writestr(name, content)
    return str(path)


@pytest.fixture
def export(tmp_path):
    return archive(
        tmp_path / "chats.ZIP",
        [
            ("ann.txt", ANN),
            ("ann-1.txt", "only an orphan"),
            ("B.TXT", "[20/06/24, 09:16:05] B: iOS\r\nmore\r\n".encode() + b"\xff"),
            ("sub/n.txt", ANN),
            ("skip.csv", ANN),
            ("empty.txt", ""),
        ],
    )


def files(spark, *texts):
    return spark.createDataFrame([("s", f"f{i}.txt", f"f{i}", t) for i, t in enumerate(texts)], FILES)


def texts(df):
    return [r.message for r in df.orderBy("fname", "g").collect()]


def test_customers_of_an_archive(spark, export):
    found = {r.fname: r for r in M.customers(read_export(spark, export)).collect()}
    assert sorted(found) == ["B.TXT", "ann-1.txt", "ann.txt", "empty.txt"]
    assert [m.message for m in found["ann.txt"].messages] == ["one two tail after system", "three"]
    assert [m.message for m in found["B.TXT"].messages] == ["iOS more"]
    assert found["ann-1.txt"].messages == [] and found["empty.txt"].messages == []
    assert {m.customer_name for m in found["ann.txt"].messages} == {"ann"}


def test_counts_and_folder_scan(spark, export, tmp_path):
    counts = {r.fname: r.n_messages for r in M.message_counts(M.customers(read_exports(spark, str(tmp_path)))).collect()}
    assert counts == {"B.TXT": 1, "ann-1.txt": 0, "ann.txt": 2, "empty.txt": 0}


def test_members_last_of_a_name_counts_and_paths_are_cleaned():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z, pytest.warns(UserWarning):
        z.writestr("a.txt", "first")
        z.writestr("a.txt", "second")
        z.writestr("../up.txt", "up")
    assert members(data.getvalue()) == [("a.txt", "second"), ("up.txt", "up")]


def test_single_text_has_no_customer(spark, tmp_path):
    path = tmp_path / "chat.txt"
    path.write_text(ANN)
    found = M.messages(read_export(spark, str(path)))
    assert texts(found) == ["one two tail after system", "three"]
    assert [r.customer_name for r in found.collect()] == [None, None]


def test_notices_are_looked_for_in_headers_only(spark):
    one = "12/06/24, 9:16 - A: hello\nwho left?\n12/06/24, 9:17 - A: 2 kg left?\n12/06/24, 9:18 - A added B"
    assert texts(M.messages(files(spark, one))) == ["hello who left? 12/06/24, 9:18 - A added B"]


def test_deletion_is_seen_after_the_fold(spark):
    one = "12/06/24, 9:16 - A: This message\nwas deleted\n12/06/24, 9:17 - A: kept"
    assert texts(M.messages(files(spark, one))) == ["kept"]


def test_flat_and_nested_agree_and_empty_files_stay(spark):
    df = files(spark, ANN, "", "  \n ", "orphan", "12/06/24, 9:16 - A: B left", None)
    nested = {r.fname: [m.message for m in r.messages] for r in M.customers(df).collect()}
    assert nested == {"f0.txt": ["one two tail after system", "three"], **{f"f{i}.txt": [] for i in range(1, 6)}}
    assert texts(M.messages(df)) == nested["f0.txt"]


def test_equal_stems_are_two_customers(spark, tmp_path):
    path = archive(tmp_path / "x.zip", [("Ana.txt", ANN), ("Ana.TXT", ANN)])
    assert M.customers(read_export(spark, path)).count() == 2


def test_line_ends_are_those_of_text_files(spark):
    found = M.lines(files(spark, "a\r\nb\rc\nd\x0be\x85f"))
    assert [r.line for r in found.orderBy("n").collect()] == ["a", "b", "c", "d\x0be\x85f"]


def test_the_header_pattern_runs_once(spark):
    plan = M.messages(files(spark, ANN))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(line") <= 2


def test_empty_table(spark):
    none = files(spark, "x").where(F.lit(False))
    assert M.messages(none).count() == 0 and M.customers(none).count() == 0
