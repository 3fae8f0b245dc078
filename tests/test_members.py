import io
import random
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from colloquy.operators import messages as M
from colloquy.sources.exports import FILES, read_exports
from colloquy.sources.members import Dropping, MemberReader, directory, inflated, lines_of, read_transcripts
from tests.test_messages import ANN, archive, texts


def text(rng, n):
    said = [f"12/06/24, 9:{i % 60:02d} - P{i % 3}: word {rng.random()}" if rng.random() < 0.4 else rng.choice(["", "  more  ", "x y", "12/06/24, 9:17 - Ann: Bob left", "é" * 5]) for i in range(n)]
    return rng.choice(["\n", "\r\n", "\r"]).join(said) + rng.choice(["", "\n"])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_rows_are_those_of_whole_files(spark, tmp_path):
    rng = random.Random(1)
    for k in range(5):
        entries = [(f"c{i}.txt", text(rng, rng.randrange(0, 60))) for i in range(7)] + [("sub/n.txt", ANN), ("skip.csv", ANN), ("empty.txt", ""), ("B.TXT", "[20/06/24, 09:16:05] B: iOS\r\nmore\r\n".encode() + b"\xff"), ("../up.txt", ANN)]
        archive(tmp_path / f"a{k}.Zip", entries)
    with pytest.warns(UserWarning):
        archive(tmp_path / "twice.zip", [("a.txt", "first"), ("a.txt", "second")])
    archive(tmp_path / "none.zip", [])
    files = read_exports(spark, str(tmp_path))
    for options in ({}, {"whole": 0, "taskBytes": 100}):
        found = read_transcripts(spark, str(tmp_path), **options)
        columns = ["src", "fname", "customer_name", "n", "line"]
        assert rows(M.stripped(found.lines), *columns) == rows(M.lines(files), *columns)
        told = ["src", "fname", "g", "date", "time", "sender", "message"]
        for block in (100_000, 3):
            assert rows(M.messages_of_lines(found.lines, block), *told) == rows(M.messages(files), *told)
            assert rows(M.customers_of_lines(found.lines, block), "fname", "messages") == rows(M.customers(files), "fname", "messages")
        assert rows(found.problems, "fname", "lost", "dropped") == [("B.TXT", False, 1)] * 5


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path):
    path = archive(tmp_path / "many.zip", [(f"c{i}.txt", f"12/06/24, 9:16 - A: {i}") for i in range(10_000)])
    assert len(MemberReader({"uri": f"file://{path}"}).partitions()) >= 20
    found = read_transcripts(spark, path)
    assert found.lines.count() == 10_000 and sorted(int(t) for t in texts(M.messages_of_lines(found.lines))) == [*range(10_000)]
    assert found.lines.select(F.input_file_name()).distinct().count() >= 20


def test_one_broken_archive_of_a_hundred(spark, tmp_path):
    for i in range(100):
        archive(tmp_path / f"a{i:02d}.zip", [("a.txt", f"12/06/24, 9:16 - A: {i}")])
    (tmp_path / "a42.zip").write_bytes(b"PK this is none")
    for options in ({}, {"whole": 0}):
        found = read_transcripts(spark, str(tmp_path), **options)
        assert M.messages_of_lines(found.lines).count() == 99
        problem = found.problems.collect()
        assert len(problem) == 1 and problem[0]["src"].endswith("/a42.zip") and problem[0]["lost"] and "BadZipFile" in problem[0]["problem"]


def test_a_broken_member_is_left_out_whole(spark, tmp_path):
    rng = random.Random(2)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.txt", "b.txt", "c.txt"):
            z.writestr(name, f"12/06/24, 9:16 - A: {name}\n" + "".join(rng.choice("abcdefgh \n") for _ in range(400_000)))
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("b.txt").header_offset + z.getinfo("b.txt").compress_size - 100
    data = bytearray(path.read_bytes())
    data[at] ^= 0xFF
    path.write_bytes(data)
    found = read_transcripts(spark, str(path))
    assert [r.fname for r in found.lines.select("fname").distinct().orderBy("fname").collect()] == ["a.txt", "c.txt"]
    assert [(r.fname, r.lost) for r in found.problems.collect()] == [("b.txt", True)]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_a_member_is_a_stream(method):
    """Many times what is held at a time passes through; other methods and encryption are refused."""
    data, line = io.BytesIO(), b"12/06/24, 9:16 - A: \xc3\xa9 and more\r\n"
    with zipfile.ZipFile(data, "w", method) as z, z.open("big.txt", "w") as out:
        for _ in range(2000):
            out.write(line * 500)
    (member,), counted, n = directory(data), Dropping(), 0
    sizes = []

    def watched():
        for chunk in inflated(data, member):
            sizes.append(len(chunk))
            yield chunk

    for got in lines_of(watched(), counted):
        n += 1
        assert got == "12/06/24, 9:16 - A: é and more" or n == 1_000_001
    assert n == 1_000_001 and max(sizes) <= 1 << 20 and counted.dropped == 0


def test_line_ends_and_bytes_at_chunk_ends():
    data = "a\r\nb\rc\n\nd\x0be\x85é\r".encode() + b"\xff\xc3" + "z\n".encode()
    want = data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for step in range(1, len(data)):
        counted = Dropping()
        assert list(lines_of((data[i : i + step] for i in range(0, len(data), step)), counted)) == want and counted.dropped == 2
    assert list(lines_of(iter([]), Dropping())) == [""]


def test_a_file_with_most_lines_is_folded_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    big = "\n".join(["orphan", *(f"12/06/24, 9:{i % 60:02d} - P: m{i}" if i % 3 == 0 else f"line {i}" for i in range(30_000)), *["tail"] * 2000])
    path = archive(tmp_path / "big.zip", [("big.txt", big), *((f"s{i}.txt", text(rng, 30)) for i in range(20))])
    found = read_transcripts(spark, path)
    whole = spark.createDataFrame([(r.src, r.fname, r.customer_name, t) for r, t in [(found.lines.where("fname = 'big.txt'").first(), big)]], FILES)
    got = M.folded(M.grouped_by_size(M.stripped(found.lines), 1000)).where("fname = 'big.txt'")
    assert rows(got, "g", "message") == rows(M.fold(M.lines(whole)), "g", "message")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put what is small together
    placed = M.grouped_in_blocks(M.stripped(found.lines.repartition(3)), 1000).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("count"), F.max("g")).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(placed) == 4 and max(r["count"] for r in placed) < 16_000


def test_nothing_there(spark, tmp_path):
    (tmp_path / "in").mkdir()
    found = read_transcripts(spark, str(tmp_path / "in"))
    assert found.lines.count() == 0 == found.problems.count() and M.messages_of_lines(found.lines).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        read_transcripts(spark, str(tmp_path / "missing"))
    shutil.rmtree(tmp_path / "in")
