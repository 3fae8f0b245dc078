import os
import zipfile

import pytest

from colloquy.operators import messages as M
from colloquy.sources.exports import FILES
from colloquy.streaming.growing import BLOCK, digests, grown_messages, watch_growing

ONE = "12/06/24, 9:16 - Ann: one\nmore\n12/06/24, 9:17 - Ann: Bob left\n12/06/24, 9:18 - Ann: two"
TWO = ONE + "\ngoes on\n\n12/06/24, 9:19 - Bob: three\n12/06/24, 9:20 - Bob: This message was deleted\n12/06/24, 9:21 - Bob: four"


@pytest.fixture
def chat(spark, tmp_path):
    class Chat:
        folder, out, moment = tmp_path / "in", str(tmp_path / "out"), [1_700_000_000]

        def drop(self, name, **texts):
            (self.folder / name).parent.mkdir(parents=True, exist_ok=True)
            with zipfile.ZipFile(self.folder / name, "w") as z:
                for fname, text in texts.items():
                    z.writestr(f"{fname}.txt", text)
            self.moment[0] += 10
            os.utime(self.folder / name, (self.moment[0], self.moment[0]))

        def run(self):
            watch_growing(spark, str(self.folder), self.out, str(tmp_path / "check")).awaitTermination()
            told = spark.read.parquet(f"{self.out}/messages")
            batch = max(int(n.removeprefix("batch=")) for n in os.listdir(f"{self.out}/messages"))
            return sorted((r["chat"], r["g"], r["message"], r["grown"]) for r in told.where(f"batch = {batch}").collect())

        def reports(self):
            return sorted((r["chat"], r["kind"], r["n"], r["known"]) for r in spark.read.parquet(f"{self.out}/reports").collect())

        def now(self):
            return sorted((r["chat"], r["g"], r["sender"], r["message"]) for r in grown_messages(spark, self.out).collect())

    found = Chat()
    found.folder.mkdir()
    return found


def folded(spark, **texts):
    files = spark.createDataFrame([("s", f"{n}.txt", n, t) for n, t in texts.items()], FILES)
    return sorted((r["fname"], r["g"], r["sender"], r["message"]) for r in M.messages(files).collect())


def test_a_second_export_adds_the_difference(spark, chat):
    chat.drop("a/one.zip", ann=ONE, bob="12/06/24, 9:16 - Bob: hi")
    assert chat.run() == [("ann.txt", 1, "one more", False), ("ann.txt", 2, "two", False), ("bob.txt", 1, "hi", False)]
    chat.drop("b/one.zip", ann=TWO, bob="12/06/24, 9:16 - Bob: hi\n\n")
    assert chat.run() == [("ann.txt", 2, "two goes on", True), ("ann.txt", 3, "three", False), ("ann.txt", 5, "four", False)]
    assert chat.now() == folded(spark, ann=TWO, bob="12/06/24, 9:16 - Bob: hi") and chat.reports() == []
    chat.drop("c/one.zip", ann=TWO, cat=ONE)
    assert [m[0] for m in chat.run()] == ["cat.txt"] * 2


def test_changed_and_shorter_histories_are_reported_and_add_nothing(spark, chat):
    long = "\n".join(f"12/06/24, 9:16 - Ann: m{i}" for i in range(2 * BLOCK + 10))
    chat.drop("1.zip", ann=long, bob=TWO, cat=ONE)
    chat.run()
    chat.drop("2.zip", ann=long.replace("m300\n", "other\n") + "\n12/06/24, 9:16 - Ann: new", bob=ONE, cat=ONE.replace("one", "won") + "\n12/06/24, 9:30 - C: x")
    assert chat.run() == []
    assert chat.reports() == [("ann.txt", "changed", BLOCK, 2 * BLOCK + 10), ("bob.txt", "shorter", 4, 9), ("cat.txt", "changed", 0, 4)]
    chat.drop("3.zip", ann=long + "\n12/06/24, 9:16 - Ann: last", bob=TWO)
    assert chat.run() == [("ann.txt", 2 * BLOCK + 11, "last", False)]


def test_exports_of_one_batch_come_in_their_order(spark, chat):
    first = "12/06/24, 9:16 - Ann: a"
    chat.drop("z.zip", ann=first)
    chat.drop("y.zip", ann=first + "\nb")
    chat.drop("x.zip", ann=first + "\nb\n12/06/24, 9:17 - Ann: c\nd")
    assert len(chat.run()) == 3
    assert chat.now() == folded(spark, ann=first + "\nb\n12/06/24, 9:17 - Ann: c\nd") and chat.reports() == []


def test_orphans_and_empty_exports(spark, chat):
    chat.drop("1.zip", ann="orphan\n", bob="")
    chat.run()
    chat.drop("2.zip", ann="orphan\nstill\n12/06/24, 9:16 - Ann: a", bob="12/06/24, 9:16 - Bob: b")
    assert chat.run() == [("ann.txt", 1, "a", False), ("bob.txt", 1, "b", False)]
    chat.drop("3.zip", ann="orphan\nstill\n12/06/24, 9:16 - Ann: a\nx\n12/06/24, 9:17 - Ann left\n12/06/24, 9:18 - Ann: z")
    assert chat.run() == [("ann.txt", 1, "a x 12/06/24, 9:17 - Ann left", True), ("ann.txt", 2, "z", False)]


def test_digests_are_of_blocks():
    lines = [str(i) for i in range(2 * BLOCK + 1)]
    assert len(digests(lines)) == 3 and digests(lines[: 2 * BLOCK]) == digests(lines)[:2] and digests([]) == []
