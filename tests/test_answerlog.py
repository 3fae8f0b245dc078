import glob
import json
import os
import subprocess
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle

from colloquy.plans.answerlog import AnswerLog
from colloquy.plans.extract import ReplayProvider, ServerError, answered, ask, extract, wave_metrics
from colloquy.plans.pace import TokenBucket
from colloquy.plans.profiles import ITEMS
from colloquy.sources.shared import qualified
from tests.test_extract import item, messages, nap

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules["tests.test_extract"])


def test_an_answer_is_logged_once_and_stands(tmp_path):
    log = AnswerLog(f"file://{tmp_path}/log", lease=0.4)
    with log.writer() as a, log.writer() as b:
        assert a.take("abc") == (None, 1)
        assert a.put("abc", 1, "one \ud800 é", 2) == {"raw": "one \ud800 é", "attempts": 2, "attempt": 1}
        assert b.take("abc")[0]["raw"] == "one \ud800 é" == b.put("abc", 2, "two", 1)["raw"]
    assert os.listdir(tmp_path / "log/owners") == []


def test_tasks_side_by_side_ask_once(tmp_path):
    log, asked, lock = AnswerLog(f"file://{tmp_path}/log", lease=2), [], threading.Lock()
    keys = [f"{k:02x}" for k in range(40)]

    def task(n):
        got = {}
        with log.writer() as mine:
            for key in keys:
                known, attempt = mine.take(key)
                if not known:
                    with lock:
                        asked.append(key)
                    time.sleep(0.005)
                    known = mine.put(key, attempt, f"{key} by {n}", 1)
                got[key] = known["raw"]
        return got

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(task, range(4)))
    assert sorted(asked) == keys and all(f == found[0] for f in found)


def test_claims_of_the_dead_are_superseded_and_those_of_the_living_are_not(tmp_path):
    log = AnswerLog(f"file://{tmp_path}/log", lease=0.4)
    gone = log.writer()  # claims, and gives no further sign of life
    gone.fs.create_dir(f"{gone.base}/owners", recursive=True)
    gone.beat(0)
    assert gone.take("k1") == (None, 1)
    with log.writer() as alive, log.writer() as other:
        assert alive.take("k2") == (None, 1)
        began = time.monotonic()
        assert other.take("k1") == (None, 2) and time.monotonic() - began > 0.3
        timer = threading.Timer(1.2, lambda: alive.put("k2", 1, "slow", 1))
        timer.start()
        assert other.take("k2")[0]["raw"] == "slow"
        assert gone.put("k1", 1, "late but first", 1)["raw"] == "late but first" == other.put("k1", 2, "x", 1)["raw"]


SCRIPT = """
import json, os, sys
sys.path.insert(0, {repo!r})
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from colloquy.plans.extract import answered
from colloquy.plans.profiles import ITEMS
from colloquy.sources.shared import qualified

class Deadly:
    def connect(self):
        def call(profile, prompt):
            with open(os.path.join({folder!r}, prompt), "a") as f:
                f.write("x")
            if prompt == "p7" and os.path.getsize(os.path.join({folder!r}, prompt)) == 1:
                os._exit(1)  # after it is asked, before it answers
            return json.dumps({{"items": [prompt]}})
        return call

cloudpickle.register_pickle_by_value(sys.modules[__name__])
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r} + "-shared").getOrCreate()
df = spark.createDataFrame([(i, f"p{{i}}") for i in range(12)], "chunk_no long, prompt string")
found = answered(df, ITEMS, Deadly(), {folder!r} + "-cache", concurrency=1, lease=1.0).collect()
print("FOUND", sorted(r["status"] for r in found) == ["answered"] * 12)
"""


def test_a_task_that_is_tried_again_asks_for_no_logged_answer(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, folder=str(folder))], capture_output=True, text=True, timeout=300)
    assert "FOUND True" in ran.stdout, ran.stderr[-2000:]
    calls = {name: os.path.getsize(folder / name) for name in os.listdir(folder)}
    assert calls == {f"p{i}": 1 + (i == 7) for i in range(12)}


class Counting:
    """Answers with the prompt; kills its worker at one prompt as long as a file is there."""

    def __init__(self, folder):
        self.folder = str(folder)

    def connect(self):
        def call(profile, prompt):
            with open(os.path.join(self.folder, prompt), "a") as f:
                f.write("x")
            if prompt == "p5" and os.path.exists(os.path.join(self.folder, "deadly")):
                os._exit(1)
            return prompt

        return call


def test_the_next_run_takes_a_lost_waves_answers_from_the_log(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    (folder / "deadly").touch()
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "chunk_no long, prompt string").coalesce(1)
    first = answered(df, ITEMS, Counting(folder), str(tmp_path / "cache"), concurrency=1, lease=0.5)
    assert {r["status"] for r in first.collect()} == {"lost"}
    paid = set(os.listdir(folder)) - {"deadly"}
    os.remove(folder / "deadly")
    again = answered(df, ITEMS, Counting(folder), str(tmp_path / "cache"), concurrency=1, lease=0.5)
    assert {r["prompt"]: r["raw"] for r in again.collect()} == {f"p{i}": f"p{i}" for i in range(10)}
    assert {n: os.path.getsize(folder / n) for n in os.listdir(folder)} == {f"p{i}": 1 + (i == 5) for i in range(10)} and "p5" in paid
    third = answered(df, ITEMS, Counting(folder), str(tmp_path / "cache"), concurrency=1)
    assert third.where("status = 'answered'").count() == 10 and os.path.getsize(folder / "p0") == 1


class Locked:
    def connect(self):
        raise KeyError("NO_KEY")


def test_a_failed_connection_ends_the_run_and_says_why(spark, tmp_path):
    df, cache = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "chunk_no long, prompt string"), str(tmp_path / "cache")
    with pytest.raises(ConnectionError, match="KeyError: 'NO_KEY'"):
        answered(df, ITEMS, Locked(), cache, concurrency=2, wave=2)
    assert {r["status"] for r in answered(df, ITEMS, ReplayProvider(), cache, concurrency=2).collect()} == {"answered"}


def test_waves_write_one_file_each_and_are_counted_without_the_table(spark, tmp_path):
    cache, heard = str(tmp_path / "cache"), []
    result = extract(messages(spark, *[1] * 9), ITEMS, ReplayProvider([("c3 m0", ["ServerError"])], item("x")), cache, "x", sleep=nap, wave=3, progress=heard.append)
    metrics = wave_metrics(spark, cache).collect()
    assert heard[-1] == {"answered": 8, "gave_up": 1} and len(heard) == len(metrics) == len(glob.glob(cache + "/*.parquet"))
    assert sum(m["asked"] for m in metrics) == 9 and sum(m["gave_up"] for m in metrics) == 1 and result.entries.count() == 8


class Clock:
    def __init__(self):
        self.now, self.lock = 0.0, threading.Lock()

    def sleep(self, seconds):
        with self.lock:
            self.now += seconds


def most_in(times, window):
    return max(sum(t <= u < t + window for u in times) for t in times)


def test_a_token_bucket_never_lets_too_many_through():
    for rate, burst in ((5, 1), (2, 3), (0.5, 1)):
        clock, times = Clock(), []
        bucket = TokenBucket(rate, burst, lambda clock=clock: clock.now, clock.sleep)
        for n in range(40):
            bucket.take()
            times.append(clock.now)
            if n == 20:
                bucket.wait(30)
        assert most_in(times, 10 / rate - 1e-6) <= burst + 10 and times[21] - times[20] >= 30
    with pytest.raises(ValueError):
        TokenBucket(0)


class Strict:
    """A server that refuses more than 4 calls in any tenth of a second, and once asks for a pause."""

    def __init__(self):
        self.times, self.lock, self.paused = [], threading.Lock(), False

    def call(self, profile, prompt):
        with self.lock:
            now = time.monotonic()
            self.times.append(now)
            if len(self.times) == 10:
                self.paused = now + 0.3
                raise ServerError("busy", 0.3)
            assert now >= self.paused - 1e-3, "asked in the pause"
        time.sleep(0.05)
        return prompt


def test_calls_in_flight_keep_the_servers_limit_and_the_order():
    server, pace = Strict(), TokenBucket(40)
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda p: ask(server.call, ITEMS, p, lambda _: None, pace), map(str, range(30))))
    assert [f[0] for f in found] == [*map(str, range(30))] and {f[1] for f in found} == {"answered"}
    assert most_in(server.times, 0.1) <= 5


def test_answers_of_calls_in_flight_are_the_sequential_ones(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "chunk_no long, prompt string")
    provider = ReplayProvider([(f"p{i}", [json.dumps(i)]) for i in reversed(range(30))])
    one, many = (answered(df, ITEMS, provider, str(tmp_path / f"c{n}"), 2, in_flight=n, rate=500).collect() for n in (1, 6))
    assert sorted((r["prompt"], r["raw"]) for r in one) == sorted((r["prompt"], r["raw"]) for r in many)


def test_paths_become_addresses(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == qualified(spark, f"file:{tmp_path}")
