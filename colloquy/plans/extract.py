"""Calling a model for every chunk, once.

A model is slow, costs money and answers differently each time, so what was paid for is kept.
Chunks are keyed by what is asked. Each answer goes to a log at once, before the task returns it,
so that neither a task that is tried again nor a second copy of it pays for it twice. Chunks are
asked in waves; a wave reads its own part of what is to be asked and appends one file to a table in
a shared folder, and the table is read back before anything is done with the answers. A call that
fails is a row with its reason, whatever the failure. A later run asks only for what neither the
table nor the log has.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Protocol

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import responses
from colloquy.operators.chunks import CHUNK_SIZE, prompts
from colloquy.operators.spans import indented, scanned, written_entries
from colloquy.plans.answerlog import LEASE, AnswerLog, Writer
from colloquy.plans.pace import TokenBucket
from colloquy.plans.profiles import Profile
from colloquy.sources.shared import materialise, qualified, scratch_path

CACHE = "chunk_key string, raw string, status string, attempts int, reason string, at timestamp"
#: Chunks of one wave.
WAVE = 1024


class ServerError(Exception):
    """The model's service failed; asking again may help, after ``wait`` seconds where it says so."""

    def __init__(self, reason: str = "", wait: float | None = None):
        super().__init__(reason)
        self.wait = wait


def told_to_wait(error: Exception) -> float | None:
    """Seconds of a ``Retry-After`` header, of whatever client's error."""
    headers = getattr(error, "headers", None) or getattr(getattr(error, "response", None), "headers", None)
    try:
        return float(headers.get("Retry-After")) if headers else None
    except (TypeError, ValueError):  # none, or a date
        return None


#: Answers by status code that asking again may change: too many requests, and failures of the service.
def is_passing(code: int | None) -> bool:
    return code == 429 or code is not None and code >= 500


class Provider(Protocol):
    def connect(self) -> Callable[[Profile, str], str]:
        """A function from (profile, prompt) to the answer's text; made once for each partition."""


@dataclass
class ReplayProvider:
    """Answers from a list of (substring of the prompt, outcomes in turn); ``ServerError`` as an outcome is raised."""

    outcomes: list[tuple[str, list[str]]] = field(default_factory=list)
    default: str = '{"items": []}'

    def connect(self) -> Callable[[Profile, str], str]:
        asked: dict[str, int] = {}

        def call(profile: Profile, prompt: str) -> str:
            for part, outcomes in self.outcomes:
                if part in prompt:
                    n = asked[part] = asked.get(part, 0) + 1
                    found = outcomes[min(n, len(outcomes)) - 1]
                    if found == "ServerError":
                        raise ServerError(part)
                    return found
            return self.default

        return call


@dataclass
class HttpProvider:
    """A JSON endpoint: posts model, system text, prompt and limits; reads ``text`` from the answer.

    The key is read from the environment where the call is made and is never part of a plan.
    There is no network where this is tested: only its request is.
    """

    url: str
    key_variable: str
    timeout: float = 120.0

    def request(self, profile: Profile, prompt: str, key: str) -> urllib.request.Request:
        body = {"model": profile.model, "system": profile.system, "prompt": prompt, "max_tokens": profile.max_tokens, "json_only": profile.json_only}
        return urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})

    def connect(self) -> Callable[[Profile, str], str]:
        import os

        key = os.environ[self.key_variable]

        def call(profile: Profile, prompt: str) -> str:
            try:
                with urllib.request.urlopen(self.request(profile, prompt, key), timeout=self.timeout) as answer:
                    return json.load(answer)["text"]
            except urllib.error.HTTPError as e:
                if is_passing(e.code):
                    raise ServerError(str(e), told_to_wait(e)) from e
                raise

        return call


@dataclass
class MessagesProvider:
    """The messages interface of the ``anthropic`` client, which is imported where the call is made. Not tried: no network."""

    key_variable: str

    def connect(self) -> Callable[[Profile, str], str]:
        import os

        import anthropic

        client = anthropic.Anthropic(api_key=os.environ[self.key_variable], max_retries=0)

        def call(profile: Profile, prompt: str) -> str:
            try:
                answer = client.messages.create(model=profile.model, max_tokens=profile.max_tokens or 4096, system=profile.system, messages=[{"role": "user", "content": prompt}])
            except anthropic.APIStatusError as e:
                if is_passing(e.status_code):
                    raise ServerError(str(e), told_to_wait(e)) from e
                raise
            return answer.content[0].text

        return call


@dataclass
class ContentProvider:
    """The content interface of the ``google.genai`` client, which is imported where the call is made. Not tried: no network."""

    key_variable: str

    def connect(self) -> Callable[[Profile, str], str]:
        import os

        from google import genai

        client = genai.Client(api_key=os.environ[self.key_variable])

        def call(profile: Profile, prompt: str) -> str:
            settings = {"system_instruction": profile.system}
            if profile.json_only:
                settings["response_mime_type"] = "application/json"
            if profile.max_tokens:
                settings["max_output_tokens"] = profile.max_tokens
            try:
                return client.models.generate_content(model=profile.model, contents=prompt, config=settings).text
            except genai.errors.APIError as e:
                if is_passing(e.code):
                    raise ServerError(str(e), told_to_wait(e)) from e
                raise

        return call


def require_key(variable: str, environment: dict[str, str]) -> None:
    """Ends the program with code 1 if the key isn't set."""
    if variable not in environment:
        print(f"Set {variable} first.")
        raise SystemExit(1)


def ask(call: Callable[[Profile, str], str], profile: Profile, prompt: str, sleep: Callable[[float], None] = time.sleep, pace: TokenBucket | None = None) -> tuple[str | None, str, int, str | None]:
    """(answer, status, attempts, reason): answered, gave_up or failed.

    Server errors are tried again after 2, 4, 8... seconds, as often as the profile says; a wait that
    the server asks for is kept by all calls that share the pace. Any other error, and an answer
    that is no text, fails the chunk at once, and no other one.
    """
    reason = None
    for attempt in range(1, profile.retries + 1):
        if pace:
            pace.take()
        try:
            found = call(profile, prompt)
        except ServerError as e:
            reason = described(e)
            if pace and e.wait:
                pace.wait(e.wait)
            if attempt < profile.retries:
                sleep(2**attempt)
        except Exception as e:  # of any client library: one chunk's failure is not the others'
            return None, "failed", attempt, described(e)
        else:
            return (whole_characters(found), "answered", attempt, None) if isinstance(found, str) else (None, "failed", attempt, "the answer holds no text")
    return None, "gave_up", profile.retries, reason


def whole_characters(text: str) -> str:
    """Halves of surrogate pairs, which no table can hold, as JSON would escape them."""
    return text if text.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def ask_once(log: Writer, key: str, *asked) -> tuple[str | None, str, int, str | None]:
    """Like ``ask``, but an answer that the log has is not asked for again, and a new one is logged first."""
    known, attempt = log.take(key)
    if not known:
        found = ask(*asked)
        if found[1] != "answered":
            return found
        known = log.put(key, attempt, found[0], found[2])
    return known["raw"], "answered", known["attempts"], None


def described(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def cached(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


METRICS = "wave long, asked long, answered long, failed long, gave_up long, seconds double, lost string"


def wave_metrics(spark: SparkSession, cache_path: str) -> DataFrame:
    """One row for each wave of all runs so far: how many chunks came out how, and how long it took."""
    return spark.read.schema(METRICS).parquet(f"{cache_path}/_metrics")


def answered(
    chunks: DataFrame,
    profile: Profile,
    provider: Provider,
    cache_path: str,
    concurrency: int = 8,
    sleep: Callable[[float], None] = time.sleep,
    wave: int = WAVE,
    progress: Callable[[dict[str, int]], None] | None = None,
    in_flight: int = 1,
    rate: float | None = None,
    lease: float = LEASE,
) -> DataFrame:
    """Chunks with raw answer, status, attempts and reason; equal prompts are asked once.

    ``concurrency`` tasks ask, each with ``in_flight`` calls at a time; ``rate`` bounds the calls a
    second of all of them. ``progress`` hears after each wave how many chunks so far came out how,
    as the tasks counted them. Chunks of a wave that was lost have the status ``lost``; its answers
    are in the log, and the next run takes them from there. Ends at once where no connection can be
    made.
    """
    spark = chunks.sparkSession
    log = AnswerLog(qualified(spark, f"{cache_path}/_log"), lease)
    log.check()
    asked_with = [F.lit(x) for x in (profile.name, profile.model, profile.system, str(profile.max_tokens), str(profile.json_only))]
    keyed = materialise(chunks.withColumn("chunk_key", F.sha2(F.concat_ws("\x00", *asked_with, F.col("prompt")), 256)))
    known = cached(spark, cache_path).where("status = 'answered'").select("chunk_key")
    todo = materialise(keyed.select("chunk_key").distinct().join(known, "chunk_key", "left_anti"))
    waves = max(1, -(-todo.count() // wave))
    mine = F.pmod(F.xxhash64("chunk_key"), F.lit(waves))
    dealt = scratch_path(spark)
    prompts_of = keyed.select("chunk_key", "prompt").dropDuplicates(["chunk_key"]).join(todo, "chunk_key", "left_semi")
    prompts_of.withColumn("wave", mine).repartition("wave").write.partitionBy("wave").parquet(dealt)
    share = rate / concurrency if rate else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, pace = None, TokenBucket(share)
        with log.writer() as written, ThreadPoolExecutor(in_flight) as calls:
            for frame in frames:
                try:
                    call = call or provider.connect()
                except Exception as e:  # it fails for all chunks: one row says so instead of task failures
                    yield pd.DataFrame([(frame["chunk_key"][0], None, "unconnected", 0, described(e), pd.Timestamp.now())], columns=columns)
                    return
                for key, found in zip(frame["chunk_key"], calls.map(lambda key, prompt: ask_once(written, key, call, profile, prompt, sleep, pace), frame["chunk_key"], frame["prompt"]), strict=True):
                    yield pd.DataFrame([(key, *found, pd.Timestamp.now())], columns=columns)

    columns = [c.split(" ")[0] for c in CACHE.split(", ")]
    count = [F.count_if(F.col("status") == s).alias(s) for s in ("answered", "failed", "gave_up", "unconnected")]
    because = F.max(F.when(F.col("status") == "unconnected", F.col("reason"))).alias("because")
    sofar, lost, metrics = Counter(), {}, []
    for k in [r["wave"] for r in spark.read.parquet(dealt).select("wave").distinct().orderBy("wave").collect()] if todo.count() else []:
        part = spark.read.schema("chunk_key string, prompt string").parquet(f"{dealt}/wave={k}")
        came_out, began = Observation(), time.monotonic()
        # One file a wave: tasks that ask hand their answers to one that writes them.
        one = part.repartition(concurrency).mapInPandas(run, CACHE).repartition(1).observe(came_out, *count, because)
        try:
            one.write.mode("append").parquet(cache_path)
            got = came_out.get
        except (PySparkException, Py4JError) as e:
            lost[k], got = described(e), {}
        if got.get("unconnected"):
            raise ConnectionError(f"no connection can be made: {got['because']}")
        told = {s: got.get(s, 0) for s in ("answered", "failed", "gave_up")}
        sofar.update(told)
        metrics.append((k, sum(told.values()), *told.values(), time.monotonic() - began, lost.get(k)))
        if progress:
            progress({s: n for s, n in sofar.items() if n})
    if metrics:
        spark.createDataFrame(metrics, METRICS).coalesce(1).write.mode("append").parquet(f"{cache_path}/_metrics")
    newest = F.max_by(F.struct("raw", "status", "attempts", "reason"), F.struct(F.col("status") == "answered", "at"))
    latest = cached(spark, cache_path).groupBy("chunk_key").agg(newest.alias("a"))
    reasons = F.create_map(*(F.lit(x) for pair in lost.items() for x in pair))[mine] if lost else F.lit(None)
    gone = F.coalesce(reasons, F.lit("no answer was kept"))
    found = keyed.join(latest, "chunk_key", "left")
    return found.select(*keyed.columns, "a.raw", F.coalesce("a.status", F.lit("lost")).alias("status"), "a.attempts", F.when(F.col("a.status").isNull(), gone).otherwise(F.col("a.reason")).alias("reason"))


def now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat() + "Z"


@dataclass
class Extraction:
    """Tables of one run."""

    entries: DataFrame
    errors: DataFrame
    total_messages: int
    profile: Profile
    source: str
    generated_at: str

    def document(self) -> Iterator[tuple[str, Iterator[str]]]:
        """(list, its entries as they were written, in order), for a sink that writes one document."""
        ordered = self.rows()
        for name in self.profile.keys:
            rows = ordered.where(F.col("list") == name).orderBy("position").select("entry")
            yield name, (r["entry"] for r in rows.toLocalIterator())

    def rows(self) -> DataFrame:
        """The result as rows (list, position, entry), entries as they were written: for a sink that many tasks write."""
        return responses.merged(self.entries, ["src", "fname", "chunk_no"], ("written",)).select("list", "position", F.col("written").alias("entry"))

    def meta(self) -> dict:
        return {"source_file": self.source, "total_messages_analyzed": self.total_messages, "generated_at": self.generated_at, "model": self.profile.model}


def extract(messages: DataFrame, profile: Profile, provider: Provider, cache_path: str, source: str, size: int = CHUNK_SIZE, concurrency: int = 8, sleep: Callable[[float], None] = time.sleep, wave: int = WAVE, progress: Callable[[dict[str, int]], None] | None = None, in_flight: int = 1, rate: float | None = None) -> Extraction:
    """Chunk, ask, read and merge. Messages whose chunk failed still count as analysed."""
    keys = ["src", "fname", "chunk_no"]
    chunks = prompts(messages, profile, size=size)
    told = answered(chunks, profile, provider, cache_path, concurrency, sleep, wave, progress, in_flight, rate)
    # Read once: entries and errors both come from it.
    read = materialise(scanned(told, responses.unfenced(F.col("raw")), profile.keys, keys, ("raw", "status", "reason")))
    found = written_entries(read, [*keys])
    unanswered = F.col("status") != "answered"
    failed = read.where(F.col("list").isNull()).withColumn("error", F.when(unanswered, F.col("status")).otherwise(F.col("error"))).withColumn("raw", F.when(unanswered, F.col("reason")).otherwise(F.col("raw")))
    return Extraction(found, responses.errors(failed, keys), messages.count(), profile, source, now())


def write_insights(result: Extraction, path: str = "insights.json") -> None:
    """One indented JSON document with the lists in order and ``_meta`` last, streamed to a local file."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for name, found in result.document():
            out.write(f"\n  {json.dumps(name)}: [")
            empty = True
            for text in found:
                out.write(("" if empty else ",") + "\n    " + indented(text, "    "))
                empty = False
            out.write("]," if empty else "\n  ],")
        text = json.dumps(result.meta(), indent=2, ensure_ascii=False)
        out.write('\n  "_meta": ' + text.replace("\n", "\n  ") + "\n}")
