"""Command line: parse an export, extract from a parsed document."""

from __future__ import annotations

import argparse
import dataclasses
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from colloquy.operators.messages import customers, customers_of_lines, message_counts
from colloquy.plans.extract import ContentProvider, HttpProvider, MessagesProvider, Provider, extract, require_key
from colloquy.plans.profiles import PROFILES
from colloquy.sources.exports import is_zip, read_export
from colloquy.sources.jsonblocks import BLOCK_BYTES
from colloquy.sources.members import read_transcripts
from colloquy.sources.onefile import write_insights_document, write_parsed_document
from colloquy.sources.parsed import parsed_path, read_parsed
from colloquy.sources.shared import clear_scratch, materialise

KEY = "COLLOQUY_API_KEY"
# Each client's key variable, and the model that each profile asks unless another is named.
KEYS = {"http": KEY, "messages": "ANTHROPIC_API_KEY", "content": "GEMINI_API_KEY"}
MODELS = {"insights": "claude-sonnet-4-5-20250929", "items": "gemini-3.6-flash"}
#: Which client a profile uses unless told otherwise.
CLIENTS = {"insights": "messages", "items": "content"}


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage()
        raise SystemExit(1)


def parse(spark: SparkSession, path: str) -> str:
    if is_zip(path):
        told = read_transcripts(spark, path)
        for row in told.problems.toLocalIterator():
            print(f"{row['fname'] or path}: {row['problem']}" + (f", {row['dropped']} left out" if row["dropped"] else ""))
        if not told.problems.where("fname IS NULL").isEmpty():
            raise SystemExit(1)
        found = materialise(customers_of_lines(told.lines))
    else:
        found = materialise(customers(read_export(spark, path)))
    out = parsed_path(path)
    write_parsed_document(found, out, nested=is_zip(path))
    counts = message_counts(found)
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n_messages"), F.lit(0))).first()
    print(f"{total} messages of {n} customer(s) -> {out}" if is_zip(path) else f"{total} messages -> {out}")
    if is_zip(path):
        for row in counts.orderBy("fname").toLocalIterator():
            print(f"  {row['customer_name']}: {row['n_messages']} messages")
    else:
        for row in found.where(F.size("messages") > 0).select(F.element_at("messages", 1).alias("m")).limit(1).collect():
            print("First message:", row["m"].asDict())
    clear_scratch(spark)
    return out


def answers_path(path: str) -> str:
    """Where a document's answers are kept: next to it, so that later runs find them."""
    return path.rsplit(".", 1)[0] + "_answers"


def run_extraction(spark: SparkSession, path: str, profile: str, provider: Provider, out: str = "insights.json", cache: str | None = None, model: str | None = None, in_flight: int = 1, rate: float | None = None) -> str:
    asked = dataclasses.replace(PROFILES[profile], model=model or MODELS[profile])
    result = extract(read_parsed(spark, path, block_bytes=BLOCK_BYTES), asked, provider, cache or answers_path(path), path, progress=lambda came_out: print("Chunks so far:", came_out), in_flight=in_flight, rate=rate)
    write_insights_document(result, out)
    for row in result.errors.toLocalIterator():
        print(f"chunk {row['chunk_no']} of {row['fname']}: {row['error']}: {row['answer']}")
    clear_scratch(spark)
    print(f"Saved to {out}")
    return out


def chosen(kind: str, url: str | None) -> Provider:
    return {"http": lambda key: HttpProvider(url, key), "messages": MessagesProvider, "content": ContentProvider}[kind](KEYS[kind])


def main(arguments: list[str] | None = None) -> None:
    parser = Parser(prog="colloquy")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("parse").add_argument("path")
    asked = commands.add_parser("extract")
    asked.add_argument("path")
    asked.add_argument("--profile", choices=sorted(PROFILES), default="items")
    asked.add_argument("--provider", choices=sorted(KEYS), help="which client to use; a URL alone means http")
    asked.add_argument("--url", help="of an http provider")
    asked.add_argument("--model")
    asked.add_argument("--in-flight", type=int, default=1, help="calls at a time in each task")
    asked.add_argument("--rate", type=float, help="calls a second of all tasks at most")
    asked.add_argument("--out", default="insights.json")
    asked.add_argument("--cache")
    given = parser.parse_args(arguments)
    if given.command == "extract":
        kind = given.provider or ("http" if given.url else CLIENTS[given.profile])
        if (kind == "http") != bool(given.url):
            parser.error("an http provider needs a URL, and others have none")
        require_key(KEYS[kind], dict(os.environ))
    spark = SparkSession.builder.appName("colloquy").getOrCreate()
    if given.command == "parse":
        parse(spark, given.path)
    else:
        run_extraction(spark, given.path, given.profile, chosen(kind, given.url), given.out, given.cache, given.model, given.in_flight, given.rate)


if __name__ == "__main__":
    main()
