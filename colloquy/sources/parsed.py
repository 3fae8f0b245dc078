"""Parsed transcripts as JSON: one document of customers with messages, or of messages alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.messages import MESSAGE
from colloquy.sources.jsonblocks import read_elements
from colloquy.sources.shared import materialise

MESSAGE_TYPE = "struct<date:string,time:string,sender:string,message:string,customer_name:string>"
SCHEMA = f"customer_name string, messages array<{MESSAGE_TYPE}>, date string, time string, sender string, message string"


def read_parsed(spark: SparkSession, path: str, lines: bool = False, block_bytes: int | None = None) -> DataFrame:
    """Rows (src, fname, customer_name, g, date, time, sender, message) of a parsed document.

    A document is read by one task; with ``block_bytes`` by one for each block of so many bytes.
    ``lines`` reads JSON lines, as ``write_parsed_lines`` writes them, by many. The first element
    alone says which shape it is: with ``messages`` it is by customer. An empty document is flat and
    has no rows. ``fname`` keeps the customers' order.
    """
    if block_bytes:
        found = materialise(read_elements(spark, path, block_bytes))
        rows = found.select(F.from_json("element", SCHEMA).alias("e"), "src", "at").select("e.*", "src", "at")
    else:
        rows = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path).select("*", F.input_file_name().alias("src"), F.monotonically_increasing_id().alias("at"))
    first = rows.orderBy("at").select(F.col("messages").isNotNull().alias("nested")).first()
    place = F.lpad(F.col("at").cast("string"), 20, "0")
    if first is not None and first["nested"]:
        each = rows.select("src", place.alias("fname"), "customer_name", F.posexplode("messages").alias("g", "m"))
        return each.select("src", "fname", "customer_name", F.col("g").cast("long").alias("g"), *(F.col(f"m.{c}").alias(c) for c in MESSAGE))
    return rows.select("src", F.lit("").alias("fname"), F.lit(None).cast("string").alias("customer_name"), F.col("at").alias("g"), *MESSAGE)


def parsed_path(path: str) -> str:
    """Where the parsed form of an export goes: the last extension anywhere in the path is replaced."""
    return path.rsplit(".", 1)[0] + "_parsed.json"


def write_parsed(per_customer: DataFrame, path: str, nested: bool = True) -> tuple[int, int]:
    """One indented JSON document, streamed to a local file in order of file name; returns (customers, messages).

    For the driver of a small export; ``write_parsed_lines`` is the distributed form.
    """
    customers = total = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        started = False
        for row in per_customer.orderBy("src", "fname").toLocalIterator():
            found = [m.asDict() for m in row["messages"]]
            customers, total = customers + 1, total + len(found)
            documents = [{"customer_name": row["customer_name"], "messages": found}] if nested else [{k: m[k] for k in MESSAGE} for m in found]
            for document in documents:
                text = json.dumps(document, indent=2, ensure_ascii=False)
                out.write((",\n" if started else "\n") + "\n".join("  " + line for line in text.split("\n")))
                started = True
        out.write("\n]" if started else "]")
    return customers, total


def write_parsed_lines(per_customer: DataFrame, path: str) -> None:
    """One JSON line a customer, nulls kept, from all executors at once."""
    per_customer.select("customer_name", "messages").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


