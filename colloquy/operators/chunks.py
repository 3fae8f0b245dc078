"""Messages into chunks of bounded size, chunks into prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.profiles import Profile

#: Fixed value: messages a chunk.
CHUNK_SIZE = 80
#: Values of the order key that one task numbers at a time.
BLOCK = 100_000


def numbered(df: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK) -> DataFrame:
    """With ``pos``: each row's place in its group, from 0 in order of a whole-number key.

    Places are counted within blocks of the order key, and blocks by their totals, so that a
    group of any size is numbered by many tasks. The order key has to be unique in its group.
    """
    with_block = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = with_block.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_block"]]
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    counted = with_block.withColumn("_inside", F.row_number().over(inside))
    placed = counted.alias("a").join(starts.alias("b"), same)
    return placed.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a._inside") - 1 + F.col("b._before")).alias("pos"))


def chunked(df: DataFrame, keys: Sequence[str], order: str, size: int = CHUNK_SIZE) -> DataFrame:
    """With ``chunk_no`` from 0: runs of ``size`` consecutive rows of one group, the last one shorter."""
    return numbered(df, keys, order).withColumn("chunk_no", F.floor(F.col("pos") / size)).drop("pos")


def rendered(date: Column, time: Column, sender: Column, message: Column) -> Column:
    """``[date time] sender: message``. A message without one of them can't be rendered and raises."""
    line = F.concat(F.lit("["), date, F.lit(" "), time, F.lit("] "), sender, F.lit(": "), message)
    return F.coalesce(line, F.raise_error(F.lit("a message has no date, time, sender or text")).cast("string"))


def prompts(messages: DataFrame, profile: Profile, keys: Sequence[str] = ("src", "fname"), order: str = "g", size: int = CHUNK_SIZE) -> DataFrame:
    """Rows (keys, chunk_no, n_messages, prompt); a group without messages has no chunk."""
    rows = chunked(messages, keys, order, size).withColumn("line", rendered(F.col("date"), F.col("time"), F.col("sender"), F.col("message")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line"))))
    chat = F.array_join(F.transform(ordered, lambda e: e["line"]), "\n")
    found = rows.groupBy(*keys, "chunk_no").agg(F.count("*").alias("n_messages"), chat.alias("chat"))
    return found.select(*keys, "chunk_no", "n_messages", profile.prompt(F.col("chat")).alias("prompt"))
