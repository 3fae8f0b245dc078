"""Transcript files into lines, lines into messages, messages into customers.

Files come as rows of at most 2 GB each, or as lines, of any number. Files are spread over the
cluster by (src, fname); those of many lines, when they come as lines, by blocks of these too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.grammar import DELETED, NOTICES, captures
from colloquy.functions.text import collapse, contains_any, strip
from colloquy.sources.shared import materialise

KEYS = ["src", "fname", "customer_name"]
MESSAGE = ["date", "time", "sender", "message"]
#: Lines of a file that one task counts.
BLOCK = 100_000


def lines(files: DataFrame) -> DataFrame:
    """Rows (keys, n, line): stripped lines, blank ones too, in file order by n.

    Every file keeps a row at least, so that files without messages are not lost. Lines end at
    CR, LF or both; null text is empty.
    """
    split = F.split(F.coalesce(F.col("txt"), F.lit("")), "\r\n|\r|\n")
    return files.select(*KEYS, F.posexplode(split).alias("n", "raw")).select(*KEYS, "n", strip(F.col("raw")).alias("line"))


def headers(of: DataFrame) -> DataFrame:
    """Lines with date, time, sender and text where they are headers, and what becomes of them."""
    found = of.withColumn("c", captures(F.col("line")))
    parts = found.select(
        *KEYS,
        "n",
        "line",
        F.col("c").isNotNull().alias("is_header"),
        F.col("c")[0].alias("date"),
        F.col("c")[1].alias("time"),
        strip(F.col("c")[2]).alias("sender"),
        strip(F.col("c")[3]).alias("body"),
    )
    return parts.withColumn("is_notice", F.col("is_header") & contains_any(F.col("body"), NOTICES))


def grouped(of: DataFrame) -> DataFrame:
    """Header lines and continuations with ``g``: how many kept headers the file has had so far.

    Notices count for nothing, so what follows one continues the message before it. The filter
    comes after the window: before it, the pattern would be worked out again for every use.
    """
    so_far = Window.partitionBy("src", "fname").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pieced(headers(of).withColumn("g", F.sum(kept()).over(so_far)))


def kept() -> Column:
    return (F.col("is_header") & ~F.col("is_notice")).cast("long")


def pieced(seen: DataFrame) -> DataFrame:
    return seen.withColumn("piece", F.when(F.col("is_header"), F.col("body")).otherwise(F.col("line")))


def grouped_in_blocks(of: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same rows as ``grouped``, by many tasks for each file.

    Headers are counted inside blocks of ``block`` lines; what the file's earlier blocks have
    counted is carried over, so a message that is unfinished at the end of a block goes on in the
    next. Totals come from rows that lie together by block already; only they are put in order.
    """
    part = ["src", "fname", "block"]
    so_far = Window.partitionBy(*part).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = headers(of).withColumn("block", F.floor(F.col("n") / block)).withColumn("inside", F.sum(kept()).over(so_far))
    earlier = Window.partitionBy("src", "fname").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = seen.groupBy(*part).agg(F.max("inside").alias("total"))
    carried = totals.select(*part, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    whole = seen.join(carried, part)  # files have names: no part of the key is null
    return pieced(whole.withColumn("g", F.col("before") + F.col("inside"))).drop(*part[2:], "inside", "before").select(*KEYS, "n", "line", "is_header", "date", "time", "sender", "body", "is_notice", "g", "piece")


def grouped_by_size(of: DataFrame, block: int = BLOCK) -> DataFrame:
    """Files of up to ``block`` lines by one task each, longer ones by many; ``of`` is a written table."""
    long = of.where(F.col("n") >= block).select("src", "fname").distinct()
    if long.isEmpty():
        return grouped(of)
    long = materialise(long)
    return grouped(of.join(long, ["src", "fname"], "left_anti")).unionByName(grouped_in_blocks(of.join(long, ["src", "fname"], "left_semi"), block))


def said() -> Column:
    return (F.col("line") != "") & ~F.col("is_notice") & (F.col("g") > 0)


def joined(pieces: Column) -> Column:
    """The pieces of one message in line order, with a space between."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["piece"]), " ")


def fold(of: DataFrame) -> DataFrame:
    """Rows (keys, g, date, time, sender, message): continuation lines joined to their message.

    Lines before the first kept header are dropped. ``g`` counts messages from 1 in file order.
    """
    return folded(grouped(of))


def folded(lines_by_message: DataFrame) -> DataFrame:
    """``fold`` from the lines' message numbers on."""
    rows = lines_by_message.where(said())
    first = F.min(F.struct("n", "date", "time", "sender")).alias("h")
    found = rows.groupBy(*KEYS, "g").agg(first, joined(F.collect_list(F.struct("n", "piece"))).alias("message"))
    return found.select(*KEYS, "g", "h.date", "h.time", "h.sender", "message")


def clean(messages: DataFrame) -> DataFrame:
    """With white space collapsed, and without empty messages and those that say they were deleted."""
    found = messages.withColumn("message", collapse(F.col("message")))
    return found.where((F.col("message") != "") & ~F.lower("message").isin(*DELETED))


def stripped(raw: DataFrame) -> DataFrame:
    """``lines`` of files that come as rows (keys, n, raw) already."""
    return raw.select(*KEYS, "n", strip(F.col("raw")).alias("line"))


def messages_of_lines(raw: DataFrame, block: int = BLOCK) -> DataFrame:
    """``messages`` of a written table of raw lines; no file has to fit into one task."""
    return clean(folded(grouped_by_size(stripped(raw), block)))


def customers_of_lines(raw: DataFrame, block: int = BLOCK) -> DataFrame:
    return nested(grouped_by_size(stripped(raw), block))


def messages(files: DataFrame) -> DataFrame:
    """The flat message table of transcript files."""
    return clean(fold(lines(files)))


def customers(files: DataFrame) -> DataFrame:
    """Rows (src, fname, customer_name, messages): one for each file, without messages too.

    No join brings empty files back: they are never filtered, only their pieces are left out.
    """
    return nested(grouped(lines(files)))


def nested(rows: DataFrame) -> DataFrame:
    """``customers`` from the lines' message numbers on. A customer's messages are one row."""
    part = F.when(said(), F.struct("n", "piece"))
    head = F.when(said(), F.struct("n", "date", "time", "sender"))
    found = rows.groupBy(*KEYS, "g").agg(F.min(head).alias("h"), collapse(joined(F.collect_list(part))).alias("message"))
    good = (F.col("g") > 0) & (F.col("message") != "") & ~F.lower("message").isin(*DELETED)
    fields = [F.col("g"), F.col("h.date").alias("date"), F.col("h.time").alias("time"), F.col("h.sender").alias("sender"), F.col("message"), F.col("customer_name")]
    listed = found.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.when(good, F.struct(*fields)))).alias("m"))

    def tagged(m: Column) -> Column:
        return F.struct(*(m[c].alias(c) for c in [*MESSAGE, "customer_name"]))

    return listed.select(*KEYS, F.transform("m", tagged).alias("messages"))


def message_counts(per_customer: DataFrame) -> DataFrame:
    """Rows (src, fname, customer_name, n_messages), zero for empty files."""
    return per_customer.select(*KEYS, F.size("messages").cast("long").alias("n_messages"))
