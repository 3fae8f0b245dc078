"""Chats that are exported again and again: a stream that appends only what is new.

An export holds the whole chat so far. Per chat a state is kept: how many lines are known, digests
of them by the block, how many messages there are and on which line the last one began. A further
export whose beginning agrees adds its other lines; the last known message is told again if these
go on with it. One that is shorter, or whose known part has changed, adds nothing and is reported.

State is a few digests a chat and is kept with the stream's checkpoint, so a batch that is run
again comes to the same. What was added is folded in Spark like any other lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from colloquy.functions.grammar import NOTICES, captures
from colloquy.functions.text import contains_any, strip
from colloquy.operators import messages as M
from colloquy.sources.exports import ZIP_GLOB, unzip

#: Lines that one digest stands for.
BLOCK = 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: ``kind``: line (of what is added, from the last known message on), shorter or changed (then ``n`` is the
#: first line of the block where it differs). ``known`` lines were there before, ``earlier`` messages end before the first told.
ADDED = "chat string, src string, fname string, customer_name string, kind string, n long, raw string, known long, earlier long"


def digests(lines: Sequence[str], block: int = BLOCK) -> list[str]:
    """One digest for each block of lines, the last one shorter."""
    return [hashlib.sha256("\n".join(lines[i : i + block]).encode()).hexdigest() for i in range(0, len(lines), block)]


class Growth(StatefulProcessor):
    """Rows (src, fname, customer_name, at, lines, heads) of one chat into rows of what each export adds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "lines long, messages long, last_head long")
        self.blocks = handle.getListState("blocks", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        exports = pd.concat(list(rows)).sort_values(["at", "src"], kind="stable")
        for src, fname, customer, lines, heads in zip(*(exports[c] for c in ("src", "fname", "customer_name", "lines", "heads")), strict=True):
            yield self.added(key[0], src, fname, customer, [*lines], [*heads])

    def added(self, chat: str, src: str, fname: str, customer: str | None, lines: list[str], heads: list[bool]) -> pd.DataFrame:
        while lines and not lines[-1]:  # a later export may go on there
            lines.pop()
        known, messages, last_head = self.known.get() if self.known.exists() else (0, 0, 0)
        before, now = [b[0] for b in self.blocks.get()], digests(lines[:known])
        report = None
        if now != before:
            differs = next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
            # A shorter export's last block is cut off, so it can't be told apart there.
            short = len(lines) < known and differs >= len(lines) // BLOCK
            report = ("shorter", len(lines)) if short else ("changed", differs * BLOCK)
        if report:
            told = [(chat, src, fname, customer, report[0], report[1], None, known, messages)]
        else:
            first = last_head if messages else 0
            told = [(chat, src, fname, customer, "line", n, lines[n], known, max(0, messages - 1)) for n in range(first, len(lines))] if len(lines) > known else []
            counted = [n for n in range(known, len(lines)) if heads[n]]
            self.known.update((len(lines), messages + len(counted), counted[-1] if counted else last_head))
            if lines:
                self.blocks.put([(d,) for d in digests(lines)])
        return pd.DataFrame(told, columns=[c.split(" ")[0] for c in ADDED.split(", ")])

    def close(self) -> None:
        pass


def exported(files: DataFrame, at: Column) -> DataFrame:
    """One row for each export, with its lines as they are folded and which of them begin a message."""
    split = F.transform(F.split(F.coalesce("txt", F.lit("")), "\r\n|\r|\n"), strip)

    def head(line: Column) -> Column:
        found = captures(line)
        return F.coalesce(found.isNotNull() & ~contains_any(strip(found[3]), NOTICES), F.lit(False))

    return files.select("src", "fname", "customer_name", at.alias("at"), split.alias("lines")).withColumn("heads", F.transform("lines", head))


def growth(exports: DataFrame, chat: Column | None = None) -> DataFrame:
    """Rows of ADDED from a stream of ``exported`` rows; ``chat`` says which exports are of one chat, by default the file name."""
    keyed = exports.withColumn("chat", F.coalesce(chat if chat is not None else F.col("fname"), F.lit("")))
    return keyed.groupBy("chat").transformWithStateInPandas(Growth(), ADDED, "Append", "none")


def new_messages(added: DataFrame) -> DataFrame:
    """Rows (chat, src, fname, customer_name, g, date, time, sender, message, grown) from one batch of added lines.

    ``g`` goes on from the chat's earlier messages. ``grown`` ones were told before and have more
    lines now: they take the place of the row with the same ``g``.
    """
    # Several exports of one chat in a batch are told apart by what was known before each.
    lines = added.where("kind = 'line'").withColumn("src", F.concat_ws("\x00", "chat", "src", "known", "earlier"))
    rows = M.grouped(lines.select(*M.KEYS, "n", F.col("raw").alias("line"))).where(M.said())
    first = F.min(F.struct("n", "date", "time", "sender")).alias("h")
    found = rows.groupBy(*M.KEYS, "g").agg(first, M.joined(F.collect_list(F.struct("n", "piece"))).alias("message"), F.max("n").alias("last"))
    part = F.split("src", "\x00")
    known, earlier = part[2].cast("long"), part[3].cast("long")
    new = found.where(F.col("last") >= known).withColumn("grown", F.col("h.n") < known)
    told = new.select(part[0].alias("chat"), part[1].alias("src"), "fname", "customer_name", (F.col("g") + earlier).alias("g"), "h.date", "h.time", "h.sender", "message", "grown")
    return M.clean(told)


def watch_growing(spark: SparkSession, folder: str, out: str, checkpoint: str, chat: Column | None = None, **trigger) -> StreamingQuery:
    """Append what every new archive under a folder adds to ``out``/messages, and reports to ``out``/reports.

    A batch that is run again replaces what it wrote before. State needs the RocksDB provider,
    which is set for the session where it isn't.
    """
    if spark.conf.get(PROVIDER) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    archives = spark.readStream.format("binaryFile").option("pathGlobFilter", ZIP_GLOB).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    times = archives.select("path", "modificationTime", "content")
    found = growth(exported(unzip(times, "modificationTime timestamp"), F.col("modificationTime")), chat)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        new_messages(batch).write.mode("overwrite").parquet(f"{out}/messages/batch={number}")
        batch.where("kind <> 'line'").drop("raw", "earlier").write.mode("overwrite").parquet(f"{out}/reports/batch={number}")
        batch.unpersist()

    return found.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def grown_messages(spark: SparkSession, out: str) -> DataFrame:
    """The messages as they are now: of those that have grown, what the last batch told."""
    told = spark.read.parquet(f"{out}/messages")
    value = F.struct("src", "fname", "customer_name", "date", "time", "sender", "message")
    # Within a batch, the export that knew more lines is the later one: its message is the longer.
    last = told.groupBy("chat", "g").agg(F.max_by(value, F.struct("batch", F.length("message"))).alias("m"))
    return last.select("chat", "g", "m.*")
