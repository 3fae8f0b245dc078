"""Substring de-duplication: passages of fixed length that an earlier document holds are cut out.

A window is so many consecutive words; its Rabin-Karp hash rolls over the words' hashes. Windows
are counted in Spark by hash, with the least document that holds each; those of later documents
are merged into maximal intervals of words, which go.

Most windows occur once, and one row for each word of the corpus would be shuffled to find that
out. So windows are counted only where they can repeat. Every window has an anchor: the least hash
among the shorter windows inside it. Equal windows have equal anchors, neighbours mostly share
theirs, and so a document has few. Anchors are counted first; windows whose anchor no other text
has are unique. Texts of equal words are one class beforehand: all but its least documents go
whole, and only one of them is looked at.

Hashes are 128 bits of two independent rolling sums, so that at 10^13 windows a false match has a
chance of about 10^-12.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialise

WINDOW = 50
#: Words of the windows among which a window's anchor is chosen, at most.
ANCHOR = 20
#: Bytes of a text whose words are held at a time.
SEGMENT = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
#: Odd multipliers of the two rolling sums.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Windows that a task passes on at a time.
ROWS = 1 << 16


def word_segments(text: bytes | None) -> Iterator[list[bytes]]:
    """A whole UTF-8 text's words, between ASCII white space, a segment at a time."""
    at, data = 0, text or b""
    while at < len(data):
        space = SPACE.search(data, at + SEGMENT)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def word_hashes(segments: Iterator[list[bytes]]) -> np.ndarray:
    """Two hashes a word."""
    found = b"".join(b"".join(map(xxhash.xxh3_128_digest, words)) for words in segments)
    return np.frombuffer(found, "<u8").reshape(-1, 2)


@cache
def powers(base: int, bits: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full((1 << bits) - 1, base, np.uint64)], dtype=np.uint64)


class Rolling:
    """Rabin-Karp hashes modulo 2^64 of all windows of any length, from one running sum."""

    def __init__(self, words: np.ndarray, base: int):
        bits = max(12, int(len(words)).bit_length())
        self.up = powers(base, bits)
        self.sums = np.r_[np.uint64(0), np.cumsum(words * powers(pow(base, -1, 1 << 64), bits)[: len(words)], dtype=np.uint64)]

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.up[length - 1 : length - 1 + n] if n > 0 else np.zeros(0, np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[: len(values) - have], values[have:]), 2 * have
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(rolling: Rolling, window: int) -> np.ndarray:
    """The anchor of each window."""
    length = min(ANCHOR, window)
    return sliding_least(rolling.windows(length), window - length + 1)


def told(docs: DataFrame, window: int) -> DataFrame:
    """Rows (doc_id, print, n_words, sha, c1, c2, anchors): a text's digest, in whole and as two numbers, and its distinct anchors."""
    schema = "doc_id long, print long, n_words long, sha string, c1 long, c2 long, anchors array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, pairs, found = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                sha, parts = hashlib.sha256(), []

                def segments(text=text, sha=sha):
                    between = b""
                    for words in word_segments(text.as_py()):
                        if words:
                            sha.update(between + b" ".join(words))
                            between = b" "
                            yield words

                parts = word_hashes(segments())
                counts.append(len(parts))
                shas.append(sha.hexdigest())
                pairs.append(np.frombuffer(sha.digest()[:16], "<i8"))
                looked_at = len(parts) >= window and doc_id.is_valid
                found.append(np.unique(anchors(Rolling(parts[:, 0], BASES[0]), window)).view(np.int64) if looked_at else np.zeros(0, np.int64))
            pairs = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("print"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), lists(found)],
                names=["doc_id", "print", "n_words", "sha", "c1", "c2", "anchors"],
            )

    return docs.mapInArrow(run, schema)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def shared_windows(texts: DataFrame, window: int) -> DataFrame:
    """Rows (h1, h2, doc_id, row, at) of the windows whose anchor is among ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text, shared in zip(*(batch.column(c) for c in ("doc_id", "row", "text", "shared")), strict=True):
                words = word_hashes(word_segments(text.as_py()))
                first, second = (Rolling(words[:, i], BASES[i]) for i in range(2))
                at = np.flatnonzero(np.isin(anchors(first, window), shared.values.to_numpy(zero_copy_only=False).view(np.uint64)))
                h1, h2 = (r.windows(window)[at].view(np.int64) for r in (first, second))
                for i in range(0, len(at), ROWS):
                    n = len(at[i : i + ROWS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h1[i : i + n]), pa.array(h2[i : i + n]), pa.array(np.full(n, doc_id.as_py(), np.int64)), pa.array(np.full(n, row.as_py(), np.int64)), pa.array(at[i : i + n].astype(np.int32))],
                        names=["h1", "h2", "doc_id", "row", "at"],
                    )

    return texts.mapInArrow(run, "h1 long, h2 long, doc_id long, row long, at int")


def merged(at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words that windows from ``at`` on cover."""
    at = np.unique(at)
    if not len(at):
        return []
    cut = np.flatnonzero(at[1:] > at[:-1] + window)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + window).tolist(), strict=True))


def cut_out(texts: DataFrame, window: int) -> DataFrame:
    """Rows (c1, c2, spans, n_removed, kept) from rows with ``text`` and the places ``at`` of repeated windows."""
    schema = "c1 long, c2 long, spans array<struct<start: long, stop: long>>, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"spans": [], "n_removed": [], "kept": []}
            for text, at in zip(batch.column("text"), batch.column("at"), strict=True):
                spans = merged(at.values.to_numpy(zero_copy_only=False), window)
                out["spans"].append([{"start": a, "stop": b} for a, b in spans])
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["kept"].append(without(text.as_py(), spans))
            yield pa.RecordBatch.from_pydict({"c1": batch.column("c1"), "c2": batch.column("c2")} | {f.name: pa.array(out[f.name], f.type) for f in KEPT})

    return texts.mapInArrow(run, schema)


KEPT = [pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.field("n_removed", pa.int64()), pa.field("kept", pa.string())]


def without(text: bytes | None, spans: list[tuple[int, int]]) -> str:
    """The words outside the spans, joined by one space."""
    out, seen, spans = [], 0, list(reversed(spans))
    for words in word_segments(text):
        at = 0
        while at < len(words):
            while spans and spans[-1][1] <= seen + at:
                spans.pop()
            inside = bool(spans) and spans[-1][0] <= seen + at
            until = min(len(words), (spans[-1][1] if inside else spans[-1][0]) - seen) if spans else len(words)
            if not inside:
                out.append(b" ".join(words[at:until]))
            at = until
        seen += len(words)
    return b" ".join(out).decode()


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_words, spans, n_removed, kept_sha256, kept), one for each row of ``docs``.

    ``spans`` are the maximal intervals [start, stop) of words to remove: those covered by a window
    that also starts in a document of smaller id, judged on the input. ``kept`` are the other words
    joined by one space; with ``keep_text`` false it is left out, and texts that stay whole are not
    read again. ``docs`` has to be a table that reads the same each time.

    Null and empty texts have no words. A row with a null id loses nothing and takes nothing from
    others, and rows of one id take nothing from each other. Repeats inside one document stay.
    Repeated rows each keep their row; other columns are ignored; an empty table gives no rows.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).withColumn("print", F.xxhash64("text"))
    facts = materialise(told(ids, window))
    least = F.min(F.struct("doc_id", "print"))
    # One row for each text of its own; ids and prints tell where it can be read again.
    classes = facts.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("c1", "c2").agg(least.alias("l"), F.first("anchors").alias("anchors"))
    classes = materialise(classes.select("c1", "c2", F.col("l.doc_id").alias("least"), F.col("l.print").alias("print"), "anchors"))
    each = classes.select("c1", "c2", F.explode("anchors").alias("anchor"))
    many = materialise(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    shared = each.join(many, "anchor").groupBy("c1", "c2").agg(F.collect_list("anchor").alias("shared"))
    wanted = materialise(classes.drop("anchors").join(shared, ["c1", "c2"]).withColumnRenamed("least", "doc_id"))
    texts = materialise(ids.join(wanted, ["doc_id", "print"]).select("c1", "c2", "doc_id", "text", "shared").withColumn("row", F.monotonically_increasing_id()))
    windows = materialise(shared_windows(texts, window))
    counted = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    hits = windows.join(materialise(counted), ["h1", "h2"]).where("doc_id > first").groupBy("row").agg(F.collect_list("at").alias("at"))
    cut = cut_out(texts.join(hits, "row").select("c1", "c2", "text", "at"), window)
    cut = cut.select("c1", "c2", "spans", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if keep_text else [])).dropDuplicates(["c1", "c2"])
    outcome = materialise(classes.select("c1", "c2", "least").join(cut, ["c1", "c2"], "left"))

    placed = facts.drop("anchors").join(outcome, ["c1", "c2"], "left")
    whole = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))  # null ids and short texts too stay
    own = F.col("doc_id") == F.col("least")
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    spans = F.when(whole, every).when(own & F.col("spans").isNotNull(), F.col("spans")).otherwise(F.array().cast("array<struct<start: long, stop: long>>"))
    removed = F.when(whole, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    sha = F.when(whole, F.sha2(F.lit(""), 256)).when(own, F.coalesce("kept_sha256", "sha")).otherwise(F.col("sha"))
    found = placed.select("doc_id", "print", "n_words", spans.alias("spans"), removed.alias("n_removed"), sha.alias("kept_sha256"), *([F.when(whole, "").when(own, F.col("kept")).alias("kept")] if keep_text else []))
    if not keep_text:
        return found.drop("print")
    told_once = found.dropDuplicates(["doc_id", "print"])
    plain = F.array_join(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    back = ids.alias("i").join(told_once.alias("f"), F.col("i.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("i.print").eqNullSafe(F.col("f.print")))
    return back.select("i.doc_id", "n_words", "spans", "n_removed", "kept_sha256", F.coalesce("kept", plain, F.lit("")).alias("kept"))
