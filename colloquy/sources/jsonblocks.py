"""One JSON document of many elements, read by many tasks.

A document is cut into blocks of bytes. Whether a block begins inside a text, and how deep in
brackets, depends on all that comes before; so each block says first what it would do to either
state: how it ends if it begins outside a text, inside one, or after a backslash in one, and by how
much it opens or closes brackets. Running over these few numbers gives each block its true
beginning. Then a block's task reads the elements that begin in it, the last one beyond its end.
Elements are numbered from the blocks' counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.sources.shared import materialise, qualified

#: Bytes of one block; bytes of elements in one batch.
BLOCK_BYTES, BATCH_BYTES = 8 << 20, 8 << 20
#: States: outside of texts, inside one, inside after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)
TEXT = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
MARK = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{}]', re.S)


def unfinished(data: bytes) -> int:
    """The state after the data of a text that hasn't ended."""
    return ESCAPED if (len(data) - len(data.rstrip(b"\\"))) % 2 else INSIDE


def begun(data: bytes, state: int) -> tuple[int, int]:
    """(where what is outside begins, state there); all of it belongs to a text if the state isn't OUTSIDE."""
    if state == OUTSIDE or not data:
        return 0, state
    at = 1 if state == ESCAPED else 0
    rest = REST.match(data, at)
    return (rest.end(), OUTSIDE) if rest else (len(data), unfinished(data[at:]))


def effect(data: bytes, state: int) -> tuple[int, int]:
    """(state at the end, brackets opened less those closed) of a block that begins in a state."""
    at, state = begun(data, state)
    if state != OUTSIDE:
        return state, 0
    bare = TEXT.sub(b"", data[at:])
    quote = bare.find(b'"')
    if quote >= 0:
        bare, state = bare[:quote], unfinished(bare[quote + 1 :])
    return state, bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def brackets(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, +1 or -1, state at the end) of the brackets outside of texts."""
    at, state = begun(data, state)
    if state != OUTSIDE:
        return np.zeros(0, int), np.zeros(0, int), state
    places, last = [], at
    for m in MARK.finditer(data, at):
        if data.find(b'"', last, m.start()) >= 0:
            break  # a text that doesn't end here: all that follows belongs to it
        last = m.end()
        if last - m.start() == 1:
            places.append(m.start())
    quote = data.find(b'"', last)
    state = unfinished(data[quote + 1 :]) if quote >= 0 else OUTSIDE
    found = np.array(places, int)
    signs = np.array([1 if data[p] in b"[{" else -1 for p in found.tolist()], int)
    return found, signs, state


def elements(read, size: int, start: int, stop: int, state: int, depth: int) -> Iterator[bytes]:
    """The objects of the outermost array that begin in bytes [start, stop); ``read(a, b)`` gives bytes."""
    data = read(start, stop)
    places, signs, state = brackets(data, state)
    after = depth + np.cumsum(signs)
    opens = places[(after - signs == 1) & (signs > 0)]
    closes = places[(after == 1) & (signs < 0)]
    if depth > 1:
        closes = closes[1:]  # of an element that began earlier
    for a, b in zip(opens.tolist(), closes.tolist(), strict=False):
        if data[a : a + 1] == b"{":
            yield data[a : b + 1]
    if len(opens) > len(closes) and data[opens[-1] : opens[-1] + 1] == b"{":
        parts, depth = [data[opens[-1] :]], int(after[-1])
        while stop < size:
            more = read(stop, min(size, stop + BLOCK_BYTES))
            stop += len(more)
            places, signs, state = brackets(more, state)
            ends = places[(depth + np.cumsum(signs) == 1) & (signs < 0)]
            if len(ends):
                yield b"".join([*parts, more[: ends[0] + 1]])
                return
            parts.append(more)
            depth += int(signs.sum())


def document_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """Rows (file, size, block) of a document, or of all JSON files under a folder, and the address they lie at."""
    uri = qualified(spark, path)
    fs, base = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.type == pafs.FileType.File and f.base_name[:1] not in ("_", ".")]
    files = spark.createDataFrame([(f.path, f.size) for f in found if f.size], "file string, size long")
    last = F.floor((F.col("size") - 1) / block_bytes)
    blocks = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return blocks.repartition(max(1, min(10_000, sum(-(-f.size // block_bytes) for f in found))), "file", "block"), uri


def read_elements(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (src, at, element): the objects of each document's array as JSON texts, numbered from 0; written once.

    An element has to fit into a row. What isn't an object is left out; an empty array, or a file
    that is no array, has no rows.
    """
    blocks, uri = document_blocks(spark, path, block_bytes)

    def opened(file: str):
        fs, _ = pafs.FileSystem.from_uri(uri)
        content = fs.open_input_file(file)

        def read(a: int, b: int) -> bytes:
            content.seek(a)
            return content.read(b - a)

        return content, read

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content, read = opened(file)
                with content:
                    data = read(block * block_bytes, min(size, (block + 1) * block_bytes))
                rows.append([x for state in range(3) for x in effect(data, state)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], names=["file", "size", "block", "effects"])

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, chain in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "chain")), strict=True):
                state, depth, found = OUTSIDE, 0, []
                for block in chain:
                    found.append((file, size, block["block"], state, depth))
                    depth += block["effects"][2 * state + 1]
                    state = block["effects"][2 * state]
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found, strict=True)], names=["file", "size", "block", "state", "depth"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block, state, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content, read = opened(file)
                held, bytes_held, first = [], 0, 0
                with content:
                    for element in elements(read, size, block * block_bytes, min(size, (block + 1) * block_bytes), state, depth):
                        held.append(element.decode("utf-8", "replace"))
                        bytes_held += len(element)
                        if bytes_held >= BATCH_BYTES:
                            yield cut_batch(file, block, first, held)
                            held, bytes_held, first = [], 0, first + len(held)
                yield cut_batch(file, block, first, held)

    changed = blocks.mapInArrow(effects, "file string, size long, block long, effects array<long>")
    chains = changed.groupBy("file", "size").agg(F.array_sort(F.collect_list(F.struct("block", "effects"))).alias("chain"))
    begin = materialise(chains.mapInArrow(beginnings, "file string, size long, block long, state long, depth long"))
    spread = begin.repartition(blocks.rdd.getNumPartitions(), "file", "block")
    found = materialise(spread.mapInArrow(cut, "file string, block long, i long, element string"))
    counts = found.groupBy("file", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    src = F.concat(F.lit("file:" if uri.startswith("file:") else ""), F.regexp_replace("file", "^/", "///") if uri.startswith("file:") else F.col("file"))
    return found.join(starts, ["file", "block"]).select(src.alias("src"), (F.col("before") + F.col("i")).alias("at"), "element")


def cut_batch(file: str, block: int, first: int, held: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([*range(first, first + n)], pa.int64()), pa.array(held, pa.string())], names=["file", "block", "i", "element"])
