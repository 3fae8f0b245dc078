"""SimHash near-duplicates, linked through Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments. The perfect Golay code decodes any 23 bits
to the one codeword within 3 bits, and each word has few codewords within 4. If two segments
differ in at most one bit, the codeword of the one is among those near the other; so a row with
one side's own index and rows with the other side's near indices meet in an equality join.

Three differing bits in three segments leave two cases. Either some segment i is equal, and one
of the others, j, differs in at most one bit: key (i, j, segment i, index j). Or each differs in
exactly one bit: key of all three indices. Keys are 33 to 36 bits long, so that chance meetings
stay below the number of rows at any size that 64-bit fingerprints make sense for. Each meeting
is verified on the whole fingerprints inside the join. Equal fingerprints are one class before
any of this, and components are found from links between classes by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from colloquy.llm.common import materialise

SEED = 42
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 3
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text; shingles are words joined by a space, with repeats."""
    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for i in range(0, n, COUNTED):
        grams = zip(*(words[i + k : min(n, i + COUNTED) + k] for k in range(shingle)), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp), one for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of at most 3 bits, and all errors of at most 4 bits, in rows ended by -1."""
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            errors[int(syndrome(np.array([word]))[0])].append(word)
    near = np.full((1 << 11, max(map(len, errors))), -1, np.int64)
    for s, words in enumerate(errors):
        near[s, : len(words)] = words
    return near[:, 0], near


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words, as polynomials, by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def own_index(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within 3 bits: any 12 neighbouring bits tell a cyclic code's words apart."""
    return (words ^ golay()[0][syndrome(words)]) >> 11


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all codewords within 4 bits of each word."""
    errors = golay()[1][syndrome(words)]
    row, column = np.nonzero(errors >= 0)
    return row, (words[row] ^ errors[row, column]) >> 11


def keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the left and of the right side of the join."""
    fps = fps.view(np.uint64)
    segment = [(fps >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    own, near = [own_index(s) for s in segment], [near_indices(s) for s in segment]
    every = np.arange(len(fps))
    left, right, tag = [], [], 1
    for i in range(3):
        for j in range(3):
            if i != j:
                base = (np.int64(tag) << 40) | segment[i] << 12
                left.append((every, base | own[j]))
                right.append((near[j][0], base[near[j][0]] | near[j][1]))
                tag += 1
    row, index = near[1]
    left.append((row, own[0][row] << 24 | index << 12 | own[2][row]))
    # Near indices of two segments at once: each near row of the first, with all of the second's.
    row, index = near[0]
    many = np.bincount(near[2][0], minlength=len(fps))
    first = np.cumsum(many) - many
    twice = np.repeat(np.arange(len(row)), many[row])
    at = np.arange(len(twice)) - np.repeat(np.cumsum(many[row]) - many[row], many[row]) + first[row[twice]]
    right.append((row[twice], index[twice] << 24 | own[1][row[twice]] << 12 | near[2][1][at]))
    return tuple(tuple(map(np.concatenate, zip(*side, strict=True))) for side in (left, right))


def keyed(classes: DataFrame, side: int) -> DataFrame:
    """Rows (key, fp) of one side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False)
                row, key = keys(fps)[side]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v), u < v, of fingerprints that differ in at most MOST_BITS bits."""
    left, right = keyed(classes, 0).alias("l"), keyed(classes, 1).alias("r")
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MOST_BITS
    # Spark sizes a side by its fingerprints, of which each makes many rows, and would broadcast those.
    met = left.join(right.hint("merge"), (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")) & near)
    return met.select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of links (u, v): root is the least node of the component.

    Large and small stars in turn; every round halves what is left of long chains at least.
    Rounds are written to the shared folder, and only two numbers a round come to the driver, which
    the writing job counts. No side of a join is broadcast: however small, it would be built there.
    """
    edges, before = links, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least.hint("merge"), "u").where("v != m").select(F.col("v"), F.col("m"))
        small = rest.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        seen, digest = Observation(), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        found = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(found.observe(seen, F.count("*").alias("n"), digest.alias("digest")))
        now = seen.get["n"], seen.get["digest"]
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    component_id is the least id that links of at most 3 differing bits lead to, the row's own
    included. Texts without words, null ones too, have fingerprint zero and are linked like any
    other. A null id is never the least one unless all of its component are null. Repeated rows
    each keep their row; other columns are ignored; an empty table gives no rows.
    """
    return grouped(materialise(fingerprints(docs, id_col, text_col, shingle)))


def grouped(prints: DataFrame) -> DataFrame:
    """As ``near_duplicates``, of written rows (doc_id, fp)."""
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(materialise(fingerprint_links(classes)))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = classes.join(linked.hint("merge"), classes["fp"] == linked["node"]).select("fp", "least", "root")
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = members.join(lowest.hint("merge"), "root").select("fp", "component_id")
    found = classes.join(placed.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    found = materialise(found)  # two plain exchanges meet below, so Spark can split a fingerprint that many rows have
    return prints.join(found.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: the row of least id stays (nulls last).

    Rows are told apart by their place in the input, not by their id, so of repeated ids too one
    row stays. ``docs`` has to be a table that reads the same each time, such as a written one.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    groups = near_duplicates(numbered.select(row, F.col(text_col).alias("text")), row, "text", shingle)
    ids = numbered.select(F.col(row).alias("doc_id"), F.col(id_col).alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id")))
    kept = groups.join(ids.hint("merge"), "doc_id").groupBy("component_id").agg(first.alias("first")).select(F.col("first.doc_id").alias(row))
    return numbered.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
