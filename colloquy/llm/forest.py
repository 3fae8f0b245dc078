"""Nearest vectors by a hash-prefix forest.

Vectors are dealt into blocks of bounded size. Each block has a forest: in every tree a sorted
array of the vectors' bit strings, which are the sides they take of the tree's random planes.
A query descends to its longest prefix match in each tree; then all trees ascend together, one
bit at a time, until the vectors that share the prefix somewhere are the wanted share of the
block. Those are scored exactly. The stated queries meet every block, in bounded groups, and
only a few rows for each query and block are shuffled on.

Equal vectors are one entry with its smallest ids, as many as can be returned, so copies neither
fill up the candidates nor make a block grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import materialise

BLOCK_ROWS = 8192
#: Queries that meet a block at a time: the rows are copied for as many groups, and there are no more of them than memory asks for.
QUERY_ROWS = 16_384
TREES = 128
BITS = 32
#: Share of a block that a query's candidates come to. Nearly orthogonal neighbours need so many.
SHARE = 0.35
#: Candidates that a query gets in any block that has so many.
LEAST = 1024
SEED = 11


def planes(dims: int, trees: int, bits: int, seed: int) -> np.ndarray:
    """Normals of all trees' planes, orthogonal in groups of as many as there are dimensions."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-trees * bits // dims))]
    return np.concatenate(groups, axis=1)[:, : trees * bits]


def strings(vectors: np.ndarray, normals: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, rows) bit strings as integers, first plane in the highest bit."""
    found = np.zeros((trees, len(vectors)), np.int64)
    for t in range(trees):
        for side in (vectors @ normals[:, t * bits : (t + 1) * bits] > 0).T:
            found[t] = found[t] << 1 | side
    return found


class Forest:
    """The forest of one block."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.trees, self.bits, self.vectors = trees, bits, vectors
        self.normals = planes(vectors.shape[1], trees, bits, seed)
        found = strings(vectors, self.normals, trees, bits)
        self.order = np.argsort(found, axis=1, kind="stable")
        self.sorted = np.take_along_axis(found, self.order, axis=1)

    def bounds(self, found: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees) bounds in the sorted arrays of what shares the first ``depth`` bits."""
        shift = self.bits - depth
        prefix = found >> shift << shift
        low = np.stack([np.searchsorted(s, p) for s, p in zip(self.sorted, prefix, strict=True)], axis=1)
        high = np.stack([np.searchsorted(s, p + (1 << shift)) for s, p in zip(self.sorted, prefix, strict=True)], axis=1)
        return low, high

    def search(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query at least ``least`` vectors of the block, or all of it if that is smaller.

        All trees stand at the same depth: first at the greatest one where their matches could be
        enough if no two were the same vector by more than chance, then one up at a time until they are.
        """
        found, rows = strings(queries, self.normals, self.trees, self.bits), len(self.vectors)
        least = min(least, rows)
        depths, wait = np.zeros(len(queries), np.int64), np.arange(len(queries))
        for depth in range(self.bits, 0, -1):
            low, high = self.bounds(found[:, wait], depth)
            enough = rows * (1 - np.prod(1 - (high - low) / rows, axis=1)) >= least
            depths[wait[enough]] = depth
            wait = wait[~enough]
            if not len(wait):
                break
        for q, depth in enumerate(depths):
            while True:
                low, high = self.bounds(found[:, q : q + 1], depth)
                hit = np.zeros(rows, bool)
                for order, a, z in zip(self.order, low[0], high[0], strict=True):
                    hit[order[a:z]] = True
                at = np.flatnonzero(hit)
                if len(at) >= least:
                    break
                depth -= 1
            yield at


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of vectors, each times a power of two that brings its largest component to 0.5 to 1.

    Cosines are the same to the last bit, and neither norms nor products leave the range of doubles.
    """
    flat = column.combine_chunks()
    found = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return np.ldexp(found, -np.frexp(np.abs(found).max(axis=1))[1][:, None])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, least: int = LEAST, block_rows: int = BLOCK_ROWS, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found by cosine, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; a query is no candidate of its own.
    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part. Vectors are compared with those of their own length. Repeated rows
    count once; an id with several vectors is found by the nearest of them. Other columns are
    ignored; an empty table gives no rows.
    """
    vector = F.col(vector_col)
    usable = vectors.where(
        F.col(id_col).isNotNull()
        & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    ).select(F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("vector")).distinct()
    # The limit for each vector is applied before the shuffle too, so a common vector is no burden.
    smallest = Window.partitionBy("vector").orderBy("id")
    entries = usable.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = materialise(entries)  # counted and dealt out: two uses
    queries = usable.where(F.col("id") % every == 0)
    blocks, groups = (max(1, math.ceil(df.count() / most)) for df, most in ((entries, block_rows), (queries, QUERY_ROWS)))
    every_block, every_group = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, groups))
    dealt = entries.select(F.size("vector").alias("dims"), F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("block"), every_group.alias("group"), "ids", "vector")
    asked = queries.select(F.size("vector").alias("dims"), every_block.alias("block"), F.pmod(F.xxhash64("id", "vector"), F.lit(groups)).cast("int").alias("group"), "id", "vector")

    def search(key, block: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if block.num_rows and wanted.num_rows:
            raw, ids = matrix(block["vector"]), block["ids"].to_pylist()
            asked, query_ids = matrix(wanted["vector"]), wanted["id"].to_pylist()
            norms, lengths = np.linalg.norm(raw, axis=1), np.linalg.norm(asked, axis=1)
            forest = Forest(raw, trees, bits, seed)
            # One more than asked for, as the query's own entry may be among them.
            wanted_rows = max(k + 1, least, math.ceil(share * len(raw)))
            for q, (query, at) in enumerate(zip(query_ids, forest.search(asked, wanted_rows), strict=True)):
                scores = raw[at] @ asked[q] / (norms[at] * lengths[q])
                if len(at) > k + 1:
                    # Entries as good as the (k + 1)th best stay in: the query's own entry may be one.
                    keep = scores >= np.partition(scores, len(at) - k - 1)[len(at) - k - 1]
                    at, scores = at[keep], scores[keep]
                best = sorted((-s, i) for s, e in zip(scores.tolist(), at, strict=True) for i in ids[e] if i != query)[:k]
                found += [(query, i, -s) for s, i in best]
        return pa.table([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    by = ["dims", "block", "group"]
    met = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
