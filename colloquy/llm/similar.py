"""Near-duplicates by SimHash, checked by exact Jaccard similarity, and by banded minima where that is not enough.

Texts with the same set of shingles are one class. Classes are grouped by ``simhash``'s operator:
fingerprints of three-word shingles with repeats, linked at MOST_BITS differing bits through Golay
indices. Each class of a group meets the group's least one, and links where their sets of five-word
shingles have the similarity. A similarity of 0.8 leaves some ten bits that differ, so that does not
find all. For the rest, each class has BANDS keys, each of BAND_ROWS
minima of its shingles' hashes; two sets of similarity s share a key unless all bands differ,
which at s = 0.8 happens to 5 pairs in a million: (1 - 0.8 ** 6) ** 40. Nothing else is left
out: whatever shares a key is verified on the whole sets, unless SimHash's links hold all members of the
key together. First each member of a key meets the key's least one. Where that leaves a key in several components, each member meets one that shares
keys with many others, which is near to what the group has in common. What is still apart after
that meets each other, as far as sketches allow: bits of a member's shingles that another lacks
are shingles that it lacks, which bounds the similarity from above. So the components are those
of all pairs, while large groups of copies and of edited copies cost a few meetings a member.

All joins are merge joins: Spark sizes a column of arrays as if each held one value, exploded rows by
their arrays, and files as they are packed, so that it would broadcast tables that the driver can't build.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import materialise, small
from colloquy.llm.simhash import components, fingerprint, grouped

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
BAND_ROWS = 6
#: Shingles whose minima are taken at a time.
TAKEN = 1024
#: Columns of a set's sketch of 64 bits each: bit h is set if one of its hashes begins so.
SKETCH = [f"sketch_{k}" for k in range(16)]
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()  # of bytes, as in simhash
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n, found = max(1, len(words) - shingle + 1), np.uint64(0)
    for k in range(min(shingle, len(words))):
        found = mixed(found + hashes[k : k + n])
    return np.unique(found)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; sets without shingles share all keys."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), TAKEN):
        np.minimum(least, (hashes[None, i : i + TAKEN] * factors).min(axis=1), out=least)
    found = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        found = mixed(found * _P + row)
    return found


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """Rows (row, id, digest, size, fp, keys) of rows (row, id, text); fp is the SimHash fingerprint."""
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("digest long, size long, fp long, keys array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            digests, sizes, prints, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingles(text, shingle)
                prints.append(fingerprint(text))
                digests.append(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes).view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "digest", "size", "fp", "keys"])

    return rows.mapInArrow(run, schema)


def sketch(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * len(SKETCH), np.uint8)
    bits[(hashes >> np.uint64(54)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, hashes, sketch) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [shingles(text.as_py(), shingle) for text in batch.column(1)]
            bits = np.array([sketch(h) for h in found], np.int64).reshape(-1, len(SKETCH))
            columns = [batch.column(0), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(bits.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "hashes", *SKETCH])

    return rows.mapInArrow(run, "node long, hashes array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


def fits(a: str, b: str, similarity: float) -> Column:
    """Sets of so different sizes cannot be similar enough."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets' Jaccard similarity is high enough."""
    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias("of_" + k)) for k in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    return pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where(both >= similarity * (F.size("of_u") + F.size("of_v") - both) - 1e-9).select("u", "v")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, root) once the links (u, v) are added; what is joined already goes in as stars, which take few rounds.

    Without links these are ``roots`` themselves: no round is planned on the driver.
    """
    if links.isEmpty():
        return roots
    return components(links.select("u", "v").unionByName(roots.select(F.col("root").alias("u"), F.col("node").alias("v"))))


def split_keys(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, node, size, root) of the keys whose members are in several components."""
    rooted = materialise(met.select("key", "node", "size").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rooted.join(split.hint("merge"), "key", "left_semi")


def apart(met: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (key, node, size, root, sketch) of the keys whose members are in several components."""
    return materialise(split_keys(met, roots).join(sets.select("node", *SKETCH).hint("merge"), "node"))


def crossing(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of one key and different components that may be similar enough by their sizes and sketches."""
    u, v = (df.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "size", *SKETCH))) for df, k in ((left, "u"), (right, "v")))

    def shared(a: str, b: str) -> Column:
        """How many shingles of the one the other may have."""
        lacks = [F.bit_count(F.col(f"{c}_{a}").bitwiseAND(F.bitwise_not(f"{c}_{b}"))) for c in SKETCH]
        return F.col(f"size_{a}") - sum(lacks[1:], lacks[0])

    enough = similarity * (F.col("size_u") + F.col("size_v")) - 1e-9
    near = [(1 + similarity) * shared(a, b) >= enough for a, b in ("uv", "vu")]
    met = u.join(v.hint("merge"), (u["key"] == v["key"]) & (F.col("root_u") != F.col("root_v")) & fits("size_u", "size_v", similarity) & near[0] & near[1])
    return met.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: the row of least id stays (nulls last).

    Near duplicates are met by SimHash, then by bands, and are linked by a Jaccard similarity of at least ``similarity`` (0.8 or more, for
    which the bands are made) of their sets of ``shingle`` words, and by chains of such links. Rows
    are told apart by their place in the input, not by their id. ``docs`` has to be a table that
    reads the same each time, such as a written one. Texts without words, null ones too, are copies
    of each other; of repeated rows one stays; an empty table gives no rows.
    """
    place = "_row"
    while place in docs.columns:
        place += "_"
    numbered = docs.withColumn(place, F.monotonically_increasing_id())
    rows = numbered.select(F.col(place).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialise(signatures(rows, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("first")
    classes = materialise(signed.groupBy("digest", "size").agg(F.min("row").alias("node"), first))
    own = signed.join(classes.select("node").hint("merge"), F.col("row") == F.col("node"), "left_semi")
    groups = grouped(materialise(own.select(F.col("row").alias("doc_id"), "fp")))
    near = materialise(groups.where("component_id < doc_id").select(F.col("component_id").alias("u"), F.col("doc_id").alias("v")))
    keyed = own.select(F.col("row").alias("node"), "size", F.explode("keys").alias("key"))
    many = materialise(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"))
    met = materialise(keyed.join(many.hint("merge"), "key"))
    nodes = met.select("node").union(near.select("u")).union(near.select("v")).distinct()
    sets = materialise(shingle_sets(rows.join(nodes.hint("merge"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "text"), shingle))

    # Each class meets the least of its group only, so these links are stars.
    roots = materialise(verified(near, sets, similarity).select(F.col("v").alias("node"), F.col("u").alias("root")))
    met = materialise(split_keys(met, roots))
    heads = met.groupBy("key").agg(F.min(F.struct("node", "size", "root")).alias("head"))
    heads = materialise(heads.select("key", *(F.col(f"head.{c}").alias(f"head_{c}") for c in ("node", "size", "root"))))
    with_head = met.join(heads.hint("merge"), "key").where((F.col("root") != F.col("head_root")) & fits("size", "head_size", similarity))
    fresh = with_head.select(F.col("head_node").alias("u"), F.col("node").alias("v")).distinct()
    fresh = materialise(fresh.join(near.hint("merge"), ["u", "v"], "left_anti"))
    roots, tried = joined(roots, materialise(verified(fresh, sets, similarity))), near.unionByName(fresh)
    members = apart(met, roots, sets)
    often = members.join(members.groupBy("key").agg(F.count("*").alias("n")).hint("merge"), "key").groupBy("node").agg(F.sum("n").alias("n"))
    # Members met about equally often take turns, so that a member's keys show it different ones.
    turn = F.struct(-F.floor(4 * F.log2("n")), F.xxhash64("key", "node"))
    middle = members.join(often.hint("merge"), "node").groupBy("key").agg(F.min_by("node", turn).alias("node")).join(members.hint("merge"), ["key", "node"])
    stars = crossing(middle, members, similarity).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    stars = materialise(stars.distinct().join(tried.hint("merge"), ["u", "v"], "left_anti"))
    before, tried = roots, tried.unionByName(stars)
    roots = joined(roots, materialise(verified(stars, sets, similarity)))
    members = members if roots is before else apart(met, roots, sets)
    rest = crossing(members, members, similarity).where("u < v")
    rest = materialise(rest.distinct().join(tried.hint("merge"), ["u", "v"], "left_anti"))
    roots = joined(roots, materialise(verified(rest, sets, similarity)))

    placed = classes.join(roots.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return numbered.join(placed.select(F.col("first.row").alias(place)).hint("merge"), place, "left_semi").select(*docs.columns)
