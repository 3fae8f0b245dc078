"""Token ids in Simple-8b blocks: writing a sorted corpus and reading it back.

A 64-bit word holds a 4-bit selector and 60 bits of payload, which the selector deals out to
60 ids of one bit, 30 of two, and so on to one id of 60 bits. An id that no payload can hold is
an escape: zero stands in its place and (place, value) goes to the block's escape list. A block
holds whole documents; its row has their ids and counts, so that any block decodes by itself,
with whole-array operations. The dataset is a Parquet table of such rows in the folder given,
written by range partitions in ascending document order.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import scratch_path

#: Bits an id for selectors 1 to 14; a word of b bits each holds 60 // b ids. Selector 0 is not used.
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
COUNTS = np.array([0, *(60 // BITS[1:])], np.int64)
ESCAPE = 1 << 60
BLOCK_IDS = 65_536
#: Chunks, and words, that a worker keeps in each of two generations: the older one goes when the newer is full.
KEPT_CHUNKS = 300_000
#: Bytes of texts that are encoded together.
SLICE_BYTES = 4_000_000

BLOCK_SCHEMA = "part int, block int, before long, doc_ids array<long>, counts array<long>, n_ids long, words binary, escape_at array<long>, escapes array<long>"

_tokenizers: dict[str, ChunkTokenizer] = {}


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the places and values of escapes, of non-negative 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    at = np.flatnonzero(ids >= ESCAPE)
    escapes = ids[at].astype(np.int64)
    if len(at):
        ids = ids.copy()
        ids[at] = 0
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), at, escapes
    # The narrowest selector that holds each id, then for each place the one with most ids from there on.
    need = np.searchsorted(BITS[1:], np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(np.int64)).astype(np.int8) + 1
    need = np.where((ids >> BITS[need].astype(np.uint64)) > 0, need + 1, need).astype(np.int8)  # where the logarithm was rounded
    best = np.full(n, 14, np.int8)
    widest, reach = need, 1  # widest[i]: the largest need among the next ``reach`` ids; past the end nothing is needed
    for selector in range(13, 0, -1):
        while reach < COUNTS[selector]:
            step = min(reach, int(COUNTS[selector]) - reach)
            ahead = np.ones(n, np.int8)
            ahead[: max(0, n - step)] = widest[step:]
            widest, reach = np.maximum(widest, ahead), reach + step
        best[widest <= selector] = selector
    jump = (np.arange(n) + COUNTS[best]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = jump[i]
    starts = np.array(starts, np.int64)
    chosen = best[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        mine, bits, count = np.flatnonzero(chosen == selector), BITS[selector], COUNTS[selector]
        places = starts[mine][:, None] + np.arange(count)
        values = np.where(places < n, ids[np.minimum(places, n - 1)], np.uint64(0))
        words[mine] |= np.bitwise_or.reduce(values << (np.arange(count) * bits).astype(np.uint64), axis=1)
    return words, at, escapes


def unpack(words: np.ndarray, n: int, escape_at: np.ndarray | None = None, escapes: np.ndarray | None = None) -> np.ndarray:
    """The first ``n`` ids that the words hold."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    word = np.repeat(np.arange(len(words)), counts)
    place = np.arange(len(word)) - np.repeat(ends - counts, counts)
    bits = BITS[selectors][word]
    masks = (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)
    ids = ((words[word] >> (place * bits).astype(np.uint64)) & masks)[:n]
    if escape_at is not None and len(escape_at):
        ids[np.asarray(escape_at)] = np.asarray(escapes, np.uint64)
    return ids


class Kept(dict):
    """A table that makes what it lacks, in two generations: the older one goes when the newer is full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if (found := self.older.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class ChunkTokenizer:
    """Ids of texts from the library, which sees each word once.

    The tokenizer drops white space and merges nothing across it, so a text's ids are those of
    its chunks in order. Cuts are at spaces and newlines only; any other white space stays inside
    a chunk for the library to deal with. A new chunk of plain western characters is lower-cased
    and cut by the tokenizer's own pattern here, and the library's model gets the new words; the
    library gets any other chunk as it is. A tokenizer with other rules gets every text whole.
    """

    #: Nothing here changes under NFC, has an unusual lower case or starts a special token.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    # The rules of the tokenizer file that the two patterns restate.
    NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORD_END = "</w>"

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = self.follows(json.loads(self.tokenizer.to_str()))
        self.chunks, self.words = Kept(self.chunk, kept), Kept(self.word, kept)
        # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        self.byte_char = [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]

    @classmethod
    def follows(cls, rules: dict) -> bool:
        """Whether a tokenizer file has the rules that this class restates."""
        cut, model = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [], rules["model"]
        return (
            (rules.get("normalizer") or {}).get("normalizers") == cls.NORMALISERS
            and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
            and cut[0].get("pattern") == {"Regex": cls.PATTERN}
            and (cut[0].get("behavior"), cut[0].get("invert")) == ("Removed", True)
            and (cut[1].get("add_prefix_space"), cut[1].get("use_regex")) == (False, False)
            and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout"), model.get("ignore_merges")) == ("BPE", cls.WORD_END, None, False)
            and all(t["content"].startswith("<|") for t in rules.get("added_tokens") or [])
        )

    def word(self, word: str) -> bytes:
        level = word if word.isascii() else "".join([self.byte_char[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(level)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk.lower()]
        if self.PLAIN.fullmatch(chunk) and "<|" not in chunk:
            words = self.words
            return b"".join([words[w] for w in self.WORDS.findall(chunk.lower())])
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and how many each text has; null texts have none.

        Arrow cuts the texts and numbers the distinct chunks, so Python sees each of these once.
        """
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        chunk, chunks = coded.indices.to_numpy(), self.chunks
        known = [chunks[c] for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size = np.array([len(k) for k in known], np.int64) // 4
        data, many = np.frombuffer(b"".join(known), "<u4"), size[chunk]
        shift = (np.cumsum(size) - size)[chunk] - (np.cumsum(many) - many)
        ids = data[np.arange(many.sum()) + np.repeat(shift, many)]
        upto = np.concatenate([[0], np.cumsum(many)])
        return ids, np.diff(upto[np.cumsum([0, *pc.list_value_length(cut).to_pylist()])])

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts come to SLICE_BYTES at most, or of one longer text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        stop = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(i, stop - i)
        i = stop


def write_tokens(docs: DataFrame, path: str, model: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id`` to each, and write the blocks in ascending id order.

    Null text counts as empty and has the end id only. Rows with a null id come first; rows of
    equal id follow one another by the text's checksum. The range partitioning also spreads an
    id that many rows share. An empty table makes an empty dataset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(public_tokenizers.path(model))
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, held, gathered = [], [], 0

        def full() -> pa.RecordBatch:
            nonlocal block, before, ids, held, gathered
            words, at, escapes = pack(np.concatenate(held))
            row = {"part": part, "block": block, "before": before, "doc_ids": ids, "counts": [len(h) for h in held], "n_ids": gathered, "words": words.astype("<u8").tobytes(), "escape_at": at.tolist(), "escapes": escapes.tolist()}
            block, before, ids, held, gathered = block + 1, before + gathered, [], [], 0
            return pa.RecordBatch.from_pylist([row], arrow_schema)

        for batch in batches:
            for rows in row_slices(batch):
                found, counts = own.encode(rows.column(1))
                ended = np.split(np.insert(found, np.cumsum(counts), end_id), np.cumsum(counts + 1)[:-1])
                for doc_id, own_ids in zip(rows.column(0).to_pylist(), ended, strict=True):
                    ids.append(doc_id)
                    held.append(own_ids)
                    gathered += len(own_ids)
                    if gathered >= block_ids:
                        yield full()
        if ids:
            yield full()

    longs = pa.list_(pa.int64())
    arrow_schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", longs), ("counts", longs), ("n_ids", pa.int64()), ("words", pa.binary()), ("escape_at", longs), ("escapes", longs)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "crc", "tie"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def read_tokens(spark, path: str, keep_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of a dataset, decoded block by block.

    ``start`` counts the ids of all documents before the row's own: the totals of the parts, of
    which there are as many as partitions were written, are summed up on the driver, the rest is
    in the blocks. ``keep_ids=False`` leaves the ids themselves out.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    starts = dict(zip([t[0] for t in totals], accumulate((t[1] for t in totals), initial=0), strict=False))
    shared = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), row["n_ids"], row["escape_at"], row["escapes"])
                ends = np.cumsum(np.array(row["counts"], np.int64))
                begins = ends - row["counts"]
                data = memoryview(ids.astype("<u4").tobytes())
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins + shared.value[row["part"]] + row["before"], pa.int64()),
                    pa.array(row["counts"], pa.int64()),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def token_dataset(docs: DataFrame, path: str | None = None, **options) -> str:
    """Write the dataset, in the shared folder if no path is given, and return where it is."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return path
