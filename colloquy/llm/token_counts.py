"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised.

A sentence-piece BPE encoding is fixed by its adjacent pairs: a token sequence is the encoding
of its text exactly if every pair of neighbours is the encoding of the pair's text. So when two
encodings of overlapping chunks hold one common token (same id, same place in the text), the
first encoding up to that token followed by the second one from it on has only proven pairs,
and is the encoding of both chunks' union. A chunk pair without a common token in its overlap
is tried again with twice the overlap, up to the whole chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
SPACE = "▁"

_counters: dict[tuple, TokenCounter] = {}


class TokenCounter:
    """Counts with one model file; ``chunk`` and ``overlap`` are in characters."""

    def __init__(self, model: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        size = self.sp.vocab_size()
        #: Bytes of normalised text that each id stands for.
        self.width = np.array([1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(size)], np.int64)

    def count(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        small = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, ids in zip(small, self.sp.encode([texts[i] for i in small], num_threads=1), strict=True):
            counts[i] = len(ids)
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                counts[i] = sum(map(len, self.pieces(text)))
        return counts

    def encoded(self, text: str, start: int, stop: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:stop] and where each begins; ``at``: normalised bytes before ``start``."""
        ids = np.array(self.sp.encode(text[start:stop]), np.int64)
        # The library puts a space before each text it gets; it lies just before ``at``.
        ends = at - len(SPACE.encode()) + np.cumsum(self.width[ids])
        return ids, ends - self.width[ids]

    def begin(self, text: str, at: int, lowest: int) -> int:
        """A chunk start near ``at``, after a space if there is one within the overlap."""
        found = text.rfind(" ", max(lowest, at - self.overlap), at)
        return found + 1 if found >= 0 else at

    def pieces(self, text: str) -> list[np.ndarray]:
        """The ids of the whole text, in arrays that follow one another."""
        wide = len(SPACE.encode())
        size = lambda a, b: len(text[a:b].encode()) + (wide - 1) * text.count(" ", a, b)
        done, start, stop, at = [], 0, min(len(text), self.chunk), wide
        ids, places = self.encoded(text, start, stop, at)
        while stop < len(text):
            overlap, following = self.overlap, min(len(text), stop + self.chunk)
            while True:
                after = self.begin(text, stop - overlap, start) if stop - overlap > start else start
                then = at + size(start, after)
                new_ids, new_places = self.encoded(text, after, following, then)
                if after == 0:  # nothing has been spliced yet, and the new chunk holds the old one
                    ids, places = new_ids, new_places
                    break
                common, i, j = np.intersect1d(places, new_places, assume_unique=True, return_indices=True)
                # The first token may hold the space that the library put before the chunk.
                same = np.flatnonzero((ids[i] == new_ids[j]) & (common >= then))
                if len(same):
                    pick = same[len(same) // 2]
                    done.append(ids[: i[pick]])
                    ids, places, start, at = new_ids[j[pick] :], new_places[j[pick] :], after, then
                    break
                if after == start:  # no place of agreement at all: the text can't be cut here
                    return [np.array(self.sp.encode(text), np.int64)]
                overlap *= 2
                self.widened += 1
            stop = following
        return [*done, ids]


def counter(model: str, chunk: int, overlap: int) -> TokenCounter:
    if (key := (model, chunk, overlap)) not in _counters:
        _counters[key] = TokenCounter(*key)
    return _counters[key]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of ``docs``.

    ``model`` names a sentence-piece file known to ``public_tokenizers``, looked up where the
    task runs. Null and empty texts have no bytes and no tokens. A map-only job: each row stands
    for itself, so repeated rows and null ids need no care. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(public_tokenizers.path(model), chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = own.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
