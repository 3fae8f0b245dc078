"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.shared import materialise, qualified, scratch_path

__all__ = ["hashed_span", "held_out", "materialise", "qualified", "read_table", "scratch_path", "small"]

#: Rows whose texts a worker has as strings, keys or ids at a time.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model may learn from; a null id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    fold = F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(5))
    return F.coalesce(fold == 0, F.lit(True))


def hashed_span(text: str, most_chars: int, key: str) -> Column:
    """The whole text, or of a longer one ``most_chars`` characters from a place that the key's hash gives."""
    places = F.greatest(F.lit(1), F.length(text) - most_chars + 1)
    return F.substring(F.col(text), (F.pmod(F.xxhash64(key, F.lit(1)), places) + 1).cast("int"), F.lit(most_chars))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS, which share the memory of the given ones.

    What Arrow keeps of earlier batches is given back, as a worker stays for later stages.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(i, BATCH_ROWS)
        del batch
        pa.default_memory_pool().release_unused()
