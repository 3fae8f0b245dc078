"""Chat exports: a ZIP with one text file per customer, or a single text file."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "src string, fname string, customer_name string, txt string"
#: ``pathGlobFilter`` minds the case.
ZIP_GLOB, TEXT_GLOB = "*.[zZ][iI][pP]", "*.[tT][xX][tT]"


def members(content: bytes) -> list[tuple[str, str]]:
    """(name, text) of the top-level text files of an archive.

    Of members of one name the last counts, as if each had been unpacked over the one before.
    Names are cleaned as unpacking would: no drive, no root, no way up. Bytes that are no UTF-8
    are left out.
    """
    found: dict[str, str] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            parts = [p for p in os.path.splitdrive(info.filename)[1].replace("\\", "/").split("/") if p not in ("", ".", "..")]
            if len(parts) == 1 and parts[0].lower().endswith(".txt"):
                found[parts[0]] = archive.read(info).decode("utf-8", "ignore")
    return sorted(found.items())


def unzip(binary: DataFrame, also: str = "") -> DataFrame:
    """Rows (src, fname, customer_name, txt) for the text files of archives read as ``binaryFile``.

    Archives are opened in memory where they are read. One without text files gives no rows; one
    that is no archive raises. ``also`` names a column of the archive, with its type, to keep.
    """
    extra = also.split(" ")[:1] if also else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content, *more in zip(*(frame[c] for c in ["path", "content", *extra]), strict=True):
                rows = [(path, name, os.path.splitext(name)[0], text, *more) for name, text in members(bytes(content))]
                yield pd.DataFrame(rows, columns=["src", "fname", "customer_name", "txt", *extra])

    return binary.select("path", "content", *extra).mapInPandas(run, ", ".join([FILES, also] if also else [FILES]))


def decode_texts(binary: DataFrame) -> DataFrame:
    """One row for each text file read as ``binaryFile``; a single file names no customer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [bytes(c).decode("utf-8", "ignore") for c in frame["content"]]
            yield pd.DataFrame({"src": frame["path"], "fname": [os.path.basename(p) for p in frame["path"]], "customer_name": None, "txt": texts})

    return binary.select("path", "content").mapInPandas(run, FILES)


def is_zip(path: str) -> bool:
    return path.lower().endswith(".zip")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Files of one export; any path that doesn't end in ``.zip`` is taken for text."""
    binary = spark.read.format("binaryFile").load(path)
    return unzip(binary) if is_zip(path) else decode_texts(binary)


def read_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all archives under a folder, read in parallel."""
    return unzip(spark.read.format("binaryFile").option("pathGlobFilter", ZIP_GLOB).option("recursiveFileLookup", "true").load(folder))


def stem(fname):
    """File name without its extension, as a column; a leading dot starts no extension."""
    return F.regexp_replace(fname, r"(?s)^(\.*[^.].*)\.[^.]*\z", "$1")
