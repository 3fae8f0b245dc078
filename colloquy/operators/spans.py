"""Entries of an answer's lists as they were written, by their places in its text.

Reading JSON into values and writing these again changes what a model said: numbers lose digits or
their ``.0``, keys change their order, some texts can't be written at all. So the text is scanned
for where each entry begins and ends, and the piece itself goes on.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text, a mark, or a number or word.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+')
#: What other readers of JSON refuse or alter: words for what is no number, numbers beyond all doubles, halves of pairs.
ODD = re.compile(r"NaN|Infinity|[eE]\+?\d{3}|\d{309}|\\u[dD][89a-fA-F]")
#: Characters of entries that are gathered before they are handed on; what an entry counts besides.
GATHERED, ENTRY_SIZE = 1 << 20, 64


def spans(text: str, keys: Collection[str]) -> dict[str, list[tuple[int, int]]]:
    """By key: where in a valid JSON object the entries of its list begin and end. Of equal keys the last counts."""
    found: dict[str, list[tuple[int, int]]] = {}
    depth, key, value, inside, start, end = 0, None, False, None, None, 0
    for m in TOKEN.finditer(text):
        mark = m[0] if len(m[0]) == 1 else ""
        if mark and mark in "]}":
            depth -= 1
            if depth == 1 and inside is not None:
                if start is not None:
                    inside.append((start, end))
                inside = None
        elif mark == ",":
            if depth == 1:
                value = False
            elif depth == 2 and inside is not None:
                inside.append((start, end))
                start = None
        elif mark == ":":
            value = value or depth == 1
        else:
            if depth == 1 and not value:
                key = json.loads(m[0])
            elif depth == 1:
                found.pop(key, None)  # what came before under this key counts no more
                if mark == "[" and key in keys:
                    inside, start = found.setdefault(key, []), None
            elif depth == 2 and inside is not None and start is None:
                start = m.start()
            depth += mark in ("[", "{") if mark else 0
        end = end if mark in (",", ":") and mark else m.end()
    return found


def indented(text: str, pad: str = "") -> str:
    """A JSON text on lines indented by two spaces; every number and text is left as it is."""
    out, depth, before = [], 0, ""
    for m in TOKEN.finditer(text):
        t = m[0]
        if t in ("]", "}"):
            depth -= 1
            if before not in ("[", "{"):
                out.append("\n" + pad + "  " * depth)
        elif before in ("[", "{", ","):
            out.append("\n" + pad + "  " * depth)
        out.append(": " if t == ":" else t)
        depth += t in ("[", "{")
        before = t
    return "".join(out)


def finite(value):
    """The value with null for what is no finite number."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, list):
        return [finite(v) for v in value]
    return {k: finite(v) for k, v in value.items()} if isinstance(value, dict) else value


def read_answer(text: str | None, keys: Collection[str]) -> tuple[str | None, list[tuple[str, int, str, str | None]]]:
    """(error, entries): entries as (list, place, text as written, plain text where a stricter reader needs one)."""
    odd = False

    def noticed(pairs: list[tuple]) -> dict:
        nonlocal odd
        found = dict(pairs)
        odd = odd or len(found) != len(pairs)
        return found

    try:
        value = json.loads(text or "", object_pairs_hook=noticed)
    except (ValueError, RecursionError):
        return "not_json", []
    if not isinstance(value, dict):
        return "not_object", []
    odd = odd or bool(ODD.search(text))
    out, found = [], spans(text, keys)
    for key in keys:
        for pos, (start, stop) in enumerate(found.get(key, [])):
            plain = json.dumps(finite(json.loads(text[start:stop]))) if odd else None
            out.append((key, pos, text[start:stop], plain))
    return None, out


def pieces(batches: Iterator[pa.RecordBatch], lists: Collection[str], n_keys: int) -> Iterator[pa.RecordBatch]:
    """``scanned`` of batches whose last column is the text; whatever the answers, few entries are held at a time."""
    names = ["list", "pos", "written", "plain"]
    told = pa.schema([("list", pa.string()), ("pos", pa.int32()), ("written", pa.string()), ("plain", pa.string())])
    for batch in batches:
        *own, texts = batch.columns
        columns = batch.schema.names[:-1]

        def handed_on(at: list[int], entries: list[tuple], own=own, columns=columns) -> pa.RecordBatch:
            keys = [c.take(pa.array(at, pa.int32())) for c in own[:n_keys]]
            rest = [pa.nulls(len(at), c.type) for c in own[n_keys:]]
            said = [pa.array(c, kind) for c, kind in zip(zip(*entries, strict=True), told.types, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, *rest, pa.nulls(len(at), pa.string()), *said], names=[*columns, "error", *names])

        errors, at, found, held = [], [], [], 0
        for i in range(batch.num_rows):
            error, entries = read_answer(texts[i].as_py(), lists)
            errors.append(error)
            for entry in entries:
                at.append(i)
                found.append(entry)
                held += ENTRY_SIZE + len(entry[2]) + len(entry[3] or "")
                if held >= GATHERED:
                    yield handed_on(at, found)
                    at, found, held = [], [], 0
        if at:
            yield handed_on(at, found)
        yield pa.RecordBatch.from_arrays([*own, pa.array(errors, pa.string()), *(pa.nulls(batch.num_rows, kind) for kind in told.types)], names=[*columns, "error", *names])
        del batch, own, texts, handed_on
        pa.default_memory_pool().release_unused()


def scanned(answers: DataFrame, text: Column, lists: Collection[str], keys: Collection[str], also: Collection[str] = ()) -> DataFrame:
    """Rows (keys, also, error, list, pos, written, plain): one for each answer, without a list, and one for each of its entries.

    Entries have only ``keys`` of the columns. They are handed on as they are found, so no row and no
    batch holds those of many answers; an answer, and what is read from it, has to fit into memory.
    """
    lists, keys, also = list(lists), list(keys), list(also)
    given = answers.select(*keys, *also, text.alias("_text"))
    fields = [T.StructField(f.name, f.dataType) for f in given.schema.fields[:-1]]
    schema = T.StructType([*fields, *T._parse_datatype_string("error string, list string, pos int, written string, plain string").fields])
    return given.mapInArrow(lambda batches: pieces(batches, lists, len(keys)), schema)


def written_entries(read: DataFrame, keys: Collection[str]) -> DataFrame:
    """Rows (keys, list, pos, entry, written) from ``scanned``: the entry as VARIANT, and as it was written."""
    plain = F.try_parse_json(F.coalesce("plain", "written"))
    return read.where(F.col("list").isNotNull()).select(*keys, "list", "pos", plain.alias("entry"), "written")
