"""One text file written by many tasks.

A document is a table of pieces in a stated order. Pieces are range partitioned by that order; the
partitions' sizes in bytes, summed up from the front, and the sizes inside each give every piece its
place in the file. Then any task can write any piece, in any order and as often as need be, and no
piece passes through the driver. The file appears under its name when all of it is there.

Places in a file can be written on local and mounted folders. Elsewhere the pieces are written in
order by one task, still a stream.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from colloquy.operators.messages import MESSAGE
from colloquy.operators.spans import indented
from colloquy.sources.shared import materialise, qualified

NAME = "one_file"
PLACED = "at long, bytes binary"


@dataclass
class Written(WriterCommitMessage):
    bytes: int


class PlaceWriter(DataSourceArrowWriter):
    """Writes rows (at, bytes) to their places in a file of known size, then gives it its name."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.size, self.run = options["uri"], int(options["size"]), options["run"]
        self.fs, self.path = pafs.FileSystem.from_uri(self.uri)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self.temporary = os.path.join(os.path.dirname(self.path), f".{os.path.basename(self.path)}.{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        total, out = 0, None
        try:
            for batch in iterator:
                if out is None:
                    out = open(os.open(self.temporary, os.O_WRONLY | os.O_CREAT), "wb") if self.local else self.fs.open_output_stream(self.temporary)
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if self.local:
                        out.seek(at)
                    elif at != total:
                        raise ValueError("this store takes pieces in order only")
                    total += out.write(data)
        finally:
            if out is not None:
                out.close()
        return Written(total)

    def commit(self, messages: list[Written | None]) -> None:
        total = sum(m.bytes for m in messages if m)
        if total != self.size:
            raise ValueError(f"{total} bytes were written, not {self.size}")
        self.fs.move(self.temporary, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if self.fs.get_file_info(self.temporary).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.temporary)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PLACED

    def writer(self, schema, overwrite: bool) -> PlaceWriter:
        return PlaceWriter(dict(self.options))


def placed(pieces: DataFrame, order: Sequence[Column | str], text: str = "text") -> tuple[DataFrame, int]:
    """(rows (at, bytes), size of all) of pieces of text in their order; ties may come either way."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = materialise(ranged.select(F.col(text).cast("binary").alias("bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    size = F.octet_length("bytes")
    sizes = kept.groupBy("part").agg(F.sum(size).alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = materialise(sizes.select("part", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.withColumn("before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    found = before.join(starts, "part").select((F.col("start") + F.col("before")).cast("long").alias("at"), "bytes")
    return found, starts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def write_text(pieces: DataFrame, order: Sequence[Column | str], path: str, text: str = "text") -> int:
    """Write the pieces' texts one after the other as one UTF-8 file; returns its size in bytes."""
    spark = pieces.sparkSession
    spark.dataSource.register(OneFile)
    uri = qualified(spark, path)
    fs, where = pafs.FileSystem.from_uri(uri)
    local = isinstance(fs, pafs.LocalFileSystem)
    found, size = placed(pieces, order, text)
    if not size:
        with fs.open_output_stream(where):
            return 0
    found = found if local else found.orderBy("at").coalesce(1)
    found.write.format(NAME).mode("append").option("uri", uri).option("size", str(size)).option("run", uuid.uuid4().hex).save()
    return size


def document_of_customers(per_customer: DataFrame, nested: bool = True) -> DataFrame:
    """Pieces (place, src, fname, text) of the parsed document: customers in order of file name, or their messages alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for customer, messages in zip(batch.column("customer_name").to_pylist(), batch.column("messages").to_pylist(), strict=True):
                documents = [{"customer_name": customer, "messages": messages}] if nested else [{k: m[k] for k in MESSAGE} for m in messages]
                lines = (json.dumps(d, indent=2, ensure_ascii=False).replace("\n", "\n  ") for d in documents)
                texts.append("".join(",\n  " + t for t in lines))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("fname"), pa.array(texts, pa.string())], names=["src", "fname", "text"])

    found = per_customer.select("src", "fname", "customer_name", "messages").mapInArrow(run, "src string, fname string, text string")
    return found.where("text <> ''").select(F.lit(1).alias("place"), "src", "fname", "text")


def write_parsed_document(per_customer: DataFrame, path: str, nested: bool = True) -> int:
    """The parsed document as one file, by many tasks; the same bytes as ``write_parsed``. Returns how many."""
    spark = per_customer.sparkSession
    pieces = materialise(document_of_customers(per_customer, nested))
    # Every piece begins with a comma; the first one's place is taken by the bracket that opens the document.
    first = pieces.orderBy("src", "fname").select("src", "fname").first()
    if first is None:
        return write_text(spark.createDataFrame([(0, "[]")], "place int, text string"), ["place"], path)
    mine = F.col("src").eqNullSafe(F.lit(first["src"])) & F.col("fname").eqNullSafe(F.lit(first["fname"]))
    opened = pieces.withColumn("text", F.when(mine, F.concat(F.lit("["), F.substring("text", 2, 2**31 - 1))).otherwise(F.col("text")))
    end = spark.createDataFrame([(2, "", "", "\n]")], opened.schema)
    return write_text(opened.unionByName(end), ["place", "src", "fname"], path)


def write_insights_document(result, path: str) -> int:
    """The extraction's document as one file, by many tasks; the same bytes as ``write_insights``. Returns how many."""
    rows = materialise(result.rows())
    spark, names = rows.sparkSession, result.profile.keys
    # A list's place among the others, then: its head, its entries in order, its end.
    number = F.array_position(F.lit(names), F.col("list")).cast("int") - 1

    @F.pandas_udf("string")
    def laid_out(entries):
        return entries.map(lambda e: "\n    " + indented(e, "    "))

    entries = rows.select(number.alias("list"), F.col("position").cast("long").alias("position"), F.concat(F.when(F.col("position") > 0, ",").otherwise(""), laid_out("entry")).alias("text"))
    filled = {r["list"] for r in rows.select("list").distinct().collect()}  # of the profile's few names
    meta = json.dumps(result.meta(), indent=2, ensure_ascii=False).replace("\n", "\n  ")
    frame = [(-1, -1, "{"), (len(names), 0, '\n  "_meta": ' + meta + "\n}")]
    for i, name in enumerate(names):
        frame += [(i, -1, f"\n  {json.dumps(name)}: ["), (i, 2**62, "\n  ]," if name in filled else "],")]
    return write_text(entries.unionByName(spark.createDataFrame(frame, "list int, position long, text string")), ["list", "position"], path)
