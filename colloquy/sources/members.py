"""Archives read member by member, each as a stream of lines.

A data source whose partitions are members of archives: small archives by the bundle, the members
of larger ones by what their central directories say. A member is inflated as it is read and never
held, so its size has no bound; a line has to fit into a row. Nothing that is wrong with one
archive or member ends the job: it is told in a row of its own, as are bytes that are no UTF-8.
"""

from __future__ import annotations

import codecs
import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colloquy.operators.messages import KEYS
from colloquy.sources.shared import materialise, qualified

NAME = "chat_members"
#: ``n`` is null in rows that tell a problem; ``lost`` says that what it is about is left out.
SCHEMA = "src string, fname string, customer_name string, n long, raw string, problem string, lost boolean, dropped long"
#: Bytes of archives, or of compressed members, that one task reads; archives up to WHOLE are not looked into beforehand.
TASK_BYTES, WHOLE = 16 << 20, 1 << 20
#: Members of one task at most; lines and characters of one batch.
TASK_MEMBERS, BATCH_LINES, BATCH_CHARS = 500, 8192, 4 << 20
#: Fixed values of the file format: a member's own header, and the flag of an encrypted one.
LOCAL_HEADER, ENCRYPTED = struct.Struct("<4s2B4HL2L2H"), 0x1


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int
    flags: int


@dataclass
class Part(InputPartition):
    """Whole archives (``members`` None), members of one, or a problem with one."""

    archives: list[tuple[str, list[Member] | None, str | None]]


def clean_name(name: str) -> str | None:
    """The file name of a top-level text member, as unpacking would write it: no drive, no root, no way up."""
    parts = [p for p in os.path.splitdrive(name)[1].replace("\\", "/").split("/") if p not in ("", ".", "..")]
    return parts[0] if len(parts) == 1 and parts[0].lower().endswith(".txt") else None


class Seekable:
    """A file as the archive reader expects it: places before its beginning are ``OSError``."""

    def __init__(self, content: pa.NativeFile):
        self.content, self.tell, self.read, self.close = content, content.tell, content.read, content.close

    def seek(self, offset: int, whence: int = 0) -> int:
        start = (0, self.content.tell() if whence == 1 else 0, self.content.size() if whence == 2 else 0)[whence]
        if start + offset < 0:
            raise OSError("a place before the file's beginning")
        return self.content.seek(start + offset)

    def seekable(self) -> bool:
        return True


def directory(content: io.RawIOBase) -> list[Member]:
    """Top-level text members in order of name; of members of one name the last counts."""
    found: dict[str, Member] = {}
    with zipfile.ZipFile(content) as archive:
        for i in archive.infolist():
            name = None if i.is_dir() else clean_name(i.filename)
            if name:
                found[name] = Member(name, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.flag_bits)
    return [found[name] for name in sorted(found)]


def inflated(content: io.RawIOBase, member: Member, step: int = 1 << 18) -> Iterator[bytes]:
    """A member's bytes; raises if it is damaged, encrypted or packed by another method."""
    if member.flags & ENCRYPTED:
        raise zipfile.BadZipFile("the member is encrypted")
    if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile(f"the member is packed by method {member.method}")
    content.seek(member.offset)
    header = content.read(LOCAL_HEADER.size)
    if len(header) < LOCAL_HEADER.size or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("the member's header is missing")
    *_, name, extra = LOCAL_HEADER.unpack(header)
    content.seek(member.offset + LOCAL_HEADER.size + name + extra)
    unpack = zlib.decompressobj(-zlib.MAX_WBITS) if member.method == zipfile.ZIP_DEFLATED else None
    left, size, crc = member.packed, 0, 0
    while left:
        packed = content.read(min(step, left))
        if not packed:
            raise zipfile.BadZipFile("the archive ends inside the member")
        left -= len(packed)
        while packed:
            data = unpack.decompress(packed, 4 * step) if unpack else packed
            packed = unpack.unconsumed_tail if unpack else b""
            size, crc = size + len(data), zlib.crc32(data, crc)
            yield data
    if size != member.size or crc != member.crc:
        raise zipfile.BadZipFile("the member's checksum is wrong")


class Dropping:
    """UTF-8 without the bytes that are none; counts them."""

    def __init__(self):
        self.dropped = 0
        codecs.register_error(f"colloquy-{id(self)}", self)
        self.decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")(f"colloquy-{id(self)}"), translate=True)

    def __call__(self, error: UnicodeError) -> tuple[str, int]:
        self.dropped += error.end - error.start
        return "", error.end


def lines_of(data: Iterator[bytes], counted: Dropping) -> Iterator[str]:
    """Lines that end at CR, LF or both; what follows the last end is one more, empty or not."""
    rest: list[str] = []
    for chunk in data:
        first, *more = counted.decoder.decode(chunk).split("\n")
        rest.append(first)
        if more:
            yield "".join(rest)
            yield from more[:-1]
            rest = [more[-1]]
    first, *more = (counted.decoder.decode(b"", final=True)).split("\n")
    yield from ["".join([*rest, first]), *more]


def batches(src: str, name: str, lines: Iterator[str]) -> Iterator[pa.RecordBatch]:
    held, chars, first = [], 0, 0
    for line in lines:
        held.append(line)
        chars += len(line)
        if len(held) >= BATCH_LINES or chars >= BATCH_CHARS:
            yield batch(src, name, first, held)
            held, chars, first = [], 0, first + len(held)
    if held:
        yield batch(src, name, first, held)


def batch(src: str, name: str | None, first: int, lines: list[str] | None, problem: str | None = None, lost: bool = False, dropped: int = 0) -> pa.RecordBatch:
    rows = len(lines) if lines is not None else 1
    stem = None if name is None else os.path.splitext(name)[0]
    columns = [[src] * rows, [name] * rows, [stem] * rows, [*range(first, first + rows)] if lines is not None else [None], lines if lines is not None else [None], [problem] * rows, [lost] * rows, [dropped] * rows]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.glob = options["uri"], options.get("suffix", ".zip").lower()
        self.task_bytes, self.whole = int(options.get("taskBytes", TASK_BYTES)), int(options.get("whole", WHOLE))

    def source(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def files(self) -> list[tuple[str, int]]:
        fs, base = self.source()
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        if info.type == pafs.FileType.File:
            return [(base, info.size)]
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        hidden = [f for f in found if any(p[:1] in ("_", ".") for p in f.path[len(base) :].split("/") if p)]
        return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(self.glob) and f not in hidden)

    def partitions(self) -> list[Part]:
        fs, _ = self.source()
        files = self.files()
        parts, held, total = [], [], 0
        for path, size in files:
            if size > self.whole:
                continue
            if held and total + size > self.task_bytes:
                parts.append(Part(held))
                held, total = [], 0
            held.append((path, None, None))
            total += size
        parts += [Part(held)] if held else []

        def looked_into(path: str) -> list[Part]:
            try:
                with fs.open_input_file(path) as content:
                    members = sorted(directory(Seekable(content)), key=lambda m: m.offset)
            except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                return [Part([(path, None, described(e))])]
            out, mine, packed = [], [], 0
            for m in members:
                if mine and (packed + m.packed > self.task_bytes or len(mine) >= TASK_MEMBERS):
                    out.append(Part([(path, mine, None)]))
                    mine, packed = [], 0
                mine.append(m)
                packed += m.packed
            return [*out, Part([(path, mine, None)])] if mine else out

        with ThreadPoolExecutor(16) as pool:
            parts += [p for found in pool.map(looked_into, [path for path, size in files if size > self.whole]) for p in found]
        return parts or [Part([])]  # without any, the reader would be called for a part that isn't there

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, base = self.source()
        for path, members, problem in partition.archives:
            src = self.told(fs, base, path)
            if problem:
                yield batch(src, None, 0, None, problem, True)
                continue
            try:
                with fs.open_input_file(path) as content:
                    for member in directory(Seekable(content)) if members is None else members:
                        yield from self.read_member(content, src, member)
            except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                yield batch(src, None, 0, None, described(e), True)

    def told(self, fs: pafs.FileSystem, base: str, path: str) -> str:
        """The path as Spark's own readers give it."""
        return f"file:{path}" if isinstance(fs, pafs.LocalFileSystem) else self.uri.rstrip("/") + path[len(base) :]

    def read_member(self, content: io.RawIOBase, src: str, member: Member) -> Iterator[pa.RecordBatch]:
        counted = Dropping()
        try:
            yield from batches(src, member.name, lines_of(inflated(content, member), counted))
        except (zipfile.BadZipFile, zlib.error, OSError) as e:
            yield batch(src, member.name, 0, None, described(e), True)
            return
        if counted.dropped:
            yield batch(src, member.name, 0, None, "bytes that are no UTF-8", False, counted.dropped)


def write_archives(files: DataFrame, path: str) -> None:
    """Transcript files (src, fname, customer_name, txt) as archives under a folder, one for each task that has any."""
    uri = qualified(files.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = archive = None
        for found in batches:
            for name, txt in zip(found.column("fname").to_pylist(), found.column("txt").to_pylist(), strict=True):
                if archive is None:
                    fs, base = pafs.FileSystem.from_uri(uri)
                    fs.create_dir(base, recursive=True)
                    # A task that is tried again writes the same file anew.
                    out = fs.open_output_stream(f"{base}/part-{TaskContext.get().partitionId():05d}.zip")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(name, txt or "")
        if archive is not None:
            archive.close()
            out.close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([archive is not None])})

    files.select("fname", "txt").mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def described(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


class MemberSource(DataSource):
    """``spark.read.format("chat_members").option("uri", ...)``: an archive, or a folder of them, as lines."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


@dataclass
class Transcripts:
    """``lines``: rows (src, fname, customer_name, n, raw). ``problems``: rows (src, fname, problem, lost, dropped).

    A problem without ``fname`` is about a whole archive. Members that are ``lost`` have no lines;
    others have all but the ``dropped`` bytes.
    """

    lines: DataFrame
    problems: DataFrame


def read_transcripts(spark: SparkSession, path: str, **options) -> Transcripts:
    """The text files of one archive, or of all under a folder; each is read once and written as lines.

    Empty archives have no rows; an empty text file has one empty line. Of members of one name the
    last counts. A damaged archive or member is told among the problems, and its lines are left out.
    """
    spark.dataSource.register(MemberSource)
    reader = spark.read.format(NAME).option("uri", qualified(spark, path))
    written = materialise(reader.options(**{k: str(v) for k, v in options.items()}).load())
    problems = written.where("n IS NULL").select("src", "fname", "problem", "lost", "dropped")
    lines = written.where("n IS NOT NULL").select(*KEYS, "n", "raw")
    lost = problems.where("lost AND fname IS NOT NULL").select("src", "fname")
    return Transcripts(lines if lost.isEmpty() else lines.join(lost, ["src", "fname"], "left_anti"), problems)
