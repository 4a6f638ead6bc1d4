"""Verified archives as a Spark data source: one task an archive, streamed in constant memory."""

from __future__ import annotations

import gzip
import hashlib
import json
import tarfile
from collections.abc import Iterator, Mapping
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Limits of an archive.
MAX_LINE_BYTES = 64 << 10
MAX_COMPRESSED_BYTES = 512 << 20
MAX_EXPANDED_BYTES = 8 << 30
MAX_MEMBERS = 1000
CHUNK = 1 << 20
BATCH_ROWS = 4096
COLUMNS = "archive string, member string, line_no long, value string"


class _Archive(InputPartition):
    def __init__(self, path: str, sha256: str):
        self.path, self.sha256 = path, sha256


class VerifiedTar(DataSource):
    """tar.gz archives of JSON lines; options: archives (JSON object of path to SHA-256) and the limits."""

    @classmethod
    def name(cls) -> str:
        return "verified_tar"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        number = lambda name, default: int(options.get(name, default))
        self.archives = json.loads(options["archives"])
        self.most_compressed, self.most_expanded = number("most_compressed", MAX_COMPRESSED_BYTES), number("most_expanded", MAX_EXPANDED_BYTES)
        self.most_members, self.most_line = number("most_members", MAX_MEMBERS), number("most_line", MAX_LINE_BYTES)
        self.most_rows = number("most_rows", 0) or None
        if min(self.most_compressed, self.most_expanded, self.most_members, self.most_line) < 1 or (self.most_rows or 1) < 1:
            raise ValueError("limits must be positive")
        for path, digest in self.archives.items():
            if len(digest) != 64 or set(digest.lower()) - set("0123456789abcdef"):
                raise ValueError(f"no SHA-256 hex digest for {path}")

    def partitions(self) -> list[InputPartition]:
        return [_Archive(path, digest.lower()) for path, digest in self.archives.items()]

    def read(self, part: _Archive) -> Iterator[pa.RecordBatch]:
        files, inner = fs.FileSystem.from_uri(part.path) if "://" in part.path or part.path.startswith("file:") else (fs.LocalFileSystem(), part.path)
        self._verify(files, inner, part)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        rows: list[tuple[str, str, int, str]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=names)
        try:
            for row in self._rows(files, inner, part.path):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield pack()
                    rows.clear()
        except (tarfile.TarError, gzip.BadGzipFile, EOFError) as error:
            raise ValueError(f"{part.path} is incomplete or unreadable") from error
        if rows:
            yield pack()

    def _verify(self, files: fs.FileSystem, inner: str, part: _Archive) -> None:
        info = files.get_file_info(inner)
        if info.type != fs.FileType.File or not 0 < info.size <= self.most_compressed:
            raise ValueError(f"{part.path} is no file of 1 to {self.most_compressed} bytes")
        digest = hashlib.sha256()
        with files.open_input_stream(inner, compression=None, buffer_size=CHUNK) as raw:
            while chunk := raw.read(CHUNK):
                digest.update(chunk)
        if digest.hexdigest() != part.sha256:
            raise ValueError(f"{part.path} has another SHA-256")

    def _rows(self, files: fs.FileSystem, inner: str, path: str) -> Iterator[tuple[str, str, int, str]]:
        """Lines of the regular members, at most most_rows of an archive; the rest is read to its end all the same."""
        seen: set[str] = set()
        declared = given = regular = 0
        with files.open_input_stream(inner, compression=None, buffer_size=CHUNK) as raw, gzip.GzipFile(fileobj=raw) as plain:
            with tarfile.open(fileobj=plain, mode="r|") as archive:
                for member in archive:
                    archive.members = []  # a streamed archive keeps every header otherwise
                    self._admit(member, seen, path)
                    if member.isdir():
                        continue
                    regular += 1
                    declared += member.size
                    if declared > self.most_expanded:
                        raise ValueError(f"{path} exceeds the expanded size limit")
                    stream, no = archive.extractfile(member), 0
                    while (self.most_rows is None or given < self.most_rows) and (line := stream.readline(self.most_line + 1)):
                        yield path, member.name, no, self._record(line, path)
                        no, given = no + 1, given + 1
            while plain.read(CHUNK):
                if plain.tell() > self.most_expanded + self.most_members * 1024:
                    raise ValueError(f"{path} exceeds the expanded size limit")
        if not regular or not given:
            raise ValueError(f"{path} has no readable JSON records")

    def _admit(self, member: tarfile.TarInfo, seen: set[str], path: str) -> None:
        name = PurePosixPath(member.name)
        if len(seen) >= self.most_members or name.is_absolute() or ".." in name.parts or "\\" in member.name or member.name in seen:
            raise ValueError(f"{path} has unsafe, repeated or too many members")
        seen.add(member.name)
        if not member.isdir() and not member.isfile():
            raise ValueError(f"{path} has a member that is neither file nor folder")

    def _record(self, line: bytes, path: str) -> str:
        if len(line) > self.most_line:
            raise ValueError(f"{path} has a line above the limit")
        if not line.endswith(b"\n"):
            raise ValueError(f"{path} has an incomplete last line")
        try:
            text = line.decode()
            if not isinstance(json.loads(text), dict):
                raise ValueError(f"{path} has a line that is no object")
        except (UnicodeDecodeError, json.JSONDecodeError) as error:
            raise ValueError(f"{path} has a line that is no JSON") from error
        return text.rstrip("\r\n")


def verified_archives(spark: SparkSession, archives: Mapping[str, str], **limits: int) -> DataFrame:
    """(archive, member, line_no, value): the lines of tar.gz archives whose SHA-256 is the one given for their path.

    Each archive is one task: hashed first, then streamed member by member; memory holds a batch of lines whatever the archive's size.  It fails on another hash,
    unsafe or repeated member names, members that are no files, lines that are no whole JSON objects, and sizes above the limits (most_compressed, most_expanded,
    most_members, most_line).  most_rows, unset by default, ends an archive's rows early; the archive is still read and judged to its end.  Members without
    lines give no rows; an archive without any fails, no archives give an empty table.  Paths may be local or URIs that pyarrow opens."""
    spark.dataSource.register(VerifiedTar)
    options = {"archives": json.dumps(dict(archives)), **{k: str(v) for k, v in limits.items()}}
    if not archives:
        return spark.createDataFrame([], COLUMNS)
    return spark.read.format("verified_tar").options(**options).load()
