"""Members of ZIP archives as rows: partitions come from the archive's directory, and each task reads its members' bytes alone."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zipfile
import zlib
from codecs import getincrementaldecoder
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: a local header's signature and length, and where in it the lengths of name and extra field stand.
SIGNATURE, HEADER, LENGTHS = b"PK\x03\x04", 30, 26
CHUNK = 1 << 20
#: Schemes that Spark and Arrow call differently.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def placed(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; ValueError for schemes that Arrow has not."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + ":" + rest)
    except (ValueError, NotImplementedError, OSError) as why:  # not known, not built in, or without its library
        raise ValueError(f"{path}: no such file system here") from why


def name_of(info: zipfile.ZipInfo) -> str:
    """A member's name in composed form; names that lack the flag for UTF-8 are decoded as such where they can be."""
    name = info.filename
    if not info.flag_bits & 0x800:
        try:
            name = name.encode("cp437").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", name)


@dataclass
class Member(InputPartition):
    """Where a member stands in its archive."""

    path: str
    name: str
    at: int
    packed: int
    size: int
    crc: int
    deflated: bool


def _unpacked(member: Member) -> Iterator[bytes]:
    """A member's content in pieces of at most CHUNK bytes, read as they are wanted; OSError if it isn't what the directory says."""
    system, path = placed(member.path)
    with system.open_input_file(path) as source:
        source.seek(member.at)
        head = source.read(HEADER)
        if not head.startswith(SIGNATURE):
            raise OSError(f"{member.path}: no member at {member.at}")
        source.seek(member.at + HEADER + sum(struct.unpack_from("<HH", head, LENGTHS)))
        left, crc, size, unpack = member.packed, 0, 0, zlib.decompressobj(-zlib.MAX_WBITS)
        rest = b""
        while left or rest:
            if not rest:
                rest = source.read(min(CHUNK, left))
                if not rest:
                    break
                left -= len(rest)
            if member.deflated:
                piece = unpack.decompress(rest, CHUNK)
                rest = unpack.unconsumed_tail
            else:
                piece, rest = rest, b""
            crc, size = zlib.crc32(piece, crc), size + len(piece)
            yield piece
        if member.deflated:
            piece = unpack.flush()
            crc, size = zlib.crc32(piece, crc), size + len(piece)
            yield piece
    if (size, crc) != (member.size, member.crc):
        raise OSError(f"{member.path}: {member.name} is damaged")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.pattern, self.lines = json.loads(options["paths"]), options.get("member", ""), options.get("lines", "false") == "true"

    def partitions(self) -> list[Member]:
        """A partition a member that the pattern finds; only the directories at the ends of the archives are read."""
        out = []
        for path in self.paths:
            system, inside = placed(path)
            with system.open_input_file(inside) as source, zipfile.ZipFile(source) as archive:
                for info in archive.infolist():
                    name = name_of(info)
                    if info.is_dir() or not re.search(self.pattern, name):
                        continue
                    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        raise ValueError(f"{path}: {name} is encrypted or packed in a way other than deflate")
                    out.append(Member(path, name, info.header_offset, info.compress_size, info.file_size, info.CRC, info.compress_type == zipfile.ZIP_DEFLATED))
        return out

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if not isinstance(partition, Member):  # without members Spark asks for one partition of nothing
            return
        decode = getincrementaldecoder("utf-8-sig")().decode
        if not self.lines:
            text = "".join(decode(piece) for piece in _unpacked(partition)) + decode(b"", final=True)
            yield (partition.path, partition.name, text)
            return
        number, rest = 0, ""
        for piece in _unpacked(partition):
            *whole, rest = (rest + decode(piece)).split("\n")
            for line in whole:
                yield (partition.path, partition.name, number, line.removesuffix("\r"))
                number += 1
        if rest := rest + decode(b"", final=True):
            yield (partition.path, partition.name, number, rest.removesuffix("\r"))


class ZipMembers(DataSource):
    """Options: paths (a JSON list), member (a regular expression of names; all by default), lines (true: a row a line, in bounded memory)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, line_number long, line string" if self.options.get("lines", "false") == "true" else "archive string, name string, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def members(spark: SparkSession, paths: list[str], member: str = "", lines: bool = False) -> DataFrame:
    """(archive, name, text) of the UTF-8 members whose name the pattern finds, or (archive, name, line_number, line); as many tasks as members.

    A text is one value and so below 2 GB; lines have no such bound but for each line. An archive without such members gives no rows.
    """
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("paths", json.dumps(paths)).option("member", member).option("lines", str(lines).lower()).load()
