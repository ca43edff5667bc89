"""Token ids in files of independent zstandard frames.

A file is a row of zstandard frames, then the seek table of the public seekable format: a skippable frame that holds each frame's
compressed size, size and checksum (the low half of its content's XXH64). The first frames hold documents' ids as little-endian
unsigned 32-bit integers, whole documents each; the last holds the document index. A reader takes the seek table from the end of
the file, then the index, then only the frames with the documents that it wants, and checks each frame that it decompresses.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywright.llm.common import Recent, settle

#: Ids are gathered up to this many bytes before a frame is closed; a longer document has a frame of its own.
FRAME_BYTES = 1 << 20
LEVEL = 3

#: Bytes of text that a file holds the ids of (about), so that files, their indexes and tasks stay small however large the table is.
FILE_BYTES = 256 << 20

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

#: Bytes of chunks and pieces of text that a worker remembers the ids of, each kind.
REMEMBERED = 128 << 20

#: Signs that stand behind a word and are one piece together.
SIGNS = ".,;:!?)\""


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents to one file; ``close`` adds the document index and the seek table."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.system, self.path = fs.FileSystem.from_uri(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.system.open_output_stream(self.path, compression=None)
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.parts: list[bytes] = []
        self.held = 0
        self.table: list[tuple[int, int, int]] = []
        self.index, self.n_docs, self.n_tokens = array("q"), 0, 0  # 32 bytes a document; files are of bounded size

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self._frame()
        self.index.extend((doc_id or 0, doc_id is not None, len(ids) // 4, len(self.table)))
        self.n_docs += 1
        self.parts.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids) // 4

    def _frame(self, data: bytes | None = None) -> None:
        data = b"".join(self.parts) if data is None else data
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), _checksum(data)))
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.parts:
            self._frame()
        self._frame(np.array(self.index, dtype=np.dtype("<i8")).tobytes())
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class FrameReader:
    """Reads a file's seek table and index when opened, and frames when asked."""

    def __init__(self, path: str):
        system, path = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError(f"{path}: no seek table at its end")
        self.table = list(struct.iter_unpack("<III", self.file.read_at(12 * n, size - 9 - 12 * n)))
        self.offsets = np.cumsum([0, *(row[0] for row in self.table)]).tolist()
        self.index = np.frombuffer(self.frame(n - 1), dtype="<i8").reshape(-1, 4)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = self.table[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.offsets[k]), max_output_size=size)
        if len(data) != size or _checksum(data) != checksum:
            raise ValueError(f"frame {k}: its checksum differs")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, ids) of all documents, or of those wanted; frames without any aren't read."""
        before = np.concatenate([[0], np.cumsum(self.index[:, 2])])
        rows = np.arange(len(self.index)) if wanted is None else np.flatnonzero(np.isin(self.index[:, 0], list(wanted)) & (self.index[:, 1] == 1))
        at, data, base = -1, b"", 0
        for i in rows.tolist():
            doc_id, known, n, k = self.index[i].tolist()
            if k != at:
                at, data, base = k, self.frame(k), int(before[np.searchsorted(self.index[:, 3], k)])
            begin = 4 * (int(before[i]) - base)
            yield doc_id if known else None, int(before[i]), data[begin : begin + 4 * n]


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as bytes, for files like word_bpe_49k.json.

    Such a tokenizer never looks across white space, so a text's ids are those of its chunks between white space, and each chunk
    that comes again is remembered. In chunks of Latin letters, lower-cased, the library is asked once for each piece (word,
    digit, or run of signs), many pieces to a call; its end-of-word tokens tell them apart. Other chunks it gets as they are.
    """

    LATIN = [chr(c) for c in range(33, 0x250) if c not in (0x85, 0xA0, 0x130)]
    LETTERS = "".join(re.escape(c) for c in LATIN if unicodedata.category(c)[0] == "L")
    DIGITS = "".join(re.escape(c) for c in LATIN if unicodedata.category(c)[0] == "N")
    PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
    CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    ODD = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
    PLAIN = re.compile("[" + "".join(re.escape(c) for c in LATIN) + "]+")

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end = _tokenizer(path), struct.pack("<I", end_id)
        spec = json.loads(self.tokenizer.to_str())
        if spec["model"]["type"] != "BPE" or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: not a tokenizer whose words end in </w>, which cutting at white space needs")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.chunks, self.pieces = Recent(REMEMBERED), Recent(REMEMBERED)

    def _ask(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        for i in range(0, len(new), 64):
            some = new[i : i + 64]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            data, cuts = ids.tobytes(), cuts.tolist()
            whole = len(cuts) == len(some) and cuts[-1] == len(ids)
            ids_of = [data[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts, strict=False)] if whole else map(self._ask, some)
            self.pieces.learn(dict(zip(some, ids_of, strict=True)))

    def _learn(self, new: list[str]) -> None:
        plain = {}
        for c in new:
            if c.isascii() and c.isalpha():
                plain[c] = (c.lower(),)
            elif (body := c.rstrip(SIGNS)).isalpha() and body.isascii():
                plain[c] = (body.lower(), c[len(body) :])
            elif (c.isascii() and c.isprintable() or self.PLAIN.fullmatch(c)) and not self.special.search(c):
                plain[c] = self.PIECE.findall(c.lower())
        self._learn_pieces(self.pieces.missing(set().union(*plain.values())))
        self.chunks.learn({c: b"".join(map(self.pieces.now.__getitem__, ps)) for c, ps in plain.items()})
        if len(plain) < len(new):
            self.chunks.learn({c: self._ask(c) for c in new if c not in plain})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 16):
            cut = [self.CHUNK.findall(t) if self.ODD.search(t) else t.split() for t in texts[i : i + 16]]
            ids = [list(map(self.chunks.now.get, c)) for c in cut]
            holes = [(c, found, at) for c, found in zip(cut, ids, strict=True) for at in _holes(found)]
            if holes and (new := self.chunks.missing({c[at] for c, _, at in holes})):
                self._learn(new)
            for c, found, at in holes:
                found[at] = self.chunks.now[c[at]]
            out += [b"".join(found) + self.end for found in ids]
        return out


def _holes(found: list[bytes | None]) -> Iterator[int]:
    at, n = -1, found.count(None)
    for _ in range(n):
        at = found.index(None, at + 1)
        yield at


@cache
def _encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encodes docs (doc_id, text) and writes them in ascending doc_id order (null first), a file for each range of ids.

    There are as many files as shuffle partitions, or more where they would hold more than FILE_BYTES of text each.
    Returns the manifest, a row a file: part, path, first, n_docs, n_tokens, base (ids in the files before it). Each document ends
    with end_id; a null or empty text is that alone. Repeated rows are written as often as they come. An attempt writes under a
    name of its own and only what the manifest names counts, so lost executors leave nothing behind that is ever read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, row = _encoder(tokenizer, end_id), None, {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            if writer is None and ids:
                row = {"part": batch.column(2)[0].as_py(), "path": f"{folder}/part-{batch.column(2)[0].as_py():06d}-{uuid.uuid4().hex}.zst", "first": ids[0]}
                writer = FrameWriter(row["path"], frame_bytes)
            for i in range(0, len(ids), 256):
                for doc_id, data in zip(ids[i : i + 256], encoder.encode(texts[i : i + 256].to_pylist()), strict=True):
                    writer.add(doc_id, data)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([row | {"n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    files = settle(rows.mapInArrow(write, "part int, path string, first long, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of all documents in the manifest's files, or of a few wanted ones.

    Null and repeated ids come as often as they were written (a null one is never wanted); an empty manifest gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, before, ids in FrameReader(path).documents(wanted):
                    rows.append((doc_id, base + before, len(ids) // 4, ids))
                    held += len(ids)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    dealt = manifest.select("path", "base").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
