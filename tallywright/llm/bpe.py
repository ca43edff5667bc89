"""Byte-level BPE, encoded with a segment tree over the ranks of adjacent pairs.

The leaves hold each adjacent pair's rank (with its place as the lower part), inner nodes the smaller child: the root is the
leftmost pair of lowest rank. A merge updates three leaves and their ancestors, until the root says that nothing can be merged.
The trees of many short words stand in one array and take their steps together; a long word has a tree of its own.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import Recent, in_slices

#: Bytes of chunks between white space that a worker remembers the ids of; bytes of a text that are looked up at a time.
REMEMBERED, PIECE_CHARS = 16 << 20, 1 << 20

#: Longest word, in bytes, whose tree shares an array with others; words in one array.
SHORT, TOGETHER = 64, 8192

# The white space of the tokenizer's patterns; letters and numbers that are newer than its tables (Unicode 17),
# which it takes for signs.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEWER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
    16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
    1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
    1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""

NONE = 1 << 62

#: Signs that stand behind a word, and the first character that may be newer than the tokenizer's tables.
SIGNS, OLD = ".,;:!?)\"", "\u0500"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself if printable Latin-1, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """The vocabulary, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        symbols = byte_symbols()
        content = {i: bytes(symbols[c] for c in s) for s, i in model["vocab"].items() if all(c in symbols for c in s)}
        content |= {t["id"]: t["content"].encode() for t in added}
        self.content = [content.get(i, b"") for i in range(max(content) + 1)]
        self.byte_ids = [0] * 256
        for s, i in model["vocab"].items():
            if len(s) == 1 and s in symbols:
                self.byte_ids[symbols[s]] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((model["vocab"][a], model["vocab"][b]), len(self.made))
            self.made.append(model["vocab"][a + b])
        self.special = {t["content"]: t["id"] for t in added}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.chunk = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        newer = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in NEWER.split())
        letter, number = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"
        self.word = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+")
        pairs = np.array(list(self.rank), dtype=np.int64).reshape(-1, 2)
        keys, ranks = pairs[:, 0] << 32 | pairs[:, 1], np.array(list(self.rank.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made_of = keys[order], ranks[order], np.array(self.made, dtype=np.int32)
        self.byte_id = np.array(self.byte_ids, dtype=np.int32)
        self.chunks = Recent(REMEMBERED)

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of one word, from the ids of its bytes."""
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.rank, self.made
        leaves = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * leaves)
        for i in range(n - 1):
            if (r := rank.get((ids[i], ids[i + 1]))) is not None:
                tree[leaves + i] = r * n + i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += leaves
            tree[i] = value
            while i > 1:
                i >>= 1
                low = tree[2 * i] if tree[2 * i] < tree[2 * i + 1] else tree[2 * i + 1]
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] != NONE:
            r, i = divmod(tree[1], n)
            gone = after[i]
            k = after[i] = after[gone]
            ids[i], ids[gone] = made[r], -1
            if gone < n - 1:
                put(gone, NONE)
            if k < n:
                before[k] = i
                r = rank.get((ids[i], ids[k]))
                put(i, NONE if r is None else r * n + i)
            else:
                put(i, NONE)
            if (p := before[i]) >= 0:
                r = rank.get((ids[p], ids[i]))
                put(p, NONE if r is None else r * n + p)
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where it can't be merged or an id is negative."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE >> 8)

    def _merge_together(self, words: list[bytes], leaves: int) -> list[bytes]:
        """The ids of words of at most ``leaves`` bytes: one row of the arrays is the segment tree of one word."""
        n = np.array([len(w) for w in words])
        width, rows = leaves + 1, np.arange(len(words))
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[np.arange(width)[None, :] < n[:, None]] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after, before = np.tile(np.arange(1, width + 1), (len(words), 1)), np.tile(np.arange(-1, width - 1), (len(words), 1))
        places = np.arange(leaves)
        tree = np.full((len(words), 2 * leaves), NONE, dtype=np.int64)
        tree[:, leaves:] = self._ranks(ids[:, :-1], ids[:, 1:]) << 8 | places
        level = leaves
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        while len(rows := rows[tree[rows, 1] < NONE >> 8 << 8]):
            root = tree[rows, 1]
            i = root & 255
            gone = after[rows, i]
            k = np.minimum(after[rows, gone], leaves)
            ids[rows, i], ids[rows, gone] = self.made_of[root >> 8], -1
            after[rows, i], before[rows, k] = k, i
            p = np.maximum(before[rows, i], 0)
            there = np.where(p < i, self._ranks(ids[rows, p], ids[rows, i]) << 8 | p, NONE)
            here = self._ranks(ids[rows, i], np.where(k > i, ids[rows, k], -1)) << 8 | i
            tree[rows, leaves + np.minimum(gone, leaves - 1)] = NONE
            tree[rows, leaves + i] = here
            tree[rows, leaves + p] = np.where(p < i, there, here)
            nodes, three = leaves + np.concatenate([np.minimum(gone, leaves - 1), i, p]), np.concatenate([rows, rows, rows])
            for _ in range(leaves.bit_length() - 1):
                nodes >>= 1
                tree[three, nodes] = np.minimum(tree[three, 2 * nodes], tree[three, 2 * nodes + 1])
        there = ids >= 0
        data, ends = ids[there].astype("<i4").tobytes(), (4 * np.cumsum(there.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_all(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        kinds: dict[int, list[bytes]] = {}
        out = {}
        for w in words:
            if len(w) > SHORT:
                out[w] = np.array(self.merge([self.byte_ids[b] for b in w]), dtype="<i4").tobytes()
            else:
                kinds.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
        for leaves, some in kinds.items():
            for i in range(0, len(some), TOGETHER):
                out.update(zip(some[i : i + TOGETHER], self._merge_together(some[i : i + TOGETHER], leaves), strict=True))
        return out

    def _cut(self, chunk: str) -> list[bytes]:
        """The words of a chunk. Most chunks are one word of letters, perhaps with signs behind it, and need no pattern."""
        body = chunk.rstrip(SIGNS)
        letters = body[1:] if body[:1] == " " else body
        if letters.isalpha() and (letters.isascii() or max(letters) < OLD):
            return [body.encode()] if len(body) == len(chunk) else [body.encode(), chunk[len(body) :].encode()]
        return [w.encode() for w in self.word.findall(chunk)]

    def _learn(self, new: list[str]) -> None:
        split = {c: self._cut(c) for c in new}
        ids = self.merge_all(list(set().union(*split.values())))
        self.chunks.learn({c: ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for c, ws in split.items()})

    def _looked_up(self, parts: list[list[str]]) -> list[bytes]:
        if new := self.chunks.missing(set().union(*parts)):
            self._learn(new)
        return [b"".join(map(self.chunks.now.__getitem__, chunks)) for chunks in parts]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian 32-bit integers; special tokens in a text are ids of their own."""
        out: list[list[bytes]] = [[] for _ in texts]
        some, places, held = [], [], 0
        for i, text in enumerate(texts):
            parts = self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else [text]
            for part in parts:
                if part in self.special:
                    out[i].append(np.array([self.special[part]], dtype="<i4").tobytes())
                    continue
                some.append(self.chunk.findall(part))
                places.append((i, len(out[i])))
                out[i].append(b"")
                held += len(part)
                if held > PIECE_CHARS:
                    for (k, at), ids in zip(places, self._looked_up(some), strict=True):
                        out[k][at] = ids
                    some, places, held = [], [], 0
        for (k, at), ids in zip(places, self._looked_up(some), strict=True):
            out[k][at] = ids
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.content.__getitem__, ids)).decode("utf-8", errors="replace")


@cache
def _model(path: str) -> ByteBpe:
    return ByteBpe(path)


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode(text: Column, tokenizer: str) -> Column:
    """array<int>: the ids of a text; of a null text, none."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        return _lists(_model(tokenizer).encode_all([t.as_py() or "" for t in texts]))

    return of(text)


def decode(ids: Column, tokenizer: str) -> Column:
    """string: the text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        model = _model(tokenizer)
        return pa.array([None if x.values is None else model.decode(x.values.to_numpy().tolist()) for x in lists], pa.string())

    return of(ids)


def both_ways(text: Column, tokenizer: str) -> Column:
    """struct of ids (array<int>) and decoded (string, made from those ids alone), in one pass."""

    @F.arrow_udf("ids array<int>, decoded string")
    def of(texts: pa.Array) -> pa.Array:
        model = _model(tokenizer)

        def some(texts: list[str | None]) -> pa.Array:
            parts = model.encode_all([t or "" for t in texts])
            decoded = pa.array([model.decode(np.frombuffer(p, dtype="<i4").tolist()) for p in parts], pa.string())
            return pa.StructArray.from_arrays([_lists(parts), decoded], ["ids", "decoded"])

        return in_slices(texts, some)

    return of(text)


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text", out: str = "bpe") -> DataFrame:
    """docs with one column more, ``out``: a struct of ids (array<int>) and decoded (string).

    A null or empty text has no ids and decodes to ''. A column of docs with the name of ``out`` is an error, so none is lost.
    Rows, repeated ones too, stay where they are: nothing is shuffled. An empty table gives an empty result.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {out} already; choose another name for the ids")
    return docs.withColumn(out, both_ways(F.col(text_col), tokenizer))
