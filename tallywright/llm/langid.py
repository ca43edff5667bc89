"""Language identification, words first.

Known words score by their log frequency in each language. An unseen word backs off to its character n-grams, the longest first:
the first length of which any n-gram is known decides, by the mean of those known. A document's score is the sum over its words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import Recent, held_out, in_slices

#: The model is fitted on so many labelled documents of each language at most (on average; a hash picks them). This bounds what is
#: collected and broadcast; all words and n-grams of the sample are kept, however rare.
SAMPLE_DOCS = 1500
LONGEST = 5
UNKNOWN = "und"

#: The share of each table's mass that is spread over all its entries, so that an unseen one tells languages apart by nothing but its absence.
SPREAD = 0.05

#: Bytes of chunks of text that a worker remembers the scores of; characters of text that are looked up at a time.
REMEMBERED, PIECE_CHARS = 8 << 20, 1 << 20

#: Least score that identified() keeps.
LEAST_SCORE = 0.5


def _letters() -> re.Pattern[str]:
    """Runs of letters (Unicode category L): word characters but digits, other numbers and the underscore."""
    odd = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L"]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(odd), lambda x: ord(x[1]) - x[0])]
    return re.compile("[^\\W\\d_" + "".join(f"{r[0]}-{r[-1]}" for r in runs) + "]+")


WORD = _letters()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case: runs of letters."""
    return WORD.findall((text or "").lower())


def _codes(grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all grams in a row, and where each begins; the last number is where they end."""
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1), np.concatenate([[0], np.cumsum(sizes)])


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of codes times powers of an odd number (modulo 2^64), and those powers."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), _ODD)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:-1], dtype=np.uint64)]), powers


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _inverses(powers: np.ndarray) -> np.ndarray:
    """The inverses of powers of the odd number, modulo 2^64."""
    one = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(powers) - 1, one)]), dtype=np.uint64)


def hashes(grams: list[str]) -> np.ndarray:
    """A 64-bit hash of each gram, the same whatever stands around it."""
    codes, at = _codes(grams)
    sums, powers = _sums(codes)
    return _mixed((sums[at[1:]] - sums[at[:-1]]) * _inverses(powers)[at[:-1]])


@dataclass
class Table:
    """Sorted hashes of grams, and for each its log frequency in each language, less their mean."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; -1 for what isn't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Model:
    """tables[0] holds words, tables[n] n-grams of length n."""

    languages: list[str]
    tables: list[Table]
    recent: Recent = field(default_factory=lambda: Recent(REMEMBERED))

    def __getstate__(self):
        return {"languages": self.languages, "tables": self.tables}

    def __setstate__(self, state):
        self.__init__(**state)

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log frequency in each language, or that of its n-grams."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        if not words:
            return out
        row = self.tables[0].find(hashes(words))
        out[row >= 0] = self.tables[0].logs[row[row >= 0]]
        left = np.flatnonzero(row < 0)
        codes, at = _codes([f" {words[i]} " for i in left])
        sums, powers = _sums(codes)
        back, owner, end = _inverses(powers), np.repeat(np.arange(len(left)), np.diff(at)), np.repeat(at[1:], np.diff(at))
        todo = np.ones(len(left), dtype=bool)
        for n in range(LONGEST, 0, -1):
            begin = np.flatnonzero(todo[owner] & (np.arange(len(codes)) + n <= end))
            row = self.tables[n].find(_mixed((sums[begin + n] - sums[begin]) * back[begin]))
            begin, row = begin[row >= 0], row[row >= 0]
            of = owner[begin]
            found = np.bincount(of, minlength=len(left))
            hit = found > 0
            for k in range(len(self.languages)):
                total = np.bincount(of, weights=self.tables[n].logs[row, k], minlength=len(left))
                out[left[hit], k] = total[hit] / found[hit]
            todo &= ~hit
        return out

    def _learn(self, chunks: list[str]) -> None:
        split = [WORD.findall(c) for c in chunks]
        known = list(set().union(*split))
        scores = np.hstack([self.score(known), np.ones((len(known), 1), dtype=np.float32)]).astype("<f4")
        at = {w: scores[i] for i, w in enumerate(known)}
        none = np.zeros(len(self.languages) + 1, dtype="<f4")
        self.recent.learn({c: (at[ws[0]] if len(ws) == 1 else sum((at[w] for w in ws), none)).tobytes() for c, ws in zip(chunks, split, strict=True)})

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its share of the likelihood) of each whole text."""
        out, some, held = [], [], 0
        for text in texts:
            some.append((text or "").lower().split())
            held += len(text or "")
            if held > PIECE_CHARS:
                out, some, held = out + self._verdicts(some), [], 0
        return out + self._verdicts(some)

    def _verdicts(self, cut: list[list[str]]) -> list[tuple[str, float]]:
        if new := self.recent.missing(set().union(*cut)):
            self._learn(new)
        out = []
        for chunks in cut:
            total = np.frombuffer(b"".join(map(self.recent.now.__getitem__, chunks)), dtype="<f4").reshape(-1, len(self.languages) + 1).sum(axis=0, dtype=np.float64)
            if not total[-1] or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            odds = np.exp(total[:-1] - total[:-1].max())
            best = int(np.argmax(odds))
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def _words(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    return of(text)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on text and lang of docs (doc_id, text, lang) that aren't held out; null texts, languages and ids teach nothing.

    Spark counts the words and n-grams of the sample; words are those that identify() looks up. Repeated rows count as often as
    they come. With nothing to learn from the model knows no language.
    """
    rows = docs.where(~held_out()).where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)).alias("draw"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Model([], [Table(np.zeros(0, np.uint64), np.zeros((0, 0))) for _ in range(LONGEST + 1)])
    below = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, math.ceil(1e6 * sample_docs / n))])
    some = rows.where(F.col("draw") < F.element_at(below, F.col("lang")))
    words = some.select("lang", F.explode(_words(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("gram"), F.lit(" "))
    cuts = F.flatten(F.array(F.array(F.struct(F.lit(0).alias("kind"), F.col("gram").alias("gram"))), *[_grams(padded, n) for n in range(1, LONGEST + 1)]))
    counts = words.select("lang", "n", F.explode(cuts).alias("g")).groupBy("lang", "g.kind", "g.gram").agg(F.sum("n").alias("n")).toArrow()
    return _model(sorted(sizes), counts)


def _grams(padded: Column, n: int) -> Column:
    def cut(i: Column) -> Column:
        return F.struct(F.lit(n).alias("kind"), F.substring(padded, i, F.lit(n)).alias("gram"))

    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), cut), lambda g: F.length(g["gram"]) == n)


def _model(languages: list[str], counts: pa.Table) -> Model:
    kinds, times = counts["kind"].to_numpy(), counts["n"].to_numpy()
    lang = np.searchsorted(languages, counts["lang"].to_numpy().astype(str))
    tables = []
    for k in range(LONGEST + 1):
        these = np.flatnonzero(kinds == k)
        keys, row = np.unique(hashes(counts["gram"].take(these).to_pylist()), return_inverse=True)
        n = np.zeros((len(keys), len(languages)))
        np.add.at(n, (row, lang[these]), times[these])
        logs = np.log((1 - SPREAD) * n / np.maximum(n.sum(axis=0), 1) + SPREAD / max(1, len(keys)))
        tables.append(Table(keys, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)))
    return Model(languages, tables)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "langid") -> DataFrame:
    """docs with one column more, ``out``: a struct of lang_pred and score, the likeliest language of the whole text and its share of the likelihood.

    A text that is null, empty or without letters is ``und`` with score 0; so is every text if nothing was there to learn from. Of
    languages that are equally likely the first in code point order is taken. Rows, repeated ones too, stay where they are; a column
    of docs with the name of ``out`` is an error, so none is lost. An empty table gives an empty result.
    """
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {out} already; choose another name for the result")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        def some(texts: list[str | None]) -> pa.Array:
            found = shared.value.documents(texts)
            return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

        return in_slices(texts, some)

    return docs.withColumn(out, of(F.col(text_col)))


def identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs (doc_id, text, lang) whose language can be told, with their own columns: neither ``und`` nor below the least score."""
    found = identify(docs.select(F.struct("*").alias("_row"), "text"), learn(docs))
    return found.where((F.col("langid.lang_pred") != UNKNOWN) & (F.col("langid.score") >= least_score)).select("_row.*")
