"""Languages by ranked n-gram profiles: the distance between two profiles is how far out of place their n-grams are.

A profile holds the MOST commonest n-grams of one to three characters of a text's words, which are lower-cased runs of letters with
an underscore at each end; of equal counts the n-gram that is smaller by code points comes first. An n-gram that a language's profile
lacks is MOST places off. Profiles are counted over all texts of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST, LONGEST = 300, 3

#: Languages that profiles may be sent to all tasks for; MOST rows each.
MOST_LANGUAGES = 1000

#: Distinct words of all languages that a task counts before it puts out their n-grams.
HELD = 1 << 18

_WORD = regex.compile(r"\p{L}+")


def grams(text: str) -> Counter[str]:
    """How often each n-gram comes in a text; each distinct word is cut once."""
    return grams_of(Counter(_WORD.findall(text.lower())))


def grams_of(words: Counter[str]) -> Counter[str]:
    """How often each n-gram comes in words that come so often."""
    out: Counter[str] = Counter()
    for word, k in words.items():
        padded = f"_{word}_"
        for n in range(1, LONGEST + 1):
            for i in range(len(padded) - n + 1):
                out[padded[i : i + n]] += k
    return out


def ranked(counts: Counter[str]) -> list[str]:
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:MOST]]


def code(gram: str) -> int:
    """A number for an n-gram of up to three characters: numbers are in the order of the n-grams by code points."""
    return sum((ord(c) + 1) << (42 - 21 * i) for i, c in enumerate(gram))


def _codes(word: str) -> np.ndarray:
    """The numbers of a word's n-grams, repeats included."""
    c = np.array([ord(x) + 1 for x in f"_{word}_"], np.int64)
    return np.concatenate([c << 42, c[:-1] << 42 | c[1:] << 21, c[:-2] << 42 | c[1:-1] << 21 | c[2:]])


_known_codes = lru_cache(1 << 15)(_codes)


def commonest(text: str) -> np.ndarray:
    """The numbers of the MOST commonest n-grams of a text, the commonest first; each distinct word is cut once, and most words once a worker."""
    words = Counter(_WORD.findall(text.lower()))
    if not words:
        return np.zeros(0, np.int64)
    each = [_known_codes(w) if len(w) <= 32 else _codes(w) for w in words]
    own, at = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.bincount(at, np.repeat(np.fromiter(words.values(), np.float64), [len(e) for e in each]))
    if len(own) > MOST:  # those that come as often as the last one may stay
        often = counts >= np.partition(counts, -MOST)[-MOST]
        own, counts = own[often], counts[often]
    return own[np.argsort(-counts, kind="stable")][:MOST]


def profiles(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, place) of the MOST commonest n-grams of each language, places from 1; null texts and null languages don't count."""
    rows = texts.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[str]] = {}

        def out() -> pa.RecordBatch:
            flat = [(lang, g, k) for lang, c in held.items() for g, k in grams_of(c).items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "k"])

        for batch in batches:
            langs, found = batch.column("lang"), batch.column("text")
            for i in range(batch.num_rows):
                held.setdefault(langs[i].as_py(), Counter()).update(_WORD.findall(found[i].as_py().lower()))
            if sum(map(len, held.values())) > HELD:
                yield out()
        yield out()

    counts = rows.mapInArrow(count, "lang string, gram string, k long").groupBy("lang", "gram").agg(F.sum("k").alias("k"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("k"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= MOST).select("lang", "gram", "place")


class Detector:
    """Tells the language of texts by profiles (lang, gram, place), which are sent to all tasks."""

    def __init__(self, known: DataFrame):
        places: dict[str, dict[str, int]] = {}
        for r in known.limit(MOST_LANGUAGES * MOST + 1).collect():
            places.setdefault(r.lang, {})[r.gram] = r.place
        if len(places) > MOST_LANGUAGES:
            raise ValueError(f"profiles of more than {MOST_LANGUAGES} languages")
        tables = {}
        for lang, of_lang in places.items():
            rows = sorted((code(g), p) for g, p in of_lang.items())
            tables[lang] = np.array([c for c, _ in rows], np.int64), np.array([p for _, p in rows], np.int64)
        self.shared = known.sparkSession.sparkContext.broadcast(tables)

    def nearest(self, text: Column) -> Column:
        """struct of lang and distance: the language whose profile is least out of place (of equal ones the first by name); null without a letter or profile."""
        shared = self.shared

        @F.pandas_udf("lang string, distance long")
        def of(texts: pd.Series) -> pd.DataFrame:
            known, out = shared.value, []
            for t in texts:
                own, far = commonest(t or ""), []
                for lang, (codes, places) in known.items() if len(own) else ():
                    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    far.append((int(np.where(codes[at] == own, np.abs(places[at] - np.arange(1, len(own) + 1)), MOST).sum()), lang))
                distance, lang = min(far, default=(None, None))
                out.append((lang, distance))
            return pd.DataFrame(out, columns=["lang", "distance"]).astype({"lang": "object", "distance": "Int64"})

        found = of(text)
        return F.when(found["lang"].isNotNull(), found)
