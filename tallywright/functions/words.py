"""Words, sentences and the likely language of a text, as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import PUNCTUATION

WORD = r"[\p{L}\p{N}_]+"

#: Words whose full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "vs", "e.g", "i.e", "Inc", "Ltd", "Co")

#: Languages that likely_language() tells apart by stop words, and those by script.
BY_STOP_WORDS = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "sv": "swedish", "da": "danish", "fi": "finnish", "no": "norwegian", "hu": "hungarian", "tr": "turkish"}
BY_SCRIPT = {
    "ja": r"[\p{IsHiragana}\p{IsKatakana}]", "ko": r"\p{IsHangul}", "zh": r"\p{IsHan}", "ru": r"\p{IsCyrillic}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}", "th": r"\p{IsThai}", "el": r"\p{IsGreek}", "he": r"\p{IsHebrew}",
    "bn": r"\p{IsBengali}", "ta": r"\p{IsTamil}", "te": r"\p{IsTelugu}", "pa": r"\p{IsGurmukhi}", "gu": r"\p{IsGujarati}", "kn": r"\p{IsKannada}", "ml": r"\p{IsMalayalam}",
}


def stripped(t: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")


def words(t: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def plain(t: Column) -> Column:
    """Without ASCII punctuation."""
    return F.translate(t, PUNCTUATION, "")


def bare(t: Column) -> Column:
    """Without ASCII punctuation and spaces at both ends."""
    return F.regexp_replace(t, r"^[\p{Punct} ]+|[\p{Punct} ]+\z", "")


def word_runs(t: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(t, F.lit(f"({WORD})"))


def tokens(t: Column) -> Column:
    """Words, with inner hyphens and apostrophes, and signs, each on its own."""
    return F.regexp_extract_all(t, F.lit(rf"({WORD}(?:['’.-]{WORD})*|[^\s\p{{L}}\p{{N}}_])"))


def sentences(t: Column) -> Column:
    """Sentences end at . ! or ? (with what closes quotes and brackets) before white space.

    A full stop before a small letter, after one capital or a known abbreviation ends none. This stands in for a trained splitter.
    """
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    cut = F.regexp_replace(t, rf"\b({known}|[A-Z])\.(\s)", "$1\u0001$2")
    cut = F.regexp_replace(cut, r"([!?][\"'”’)\]]*)\s+", "$1\u0002")
    cut = F.regexp_replace(cut, r"(\.[\"'”’)\]]*)\s+(?!\p{Ll})", "$1\u0002")
    return F.filter(F.transform(F.split(cut, "\u0002"), lambda s: F.replace(stripped(s), F.lit("\u0001"), F.lit("."))), lambda s: s != "")


@cache
def stop_words(language: str = "en") -> tuple[str, ...]:
    """Spark's list of stop words of a language; needs a running session."""
    return tuple(sorted(set(StopWordsRemover.loadDefaultStopWords(BY_STOP_WORDS[language]))))


def stop_word_count(t: Column, language: str = "en") -> Column:
    return F.size(F.filter(word_runs(F.lower(t)), lambda w: w.isin(*stop_words(language))))


def likely_language(t: Column) -> Column:
    """A language code: by script where one has a third of all letters, else by the most stop words; null without any letter.

    It stands in for a trained detector. Of equal counts the language that BY_STOP_WORDS names first is taken.
    """
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    script = F.lit(None).cast("string")
    for code, pattern in reversed(BY_SCRIPT.items()):
        script = F.when(F.regexp_count(t, F.lit(pattern)) * 3 >= letters, code).otherwise(script)
    counts = F.array(*[F.struct(stop_word_count(t, code).alias("n"), F.lit(-i).alias("place"), F.lit(code).alias("code")) for i, code in enumerate(BY_STOP_WORDS)])
    return F.when(letters > 0, F.coalesce(script, F.array_max(counts)["code"]))


def all_pairs_next(items: Column, holds) -> Column:  # noqa: ANN001
    """Whether ``holds`` (a function of two columns) is true of each item and the one after it; true of fewer than two items."""
    n = F.size(items)
    pairs = F.zip_with(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(items, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.forall(pairs, lambda p: holds(p["a"], p["b"]))


def occurrences(t: Column, part: Column | str) -> Column:
    """How often a part stands in the text, without overlaps."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.when(F.length(part) > 0, (F.length(t) - F.length(F.replace(t, part, F.lit("")))) / F.length(part)).cast("int")
