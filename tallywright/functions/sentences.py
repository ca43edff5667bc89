"""A sentence splitter that learns abbreviations from texts: words that keep company with the full stop.

For every word, a log-likelihood ratio compares two explanations of how often a full stop follows it: that stops come after it as
after any word, or nearly always (0.99). Short words with inner stops score higher, and every occurrence without a stop speaks
against. The counts are a grouped count over all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.constraints import quoted
from tallywright.functions.words import stripped

#: The score from which a word is an abbreviation, the share of stops behind one, and how many abbreviations a splitter is built from at most.
LEAST_SCORE, ALWAYS, MOST = 0.3, 0.99, 2000

#: A word is letters, perhaps with stops inside, and perhaps a stop behind it.
WORD = r"\p{L}+(?:\.\p{L}+)*\.?"


def stop_scores(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, with_stop, without, score) of every lower-cased word that a full stop follows somewhere."""
    each = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({WORD})"))).alias("w"))
    word = F.regexp_replace("w", r"\.\z", "")
    counts = each.groupBy(word.alias("word")).agg(F.count_if(F.col("w").endswith(".")).alias("with_stop"), F.count_if(~F.col("w").endswith(".")).alias("without"))
    total = counts.agg((F.sum("with_stop") / F.sum(F.col("with_stop") + F.col("without"))).alias("_p"))  # one row
    a, b, p = F.col("with_stop"), F.col("without"), F.col("_p")
    # where every word has a stop, nothing speaks for an abbreviation
    ratio = F.when(p < 1, 2 * (a * (F.log(F.lit(ALWAYS)) - F.log(p)) + b * (F.log(F.lit(1 - ALWAYS)) - F.log(1 - p)))).otherwise(F.lit(0.0))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    stops = F.length("word") - letters + 1
    score = ratio * F.exp(-letters.cast("double")) * stops * F.pow(letters.cast("double"), -b.cast("double"))
    return counts.where("with_stop > 0").join(F.broadcast(total)).select("word", "with_stop", "without", score.alias("score"))


def abbreviations(scores: DataFrame, least: float = LEAST_SCORE) -> list[str]:
    """The words that are abbreviations; the MOST likely ones if there are more than MOST, and of equal scores the first by name."""
    return [r.word for r in scores.where(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(MOST).collect()]


def sentences(t: Column, known: list[str]) -> Column:
    """Sentences end at . ! or ? (with what closes quotes and brackets) before white space, but not at the stop of a known abbreviation or of an initial.

    A stop before a small letter ends none; one behind a number or letter of a list at a line's begin ends none either.
    """
    initials = r"(?<![\p{L}\p{N}])\p{Lu}"
    words = "|".join(quoted(w) for w in sorted(known, key=lambda w: (-len(w), w)))
    kept = rf"(?iu:(?<![\p{{L}}\p{{N}}.])(?:{words}))|{initials}" if known else initials
    cut = F.regexp_replace(t, rf"({kept})\.(?=\s)", "$1\u0001")
    cut = F.regexp_replace(cut, r"(?m)^(\s*(?:\d{1,3}|\p{L}))\.(?=\s)", "$1\u0001")
    cut = F.regexp_replace(cut, r"([!?][\"'”’)\]]*)\s+", "$1\u0002")
    cut = F.regexp_replace(cut, r"(\.[\"'”’)\]]*)\s+(?!\p{Ll})", "$1\u0002")
    return F.filter(F.transform(F.split(cut, "\u0002"), lambda s: F.replace(stripped(s), F.lit("\u0001"), F.lit("."))), lambda s: s != "")
