"""Extraction and normalisation of answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What normalize_text() drops.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ["a", "an", "the"]

# The strict and the flexible pattern of a number that is an answer.
STRICT = r"#### (\-?[0-9\.\,]+)"
FLEXIBLE = r"-?[$0-9.,]{2,}|-?[0-9]+"


def normalize_text(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, words one space apart."""
    words = F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"[ \t\n\r\f\x0B]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(ARTICLES)), " ")


def extract_choice(text: Column) -> Column:
    """The first letter from A to E of the text in upper case, or ''."""
    return F.regexp_extract(F.upper(text), "([A-E])", 1)


def strict_number(text: Column) -> Column:
    return F.regexp_extract(text, STRICT, 1)


def flexible_number(text: Column) -> Column:
    """The last thing that looks like a number, or ''."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(f"({FLEXIBLE})")), F.lit(-1)), F.lit(""))


def last_integer(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b([0-9]+)\b")), F.lit(-1))


def exact_match_form(number: Column) -> Column:
    """Without commas, dollars and a trailing dot, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace(number, "[,$]", "")), r"\.$", "")))


def letters(text: Column) -> Column:
    """All letters from A to F, in order."""
    return F.regexp_extract_all(text, F.lit("([A-F])"))


def fenced_code(text: Column) -> Column:
    """The lines between the last two lines with a fence; '' if there are fewer than two."""
    lines = F.split(text, "\n")
    fences = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("```"), i)), lambda i: i.isNotNull())
    begin, end = F.get(fences, F.size(fences) - 2), F.get(fences, F.size(fences) - 1)
    return F.when(F.size(fences) >= 2, F.array_join(F.slice(lines, begin + 2, end - begin - 1), "\n")).otherwise("")


def judge_grade(reply: Column) -> Column:
    """The first letter A, B or C of a judge's reply; without one, C."""
    found = F.regexp_extract(reply, "([ABC])", 1)
    return F.when(found == "", "C").otherwise(found)


def judge_yes(reply: Column) -> Column:
    """Whether the first 'correct: yes' or 'correct: no' says yes."""
    return F.lower(F.regexp_extract(reply, "(?i)correct: (yes|no)", 1)) == "yes"


def judge_confidence(reply: Column) -> Column:
    """The stated percentage; without one, 100."""
    return F.coalesce(F.regexp_extract(reply, r"(?i)confidence:\s*([0-9]+)", 1).try_cast("int"), F.lit(100))


def strip(text: Column) -> Column:
    """Without white space (spaces, tabs, line ends) at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def loose_forms(text: Column) -> Column:
    """The eight forms in which a response may comply: with or without its first and last line and its asterisks."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    cuts = [text] + [strip(F.array_join(x, "\n")) for x in (F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))))]
    return F.array(*cuts, *[F.replace(c, F.lit("*"), F.lit("")) for c in cuts])


def strip_latex(text: Column) -> Column:
    """A formula's canonical form: plain fractions and roots, no spacing, sizes, degrees, units or percents."""
    out = F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit("\\!"), F.lit(""))
    for was, now in ((r"\\\\\\\\", r"\\\\"), (r"\\[td]frac", r"\\frac"), (r"\\left|\\right", ""), (r"\^\{?\\circ\}?", ""), (r"\\\$", ""), (r"\\?%", ""), (r"\\text\{ .*$", ""), (r"(^|[ {])\.([0-9])", r"$10.$2"), (r"\\sqrt([^{ ])", r"\\sqrt{$1}"), (r"\\frac([0-9])([0-9])", r"\\frac{$1}{$2}"), (r"^[a-zA-Z]{1,2} ?= ?", ""), (r" ", "")):
        out = F.regexp_replace(out, was, now)
    return F.regexp_replace(out, r"^(-?[0-9]+)/([0-9]+)$", r"\\frac{$1}{$2}")
