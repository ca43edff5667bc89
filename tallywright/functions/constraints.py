"""Checks that a response follows an instruction: a registry of name -> builder of a boolean column.

Patterns are aware of Unicode and take only line feeds for line ends. Names and patterns of what is looked for are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.text import loose_forms, strip
from tallywright.functions.words import likely_language, occurrences, sentences, tokens, word_runs

Check = Callable[..., Column]
CHECKS: dict[str, Check] = {}

WORD = r"[\p{L}\p{N}_]+"


def check(name: str) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        CHECKS[name] = f
        return f

    return add


#: Parameters of checks: a value, or a column of such values, so that every text can have its own.
Text, Texts, Whole, Share = Column | str, Column | tuple[str, ...], Column | int, Column | float


def arg(value: object) -> Column:
    """A parameter as a column."""
    if isinstance(value, Column):
        return value
    return F.array(*map(F.lit, value)) if isinstance(value, tuple | list) else F.lit(value)


def related(count: Column, relation: Text, n: Whole) -> Column:
    """A relation that isn't known is an error as a value, and null in a column."""
    if isinstance(relation, str) and relation not in ("less than", "at least"):
        raise ValueError(f"no relation named {relation}")
    return F.when(arg(relation) == "less than", count < n).when(arg(relation) == "at least", count >= n)


def matches(text: Column, pattern: Text) -> Column:
    return F.regexp_count(text, arg(pattern))


def literal(word: Text) -> Column:
    """A pattern that matches the word as it is."""
    return F.regexp_replace(arg(word), r"([.^$*+?{}\[\]\\|()])", r"\\$1")


def quoted(word: str) -> str:
    """The same for a word that is known when the plan is made."""
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", word)


def pattern(*parts: Text) -> Column:
    return F.concat(*map(arg, parts))


@check("length_constraints:number_words")
def number_of_words(t: Column, relation: Text, num_words: Whole) -> Column:
    return related(matches(t, WORD), relation, num_words)


@check("length_constraints:word_range")
def word_range(t: Column, min_words: Whole, max_words: Whole) -> Column:
    return matches(t, WORD).between(min_words, max_words)


@check("length_constraints:number_sentences")
def number_of_sentences(t: Column, relation: Text, num_sentences: Whole) -> Column:
    return related(F.size(sentences(t)), relation, num_sentences)


@check("language:response_language")
def response_language(t: Column, language: Text) -> Column:
    """A text whose language can't be told is let through."""
    wanted = F.substring_index(arg(language), "-", 1)
    return F.coalesce(likely_language(t), wanted) == wanted


@check("length_constraints:number_paragraphs")
def paragraphs(t: Column, num_paragraphs: Whole, blank_ends: bool = True) -> Column:
    """Paragraphs stand between lines of ***; only the first and the last may be blank, and don't count then. Without ``blank_ends`` all parts count, blank ones too."""
    parts = F.transform(F.split(t, r"\s?\*\*\*\s?"), strip)
    if not blank_ends:
        return F.size(parts) == num_paragraphs
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return (F.size(F.filter(parts, lambda p: p != "")) == num_paragraphs) & ~F.exists(inner, lambda p: p == "")


@check("detectable_content:number_placeholders")
def placeholders(t: Column, num_placeholders: Whole) -> Column:
    return matches(t, r"\[.*?\]") >= num_placeholders


@check("detectable_content:postscript")
def postscript(t: Column, marker: Text = "P.S.") -> Column:
    wanted = F.when(arg(marker) == "P.P.S", r"p\.\s?p\.\s?s").when(arg(marker) == "P.S.", r"p\.\s?s\.").otherwise(literal(F.lower(arg(marker))))
    return F.rlike(F.lower(t), wanted)


@check("detectable_format:number_bullet_lists")
def bullets(t: Column, num_bullets: Whole) -> Column:
    return matches(t, r"(?md)^\s*\*[^*].*$") + matches(t, r"(?md)^\s*-.*$") == num_bullets


@check("detectable_format:constrained_response")
def constrained_response(t: Column, options: Texts = ("My answer is yes.", "My answer is no.", "My answer is maybe.")) -> Column:
    return F.exists(arg(options), lambda o: strip(t).contains(o))


@check("detectable_format:number_highlighted_sections")
def highlights(t: Column, num_highlights: Whole) -> Column:
    """Spans between single asterisks and spans between double ones, each kind found on its own; blank ones don't count."""
    single = F.regexp_extract_all(t, F.lit(r"(\*[^\n*]*\*)"))
    double = F.regexp_extract_all(t, F.lit(r"(\*\*[^\n*]*\*\*)"))
    filled = F.filter(F.concat(single, double), lambda h: strip(F.replace(h, F.lit("*"), F.lit(""))) != "")
    return F.size(filled) >= num_highlights


@check("detectable_format:multiple_sections")
def sections(t: Column, section_spliter: Text, num_sections: Whole) -> Column:
    return matches(t, pattern(r"\s?", literal(section_spliter), r"\s?\d+\s?")) >= num_sections


@check("detectable_format:json_format")
def json_format(t: Column) -> Column:
    """JSON, in a code fence or not."""
    inner = F.regexp_replace(strip(t), r"^```(?:json|Json|JSON)?|```$", "")
    return F.try_parse_json(strip(inner)).isNotNull()


@check("detectable_format:title")
def title(t: Column) -> Column:
    return F.exists(F.regexp_extract_all(t, F.lit(r"(<<[^\n]+>>)")), lambda x: strip(F.regexp_replace(x, r"^<+|>+\z", "")) != "")


@check("detectable_format:rephrase")
def rephrased(t: Column, original_message: Text) -> Column:
    """Nothing but what stands between asterisks is changed; without any such change it isn't followed."""
    change = r"(?d)\*.*\*"
    return t.rlike(change) & (F.regexp_replace(t, change, "") == F.regexp_replace(arg(original_message), change, ""))


@check("detectable_content:rephrase_paragraph")
def rephrased_paragraph(t: Column, original_paragraph: Text, low: Whole, high: Whole) -> Column:
    """The words that both have, each as often as both have it, are from low to high."""
    mine, theirs = word_runs(F.lower(t)), word_runs(F.lower(arg(original_paragraph)))
    shared = F.aggregate(F.array_intersect(mine, theirs), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(mine, lambda x: x == w)), F.size(F.filter(theirs, lambda x: x == w))))
    return shared.between(low, high)


@check("keywords:key_sentences")
def key_sentences(t: Column, key_sentences: Texts, num_sentences: Whole) -> Column:
    return F.size(F.array_intersect(arg(key_sentences), sentences(t))) == num_sentences


@check("keywords:existence")
def keywords(t: Column, words: Texts) -> Column:
    return F.forall(arg(words), lambda w: F.rlike(t, pattern("(?iu)", literal(w))))


@check("keywords:frequency")
def keyword_frequency(t: Column, keyword: Text, relation: Text, frequency: Whole) -> Column:
    return related(matches(t, pattern("(?iu)", literal(keyword))), relation, frequency)


@check("keywords:forbidden_words")
def forbidden(t: Column, words: Texts) -> Column:
    return ~F.rlike(t, pattern(r"(?iuU)\b(?:", F.array_join(F.transform(arg(words), literal), "|"), r")\b"))


@check("keywords:letter_frequency")
def letter_frequency(t: Column, letter: Text, relation: Text, frequency: Whole) -> Column:
    """The letter is one character; what isn't from a to z is counted as it is."""
    return related(occurrences(F.lower(t), F.lower(strip(arg(letter)))), relation, frequency)


def _english(t: Column) -> Column:
    return F.coalesce(likely_language(t) == "en", F.lit(True))


@check("change_case:english_lowercase")
def english_lowercase(t: Column) -> Column:
    return lowercase(t) & _english(t)


@check("change_case:english_capital")
def english_uppercase(t: Column) -> Column:
    """English is told from the text in small letters, which stop words are in."""
    return uppercase(t) & _english(t)


@check("change_case:lowercase")
def lowercase(t: Column) -> Column:
    return (t == F.lower(t)) & (t != F.upper(t))


@check("change_case:uppercase")
def uppercase(t: Column) -> Column:
    return (t == F.upper(t)) & (t != F.lower(t))


@check("change_case:capital_word_frequency")
def capital_words(t: Column, relation: Text, frequency: Whole) -> Column:
    return related(F.size(F.filter(tokens(t), lambda w: (w == F.upper(w)) & (w != F.lower(w)))), relation, frequency)


@check("combination:two_responses")
def two_responses(t: Column) -> Column:
    parts = F.transform(F.split(t, r"\*\*\*\*\*\*"), strip)
    some = F.filter(parts, lambda p: p != "")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return (F.size(some) == 2) & ~F.exists(inner, lambda p: p == "") & (F.get(some, F.lit(0)) != F.get(some, F.lit(1)))


@check("combination:repeat_prompt")
def repeat_prompt(t: Column, prompt: Text) -> Column:
    return F.lower(strip(t)).startswith(F.lower(strip(arg(prompt))))


@check("startend:end_checker")
def end_phrase(t: Column, phrase: Text) -> Column:
    return F.lower(F.regexp_replace(strip(t), '"+$', "")).endswith(F.lower(strip(arg(phrase))))


@check("startend:quotation")
def quotation(t: Column) -> Column:
    s = strip(t)
    return (F.length(s) > 1) & s.startswith('"') & s.endswith('"')


@check("startend:constrained_start")
def constrained_start(t: Column, starter: Text) -> Column:
    return F.rlike(t, pattern(r"(?mdU)^\s*", literal(starter), ".*$"))


@check("punctuation:no_comma")
def no_comma(t: Column) -> Column:
    return ~t.contains(",")


def _first_word(paragraph: Column) -> Column:
    """Without quotes before it, up to the first mark behind it, in lower case."""
    return F.regexp_extract(F.lower(paragraph), r"(?U)^'*\"*([^\s.,?!'\"]*)", 1)


@check("length_constraints:nth_paragraph_first_word")
def nth_paragraph(t: Column, num_paragraphs: Whole, nth_paragraph: Whole, first_word: Text) -> Column:
    """Blank paragraphs don't count among all of them, but they do before the nth."""
    parts = F.transform(F.split(t, r"\n\n"), strip)
    count, mine = F.size(F.filter(parts, lambda p: p != "")), F.get(parts, arg(nth_paragraph) - 1)
    return (count == num_paragraphs) & (count >= nth_paragraph) & (mine != "") & (_first_word(mine) == first_word)


@check("nth_paragraph:first_word")
def repaired_nth_paragraph(t: Column, num_paragraphs: Whole, nth_paragraph: Whole, first_word: Text) -> Column:
    """Blank paragraphs never count; a first "word" of several is compared with as many."""
    parts = F.filter(F.transform(F.split(t, r"\n\n"), strip), lambda p: p != "")
    opening = F.slice(F.split(F.get(parts, arg(nth_paragraph) - 1), r"(?U)\s+"), F.lit(1), F.size(F.split(strip(arg(first_word)), r"(?U)\s+")))
    return (F.size(parts) == num_paragraphs) & (F.array_join(F.transform(opening, _first_word), " ") == F.lower(arg(first_word)))


REPAIRED: dict[str, Check] = CHECKS | {"length_constraints:nth_paragraph_first_word": repaired_nth_paragraph}


def strict(name: str, text: Column, registry: dict[str, Check] | None = None, **kwargs: object) -> Column:
    """Whether the response follows the instruction; a blank one doesn't."""
    return F.coalesce((strip(text) != "") & (registry or CHECKS)[name](text, **kwargs), F.lit(False))


def loose(name: str, text: Column, registry: dict[str, Check] | None = None, **kwargs: object) -> Column:
    """Whether any of the eight loose forms does.

    Checks that are columns run inside one expression over all forms. Checks by a Python reader, which can't, get each form as a
    column of its own.
    """
    test, forms = (registry or CHECKS)[name], loose_forms(text)
    if getattr(test, "scans", False):
        each = [F.get(forms, F.lit(i)) for i in range(8)]
        return F.coalesce(F.greatest(*[(strip(t) != "") & test(t, **kwargs) for t in each]), F.lit(False))
    return F.coalesce(F.exists(forms, lambda t: (strip(t) != "") & test(t, **kwargs)), F.lit(False))


#: How the kinds of parameters are read from the texts of JSON values. Whole numbers may be written with a fraction of zero.
READ: dict[str, Callable[[Column], Column]] = {
    "Text": lambda v: v, "Texts": lambda v: F.from_json(v, "array<string>"), "Whole": lambda v: v.cast("double").cast("int"), "Share": lambda v: v.cast("double"),
}


def arguments(test: Check, given: Column, renamed: dict[str, str]) -> dict[str, Column]:
    """A check's parameters from a map of texts, under their own names or those that a benchmark gives them; without one, the default."""
    out = {}
    for name, p in list(signature(test).parameters.items())[1:]:
        if p.annotation in READ:
            value = F.coalesce(*[READ[p.annotation](F.try_element_at(given, F.lit(k))) for k in (name, *(k for k, v in renamed.items() if v == name))])
            out[name] = value if p.default is p.empty else F.coalesce(value, arg(p.default))
    return out


def followed(rows: DataFrame, registry: dict[str, Check] | None = None, renamed: dict[str, str] | None = None, keys: tuple[str, ...] = ("sample_id", "idx")) -> DataFrame:
    """rows (keys, text, instruction_id_list, kwargs as JSON) with two columns more: strict and loose, array<boolean> in order of the instructions.

    Parameters stay columns: the plan has a branch a check of the registry, however many samples and parameters there are. Each
    instruction is a row of its own, so that a text is tested for its own instructions only; unknown ones, and those that lack a
    parameter, are not followed. Rows without instructions get empty arrays.
    """
    tests = registry or CHECKS
    each = rows.select(*keys, "text", F.posexplode(F.arrays_zip("instruction_id_list", "kwargs")).alias("_at", "_of"))
    each = each.withColumn("_name", F.col("_of.instruction_id_list")).withColumn("_given", F.from_json(F.coalesce("_of.kwargs", F.lit("{}")), "map<string,string>"))
    verdicts = []
    for way in (strict, loose):
        verdict = F.lit(False)
        for name, test in sorted(tests.items(), reverse=True):
            verdict = F.when(F.col("_name") == name, way(name, F.col("text"), tests, **arguments(test, F.col("_given"), renamed or {}))).otherwise(verdict)
        verdicts.append(verdict.alias(f"_{way.__name__}"))
    done = each.select(*keys, "_at", *verdicts).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_strict", "_loose"))).alias("_all"))  # a prompt's few instructions
    none = F.array().cast("array<boolean>")
    joined = rows.join(done, list(keys), "left")
    return joined.withColumns({w: F.coalesce(F.transform("_all", lambda x: x[f"_{w}"]), none) for w in ("strict", "loose")}).drop("_all")  # noqa: B023
