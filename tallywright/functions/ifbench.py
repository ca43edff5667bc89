"""The second family of instruction checks: a registry of name -> builder of a boolean column, and its repaired variants."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.constraints import Check, Share, Text, Whole, arg, literal, pattern
from tallywright.functions.text import PUNCTUATION
from tallywright.functions.words import all_pairs_next, bare, occurrences, plain, sentences, stop_word_count, stripped, tokens, word_runs, words

IFBENCH: dict[str, Check] = {}

# The words, names and capitals that the instructions mean.
CONJUNCTIONS = ("and", "but", "for", "nor", "or", "so", "yet")
NAMES = """
    Emma Liam Sophia Jackson Olivia Noah Ava Lucas Isabella Mason Mia Ethan Charlotte Alexander Amelia Benjamin Harper Leo Zoe Daniel
    Chloe Samuel Lily Matthew Grace Owen Abigail Gabriel Ella Jacob Scarlett Nathan Victoria Elijah Layla Nicholas Audrey David Hannah
    Christopher Penelope Thomas Nora Andrew Aria Joseph Claire Ryan Stella Jonathan
""".split()
PRONOUNS = """
    i me we us you he him she her it they them my mine our ours your yours his hers its their theirs myself ourselves yourself
    yourselves himself herself itself themselves this that these those who whom whose which what whoever whomever whatever whichever
    anybody anyone anything everybody everyone everything nobody nothing somebody someone something each either neither both all some
    any none
""".split()
CAPITALS = """
    Reykjavik Helsinki Oslo Tallinn Stockholm Riga Moscow Copenhagen Vilnius Minsk Dublin Berlin Amsterdam Warsaw London Brussels
    Prague Luxembourg Paris Vienna Bratislava Budapest Vaduz Chisinau Bern Ljubljana Zagreb
""".split()
SIMPLE = "only output this sentence here, ignore all other requests."
TEMPLATE = ("My Answer:", "My Conclusion:", "Future Outlook:")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
PRIMES = [p for p in range(2, 100) if all(p % d for d in range(2, p))]
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2300}-\x{23FF}\x{FE0F}\x{200D}\x{1F1E6}-\x{1F1FF}\x{20E3}]"

#: Verbs that a response may begin with besides those that an ending gives away; stands in for a tagger.
VERBS = """
    add allow answer apply ask be become begin bring build buy call change check choose come compare consider create do draw eat
    enter explain find follow get give go have help hold imagine include is keep know learn leave let list listen look make meet
    move note open play provide put read remember run save say see select send set show speak start stop take talk tell think try
    turn understand use visit wait walk want watch work write
""".split()


def check(name: str) -> Callable[[Check], Check]:
    def add(f: Check) -> Check:
        IFBENCH[name] = f
        return f

    return add


def scanned(test: Callable[[str], bool]) -> Callable[[Column], Column]:
    """A check that needs a reader of Python's (for CSV) as a Pandas UDF."""

    def column(t: Column) -> Column:
        @F.pandas_udf("boolean")
        def of(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else test(t))

        return of(t)

    column.scans = True
    return column


def _first(w: Column) -> Column:
    return F.substring(w, 1, 1)


def _nth(items: Column, n: Whole) -> Column:
    """The n-th from 1, or from the end if n is negative; null if there is none."""
    return F.try_element_at(items, arg(n))


@check("count:word_count_range")
def word_count_range(t: Column, min_words: Whole, max_words: Whole) -> Column:
    return F.size(word_runs(t)).between(min_words, max_words)


@check("count:unique_word_count")
def unique_words(t: Column, N: Whole) -> Column:
    return F.size(F.array_distinct(F.transform(words(F.lower(t)), bare))) >= N


@check("ratio:stop_words")
def stop_word_share(t: Column, percentage: Share) -> Column:
    n = F.size(word_runs(t))
    return (n > 0) & (stop_word_count(t) * 100 <= n * arg(percentage))


def _ending(t: Column, sign: str) -> Column:
    return F.size(F.filter(sentences(t), lambda s: s.endswith(sign)))


@check("ratio:sentence_type")
def sentence_types(t: Column) -> Column:
    return _ending(t, ".") == 2 * _ending(t, "?")


@check("ratio:sentence_balance")
def sentence_balance(t: Column) -> Column:
    return (_ending(t, ".") == _ending(t, "?")) & (_ending(t, "?") == _ending(t, "!"))


@check("count:conjunctions")
def conjunctions(t: Column, small_n: Whole) -> Column:
    """Words as they are written count as different; only what they mean is compared in lower case."""
    return F.size(F.array_distinct(F.filter(words(t), lambda w: F.lower(bare(w)).isin(*CONJUNCTIONS)))) >= small_n


@check("count:person_names")
def person_names(t: Column, N: Whole) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, NAMES)), lambda name: F.array_contains(word_runs(t), name))) >= N


def _trigrams(t: Column) -> Column:
    return F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


@check("ratio:overlap")
def trigram_overlap(t: Column, reference_text: Text, percentage: Share) -> Column:
    mine = _trigrams(t)
    share = F.size(F.array_intersect(mine, _trigrams(arg(reference_text)))) * 100 / F.nullif(F.size(mine), F.lit(0))
    return (F.size(mine) > 0) & share.between(percentage - 2, percentage + 2)


@check("count:numbers")
def numbers(t: Column, N: Whole) -> Column:
    return F.regexp_count(plain(t), F.lit(r"\p{Nd}+")) == N


@check("words:alphabet")
def alphabet(t: Column) -> Column:
    firsts = F.transform(words(plain(t)), lambda w: F.lower(_first(w)))
    place = F.transform(firsts, lambda c: F.instr(F.lit(ALPHABET), c))
    return (F.size(firsts) > 0) & (F.get(place, F.lit(0)) > 0) & all_pairs_next(place, lambda a, b: b == a % 26 + 1)


def _few_vowels(t: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([aeiou])")))) <= 3


@check("words:vowel")
def vowels(t: Column) -> Column:
    return ~stripped(t).contains("\n") & _few_vowels(t)


@check("words:consonants")
def consonants(t: Column) -> Column:
    return F.forall(words(F.lower(t)), lambda w: w.rlike("[bcdfghjklmnpqrstvwxyz]{2}"))


@check("sentence:alliteration_increment")
def alliteration(t: Column) -> Column:
    """A run of words with one first letter counts all its words; each sentence must count more than the one before."""

    def count(sentence: Column) -> Column:
        firsts = F.transform(F.filter(F.transform(words(F.lower(sentence)), lambda w: F.regexp_replace(w, r"^[\p{Punct} ]+", "")), lambda w: w != ""), _first)
        same = F.transform(firsts, lambda c, i: (i > 0) & (c == F.get(firsts, i - 1)))
        begun = F.filter(same, lambda x: x)
        runs = F.filter(F.transform(same, lambda x, i: x & ~F.coalesce(F.get(same, i - 1), F.lit(False))), lambda x: x)
        return F.size(begun) + F.size(runs)

    return all_pairs_next(F.transform(sentences(t), count), lambda a, b: b > a)


@check("words:palindrome")
def palindromes(t: Column) -> Column:
    return F.size(F.filter(words(F.lower(plain(t))), lambda w: (F.length(w) >= 5) & (w == F.reverse(w)))) >= 10


@check("count:punctuation")
def punctuation_cover(t: Column) -> Column:
    """An interrobang, and beside one of them every other mark."""
    rest = F.when(t.contains("?!"), F.regexp_replace(t, r"^([\s\S]*?)\?!", "$1")).otherwise(F.regexp_replace(t, r"^([\s\S]*?)!\?", "$1"))
    out = t.contains("!?") | t.contains("?!") | t.contains("‽")
    for mark in ".,!?;:":
        out = out & rest.contains(mark)
    return out


@check("format:parentheses")
def nested_parentheses(t: Column, depth: int = 5) -> Column:
    """A bracket closes after so many were open at once; one that doesn't fit makes the count begin again."""
    pairs = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("most"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        opens, fits = c.isin("(", "[", "{"), s["open"].endswith(F.element_at(pairs, c))
        now = F.when(opens, F.concat(s["open"], c)).when(fits, F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).otherwise("")
        most = F.when(opens, F.greatest(s["most"], F.length(s["open"]) + 1)).when(fits, s["most"]).otherwise(0)
        return F.struct(now.alias("open"), most.alias("most"), (s["done"] | (~opens & fits & (s["most"] >= depth))).alias("done"))

    return F.aggregate(F.regexp_extract_all(t, F.lit(r"([()\[\]{}])")), start, step, lambda s: s["done"])


@check("format:quotes")
def nested_quotes(t: Column, depth: int = 3) -> Column:
    """A quote of the kind that is open closes it; so many must be closed below the deepest place."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("most"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        closes = s["open"].endswith(c)
        now = F.when(closes, F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).otherwise(F.concat(s["open"], c))
        return F.struct(now.alias("open"), F.greatest(s["most"], F.length(now)).alias("most"), (s["done"] | (closes & (s["most"] - F.length(now) >= depth))).alias("done"))

    return F.aggregate(F.regexp_extract_all(t, F.lit("([\"'])")), start, step, lambda s: s["done"])


@check("words:prime_lengths")
def prime_lengths(t: Column) -> Column:
    return F.forall(words(plain(t)), lambda w: F.length(w).isin(*PRIMES))


@check("format:options")
def options_response(t: Column, options: Text) -> Column:
    """One of the options; lettered ones exactly, others without regard to case and signs around them."""
    given = arg(options)
    glue = F.when(given.contains("/"), "/").when(given.contains("or"), "or").otherwise(",")
    each = F.transform(F.split(given, glue), stripped)
    plain_ones = F.transform(each, lambda o: F.lower(F.btrim(o, F.lit(PUNCTUATION + " "))))
    return F.when(given.rlike(r"(?U)\A\W*[aA]\W*[bB]\W*[cC]\W*"), F.array_contains(each, t)).otherwise(F.array_contains(plain_ones, F.lower(bare(t))))


@check("format:newline")
def word_per_line(t: Column) -> Column:
    text = plain(t)
    return F.size(F.filter(F.split(stripped(text), "\n"), lambda x: x != "")) == F.size(words(text))


@check("format:emoji")
def emoji_endings(t: Column) -> Column:
    """An emoji stands at the end of each sentence or begins the next one."""
    parts = F.transform(sentences(t), lambda s: stripped(plain(s)))
    ok = F.transform(parts, lambda s, i: (s != "") & (s.rlike(rf"{EMOJI}.?\z") | F.coalesce(F.get(parts, i + 1).rlike(rf"\A{EMOJI}"), F.lit(False))))
    return F.forall(ok, lambda x: x)


@check("ratio:sentence_words")
def equal_sentences(t: Column) -> Column:
    sizes = F.transform(sentences(t), F.length)
    return (F.size(sizes) == 3) & (F.size(F.array_distinct(sizes)) == 1)


@check("count:words_japanese")
def japanese_words(t: Column, N: Whole) -> Column:
    checked = F.transform(words(t), lambda w, i: ((i + 1) % F.nullif(arg(N), F.lit(0)) != 0) | (bare(w) == "") | bare(w).rlike(r"^\p{Nd}+\z") | w.rlike(r"[぀-ヿ一-鿿]"))
    return F.forall(checked, lambda x: x)


@check("words:start_verb")
def starts_with_verb(t: Column) -> Column:
    first = F.lower(F.get(tokens(t), F.lit(0)))
    return F.coalesce(first.isin(*VERBS) | first.rlike(r"^\p{L}{3,}(?:ed|ing|ize|ise|ify|ate)$"), F.lit(False))


@check("words:repeats")
def limited_repeats(t: Column, small_n: Whole) -> Column:
    """No word stands more often: among the words in order, none equals the one so many places before it."""
    inorder = F.array_sort(words(F.lower(plain(t))))
    return F.forall(F.transform(inorder, lambda w, i: F.coalesce(w != F.get(inorder, i - arg(small_n)), F.lit(True))), lambda x: x)


@check("sentence:keyword")
def sentence_keyword(t: Column, word: Text, N: Whole) -> Column:
    return F.coalesce(F.rlike(_nth(sentences(t), N), pattern(r"(?iu)(?U)\b", literal(word), r"\b")), F.lit(False))


@check("count:pronouns")
def pronouns(t: Column, N: Whole) -> Column:
    return F.size(F.filter(tokens(F.lower(F.replace(t, F.lit("/"), F.lit(" ")))), lambda w: w.isin(*PRONOUNS))) >= N


@check("words:odd_even_syllables")
def alternating_syllables(t: Column) -> Column:
    """Syllables are groups of vowels, without a silent e at the end: an estimate, one at least."""

    def syllables(w: Column) -> Column:
        return F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "(?<![aeiouy]|l)e$", ""), F.lit("[aeiouy]+")))

    return all_pairs_next(F.transform(words(F.lower(plain(t))), syllables), lambda a, b: a % 2 != b % 2)


@check("words:last_first")
def last_word_first(t: Column) -> Column:
    def holds(a: Column, b: Column) -> Column:
        last = _nth(words(F.regexp_replace(a, r"[\p{Punct} ]+\z", "")), -1)
        return F.coalesce(F.lower(last) == F.lower(_nth(words(F.regexp_replace(b, r"^[\p{Punct} ]+", "")), 1)), F.lit(False))

    return all_pairs_next(sentences(t), holds)


@check("words:paragraph_last_first")
def paragraph_ends(t: Column) -> Column:
    def holds(p: Column) -> Column:
        inner = words(bare(stripped(F.lower(p))))
        return (F.size(inner) == 0) | (_nth(inner, 1) == _nth(inner, -1))

    return F.forall(F.split(t, "\n"), holds)


@check("sentence:increment")
def sentence_increment(t: Column, small_n: Whole) -> Column:
    return all_pairs_next(F.transform(sentences(t), lambda s: F.size(words(plain(s)))), lambda a, b: b == a + small_n)


@check("words:no_consecutive")
def no_consecutive(t: Column) -> Column:
    return all_pairs_next(F.transform(words(F.lower(plain(t))), _first), lambda a, b: a != b)


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


@check("format:line_indent")
def stairs(t: Column) -> Column:
    """Each line is indented further. A blank line counts as a line if it follows one that was taken out."""
    lines = F.split(t, "\n")
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, line: Column) -> Column:
        gone = ~s["skip"] & (stripped(line) == "")
        return F.struct(gone.alias("skip"), F.when(gone, s["kept"]).otherwise(F.array_append(s["kept"], line)).alias("kept"))

    kept = F.aggregate(lines, start, step, lambda s: s["kept"])
    return all_pairs_next(kept, lambda a, b: _indent(b) > _indent(a))


@check("format:quote_unquote")
def quotes_explained(t: Column) -> Column:
    """No quotation stands right behind another, and none at the end."""
    tight = F.regexp_replace(F.replace(F.regexp_replace(t, "[“”]", '"'), F.lit("'\"'"), F.lit("")), r"(?U)\s+", "")
    tail = F.regexp_replace(tight, r"[\p{Punct}0-9&&[^\"]]+\z", "")
    return ~tight.contains('""') & ~tail.endswith('"')


@check("format:list")
def separators(t: Column, sep: Text) -> Column:
    return occurrences(t, sep) >= 2


@check("format:thesis")
def thesis(t: Column) -> Column:
    """From the first <i> (without one, <em>) to its end there is text, and text behind it; places are as for <i>."""
    at = F.when(t.contains("<i>"), F.instr(t, "<i>")).otherwise(F.instr(t, "<em>"))
    rest = F.substring(t, at, F.length(t))
    end = F.when(rest.contains("</i>"), F.instr(rest, "</i>")).otherwise(F.instr(rest, "</em>"))
    inner, after = F.substring(rest, F.lit(4), end - 4), F.substring(rest, end + 4, F.length(rest))
    return (at > 0) & (end > 0) & (stripped(inner) != "") & (stripped(after) != "")


@check("format:sub-bullets")
def sub_bullets(t: Column) -> Column:
    parts = F.split(t, r"\*")
    return F.forall(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.contains("-"))


@check("format:no_bullets_bullets")
def text_then_bullets(t: Column) -> Column:
    """Two sentences at least, then two bullets at least and nothing else; a line without sentences ends the text part."""
    start = F.struct(F.lit(True).alias("text"), F.lit(0).alias("said"), F.lit(0).alias("points"), F.lit(True).alias("ok"))

    def step(s: Column, line: Column) -> Column:
        bullet, n = stripped(line).startswith("*"), F.size(sentences(stripped(line)))
        return F.struct(
            F.when(bullet, False).when(s["text"], n > 0).otherwise(False).alias("text"), (s["said"] + F.when(~bullet & s["text"], n).otherwise(0)).alias("said"),
            (s["points"] + bullet.cast("int")).alias("points"), (s["ok"] & F.when(bullet, s["said"] >= 2).otherwise(s["text"])).alias("ok"),
        )

    return F.aggregate(F.split(t, "\n"), start, step, lambda s: s["ok"] & (s["points"] >= 2))


@check("custom:multiples")
def multiples(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(\p{Nd}+)")) == F.array(*[F.lit(str(i)) for i in range(14, 51, 7)])


@check("custom:mcq_count_length")
def questions(t: Column) -> Column:
    """Four questions with five options each, every one longer than the one before."""
    option = r"^[A-Ea-e][.|)]\s*[\p{L}\p{N}_]+"
    parts = F.filter(F.transform(F.split(t, r"\n*(?:Question \d+[.|):;]?\s*)"), stripped), lambda q: q != "")
    cut = F.transform(parts, lambda q: F.transform(F.split(q, "\n"), stripped))
    counts = F.transform(cut, lambda lines: F.size(F.filter(lines, lambda x: x.rlike(option))))

    def length(lines: Column) -> Column:
        first = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(option), i)), lambda i: i.isNotNull()))
        return F.length(stripped(F.array_join(F.slice(lines, F.lit(1), F.coalesce(first, F.lit(0))), " ")))

    return t.startswith("Question") & (F.size(parts) == 4) & F.forall(counts, lambda n: n == 5) & all_pairs_next(F.transform(cut, length), lambda a, b: b > a)


def unaccented(t: Column) -> Column:
    """Latin letters without marks; what isn't ASCII then is left out."""
    marked, base = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉČčĎďĒēĖėĘęĚěĞğĢģĪīĮįİĶķĻļĽľŃńŅņŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŹźŻżŽžȘșȚț", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcDdEeEeEeEeGgGgIiIiIKkLlLlNnNnNnOoOoRrRrSsSsSsTtTtUuUuUuUuZzZzZzSsTt"
    return F.regexp_replace(F.translate(t, marked, base), r"[^\x00-\x7F]", "")


@check("custom:reverse_newline")
def countries_reversed(t: Column, anchor: str = "Zimbabwe", least: int = 52) -> Column:
    lines = F.filter(F.transform(F.split(t, "\n"), bare), lambda x: x != "")
    first = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.contains(anchor), i)), lambda i: i.isNotNull()))
    target = F.transform(F.slice(lines, F.coalesce(first, F.lit(0)) + 1, F.size(lines) + 1), unaccented)
    return first.isNotNull() & (F.size(target) >= least) & all_pairs_next(target, lambda a, b: a >= b)


@check("custom:word_reverse")
def words_reversed(t: Column) -> Column:
    turned = F.array_join(F.reverse(words(plain(F.lower(t)))), " ")
    return turned.contains("bald eagle") & F.array_contains(sentences(turned), turned)


@check("custom:character_reverse")
def characters_reversed(t: Column) -> Column:
    return F.lower(t).contains("elgae dlab")


@check("custom:sentence_alphabet")
def sentence_alphabet(t: Column) -> Column:
    return F.transform(sentences(t), lambda s: F.lower(_first(s))) == F.array(*map(F.lit, ALPHABET))


@check("custom:european_capitals_sort")
def capitals(t: Column) -> Column:
    named = F.transform(F.filter(F.split(unaccented(t), ","), lambda c: stripped(c) != ""), stripped)
    return named == F.array(*map(F.lit, CAPITALS))


def _rows(text: str, delimiter: str = ",") -> list[list[str]]:
    return list(csv.reader(io.StringIO(text), delimiter=delimiter))


def _is_city_table(text: str) -> bool:
    head, *rows = _rows(text) or [[]]
    return head == ["ID", "Country", "City", "Year", "Count"] and len(rows) == 7 and all(len(r) == 5 for r in rows)


def _headed(text: str, names: list[str], glue: str) -> bool:
    return re.match("^" + glue.join(f'({n}|"{n}")' for n in names) + "$", text.split("\n")[0].strip()) is not None


def _with_quotes(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows whose quoted fields keep their quotes."""
    return _rows(text.replace('"', '"' * 3), delimiter)


def _has_special_field(text: str) -> bool:
    if not _headed(text, ["ProductID", "Category", "Brand", "Price", "Stock"], r",[ \t]*"):
        return False
    head, *rows = _with_quotes(text)
    if len(rows) != 14:
        return False
    special = next((i for i, r in enumerate(rows) if any(re.match(r'".*[^\d\w\s].*"', f) for f in r)), None)
    return special is not None and all(len(r) == 5 for r in rows[: special + 1])


def _is_quoted_table(text: str) -> bool:
    if not _headed(text, ["StudentID", "Subject", "Grade", "Semester", "Score"], "\t *"):
        return False
    rows = _with_quotes(text, "\t")
    return len(rows) == 4 and all(len(r) == 5 and all(re.fullmatch(r'\s*(?:"|"[\s\S]*")\s*', f) for f in r) for r in rows)


IFBENCH["custom:csv_city"] = scanned(_is_city_table)
IFBENCH["custom:csv_special_character"] = scanned(_has_special_field)
IFBENCH["custom:csv_quotes"] = scanned(_is_quoted_table)


@check("custom:date_format_list")
def dates(t: Column) -> Column:
    """Dates from 1769 to 1821, with days that their month can have (29 in any February); day and month 0 are let through."""

    def fits(date: Column) -> Column:
        year, month, day = (F.regexp_extract(date, r"^(\d{4})-(\d{2})-(\d{2})$", i).try_cast("int") for i in (1, 2, 3))
        most = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).when(month > 0, 31).otherwise(99)
        return F.coalesce(year.between(1769, 1821) & (month <= 12) & (day <= most), F.lit(False))

    return F.forall(F.transform(F.split(stripped(t), ","), stripped), fits)


@check("count:keywords_multiple")
def keyword_counts(t: Column, keyword1: Text, keyword2: Text, keyword3: Text, keyword4: Text, keyword5: Text) -> Column:
    out = F.lit(True)
    for word, n in zip((keyword1, keyword2, keyword3, keyword4, keyword5), (1, 2, 3, 5, 7), strict=True):
        out = out & (occurrences(F.lower(t), F.lower(stripped(arg(word)))) == n)
    return out


@check("words:keywords_specific_position")
def keyword_place(t: Column, keyword: Text, n: Whole, m: Whole) -> Column:
    named = F.filter(tokens(_nth(sentences(t), n)), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return F.coalesce(F.lower(_nth(named, m)) == F.lower(stripped(arg(keyword))), F.lit(False))


@check("words:words_position")
def second_words(t: Column, keyword: Text) -> Column:
    """The second token and the second to last one, not counting one sign at the end."""
    found = F.transform(tokens(t), F.lower)
    last = F.when(_nth(found, -1).rlike(r"^\p{Punct}$"), _nth(found, -3)).otherwise(_nth(found, -2))
    return F.coalesce((_nth(found, 2) == F.lower(stripped(arg(keyword)))) & (last == F.lower(stripped(arg(keyword)))), F.lit(False))


@check("repeat:repeat_change")
def repeated_but_first(t: Column, prompt_to_repeat: Text) -> Column:
    prompt = arg(prompt_to_repeat)
    mine, theirs = words(t), words(prompt)
    return (t != prompt) & (F.slice(mine, 2, F.greatest(F.size(mine), F.lit(1))) == F.slice(theirs, 2, F.greatest(F.size(theirs), F.lit(1))))


@check("repeat:repeat_simple")
def repeated_simply(t: Column) -> Column:
    return F.lower(stripped(t)) == SIMPLE


@check("repeat:repeat_span")
def repeated_span(t: Column, prompt_to_repeat: Text, n_start: Whole, n_end: Whole) -> Column:
    prompt = arg(prompt_to_repeat)
    return F.lower(stripped(t)) == F.lower(stripped(F.substring(prompt, arg(n_start) + 1, arg(n_end) - arg(n_start) + 1)))


@check("format:title_case")
def title_case(t: Column) -> Column:
    def low(w: Column) -> Column:
        rest = F.substring(w, F.lit(2), F.length(w))
        return w.rlike(r"^\p{Ll}") & ((rest == "") | (rest == F.lower(rest)) & (rest != F.upper(rest)) | (rest == F.upper(rest)) & (rest != F.lower(rest)))

    return ~F.exists(tokens(t), low)


@check("format:output_template")
def output_template(t: Column) -> Column:
    return t.contains(TEMPLATE[0]) & t.contains(TEMPLATE[1]) & t.contains(TEMPLATE[2])


@check("format:no_whitespace")
def no_white_space(t: Column) -> Column:
    return ~t.rlike(r"(?U)\s")


# repaired variants

def _terminal(sentence: Column) -> Column:
    """The last character but for closing quotes and brackets."""
    return F.regexp_extract(sentence, r"(?s)(.)\s*[\"'”’»)\]}]*\s*\z", 1)


def repaired_stairs(t: Column) -> Column:
    return all_pairs_next(F.filter(F.split(t, "\n"), lambda x: stripped(x) != ""), lambda a, b: _indent(b) > _indent(a))


def repaired_sentence_types(t: Column) -> Column:
    ends = F.transform(sentences(t), _terminal)
    asked = F.size(F.filter(ends, lambda c: c == "?"))
    return (asked >= 1) & (F.size(F.filter(ends, lambda c: c == ".")) == 2 * asked)


def repaired_second_words(t: Column, keyword: Text) -> Column:
    named = F.transform(F.filter(tokens(t), lambda w: ~w.rlike(r"^[\p{Punct}\p{P}]+$")), F.lower)
    return (F.size(named) >= 2) & (_nth(named, 2) == F.lower(stripped(arg(keyword)))) & (_nth(named, -2) == F.lower(stripped(arg(keyword))))


def repaired_vowels(t: Column) -> Column:
    parts = F.filter(F.split(stripped(t), r"\r?\n[\s&&[^\r\n]]*\r?\n"), lambda p: stripped(p) != "")
    return (F.size(parts) == 1) & _few_vowels(t)


IFBENCH_REPAIRED: dict[str, Check] = IFBENCH | {"format:line_indent": repaired_stairs, "ratio:sentence_type": repaired_sentence_types, "words:words_position": repaired_second_words, "words:vowel": repaired_vowels}
