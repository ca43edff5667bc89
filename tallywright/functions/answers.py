"""Answers out of responses, and verdicts out of judges' replies, as column expressions.

Cues, markers and phrases that are looked for are fixed values of the benchmarks.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.constraints import quoted
from tallywright.functions.text import PUNCTUATION, exact_match_form, strict_number
from tallywright.functions.words import stripped

#: Levels of braces that balanced patterns follow. In texts with more of them, braces inside are masked before (``shallow``).
DEPTH = 12
MASKS = "\ufdd0\ufdd1"


@cache
def balanced(depth: int = DEPTH) -> str:
    """A pattern for text in which braces are balanced, to so many levels."""
    inner = r"[^{}]*+"
    for _ in range(depth):
        inner = rf"(?:[^{{}}]++|\{{{inner}\}})*+"
    return inner


def shallow(t: Column) -> Column:
    """The text with pairs of braces masked from the inside until patterns can follow those that are left; ``unmasked`` undoes it.

    Braces that open a box are never masked, so boxes are found as if patterns followed any depth; only boxes within boxes stay.
    Most texts have fewer braces than DEPTH and are taken as they are.
    """
    opened = F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit("")))
    levels = F.aggregate(
        F.regexp_extract_all(t, F.lit("[{}]"), F.lit(0)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, b: F.struct(F.greatest(s["now"] + F.when(b == "{", 1).otherwise(-1), F.lit(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(b == "{", 1).otherwise(0)).alias("most")),
    )["most"]
    masked = F.aggregate(F.sequence(F.lit(1), levels), t, lambda s, _: F.regexp_replace(s, r"(?<!boxed|fbox)\{([^{}]*)\}", f"{MASKS[0]}$1{MASKS[1]}"))
    return F.when(opened <= DEPTH, t).when(levels <= DEPTH, t).otherwise(masked)


def unmasked(t: Column) -> Column:
    return F.translate(t, MASKS, "{}")


def last_of(t: Column, pattern: str, group: int = 1) -> Column:
    """What the group holds in the last match; null without a match."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), F.lit(-1))


def first_of(t: Column, pattern: str, group: int = 1) -> Column:
    """What the group holds in the first match; null without a match."""
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def after_last(t: Column, part: str) -> Column:
    return F.substring_index(t, part, -1)


# boxed answers

#: What tells an exact boxed expression, and what an approximation.
EXACT, APPROXIMATE = (r"\frac", r"\sqrt", r"\binom", "/", "^"), r"(?i)\\approx|≈|approximately|approx\.?|about"


def boxes(t: Column) -> Column:
    """The contents of all outermost \\boxed{} and \\fbox{}, in order."""
    return F.regexp_extract_all(t, F.lit(rf"(?:boxed|fbox)\{{({balanced()})\}}"))


def unboxed(t: Column) -> Column:
    """Boxes within are replaced by what they hold."""
    return F.regexp_replace(t, rf"\\(?:boxed|fbox)\{{({balanced()})\}}", "$1")


def _has_any(t: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [t.contains(p) for p in parts])


def _bare_decimal(t: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit(r"\displaystyle"), F.lit("")), r"\\[,;:! ]|[$,]", ""), r"(?U)\s+", "")
    return inner.rlike(r"\A[-+]?\d+\.\d+(?:\.\.\.)?\z")


def last_box(t: Column, many: Column | bool = False) -> Column:
    """The last box, or an earlier exact one if the last only approximates it; null without any.

    With ``many`` all boxes of the last line that has some count, joined by commas unless one of them holds a list itself.
    """
    t = shallow(t)
    every = boxes(t)
    last, before = F.try_element_at(every, F.lit(-1)), F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0)))
    prefix = stripped(F.regexp_replace(last, rf"(?s)(?:{APPROXIMATE}).*", ""))
    loose = last.rlike(APPROXIMATE) & ((prefix == "") | (~_has_any(prefix, ("=", *EXACT)) & prefix.rlike(r"\A[\s$(){}\[\].,0-9+\-]+\z")))
    exact = F.try_element_at(F.filter(before, lambda b: ~b.rlike(APPROXIMATE)), F.lit(-1))
    chosen = F.when(loose, F.coalesce(exact, last)).otherwise(last)
    better = F.try_element_at(F.filter(before, lambda b: ~b.rlike(APPROXIMATE) & ~_bare_decimal(b) & _has_any(b, EXACT)), F.lit(-1))
    chosen = F.when(_bare_decimal(chosen), F.coalesce(better, chosen)).otherwise(chosen)
    line = F.try_element_at(F.filter(F.transform(F.split(t, "\n"), boxes), lambda b: F.size(b) > 0), F.lit(-1))
    joined = F.when(F.exists(line, lambda b: b.contains(",")), F.try_element_at(line, F.lit(-1))).otherwise(F.array_join(line, ","))
    many = F.lit(many) if isinstance(many, bool) else many
    return unmasked(stripped(unboxed(F.when(many & (F.size(every) > 1) & line.isNotNull(), joined).otherwise(chosen))))


def last_whole_number(t: Column) -> Column:
    return last_of(t, r"(?U)\b(\d+)\b")


def competition_answer(t: Column, many: Column | bool = False, strict: bool = False) -> Column:
    """The boxed answer; without one, unless ``strict``, the last whole number."""
    box = last_box(t, many)
    return box if strict else F.coalesce(box, last_whole_number(t))


# options

#: How an answer is announced in many languages, in the order in which the cues are tried.
CUES = [
    r"Answer\s*:", "উত্তর\\s*:", "उत्तर\\s*:", "উত্তরঃ", r"Antwort\s*:", r"답변\s*:", r"정답\s*:", r"답\s*:", r"答案\s*：", r"答案\s*:", r"答\s*：", r"答\s*:", r"答复\s*：",
    r"答曰\s*：", "الإجابة:", "الجواب:", "إجابة:", "الإجابة النهائية:", "الإجابة الصحيحة:", "الإجابة الصحيحة هي:", "الإجابة هي:", "الجواب النهائي:", r"Respuesta\s*:",
    r"Risposta\s*:", r"答え\s*:", r"答え\s*：", r"回答\s*:", r"回答\s*：", r"解答\s*:", r"Jawaban\s*:", r"Réponse\s*:", r"Resposta\s*:", r"Jibu\s*:", r"Idahun\s*:",
    r"Ìdáhùn\s*:", r"Idáhùn\s*:", r"Àmọ̀nà\s*:", r"Àdáhùn\s*:", r"Ànúgọ\s*:", r"Àṣàyàn\s*:",
]
#: Letters that stand for A to D.
OPTION_LETTERS = {"A": "أঅＡ", "B": "بবＢ", "C": "جডＣ", "D": "دঢＤ"}
#: Decoration that is taken out before cues are looked for, in order.
DECORATION = ["**", "$\\boxed{", "}$", "\\$", "$\\text{", "$", "\\mathrm{", "\\{", "\\text", "\\(", "\\mathbf{", "{", "\\boxed"]


def undecorated(t: Column) -> Column:
    for part in DECORATION:
        t = F.replace(t, F.lit(part), F.lit(""))
    return t


def announced_option(t: Column) -> Column:
    """A to D (as it is written) behind the first cue, in the order of CUES, that has a letter behind it; '' without one."""
    text = undecorated(t)
    marks = "[A-Dأ-د" + "".join(x for v in OPTION_LETTERS.values() for x in v) + "]"
    found = first_filled(*[F.regexp_extract(text, rf"(?iu){cue}[ \t]*({marks})", 1) for cue in CUES])
    for letter, others in OPTION_LETTERS.items():
        found = F.regexp_replace(found, f"[{others}]", letter)
    return F.coalesce(found, F.lit(""))


def option_cues(options: str) -> list[str]:
    """The patterns that announce one of the options, in the order in which they are tried."""
    o = f"[{options}]"
    plain = [
        "答案是?\\s*", "答案是?\\s*：\\s*", "答案是?\\s*:\\s*", "答案选项应?该?是\\s*", "答案选项应?该?为\\s*", "答案应该?是\\s*", "答案应该?选\\s*", "答案选项为?\\s*：\\s*", "答案选项为?\\s+\\(?\\*?\\*?", "答案选项是?\\s*:\\s*", "答案为\\s*", "答案选\\s*", "选择?\\s*",
    ]
    english = ["answer is:?\\s+\\(?", "answer is:?\\s+\\(?\\*?\\*?", "answer is option:?\\s+\\(?", "correct answer is:?\\s+\\(?", "correct answer is option:?\\s+\\(?"]
    boxed = ["correct answer is", "correct option is", "correct answer option is"]
    return [
        *[f"{p}({o})" for p in plain], f"故选?\\s*({o})只有选?项?\\s?({o})\\s?是?对", *[f"只有选?项?\\s?({o})\\s?{x}" for x in ("是?错", "不?正确", "错误")],
        *[f"说法{x}选?项?的?是\\s?({o})" for x in ("不?对", "不?正确", "错误")], f"({o})\\s?是正确的", f"({o})\\s?是正确答案", f"选项\\s?({o})\\s?正确", f"所以答\\s?({o})", f"所以\\s?({o}[.。$]?$)", f"所有\\s?({o}[.。$]?$)",
        f"[\\s，：:,]({o})[。，,.]?$", f"[\\s，,：:][故即]({o})[。.]?$", f"[\\s，,：:]因此({o})[。.]?$", f"[是为。]\\s?({o})[。.]?$", f"因此\\s?({o})[。.]?$", f"显然\\s?({o})[。.]?$",
        "答案是\\s?(\\S+)(?:。|$)", "答案应该是\\s?(\\S+)(?:。|$)", "答案为\\s?(\\S+)(?:。|$)", f"(?i)ANSWER\\s*:\\s*({o})", *[f"[Tt]he {p}({o})" for p in english], *[f"[Tt]he {p}:?.*?boxed\\{{({o})\\}}" for p in boxed],
        f"[Tt]he answer to the question is:?\\s+\\(?({o})", f"^选项\\s?({o})", f"^({o})\\s?选?项", f"((?:\\s|^){o}[\\s。，,：:.$])", "1.\\s?(.*?)$", f"1.\\s?({o})[.。$]?$", f"({o}):", f"({o})",
    ]


def first_option(t: Column, options: str) -> Column:
    """The option of the first pattern that announces one; the first of ``options`` that is in what it found. '' without one."""
    text = stripped(t)

    def option(found: Column) -> Column:
        return F.coalesce(*[F.when(found.contains(o), o) for o in options])

    return F.coalesce(*[option(first_of(text, "(?s)" + p)) for p in option_cues(options)], F.lit(""))


def lettered(t: Column, letters: str = "A-J") -> Column:
    """The letter behind the first ANSWER:, as it is written; '' without one."""
    return F.regexp_extract(t, rf"(?i)ANSWER\s*:\s*([{letters}])", 1)


# cloze answers

#: What announces an answer in examples.
EXAMPLE_PREFIXES = ("The answer is therefore", "答案是", "The answer is")


def without_example_prefix(t: Column) -> Column:
    """What follows the last announcement, of each kind in order."""
    for p in EXAMPLE_PREFIXES:
        t = F.when(t.startswith(p), stripped(F.substring(t, F.lit(len(p) + 1), F.length(t)))).when(t.contains(p), stripped(after_last(t, p))).otherwise(t)
    return t


def _right_of_equals(t: Column) -> Column:
    return F.when(t.contains("="), F.regexp_replace(after_last(t, "="), "^ +", "")).otherwise(t)


def cloze_answer(t: Column) -> Column:
    """The last box; else what stands between dollars; else what is right of the last =; else the last number. Null without any."""
    text = shallow(without_example_prefix(t))
    boxed = _right_of_equals(last_of(text, rf"(?:\\boxed)\{{({balanced()})\}}"))
    dollars = F.nullif(_right_of_equals(last_of(text, r"(?d)\$(.*)\$")), F.lit(""))
    right = F.substring_index(F.regexp_replace(_right_of_equals(text), r"\.+\z", ""), "\\", 1)
    bare = F.when(text.contains("="), right).otherwise(last_of(text, r"((?:\$)?\d+(?:\.\d+)?(?![\p{L}\p{N}_]))"))
    return unmasked(F.nullif(F.when(text.contains("\\boxed"), boxed).otherwise(F.coalesce(dollars, bare)), F.lit("")))


def first_capital(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, "([A-F])", 1), F.lit(""))


def all_letters(t: Column) -> Column:
    found = F.regexp_extract_all(t, F.lit(r"\(*([A-F])\)*"))
    return F.when(F.size(found) > 0, found)


# numbers

NUMBER = r"-?\d*\.?\d+"


def prefixed_form(number: Column) -> Column:
    """exact_match_form() without what stands before the last '#### '."""
    return exact_match_form(F.regexp_replace(number, r"(?s).*#### ", ""))


def strict_form(t: Column) -> Column:
    return F.when(strict_number(t) == "", "").otherwise(prefixed_form(strict_number(t)))


#: A number with an optional fraction behind it.
FRACTION = r"-?\d+(?:\.\d+)?(?:/\d+)?"


def no_extra_zeros(number: Column) -> Column:
    """3.50 is 3.5 and 3.0 is 3; what is no decimal number stays as it is."""
    value = F.trim(number)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value.rlike(r"^-?\d+(?:\.\d*)?$"), short).otherwise(number)


def marked_number(t: Column) -> Column:
    """The number behind the last #### before any further question; without one, the last number. '' without any."""
    text = F.substring_index(F.replace(F.regexp_replace(t, r"\.+\z", ""), F.lit(","), F.lit("")), "Question", 1)
    marked = last_of(text, r"(?d)####(.*)")
    payload = first_of(F.when(marked.rlike(r"\d"), no_extra_zeros(F.trim(marked))), f"({FRACTION})")
    return F.coalesce(no_extra_zeros(F.coalesce(payload, last_of(text, f"({FRACTION})"))), F.lit(""))


#: Phrases by which a question is found unanswerable.
UNANSWERABLE = [
    "does not provide enough information", "does not specify", "does not provide", "can't provide", "can not provide", "don't know", "do not know", "doesn't specify", "not specify", "not mention", "doesn't mention",
    "don't have enough information", "do not have enough", "not provide", "doesn't provide", "cannot calculate", "can't calculate", "can't determine", "cannot determine", "missing necessary information", "none",
]


def unanswerable(t: Column) -> Column:
    """'None' if the response says so or has no ####, else ''."""
    low = F.lower(F.replace(t, F.lit(","), F.lit("")))
    return F.when(_has_any(low, tuple(UNANSWERABLE)) | ~low.contains("####"), "None").otherwise("")


def perturbed_answer(t: Column, kind: Column) -> Column:
    return F.when(kind == "critical thinking", unanswerable(t)).otherwise(marked_number(t))


def program_output(t: Column) -> Column:
    return F.when(t.contains("```output"), stripped(F.substring_index(after_last(t, "```output"), "```", 1))).otherwise("")


def stated_answer(t: Column) -> Column:
    """A stated final answer; else the last box, what follows 'he answer is', a program's output, or the last number."""
    t = shallow(t)
    final = F.when(t.contains("final answer is $") & t.contains("$. I hope"), stripped(F.regexp_extract(t, r"(?s)final answer is \$(.*?)\$\. I hope", 1)))
    boxed = F.concat(F.regexp_extract(t, rf"(?s).*boxed\{{({balanced()})\}}(?:%?)", 1), F.when(t.rlike(rf"(?s).*boxed\{{{balanced()}\}}%"), "}").otherwise(""))
    said = F.when(t.contains("boxed"), boxed).when(t.contains("he answer is"), stripped(after_last(t, "he answer is")))
    number = last_of(F.replace(t, F.lit(","), F.lit("")), f"({NUMBER})")
    found = F.coalesce(final, said, F.nullif(program_output(t), F.lit("")), number, F.lit(""))
    line = F.substring_index(stripped(found), "\n", 1)
    return unmasked(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "^:+", ""), r"\.+$", ""), "/+$", ""))


# slots

#: What announces an answer in prose, the most specific first.
MARKERS = ("final answers are", "final answer is", "answer is", "answer:")
#: LaTeX that carries no meaning, and delimiters of sets.
WITHOUT_MEANING = ("\\left", "\\right", "\\!", "\\,", "\\;", "\\quad", "\\qquad", "^{\\circ}", "^\\circ", "\\%", "%", "$")
SET_DELIMITERS = {"\\{": "(", "\\}": ")", "\\langle": "(", "\\rangle": ")", "\\lbrace": "(", "\\rbrace": ")"}


def plain_answer(t: Column) -> Column:
    """Without wrappers of text, spacing, sizes, degrees, percents and dollars."""
    for was, now in (("∶", ":"), ("，", ","), ("\\approx", "="), ("\\simeq", "=")):
        t = F.replace(t, F.lit(was), F.lit(now))
    t = F.regexp_replace(t, r"\\(?:text|mathrm|mathbf|textbf|mbox)\s*\{([^{}]*)\}", "$1")
    for part in WITHOUT_MEANING:
        t = F.replace(t, F.lit(part), F.lit(""))
    return stripped(t)


def slot_answer(t: Column) -> Column:
    """The last box; else the paragraph behind the last announcement. Null without either, and if a box is empty."""
    box = last_of(shallow(t), rf"\\(?:boxed|fbox)[^{{]*\{{({balanced()})\}}")
    low = F.lower(t)
    prose = []
    for m in MARKERS:
        at = F.length(low) - F.length(after_last(low, m)) + 1
        tail = F.regexp_replace(stripped(F.substring_index(stripped(F.substring(t, at, F.length(t))), "\n\n", 1)), r"\.+\z", "")
        prose.append(F.when(low.contains(m), F.nullif(plain_answer(tail), F.lit(""))))
    return F.when(box.isNotNull(), F.nullif(plain_answer(unmasked(box)), F.lit(""))).otherwise(F.coalesce(*prose))


def slots(t: Column) -> Column:
    """An answer's parts: cut at commas outside brackets, without white space and dollars around them."""
    for was, now in SET_DELIMITERS.items():
        t = F.replace(t, F.lit(was), F.lit(now))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, c: Column) -> Column:
        cut = (c == ",") & (s["depth"] == 0)
        depth = F.when(c.isin("(", "[", "{"), s["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["part"], c)).alias("part"), F.when(cut, F.array_append(s["done"], s["part"])).otherwise(s["done"]).alias("done"))

    pieces = F.aggregate(F.regexp_extract_all(t, F.lit(r"([^,()\[\]{}]+|[,()\[\]{}])")), start, step, lambda s: F.array_append(s["done"], s["part"]))
    return F.transform(pieces, lambda p: stripped(F.regexp_replace(stripped(p), r"^\$+|\$+$", "")))


# theorem answers

def numbers_only(t: Column) -> Column:
    """Pi as 3.14, percents as hundredths; no currency, degrees or Celsius."""
    t = F.replace(t, F.lit("\\pi"), F.lit("π"))
    for pattern, now in ((r"(?<![\d}])\\?π", "3.14"), (r"(\d)\\?π", "$1*3.14"), (r"\{\\?π\}", "3.14"), (r"\*\\?π", "*3.14")):
        t = F.regexp_replace(t, pattern, now)
    t = F.replace(t, F.lit("%"), F.lit("/100"))
    for part in ("$", "¥", "°C", " C", "°"):
        t = F.replace(t, F.lit(part), F.lit(""))
    return t


def _theorem_form(t: Column, announced: Column) -> Column:
    low = F.lower(t)
    right = numbers_only(stripped(after_last(t, "=")))
    right = F.when(right.rlike(r"^-?[\d.]+\s(?:\D+|\S+)$"), F.substring_index(right, " ", 1)).otherwise(right)
    return (
        F.when(_has_any(low, ("yes", "true")), "True").when(_has_any(low, ("no", "false")), "False").when(low.rlike(r"\([a-f]\)"), t)
        .when(announced, right).otherwise(F.coalesce(last_of(t, f"({NUMBER})"), F.lit("")))
    )


def theorem_answer(t: Column, triggers: tuple[str, ...] = ("The answer is:", "The answer is", "the answer is")) -> Column:
    """What follows the last announcement as True, False, an option in brackets or a number; without one, the last number."""
    text = F.regexp_replace(t, r"\A\n+|\n+\z", "")
    often = reduce(lambda a, b: a | b, [text.rlike(rf"(?s){quoted(p)}.*{quoted(p)}") for p in triggers])
    text = F.when(often, F.substring_index(text, "\n\n", 1)).otherwise(text)
    parts = F.split(text, "|".join(map(quoted, triggers)))
    tail = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\A\n+|\n+\z", ""), r"\.+\z", ""), r"/+\z", ""))
    return F.regexp_replace(F.regexp_replace(_theorem_form(tail, F.size(parts) > 1), r"\.+\z", ""), r"/+\z", "")


# judges

QUALIFIERS = "NOT|PARTIALLY|PARTLY|SEMI|MOSTLY|LARGELY|SOMEWHAT|NEARLY|ALMOST"


def judge_correct(reply: Column) -> Column:
    """Whether the last verdict of the reply is CORRECT, without a qualifier before it."""
    verdict = last_of(F.upper(reply), rf"\b((?:(?:{QUALIFIERS})[\s-]+)?(?:IN)?CORRECT)\b")
    return F.coalesce(verdict == "CORRECT", F.lit(False))


def judge_last(reply: Column) -> Column:
    """struct of correct, confidence and parsed: the last 'correct: yes|no' and the last 'confidence: n'."""
    verdict = last_of(reply, r"(?i)\bcorrect[\s\"'*]*:[\s\"'*]*(yes|no)")
    confidence = last_of(reply, r"(?i)\bconfidence[\s\"'*]*:[\s\"'*]*(\d+)").try_cast("int")
    return F.struct(F.coalesce(F.lower(verdict) == "yes", F.lit(False)).alias("correct"), F.coalesce(confidence, F.lit(100)).alias("confidence"), verdict.isNotNull().alias("parsed"))


def _last_by_key(keys: Column, values: Column, wanted: Column) -> Column:
    """For each wanted key, the last of its values; null without one."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    return F.transform(wanted, lambda w: F.try_element_at(F.filter(pairs, lambda p: p["k"] == w), F.lit(-1))["v"])


VERDICT_LINE = r"(?imd)^[^\w\n]*(?:criterion\s*)?(\d{1,3})\s*[:.)\-]\s*[^\w\n]*(PASS|FAIL)\b(?![^\n]*\b(?:PASS|FAIL)\b)"


def judge_criteria(reply: Column, n: Column) -> Column:
    """array<boolean> of n verdicts: the last PASS or FAIL of each criterion's number; null for those without any."""
    keys = F.transform(F.regexp_extract_all(reply, F.lit(VERDICT_LINE), F.lit(1)), lambda k: k.cast("int"))
    values = F.transform(F.regexp_extract_all(reply, F.lit(VERDICT_LINE), F.lit(2)), lambda v: F.upper(v) == "PASS")
    return F.when(n > 0, _last_by_key(keys, values, F.sequence(F.lit(1), n))).otherwise(F.array().cast("array<boolean>"))


#: A block of verdicts, a verdict in it, and what passes.
VERDICT_BLOCK, VERDICT_PAIR, PASSED = r"(?s)评判结果[\"']?\s*[:：]\s*\{(.+?)\}", r"[\"']?(\d+)[\"']?\s*[:：]\s*[\"']?(是|否|yes|no|YES|NO|Yes|No)", ("是", "yes", "YES", "Yes")


def judge_block(reply: Column, ids: Column) -> Column:
    """array<boolean> for ids (array<string>): the verdicts of the last block that has any of them; null for the others."""
    found = F.regexp_extract_all(reply, F.lit(VERDICT_BLOCK))
    blocks = F.when(F.size(found) > 0, found).otherwise(F.array(reply))
    read = F.transform(blocks, lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(VERDICT_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(b, F.lit(VERDICT_PAIR), F.lit(2)).alias("v")))
    good = F.try_element_at(F.filter(read, lambda r: F.exists(r, lambda p: F.array_contains(ids, p["k"]))), F.lit(-1))
    return F.transform(ids, lambda i: F.try_element_at(F.filter(good, lambda p: p["k"] == i), F.lit(-1))["v"].isin(*PASSED))


def judge_score(reply: Column) -> Column:
    """struct of score (0, 1 or null) and raw: the last answer_score behind the last JSON mark, in a fence if one has it; else the line of the score."""
    region = F.regexp_replace(reply, r"(?s)\A.*【\s*JSON\s*】", "")
    key = r"[\"']?answer_score[\"']?\s*[:：]\s*[\"']?(-?\d+(?:\.\d+)?)"
    fenced = F.try_element_at(F.filter(F.regexp_extract_all(region, F.lit(r"(?s)```[A-Za-z]*\s*\n?(.*?)```")), lambda b: b.contains("answer_score")), F.lit(-1))
    raw = F.when(fenced.isNotNull(), last_of(fenced, key)).otherwise(F.coalesce(last_of(region, key), last_of(reply, r"【\s*评分\s*】\s*[:：]?\s*(-?\d+(?:\.\d+)?)\s*分?")))
    value = raw.try_cast("double")
    return F.struct(F.when(value.isin(0.0, 1.0), value.cast("int")).alias("score"), raw.alias("raw"))


CHECKS_KEY, DECLARATION_KEY = "rubrics_check", "SATISFIED_ALL_REQUIREMENTS"


def judge_object(reply: Column) -> Column:
    """struct of checks (map<string,string>) and satisfied, from the reply as JSON or the first object in it that has one of the keys; null without one."""
    objects = F.regexp_extract_all(reply, F.lit(rf"(\{{{balanced()}\}})"))
    whole = F.when(F.get_json_object(stripped(reply), "$").isNotNull() & stripped(reply).startswith("{"), stripped(reply))
    keyed = F.get(F.filter(objects, lambda o: o.contains(CHECKS_KEY) | o.contains(DECLARATION_KEY)), F.lit(0))
    chosen = F.coalesce(whole, keyed, F.get(F.filter(objects, lambda o: F.get_json_object(o, "$").isNotNull()), F.lit(0)))
    raw = F.get_json_object(chosen, f"$.{CHECKS_KEY}")
    checks = F.from_json(raw, "map<string,string>")
    said = F.coalesce(F.get_json_object(chosen, f"$.{DECLARATION_KEY}"), F.lit("NO"))
    usable = chosen.isNotNull() & (raw.isNull() | raw.startswith("{"))
    return F.when(usable, F.struct(F.coalesce(checks, F.create_map().cast("map<string,string>")).alias("checks"), (F.lower(said) == "yes").alias("satisfied")))


def passes_in_range(checks: Column, rubrics: Column) -> Column:
    """How many of the answers to existing rubrics (keys name_<n>) contain yes."""
    return F.size(F.filter(F.map_entries(checks), lambda e: (F.get(F.split(e["key"], "_"), F.lit(1)).try_cast("int") <= F.size(rubrics)) & F.lower(e["value"]).contains("yes")))


def all_passes(checks: Column) -> Column:
    return F.size(F.filter(F.map_values(checks), lambda v: F.lower(v).contains("yes")))


#: Ways in which a grader writes a score, in the order in which they are tried; case doesn't count.
SCORE_PATTERNS = [
    r'"score":\s*', r"score[\"']?\s*[:=]\s*", r"\*\*final\s+score\*\*:?\s*", r"\*\*score\*\*:?\s*", r"\*\*scoring\*\*:?\s*", r"final\s+score:?\s*", r"score:?\s*", r"scoring:?\s*",
    r"my\s+score:?\s*", r"the\s+score:?\s*", r"overall\s+score:?\s*",
]


def judge_partial(response: Column) -> Column:
    """struct of score (double) and parsed: what the text between the evaluation marks scores, as JSON or loosely; unread is 0."""
    text = stripped(F.substring_index(stripped(after_last(response, "[Evaluation Start]")), "[Evaluation End]", 1))
    in_json = F.get_json_object(F.regexp_extract(text, r"(\{[^}]*\"score\"[^}]*\})", 1), "$.score").try_cast("double")
    score = F.coalesce(in_json, *[first_of(text, rf"(?i){p}([\d.]+)").try_cast("double") for p in SCORE_PATTERNS])
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), score.isNotNull().alias("parsed"))


def answer_line(t: Column) -> Column:
    """All that follows the first line that begins with (final) answer:, or the whole response."""
    return stripped(F.coalesce(first_of(t, r"(?is)(?:^|\n)\s*(?:final\s*)?answer\s*:\s*(.*)\z"), t))


def same_answer(prediction: Column, truth: Column) -> Column:
    return stripped(F.coalesce(prediction, F.lit(""))) == stripped(F.coalesce(truth, F.lit("")))


def turns(conversation: Column) -> Column:
    """array<struct<role, content>> of a conversation in JSON; null if it isn't one."""
    return F.from_json(conversation, "array<struct<role:string,content:string>>")


def object_slice(t: Column, start: str = "{", end: str = "}") -> Column:
    """The JSON object (as a string) in a text: behind a json fence, from the first start to the last end, with single quotes as double ones where that is needed; null if it can't be read."""
    inner = F.when(t.contains("```json"), F.regexp_replace(F.regexp_replace(t, r"(?s)\A.*?```json", ""), "^`+|`+$", "")).otherwise(t)
    cut = F.regexp_extract(inner, rf"(?s)({quoted(start)}.*{quoted(end)})", 1)
    doubled = F.replace(cut, F.lit("'"), F.lit('"'))
    return F.coalesce(F.when(F.try_parse_json(cut).isNotNull(), cut), F.when(F.try_parse_json(doubled).isNotNull(), doubled))


def bare_word(t: Column) -> Column:
    """Without ASCII punctuation, spaces and line feeds around it, in lower case."""
    return F.lower(F.regexp_replace(t, r"\A[\p{Punct} \n]+|[\p{Punct} \n]+\z", ""))


assert set(PUNCTUATION) == set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")  # \p{Punct} means the same
