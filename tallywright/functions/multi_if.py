"""The instruction checks for texts in many languages: the first family, with its own counts, marks and quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions import constraints
from tallywright.functions.constraints import CHECKS, Check, Text, Whole, related
from tallywright.functions.ifbench import EMOJI
from tallywright.functions.text import loose_forms
from tallywright.functions.words import likely_language, sentences, stripped, word_runs, words

# Signs that join what stands around them when Chinese, Japanese or Korean words are counted, and those scripts.
SIGNS = "\\.!?．/_,{}<>:;$%^&*(+\"'—！，。？、`~@#￥…（）：；《》“”()[]»〔〕-「」"
EASTERN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def eastern_words(t: Column) -> Column:
    """Each character of Chinese, Japanese and Korean is a word, so is each emoji; what is left is cut at white space."""
    text = F.translate(t, SIGNS, "")
    rest = F.regexp_replace(F.regexp_replace(text, EMOJI, ""), EASTERN, " ")
    return F.size(words(rest)) + F.regexp_count(text, F.lit(EASTERN)) + F.regexp_count(text, F.lit(EMOJI))


def word_count(t: Column) -> Column:
    """Thai has no spaces between words: runs of its letters stand in for words."""
    return F.when(likely_language(t).isin("zh", "ja"), eastern_words(t)).otherwise(F.size(word_runs(t)))


def sentence_count(t: Column) -> Column:
    language = likely_language(t)
    eastern = F.regexp_count(t, F.lit(r"[^!?。.！？．\n]+[!?。.！？．]?"))
    hindi = F.size(F.filter(F.split(t, "(?<=[।!?])"), lambda s: stripped(s) != ""))
    thai = F.size(F.filter(F.split(t, r"[\n ]+"), lambda s: stripped(s) != ""))
    return F.when(language.isin("zh", "ja"), eastern).when(language == "hi", hindi).when(language == "th", thai).otherwise(F.size(sentences(t)))


def number_of_words(t: Column, relation: Text, num_words: Whole) -> Column:
    return related(word_count(t), relation, num_words)


def number_of_sentences(t: Column, relation: Text, num_sentences: Whole) -> Column:
    return related(sentence_count(t), relation, num_sentences)


def quotation(t: Column) -> Column:
    """In quotes as English, Chinese or Japanese writes them."""
    return stripped(t).rlike(r'(?s)\A(?:".*"|“.*”|「.*」)\z') & (F.length(stripped(t)) > 1)


MULTI_IF: dict[str, Check] = CHECKS | {"length_constraints:number_words": number_of_words, "length_constraints:number_sentences": number_of_sentences, "startend:quotation": quotation}
MULTI_IF_REPAIRED: dict[str, Check] = MULTI_IF | {k: constraints.REPAIRED[k] for k in ("length_constraints:nth_paragraph_first_word",)}


def strict(name: str, text: Column, registry: dict[str, Check] | None = None, **kwargs: object) -> Column:
    """Whether the response follows the instruction; only an empty one doesn't for being so."""
    return F.coalesce((text != "") & (registry or MULTI_IF)[name](text, **kwargs), F.lit(False))


def loose(name: str, text: Column, registry: dict[str, Check] | None = None, **kwargs: object) -> Column:
    return F.coalesce(F.exists(loose_forms(text), lambda t: (t != "") & (registry or MULTI_IF)[name](t, **kwargs)), F.lit(False))
