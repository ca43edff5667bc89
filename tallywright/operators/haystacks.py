"""Needles and chains in haystacks that fill a budget of tokens: as many items as fit, and not one less.

A haystack is an array of items in a row, repeated from its begin when it ends; the fit is one pass over its counts, so nothing is
shuffled and every sample can have a haystack of its own. A counter of tokens is a function from a column of texts to one of counts. It
must be additive over texts that are joined by white space, as it is for all tokenizers that split at white space first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.generators import drawn, number_of

Counter = Callable[[Column], Column]

#: A token is a word, a single digit or a sign.
TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]"

# What the samples say.
NOISE = "The grass is green. The sky is blue. The sun is yellow. Here we go. There and back again."
ONE = ("A special magic {kind} is hidden within the following text. Make sure to memorize it. I will quiz you about the {kind} afterwards.", "What is the special magic {kind} for ", " The special magic {kind} for ", " mentioned in the provided text is")
MANY = ("Some special magic {kind} are hidden within the following text. Make sure to memorize it. I will quiz you about the {kind} afterwards.", "What are all the special magic {kind} for ", " The special magic {kind} for ", " mentioned in the provided text are")
CHAINS = "Memorize and track the chain(s) of variable assignment hidden in the following text.\n"


@dataclass(frozen=True)
class Needles:
    """A kind of needle sample: what the haystack is (noise, essay, needle), what keys and values are, how many of each, how many are asked for."""

    haystack: str
    key: str = "words"
    value: str = "numbers"
    keys: int = 1
    values: int = 1
    asked: int = 1


# The needle subtasks.
SUBTASKS = {
    "niah_single_1": Needles("noise"),
    "niah_single_2": Needles("essay"),
    "niah_single_3": Needles("essay", value="uuids"),
    "niah_multikey_1": Needles("essay", keys=4),
    "niah_multikey_2": Needles("needle"),
    "niah_multikey_3": Needles("needle", key="uuids", value="uuids"),
    "niah_multivalue": Needles("essay", values=4),
    "niah_multiquery": Needles("essay", keys=4, asked=4),
}


def tokens(t: Column) -> Column:
    return F.regexp_count(t, F.lit(TOKEN))


def fitted(counts: Column, left: Column) -> Column:
    """How many items of a row that repeats itself fit into ``left`` tokens, from its begin on; counts are the items' tokens.

    Whole turns first, then items one by one until one doesn't fit. Items without tokens must not be there; without any item, or with
    nothing left, it is 0.
    """
    start = lambda left: F.struct(left.cast("long").alias("left"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("open"))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def step(a: Column, x: Column) -> Column:
        fits = a["open"] & (x <= a["left"])
        return F.struct((a["left"] - F.when(fits, x).otherwise(0)).cast("long").alias("left"), (a["k"] + fits.cast("long")).alias("k"), fits.alias("open"))

    part = F.aggregate(counts, start(left % total), step, lambda a: a["k"])
    return F.when((left > 0) & (total > 0), F.floor(left / total) * F.size(counts) + part).otherwise(F.lit(0)).cast("int")


def around(items: Column, n: Column) -> Column:
    """The first n items of a row that repeats itself."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(items, (i % F.size(items)).cast("int")))).otherwise(F.array().cast("array<string>"))


def inserted(items: Column, spots: Column, texts: list[Column], joint: str) -> Column:
    """Items as one text, with each text before the item at its spot (from 0, in rising order; as many spots as texts)."""
    parts, before = [], F.lit(0)
    for j, text in enumerate(texts):
        at = F.get(spots, F.lit(j))
        parts += [F.slice(items, before + 1, at - before), F.array(text)]
        before = at
    return F.array_join(F.concat(*parts, F.slice(items, before + 1, F.greatest(F.size(items) - before, F.lit(0)))), joint)


def _named(kind: str, *parts: Column) -> Column:
    """A key or value drawn from the parts: two coded words, a number of seven digits, or an identifier of 32 hexadecimal digits."""
    if kind == "numbers":
        return number_of(7, *parts)
    code = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    if kind == "uuids":
        return F.concat_ws("-", *[F.substring(code, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    word = F.translate(code, "0123456789abcdef", "bcdfghjklmnpqrst")
    return F.concat(F.substring(word, 1, 6), F.lit("-"), F.substring(word, 7, 6))


def _said(spec: Needles, key: Column, value: Column) -> Column:
    return F.concat(F.lit(f"One of the special magic {spec.value} for "), key, F.lit(" is: "), value, F.lit("."))


def _rising(k: int, at: Callable[[Column], Column]) -> Column:
    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: at(j).cast("int")))


def needle_samples(samples: DataFrame, spec: Needles, length: int, generated: int = 128, reserve: int = 0, seed: int = 0, count: Counter = tokens) -> DataFrame:
    """(sample_id, input, answer_prefix, outputs, n_items, length, token_position_answer) of samples (sample_id, and haystack for essays).

    An essay's ``haystack`` is an array of its words; needles stand at ends of its sentences, at depths drawn from 40 steps. Noise and
    further needles are made here, and needles stand at drawn lines. ``length`` is the budget: what is generated, what is in reserve for a
    model's template, the prompt and the answer's prefix fit into it, and with one item more they wouldn't. Where not even the needles
    fit, n_items is 0 and the returned length above the budget. Null or empty words are left out; without any the needles stand alone.
    """
    sid, essay = F.col("sample_id"), spec.haystack == "essay"
    names = [_named(spec.key, F.lit(seed), sid, F.lit("key"), F.lit(i)) for i in range(spec.keys)]
    values = [[_named(spec.value, F.lit(seed), sid, F.lit("value"), F.lit(i), F.lit(v)) for v in range(spec.values)] for i in range(spec.keys)]
    # no two needles are alike, so it doesn't matter which stands first
    rows = samples.select("sample_id", *(["haystack"] if essay else []), F.array(*names).alias("_keys"), F.array(*[F.array(*v) for v in values]).alias("_values"))
    key, value = (lambda i: F.get("_keys", F.lit(i))), (lambda i, v: F.get(F.get("_values", F.lit(i)), F.lit(v)))
    texts = [_said(spec, key(i), value(i, v)) for i in range(spec.keys) for v in range(spec.values)]
    single = spec.asked * spec.values == 1
    head, ask, prefix, end = (part.format(kind=spec.value[:-1] if single else spec.value) for part in (ONE if single else MANY))
    asked = key(0) if spec.asked == 1 else F.concat(F.concat_ws(", ", *[key(i) for i in range(spec.asked - 1)]), F.lit(", and "), key(spec.asked - 1))
    rows = rows.select("*", F.concat(F.lit("\n" + ask), asked, F.lit(" mentioned in the provided text?")).alias("_tail"), F.concat(F.lit(prefix), asked, F.lit(end)).alias("answer_prefix"))
    fixed = count(F.concat(F.lit(head + "\n"), F.concat_ws("\n", *texts), "_tail", "answer_prefix"))
    rows = rows.select("*", (F.lit(length - generated - reserve) - fixed).alias("_left"))
    if essay:
        # items have a token or more, so no more than the budget are taken; all words are counted only where the first ones may not fill it
        counted = lambda words: F.filter(F.transform(words, lambda w: F.struct(w.alias("w"), count(w).alias("c"))), lambda x: x["c"] > 0)
        most = max(length - generated - reserve, 0) + 1
        rows = rows.withColumn("_words", F.coalesce("haystack", F.array().cast("array<string>")))
        rows = rows.withColumn("_head", counted(F.slice("_words", 1, 2 * most)))
        rows = rows.withColumn("_counted", F.when((F.size("_head") >= most) | (F.size("_words") <= 2 * most), F.slice("_head", 1, most)).otherwise(counted(F.col("_words"))))
        items = F.col("_counted")["w"]
    elif spec.haystack == "noise":
        items = F.array(F.lit(NOISE))
    else:  # every line has ten tokens or more, so that many are enough
        lines = F.sequence(F.lit(0), F.greatest(F.floor(F.col("_left") / 10), F.lit(0)).cast("int"))
        items = F.transform(lines, lambda i: _said(spec, _named(spec.key, F.lit(seed), sid, F.lit("other key"), i), _named(spec.value, F.lit(seed), sid, F.lit("other"), i)))
    rows = rows.select("*", items.alias("_items"))
    counts = F.col("_counted")["c"] if essay else F.transform("_items", lambda w: count(w))
    rows = rows.select("*", fitted(counts, F.col("_left")).alias("n_items"))
    rows = rows.select("*", around(F.col("_items"), F.col("n_items")).alias("_taken"))
    k = len(texts)
    if essay:
        steps = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda j: F.struct(drawn(F.lit(seed), sid, F.lit("depth"), j).alias("code"), (F.round(j * 100 / 39)).alias("share")))
        ends = F.concat(F.array(F.lit(0)), F.filter(F.transform("_taken", lambda w, i: F.when(w.rlike(r"[.!?][\"')\]]*$"), i + 1)), lambda e: e.isNotNull()))
        rows = rows.select("*", F.slice(F.array_sort(steps), 1, k).alias("_steps"), ends.alias("_ends"))
        # depths are shares of the sentences, as ends of sentences are numbered
        rows = rows.withColumn("_spots", _rising(k, lambda j: F.get("_ends", F.floor((F.size("_ends") - 1) * F.get("_steps", j)["share"] / 100).cast("int"))))
    else:
        rows = rows.withColumn("_spots", _rising(k, lambda j: drawn(F.lit(seed), sid, F.lit("depth"), j) % (F.col("n_items") + 1)))
    whole = F.concat(F.lit(head + "\n"), inserted(F.col("_taken"), F.col("_spots"), texts, " " if essay else "\n"), "_tail")
    outputs = F.flatten(F.slice("_values", 1, spec.asked))
    rows = rows.select("sample_id", whole.alias("input"), "answer_prefix", outputs.alias("outputs"), "n_items")
    answer = F.left("input", F.position(F.get("outputs", F.lit(0)), F.col("input")) - 1)
    return rows.select("*", (count(F.concat("input", "answer_prefix")) + generated + reserve).cast("int").alias("length"), count(answer).cast("int").alias("token_position_answer"))


def chain_samples(chains: DataFrame, lines: int, length: int, generated: int = 30, reserve: int = 0, seed: int = 0, count: Counter = tokens) -> DataFrame:
    """(sample_id, input, answer_prefix, outputs, n_items, length) of chains (sample_id, input of so many lines, outputs, value) among lines of noise that fill the budget."""
    sid = F.col("sample_id")
    prefix = F.concat(F.lit(" Answer: According to the chain(s) of variable assignment in the text above, "), F.size("outputs").cast("string"), F.lit(" variables are assigned the value "), "value", F.lit(", they are: "))
    tail = F.concat(F.lit("\nQuestion: Find all variables that are assigned the value "), "value", F.lit(" in the text above."))
    rows = chains.select("sample_id", "outputs", F.split("input", "\n").alias("_lines"), prefix.alias("answer_prefix"), tail.alias("_tail"))
    fixed = count(F.concat(F.lit(CHAINS + "\n"), F.array_join("_lines", "\n"), "_tail", "answer_prefix"))
    rows = rows.withColumn("n_items", fitted(F.array(count(F.lit(NOISE))), F.lit(length - generated - reserve) - fixed))
    rows = rows.withColumn("_spots", _rising(lines, lambda j: drawn(F.lit(seed), sid, F.lit("depth"), j) % (F.col("n_items") + 1)))
    body = inserted(around(F.array(F.lit(NOISE)), F.col("n_items")), F.col("_spots"), [F.get("_lines", F.lit(j)) for j in range(lines)], "\n")
    rows = rows.select("sample_id", F.concat(F.lit(CHAINS + "\n"), body, "_tail").alias("input"), "answer_prefix", "outputs", "n_items")
    return rows.withColumn("length", (count(F.concat("input", "answer_prefix")) + generated + reserve).cast("int"))
