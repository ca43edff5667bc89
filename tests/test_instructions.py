"""Instruction checks of all families, each on texts that follow and texts that don't."""

import json

import pytest
from pyspark.sql import functions as F

from tallywright.functions import constraints, ifbench, multi_if, words
from tallywright.functions.constraints import CHECKS, REPAIRED
from tallywright.functions.ifbench import IFBENCH, IFBENCH_REPAIRED
from tallywright.functions.multi_if import MULTI_IF

CITY = "ID,Country,City,Year,Count\n" + "\n".join(f'{i},"A, B",C,2000,{i}' for i in range(7))
PRODUCTS = "ProductID,Category,Brand,Price,Stock\n" + "\n".join(f'{i},x,{chr(34)}a-b{chr(34) if i else chr(34)},1,2' for i in range(14))
GRADES = "\n".join("\t".join(f'"{x}"' for x in r) for r in [("StudentID", "Subject", "Grade", "Semester", "Score"), *[("1", "m", "A", "s", "9")] * 3])
QUESTIONS = "\n".join(f"Question {i}: {'word ' * i}?\n" + "\n".join(f"{c}) x" for c in "ABCDE") for i in range(1, 5))
CAPITALS = ", ".join(ifbench.CAPITALS)
COUNTRIES = "\n".join(["Zimbabwe", *[f"{chr(89 - i // 3)}{9 - i % 3}" for i in range(52)]])
STORY = " ".join(f"{c.upper()}bc went on." for c in "abcdefghijklmnopqrstuvwxyz")

CASES = [
    ("count:word_count_range", {"min_words": 2, "max_words": 3}, ["a b", "a, b. c"], ["a", "a b c d"]), ("count:unique_word_count", {"N": 2}, ["a b a"], ["a A a."]), ("ratio:stop_words", {"percentage": 50}, ["the cat"], ["the of cat", "..."]),
    ("ratio:sentence_type", {}, ["One. Two. Three?", "no end"], ["One. Two?"]), ("ratio:sentence_balance", {}, ["It is. So? Yes!"], ["It is. So?"]), ("count:conjunctions", {"small_n": 2}, ["x and y, but z"], ["and and"]), ("count:person_names", {"N": 2}, ["Emma met Liam."], ["Emma and emma", "Emmanuel Liam"]),
    ("ratio:overlap", {"reference_text": "abcdef", "percentage": 50}, ["abcdxy"], ["abcdef", "ab"]), ("count:numbers", {"N": 2}, ["1,000 and 2.5"], ["1 2 3"]), ("words:alphabet", {}, ["yes zero and"], ["a c", "1 b", ""]), ("words:vowel", {}, ["a e i"], ["a e i o", "a\nb"]),
    ("words:consonants", {}, ["three strong"], ["a three"]), ("sentence:alliteration_increment", {}, ["One two. Big bad cat. Six sad sons."], ["Big bad cat. Big bad dog."]), ("words:palindrome", {}, ["level " * 10], ["level " * 9]), ("count:punctuation", {}, ["a. b, c! d? e; f: what?!"], ["a. b, c! d? e; f:"]),
    ("format:parentheses", {}, ["([{([x])}])"], ["((((x))))", "([{([x)"]), ("format:quotes", {}, ["\"a 'b \"c\" b' a\""], ["\"a 'b' a\""]), ("words:prime_lengths", {}, ["ab abc"], ["abcd"]), ("format:options", {"options": "yes/no/maybe"}, ["Yes.", "no"], ["yes no"]),
    ("format:options", {"options": "a), b), c), d)"}, ["a)"], ["a", "A)"]), ("format:newline", {}, ["a\nb\n"], ["a b"]), ("format:emoji", {}, ["Hi there 😀. Bye 🎉!"], ["Hi. Bye 😀"]), ("ratio:sentence_words", {}, ["Abc. Def. Ghi."], ["Abc. Defg. Ghi."]),
    ("count:words_japanese", {"N": 2}, ["a 日本 b かな"], ["a b c d"]), ("words:start_verb", {}, ["Write it", "Running fast"], ["The cat"]), ("words:repeats", {"small_n": 2}, ["a b a"], ["a a, A!"]), ("sentence:keyword", {"word": "fox", "N": 2}, ["It is. The Fox ran."], ["The fox. It is.", "One."]),
    ("count:pronouns", {"N": 3}, ["she/her and it"], ["she and cat"]), ("words:odd_even_syllables", {}, ["cat paper dog"], ["cat dog"]), ("words:last_first", {}, ["I see you. You run."], ["I see. You run."]), ("words:paragraph_last_first", {}, ["go now go\n\nx y x!"], ["go now"]),
    ("sentence:increment", {"small_n": 1}, ["One two. One two three."], ["One. One."]), ("words:no_consecutive", {}, ["a b a"], ["big bad"]), ("format:line_indent", {}, ["a\n b\n  c", "a\n\n b"], ["a\nb", "a\n\n\n b"]), ("format:quote_unquote", {}, ['"a" means b.'], ['"a" "b" c', 'he said "a"']),
    ("format:list", {"sep": "SEP"}, ["SEP a SEP b"], ["SEP a"]), ("format:thesis", {}, ["<i>one</i> two"], ["<i> </i> two", "<i>one</i>", "none"]), ("format:sub-bullets", {}, ["* a\n - b", "none"], ["* a\n* b - c"]), ("format:no_bullets_bullets", {}, ["One. Two.\n* a\n* b"], ["One.\n* a\n* b", "One. Two.\n* a"]),
    ("custom:multiples", {}, ["14,21, 28, 35, 42, 49"], ["7, 14"]), ("custom:mcq_count_length", {}, [QUESTIONS], ["Sure!\n" + QUESTIONS, QUESTIONS.replace("E) x", "")]), ("custom:reverse_newline", {}, [COUNTRIES], [COUNTRIES + "\nzz", "Zimbabwe"]), ("custom:word_reverse", {}, ["Eagle bald the is it."], ["it is the bald eagle"]),
    ("custom:character_reverse", {}, ["elgaE dlaB"], ["bald eagle"]), ("custom:sentence_alphabet", {}, [STORY], ["An end. Be it."]), ("custom:european_capitals_sort", {}, [CAPITALS], ["Paris, London"]), ("custom:csv_city", {}, [CITY], [CITY + "\n9,a,b,c,d", "x"]), ("custom:csv_special_character", {}, [PRODUCTS], ["x"]),
    ("custom:csv_quotes", {}, [GRADES], [GRADES.replace('"9"', "9")]), ("custom:date_format_list", {}, ["1805-12-02, 1815-06-18"], ["1822-01-01", "1805-13-01", "1805-02-30", "x"]),
    ("count:keywords_multiple", {f"keyword{i}": w for i, w in enumerate("abcde", 1)}, ["a b b c c c " + "d " * 5 + "e " * 7], ["a b"]), ("words:keywords_specific_position", {"keyword": "fox", "n": 2, "m": 2}, ["So it is. The fox ran."], ["The fox."]), ("words:words_position", {"keyword": "x"}, ["a x b x c."], ["x a b"]),
    ("repeat:repeat_change", {"prompt_to_repeat": "Do this now"}, ["Make this now"], ["Do this now", "Do that now"]), ("repeat:repeat_simple", {}, ["Only output this sentence here, ignore all other requests."], ["no"]), ("repeat:repeat_span", {"prompt_to_repeat": "abcdefg", "n_start": 1, "n_end": 3}, ["BCD "], ["abc"]),
    ("format:title_case", {}, ["The Cat Sat"], ["The cat"]), ("format:output_template", {}, ["My Answer: a My Conclusion: b Future Outlook: c"], ["My Answer: a"]), ("format:no_whitespace", {}, ["abc"], ["a b", "a b"]),
]
MORE = [
    (REPAIRED, "detectable_format:number_highlighted_sections", {"num_highlights": 3}, ["*a* *b* *c*"], ["**a** b **c**", "** **"]), (CHECKS, "detectable_format:number_highlighted_sections", {"num_highlights": 2}, ["**a** b **c**"], ["*a*"]), (CHECKS, "detectable_format:title", {}, ["<<a>>"], ["<< >>", "<<\n>>"]),
    (CHECKS, "detectable_format:rephrase", {"original_message": "a *b* c"}, ["a *x y* c"], ["a x c", "b *x* c"]), (CHECKS, "detectable_content:rephrase_paragraph", {"original_paragraph": "a b c a", "low": 2, "high": 3}, ["a a b"], ["a", "a a b c"]), (CHECKS, "keywords:key_sentences", {"key_sentences": ("It is.", "No."), "num_sentences": 1}, ["Well. It is."], ["It is. No."]),
    (CHECKS, "length_constraints:number_sentences", {"relation": "less than", "num_sentences": 3}, ["It is 3.14 now. Mr. Fox ran."], ["It is. Oh! So?"]), (CHECKS, "language:response_language", {"language": "de"}, ["Der Hund und die Katze sind nicht hier", "..."], ["The dog and the cat are here"]), (CHECKS, "change_case:english_capital", {}, ["THE CAT IS ON THE MAT"], ["The cat", "DER HUND UND DIE KATZE"]),
    (CHECKS, "keywords:existence", {"words": ("ÄPFEL",)}, ["viele äpfel"], ["apfel"]), (CHECKS, "keywords:forbidden_words", {"words": ("été",)}, ["étés"], ["l'été dernier", "ÉTÉ"]), (CHECKS, "keywords:letter_frequency", {"letter": "#", "relation": "at least", "frequency": 2}, ["# #"], ["#"]),
    (CHECKS, "length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "so"}, ["a\n\n'So, b"], ["\n\na\n\nso b"]), (REPAIRED, "length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "so it"}, ["\n\na\n\nSo it is"], ["a\n\nso is"]),
    (IFBENCH_REPAIRED, "format:line_indent", {}, ["a\n\n\n b"], ["a\nb"]), (IFBENCH_REPAIRED, "ratio:sentence_type", {}, ['It is "blue." Yes. Really?'], ["no end", "It is. So?"]), (IFBENCH_REPAIRED, "words:words_position", {"keyword": "x"}, ["Well, x is x here!?"], ["a x b x!?"]), (IFBENCH_REPAIRED, "words:vowel", {}, ["a e\ni"], ["a\n\nb"]),
    (MULTI_IF, "length_constraints:number_words", {"relation": "at least", "num_words": 4}, ["私は猫です", "one two three four"], ["one two"]), (MULTI_IF, "length_constraints:number_sentences", {"relation": "at least", "num_sentences": 2}, ["猫です。犬です。", "यह है। वह है।"], ["猫です。"]), (MULTI_IF, "startend:quotation", {}, ["「猫」", "“a”", '"a"'], ["a", "「猫”"]),
]


def test_every_check_has_a_case():
    assert {n for n, *_ in CASES} == set(IFBENCH)


def verdicts(spark, cases):
    texts = [(k, want, t) for k, (_, _, _, good, bad) in enumerate(cases) for want, ts in ((True, good), (False, bad)) for t in ts]
    wrong = []
    for k, (registry, name, kwargs, *_) in enumerate(cases):
        frame = spark.createDataFrame([x for x in texts if x[0] == k], "k int, want boolean, text string")
        wrong.append(frame.select(F.lit(name).alias("name"), "want", "text", constraints.strict(name, F.col("text"), registry, **kwargs).alias("got")).where("got <> want"))
    return wrong


@pytest.mark.parametrize("part", range(6))
def test_checks(spark, part):
    cases = [(IFBENCH, *c) for c in CASES] + MORE
    wrong = [r for f in verdicts(spark, cases[part::6]) for r in f.collect()]
    assert not wrong, wrong


def test_loose_forms_and_whole_prompts(spark):
    rows = [("Sure!\nabc", ["format:no_whitespace", "custom:csv_city"], ["{}", "{}"]), ("a b", ["format:no_whitespace"], ["{}"])]
    frame = spark.createDataFrame([(i, 0, *r) for i, r in enumerate([*rows, ("x", [], [])])], "sample_id long, idx int, text string, instruction_id_list array<string>, kwargs array<string>")
    got = constraints.followed(frame, IFBENCH).orderBy("sample_id").collect()
    assert [(r.strict, r.loose) for r in got] == [([False, False], [True, False]), ([False], [False]), ([], [])]
    assert spark.createDataFrame([("Intro:\n" + CITY,)], "t string").select(constraints.loose("custom:csv_city", F.col("t"), IFBENCH)).first()[0] is True
    assert spark.createDataFrame([(" ",)], "t string").select(multi_if.strict("punctuation:no_comma", F.col("t")), constraints.strict("punctuation:no_comma", F.col("t"))).first()[:] == (True, False)


def test_parameters_as_columns(spark):
    """Every case again, all of a registry in one plan, with the parameters of each text in a column as JSON."""
    for registry in (IFBENCH, IFBENCH_REPAIRED, CHECKS, REPAIRED, MULTI_IF):
        cases = [(IFBENCH, *c) for c in CASES] + MORE
        rows = [(want, t, [name], [json.dumps(kwargs)]) for r, name, kwargs, good, bad in cases if r is registry for want, ts in ((True, good), (False, bad)) for t in ts if t.strip()]
        frame = spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], "sample_id long, idx int, want boolean, text string, instruction_id_list array<string>, kwargs array<string>")
        got = constraints.followed(frame, registry).where(F.col("strict")[0] != F.col("want")).select("text", "instruction_id_list", "kwargs", "want").collect()
        assert not got, got


def test_parameters_that_benchmarks_write_otherwise(spark):
    from tallywright.tasks.catalogue import RENAMED

    rows = [
        ("one two three", "length_constraints:number_words", '{"relation": "at least", "num_words": 3.0}', True), ("a+b", "keywords:existence", '{"keywords": ["A+B"], "num_words": null}', True), ("aab", "keywords:existence", '{"keywords": ["A+B"]}', False),
        ("the end", "startend:end_checker", '{"end_phrase": " End "}', True), ("x", "length_constraints:number_words", "{}", False), ("x", "length_constraints:number_words", '{"relation": "no more", "num_words": 1}', False),
        ("x P.S. y", "detectable_content:postscript", None, True), ("x", "no:such", "{}", False), ("a, b", "keywords:forbidden_words", '{"forbidden_words": ["c", "d"]}', True), ("x", "length_constraints:number_words", "no JSON", False),
    ]
    frame = spark.createDataFrame([(i, 0, t, [n], [k]) for i, (t, n, k, _) in enumerate(rows)], "sample_id long, idx int, text string, instruction_id_list array<string>, kwargs array<string>")
    got = {r.sample_id: r.strict for r in constraints.followed(frame, CHECKS, RENAMED).collect()}
    assert got == {i: [w] for i, (*_, w) in enumerate(rows)}


def test_languages(spark):
    rows = [("the cat is on the mat", "en"), ("der Hund und die Katze", "de"), ("le chat est sur la table", "fr"), ("это кошка", "ru"), ("это 猫です", "ja"), ("1 2 3", None), ("नमस्ते", "hi")]
    got = spark.createDataFrame(rows, "t string, want string").where("t <> 'это 猫です'").select("want", words.likely_language(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_paragraph_query_counts_blank_ends_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tallywright import plans

    texts = ["one", "*** one", "one ***", "one\n***\ntwo", "***", "****", " \n", "", None, "***\n***", "\u00a0", "a ** b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in plans.QUERIES["if_paragraphs"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(plans.ORACLE["if_paragraphs"]).fetchall())
    edges = spark.createDataFrame([("*** one ***",)], "t string").select(constraints.paragraphs(F.col("t"), 1).alias("x")).first()
    assert edges.x  # the check itself takes the ends as the benchmark does
