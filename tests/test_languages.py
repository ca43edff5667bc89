"""Languages by profiles and learned sentence ends."""

from collections import Counter

from pyspark.sql import functions as F

from tallywright.functions import languages
from tallywright.functions.languages import Detector, profiles
from tallywright.functions.sentences import abbreviations, sentences, stop_scores


def test_profiles_and_distances(spark, monkeypatch):
    rows = [("en", "the cat and the dog"), ("en", "the bird"), ("de", "der Hund und die Katze"), ("de", None), (None, "xyz"), ("fr", "")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    for most in (300, 4):
        monkeypatch.setattr(languages, "MOST", most)
        want = {lang: languages.ranked(sum((languages.grams(t) for l, t in rows if l == lang and t), Counter())) for lang in ("en", "de")}
        known = profiles(frame)
        got = {}
        for r in known.collect():
            got.setdefault(r.lang, {})[r.place] = r.gram
        assert {k: [v[p] for p in sorted(v)] for k, v in got.items()} == want
        if most == 300:
            near = Detector(known).nearest(F.col("text"))
            asked = spark.createDataFrame([("the cat",), ("die Katze",), (None,), ("12 !",), ("",)], "text string")
            found = [r.n for r in asked.select(near.alias("n")).collect()]
            assert [n and n.lang for n in found] == ["en", "de", None, None, None] and found[0].distance >= 0
    assert profiles(frame.where("false")).count() == 0 and Detector(profiles(frame.where("false"))).shared.value == {}


def test_held_out_languages_are_told(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = Detector(profiles(docs.where("doc_id % 5 <> 0"))).nearest(F.col("text"))
    asked = docs.where("doc_id % 5 = 0 and lang is not null and length(text) > 40").select("lang", near.alias("near"))
    n, right = asked.agg(F.count("*"), F.count_if(F.col("near.lang") == F.col("lang"))).first()
    assert n > 20 and right / n >= 0.9


CORPUS = """Dr. Smith met Mr. Jones at approx. noon. They spoke of the U.S. economy. Mr. Jones left. Dr. Smith stayed and wrote to Prof. Lee. The prof. was away.
The firm, Acme Inc. of Boston, sold it. It was a large firm. Prof. Lee wrote to Dr. Brown. Mr. Brown was late. The noon train came. They left for Boston. No one stayed. It came late to Boston and was away at noon, so the economy of them all came and left late too."""

MARKED = [
    "Dr. Smith came.|He met Mr. Jones of Acme Inc. in Boston.", "J. R. Smith wrote it.|A. Lee read it!|Why?", "The U.S. economy grew.|It fell.", "He said \"No.\"|She left.", "1. Go home.\n2. Stay.", "It cost 3.50 dollars.|Cheap.",
    "We met at noon.|They left.", "see approx. nine", "No stop at all", "Prof. Lee and Dr. Brown, e.g. both, came.|All of them.",
]


def test_sentences_with_learned_abbreviations(spark):
    scores = stop_scores(spark.createDataFrame([(CORPUS,)] * 10 + [(None,), ("",)], "text string"))
    known = abbreviations(scores)
    assert {"dr", "mr", "u.s"} <= set(known) and not {"noon", "boston", "left", "firm"} & set(known)
    frame = spark.createDataFrame([(m.replace("|", " "), m) for m in MARKED], "text string, marked string")
    wrong = [(r.marked, r.s) for r in frame.select("marked", sentences(F.col("text"), [*known, "prof", "inc", "approx", "e.g"]).alias("s")).collect() if r.s != [x.strip() for x in r.marked.replace("1. Go home.\n2.", "1. Go home.|2.").split("|")]]
    assert not wrong, wrong
    assert sentences(F.col("text"), []) is not None and stop_scores(spark.createDataFrame([], "text string")).count() == 0


def test_numbers_of_grams_rank_as_counted_grams_do():
    from tallywright.functions import languages

    text = "Zebra zoo Ärger " * 3 + " ".join(f"w{chr(0x4E00 + i)}{chr(97 + i % 26)}" for i in range(400)) + " \U0001D400x " + "y" * 50
    want = [languages.code(g) for g in languages.ranked(languages.grams(text))]
    assert languages.commonest(text).tolist() == want and len(want) == languages.MOST and len(languages.commonest("12")) == 0
