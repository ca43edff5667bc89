"""Loaders of benchmarks from staged files: name -> loader of (session, folder, options) that gives a Dataset.

A folder holds files as they are published: <split>.parquet, <split>-00000-of-00001.parquet, .jsonl, .json or .csv, perhaps gzipped, in
a folder of the configuration's name if there are several; single files have the names that they are published under. All is read by
Spark, so any file system that Spark knows will do. Loaders check what would otherwise give a score over nothing: an empty test
split, a missing column, an unknown subset.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from base64 import b64decode
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.words import stripped
from tallywright.sources import archives
from tallywright.sources.tables import Dataset

Loader = Callable[..., Dataset]
LOADERS: dict[str, Loader] = {}


def loader(name: str) -> Callable[[Loader], Loader]:
    def add(f: Loader) -> Loader:
        LOADERS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, folder: str, **options: object) -> Dataset:
    """The benchmark of this name; its test split must hold something."""
    if name not in LOADERS:
        raise ValueError(f"no benchmark named {name}")
    data = LOADERS[name](spark, folder.rstrip("/"), **options)
    if data.test is None or data.test.isEmpty():
        raise ValueError(f"{name}: the test split is missing or empty")
    return data


# files


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order; none if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def read(spark: SparkSession, paths: list[str], **options: object) -> DataFrame:
    """Files of one kind, by their names' ending."""
    kind = re.search(r"\.(parquet|jsonl|json|csv)(?:\.gz)?$", paths[0])
    if kind is None:
        raise ValueError(f"{paths[0]}: not a kind of file that can be read")
    if kind[1] == "parquet":
        return spark.read.parquet(*paths)
    if kind[1] == "csv":
        return csv(spark, paths, **options)
    return spark.read.option("multiLine", kind[1] == "json").json(paths)


def csv(spark: SparkSession, paths: str | list[str], **options: object) -> DataFrame:
    """All columns as strings; quotes are doubled in quoted fields, which may hold line ends."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', inferSchema=False, **options).csv(paths)


def hub(spark: SparkSession, folder: str, config: str | None = None, **options: object) -> Dataset:
    """All splits of a configuration: files are grouped by the name before -00000-of-00001 or the ending."""
    base = f"{folder}/{config}" if config else folder
    splits: dict[str, list[str]] = {}
    for path in listed(spark, f"{base}/*"):
        if m := re.match(r"([A-Za-z]\w*?)(?:-\d+-of-\d+)?\.(?:parquet|jsonl|json|csv)(?:\.gz)?$", path.rsplit("/", 1)[-1]):
            splits.setdefault(m[1], []).append(path)
    if not splits:
        raise FileNotFoundError(f"{base}: no splits")
    return Dataset({name: read(spark, paths, **options) for name, paths in splits.items()})


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def united_splits(parts: list[Dataset]) -> Dataset:
    names = dict.fromkeys(s for p in parts for s in p.splits)
    return Dataset({s: united([p.splits[s] for p in parts if s in p.splits]) for s in names})


def each_split(data: Dataset, change: Callable[[DataFrame], DataFrame]) -> Dataset:
    return Dataset({k: change(v) for k, v in data.splits.items()})


def only_split_as_test(data: Dataset) -> Dataset:
    """What is published as train is what is evaluated, if there is no test split."""
    return data if "test" in data.splits else data.evaluated_on("train")


def required(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def selected(given: list[str] | None, known: list[str], what: str) -> list[str]:
    """The known names among the given ones, in the known order; all without any. Unknown names and an empty list are errors."""
    if given is None:
        return known
    if not given or (unknown := sorted(set(given) - set(known))):
        raise ValueError(f"unknown or no {what}: {unknown if given else given}")
    return [k for k in known if k in set(given)]


def trimmed(*columns: str) -> Callable[[DataFrame], DataFrame]:
    def change(df: DataFrame) -> DataFrame:
        return required(df, *columns).withColumns({c: stripped(F.col(c).cast("string")) for c in columns})

    return change


def unzipped(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(name, text) of an archive's members whose name matches a pattern, a task a member.

    On storage that Arrow has no file system for, Spark hands the archive over in one row, which bounds it to 2 GB.
    """
    try:
        archives.placed(path)
    except ValueError:
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lambda frames: _of_archives(frames, member), "name string, text string")
    return archives.members(spark, [path], member).select("name", "text")


def _of_archives(frames: Iterator[pd.DataFrame], member: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame.content:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    if not info.is_dir() and re.search(member, archives.name_of(info)):
                        yield pd.DataFrame({"name": [archives.name_of(info)], "text": [archive.read(info).decode("utf-8-sig")]})


# competitions: a problem and a short answer

for _name in ("aime_2024", "aime_2026", "apex_2025", "apex_shortlist_2025", "brumo_2025", "cmimc_2025", "hmmt_feb_2025", "hmmt_feb_2026", "hmmt_nov_2025", "smt_2025", "math_500"):

    @loader(_name)
    def _(spark: SparkSession, folder: str) -> Dataset:
        return only_split_as_test(each_split(hub(spark, folder), trimmed("problem", "answer")))


@loader("aime_2025")
def aime_2025(spark: SparkSession, folder: str) -> Dataset:
    """Both parts of the contest."""
    parts = [hub(spark, folder, config) for config in ("AIME2025-I", "AIME2025-II")]
    return only_split_as_test(each_split(united_splits(parts), trimmed("question", "answer")))


@loader("imo_answer_bench")
def imo_answer_bench(spark: SparkSession, folder: str) -> Dataset:
    rows = csv(spark, f"{folder}/answerbench_v2.csv").withColumnsRenamed({"Problem": "problem", "Short Answer": "answer"})
    return Dataset({"train": rows, "test": rows})


@loader("hendrycks_math")
def hendrycks_math(spark: SparkSession, folder: str) -> Dataset:
    subjects = ["algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus"]
    return united_splits([hub(spark, folder, s) for s in subjects])


# published as they are read

for _name, _columns in {
    "gsm8k": ("question", "answer"), "gsm1k": ("question", "answer"), "human_eval": ("prompt", "test", "entry_point"), "mbpp": ("task_id", "text", "code", "test_list"),
    "mmlu": ("question", "subject", "choices", "answer"), "mmlu_pro": ("question", "options", "answer", "category"), "openbookqa": ("question_stem", "choices", "answerKey"), "scitarc": ("question", "answer", "relevant_tables"),
}.items():

    @loader(_name)
    def _(spark: SparkSession, folder: str, eval_split: str | None = None, columns: tuple[str, ...] = _columns, config: str | None = {"gsm8k": "main", "mmlu": "all"}.get(_name)) -> Dataset:
        data = only_split_as_test(hub(spark, folder, config if config and listed(spark, f"{folder}/{config}") else None))
        data = data.evaluated_on(eval_split) if eval_split else data
        required(data.test, *columns)
        return data


@loader("gsm_plus")
def gsm_plus(spark: SparkSession, folder: str, split: str = "test") -> Dataset:
    if split not in ("test", "testmini"):
        raise ValueError("gsm_plus has the splits test and testmini")
    rows = hub(spark, folder).splits[split]
    return Dataset({"test": required(rows, "question", "solution", "perturbation_type")})


@loader("hellaswag")
def hellaswag(spark: SparkSession, folder: str, eval_split: str = "validation") -> Dataset:
    return hub(spark, folder).evaluated_on(eval_split)


@loader("theoremqa")
def theoremqa(spark: SparkSession, folder: str) -> Dataset:
    """Pictures stay as they are stored; nothing decodes them."""
    data = only_split_as_test(hub(spark, folder))
    required(data.test, "Question", "Answer", "Answer_type")
    return data


for _name in ("ifeval", "ifbench"):

    @loader(_name)
    def _(spark: SparkSession, folder: str) -> Dataset:
        data = only_split_as_test(hub(spark, folder))
        required(data.test, "key", "prompt", "instruction_id_list", "kwargs")
        return data


@loader("advanced_if")
def advanced_if(spark: SparkSession, folder: str) -> Dataset:
    data = only_split_as_test(hub(spark, folder))
    required(data.test, "conversation_history", "benchmark_name", "prompt_metadata")
    return data


@loader("gpqa_diamond")
def gpqa_diamond(spark: SparkSession, folder: str) -> Dataset:
    return Dataset({"test": csv(spark, f"{folder}/gpqa_diamond.csv")})


@loader("simpleqa_verified")
def simpleqa_verified(spark: SparkSession, folder: str) -> Dataset:
    rows = csv(spark, f"{folder}/simpleqa_verified.csv")
    typed = {"original_index": F.col("original_index").cast("int"), **{c: F.col(c).cast("boolean") for c in ("multi_step", "requires_reasoning") if c in rows.columns}}
    return Dataset({"test": required(rows, "problem", "answer").withColumns(typed)})


# choices


def _arc(spark: SparkSession, folder: str, config: str, eval_split: str | None) -> Dataset:
    def change(df: DataFrame) -> DataFrame:
        place = F.array_position(F.col("choices.label"), stripped("answerKey")) - 1
        checked = F.when(place >= 0, place.cast("int")).otherwise(F.raise_error(F.lit("the answer is no label of a choice")))
        return df.select("question", F.col("choices.text").alias("choices"), checked.alias("answer"))

    data = hub(spark, folder, config)
    return each_split(data.evaluated_on(eval_split) if eval_split else data, change)


@loader("arc_challenge")
def arc_challenge(spark: SparkSession, folder: str, eval_split: str | None = None) -> Dataset:
    """Choices as an array of texts, the answer as its place from 0."""
    return _arc(spark, folder, "ARC-Challenge", eval_split)


@loader("arc_easy")
def arc_easy(spark: SparkSession, folder: str, eval_split: str | None = None) -> Dataset:
    return _arc(spark, folder, "ARC-Easy", eval_split)


def subjects_of(spark: SparkSession, folder: str) -> list[str]:
    return [p.rsplit("/", 1)[-1] for p in listed(spark, f"{folder}/*") if "." not in p.rsplit("/", 1)[-1]]


@loader("c_eval")
def c_eval(spark: SparkSession, folder: str, subjects: list[str] | None = None) -> Dataset:
    """All subjects (a configuration each), with the subject as a column."""
    chosen = selected(subjects, subjects_of(spark, folder), "subjects")
    return united_splits([each_split(hub(spark, folder, s), lambda df, s=s: df.withColumn("subject", F.lit(s))) for s in chosen])


def _csv_rows(texts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of CSV texts (name, text) with the wanted columns, renamed; an archive's member is one text of bounded size."""
    import csv as reader

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, text in zip(frame.name, frame.text, strict=True):
                rows = [{new: (r.get(old) or "").strip() for old, new in columns.items()} | {"name": name} for r in reader.DictReader(io.StringIO(text))]
                if rows:
                    yield pd.DataFrame(rows)[["name", *columns.values()]]

    return texts.mapInPandas(parse, ", ".join(f"{c} string" for c in ("name", *columns.values())))


@loader("cmmlu")
def cmmlu(spark: SparkSession, folder: str, subjects: list[str] | None = None) -> Dataset:
    """An archive with a CSV file for each split and subject."""
    paths = listed(spark, folder) if folder.endswith(".zip") else listed(spark, f"{folder}/*.zip")
    if not paths:
        raise FileNotFoundError(f"{folder}: no archive")
    columns = {"Question": "question", "A": "A", "B": "B", "C": "C", "D": "D", "Answer": "answer"}
    rows = _csv_rows(unzipped(spark, paths[0], r"data/(?:dev|test)/\w+\.csv$"), columns)
    rows = rows.withColumn("subject", F.regexp_extract("name", r"(\w+)\.csv$", 1)).withColumn("split", F.regexp_extract("name", r"data/(dev|test)/", 1))
    rows = rows.where(F.col("subject").isin(*subjects)) if subjects else rows
    return Dataset({s: rows.where(F.col("split") == s).drop("name", "split") for s in ("dev", "test")})


# Subjects of the multi-subject exam by category, and what another release files elsewhere.
SUBJECTS = {
    "stem": """
        abstract_algebra anatomy astronomy college_biology college_chemistry college_computer_science college_mathematics college_physics computer_security
        conceptual_physics electrical_engineering elementary_mathematics high_school_biology high_school_chemistry high_school_computer_science
        high_school_mathematics high_school_physics high_school_statistics machine_learning
    """,
    "humanities": """
        formal_logic high_school_european_history high_school_us_history high_school_world_history international_law jurisprudence logical_fallacies
        moral_disputes moral_scenarios philosophy prehistory professional_law world_religions
    """,
    "social_sciences": """
        econometrics high_school_geography high_school_government_and_politics high_school_macroeconomics high_school_microeconomics
        high_school_psychology human_sexuality professional_psychology public_relations security_studies sociology us_foreign_policy
    """,
    "other": """
        business_ethics clinical_knowledge college_medicine global_facts human_aging management marketing medical_genetics miscellaneous nutrition
        professional_accounting professional_medicine virology
    """,
}
CATEGORY_OF = {s: c for c, subjects in SUBJECTS.items() for s in subjects.split()}
OTHERWISE = {"anatomy": "other"}
LOCALES = "ar_xy bn_bd de_de es_la fr_fr hi_in id_id it_it ja_jp ko_kr pt_br sw_ke yo_ng zh_cn".split()


def category(subject: Column, exceptions: dict[str, str] | None = None) -> Column:
    """The category of a subject; an unknown one is other."""
    pairs = CATEGORY_OF | (exceptions or {})
    known = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.element_at(known, subject), F.lit("other"))


@loader("mmmlu")
def mmmlu(spark: SparkSession, folder: str, locales: list[str] | None = None, categories: list[str] | None = None) -> Dataset:
    """A CSV file a locale; answers as letters, subjects without file names, with category and locale."""
    parts = []
    for locale in selected([x.lower().replace("-", "_") for x in locales] if locales else None, LOCALES, "locales"):
        file = "mmlu_" + locale.upper().replace("_", "-") + ".csv"
        paths = listed(spark, f"{folder}/test/{file}") or listed(spark, f"{folder}/{file}")
        if paths:
            parts.append(csv(spark, paths).withColumn("Locale", F.lit(locale)))
        elif locales:
            raise FileNotFoundError(f"{folder}: no {file}")
    if not parts:
        raise FileNotFoundError(f"{folder}: no locale's file")
    rows, answer = united(parts), F.upper(stripped("Answer"))
    letter = F.when(answer.rlike("^[ABCD]$"), answer).when(answer.rlike("^[0-3]$"), F.substring(F.lit("ABCD"), answer.cast("int") + 1, F.lit(1))).otherwise("")
    rows = rows.withColumn("Subject", F.regexp_replace(stripped("Subject"), r"_test(?:\.csv|-).*$", "")).withColumn("Answer", letter)
    rows = rows.withColumn("Category", category(F.col("Subject"))).drop("_c0", "Unnamed: 0")
    if categories is not None:
        rows = rows.where(F.col("Category").isin(*selected([c.strip().lower() for c in categories], list(SUBJECTS), "categories")))
    return Dataset({"test": rows})


PLATINUM_COLUMNS = ["cleaning_status", "original_target", "platinum_parsing_strategy", "platinum_prompt", "platinum_prompt_no_cot", "platinum_target"]


@loader("platinum_bench")
def platinum_bench(spark: SparkSession, folder: str) -> Dataset:
    """All subsets with the subset as a column; rows that were rejected in cleaning are left out, and none may be left empty by that."""
    parts = []
    for subset in subjects_of(spark, folder):
        data = each_split(hub(spark, folder, subset), lambda df, s=subset: required(df, *PLATINUM_COLUMNS).where("cleaning_status is null or cleaning_status <> 'rejected'").select(*PLATINUM_COLUMNS, F.lit(s).alias("subset")))
        if empty := [k for k, v in data.splits.items() if v.isEmpty()]:
            raise ValueError(f"platinum_bench: {subset} has no rows left in {empty}")
        parts.append(data)
    return united_splits(parts)


# The exams' subsets by what kind of answer they want.
ENGLISH_QA = "lsat-ar lsat-lr lsat-rc logiqa-en sat-math sat-en aqua-rat sat-en-without-passage gaokao-english".split()
CHINESE_QA = "logiqa-zh jec-qa-kd jec-qa-ca gaokao-chinese gaokao-geography gaokao-history gaokao-biology gaokao-chemistry gaokao-physics gaokao-mathqa".split()
ENGLISH_CLOZE, CHINESE_CLOZE, MANY_LETTERS = ["math"], ["gaokao-mathcloze"], ["jec-qa-kd", "jec-qa-ca", "gaokao-physics"]
EXAMS = [*ENGLISH_QA, *CHINESE_QA, *ENGLISH_CLOZE, *CHINESE_CLOZE]


@loader("agieval")
def agieval(spark: SparkSession, folder: str, subsets: list[str] | None = None) -> Dataset:
    """A JSONL file a subset. Labels in lists of one are unwrapped; cloze subsets have no options; the other fields are kept as JSON."""
    parts = []
    for subset in selected(subsets, EXAMS, "subsets"):
        text = spark.read.text(f"{folder}/{subset}.jsonl").where(stripped("value") != "").select(F.col("value").alias("v"))
        label, field = F.get_json_object("v", "$.label"), lambda k: F.get_json_object("v", f"$.{k}")
        listed_labels = F.from_json(F.when(label.startswith("["), label), "array<string>")
        one = F.when(F.size(listed_labels) > 1, F.raise_error(F.lit("a label of several"))).when(listed_labels.isNotNull(), F.get(listed_labels, F.lit(0))).otherwise(label)
        options = F.from_json(field("options"), "array<string>")
        if subset not in (*ENGLISH_CLOZE, *CHINESE_CLOZE):
            options = F.coalesce(options, F.raise_error(F.lit("a question without options")))
        parts.append(text.select(F.lit(subset).alias("subset"), field("passage").alias("passage"), field("question").alias("question"), F.coalesce(options, F.array().cast("array<string>")).alias("options"), one.alias("label"), field("answer").alias("answer"), field("other").alias("other")))
    return Dataset({"test": united(parts)})


# documents, instructions, conversations


@loader("aa_lcr")
def aa_lcr(spark: SparkSession, folder: str) -> Dataset:
    """Questions from a CSV file, each with its documents from an archive, in the order in which the question names them."""
    rows = csv(spark, f"{folder}/AA-LCR_Dataset.csv").withColumn("document_category", stripped(F.coalesce("document_category", F.lit("")))).withColumn("document_set_id", stripped(F.coalesce("document_set_id", F.lit(""))))
    names = F.filter(F.transform(F.split(F.coalesce("data_source_filenames", F.lit("")), ";"), stripped), lambda n: n != "")
    texts = unzipped(spark, f"{folder}/extracted_text/AA-LCR_extracted-text.zip", r"\.\w+$").withColumn("key", F.regexp_extract("name", r"([^/]+/[^/]+/[^/]+)$", 1))
    wanted = rows.select("question_id", F.posexplode(names).alias("at", "file"), F.concat_ws("/", "document_category", "document_set_id").alias("set")).withColumn("key", F.concat_ws("/", "set", "file"))
    found = wanted.join(texts.select("key", "text"), "key", "left").withColumn("text", F.coalesce("text", F.raise_error(F.concat(F.lit("no document "), F.col("key")))))
    packed = found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("documents"))  # a question's few documents
    out = rows.join(packed, "question_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))
    return Dataset({"test": out.withColumns({c: F.col(c).cast("int") for c in ("question_id", "input_tokens")})})


def _decrypted(text: Column, password: Column) -> Column:
    """Base64 text, XORed with the SHA-256 of a password over and over."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, passwords: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(texts, passwords, strict=True):
            raw, key = b64decode(t or ""), hashlib.sha256((p or "").encode()).digest()
            out.append(bytes(a ^ key[i % len(key)] for i, a in enumerate(raw)).decode())
        return pd.Series(out)

    return of(text, password)


@loader("browsecomp")
def browsecomp(spark: SparkSession, folder: str) -> Dataset:
    rows = required(csv(spark, folder if folder.endswith(".csv") else f"{folder}/browse_comp_test_set.csv"), "problem", "answer", "canary")
    topic = F.coalesce(F.col("problem_topic"), F.lit("")) if "problem_topic" in rows.columns else F.lit("")
    return Dataset({"test": rows.select(_decrypted(F.col("problem"), F.col("canary")).alias("problem"), _decrypted(F.col("answer"), F.col("canary")).alias("answer"), topic.alias("problem_topic"))})


@loader("complex_constraints")
def complex_constraints(spark: SparkSession, folder: str, most: int = 40) -> Dataset:
    """criterion_1 to criterion_40 become one array of those that aren't blank; other criterion columns are an error."""
    rows = csv(spark, folder if folder.endswith(".csv") else f"{folder}/ComplexConstraints_benchmark_set.csv")
    columns = [f"criterion_{i}" for i in range(1, most + 1)]
    required(rows, *columns)
    if extra := [c for c in rows.columns if c.startswith("criterion_") and c not in columns]:
        raise ValueError(f"unexpected columns: {extra}")
    criteria = F.filter(F.array(*[stripped(c) for c in columns]), lambda c: c.isNotNull() & (c != ""))
    return Dataset({"test": rows.withColumn("criteria", criteria).drop(*columns)})


@loader("drop")
def drop(spark: SparkSession, folder: str) -> Dataset:
    """Gzipped JSON lines; dev is what is evaluated."""

    def rows(split: str) -> DataFrame:
        df = spark.read.json(f"{folder}/drop_v0_{split}.jsonl.gz")
        return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in ("context", "completion", "ref_text")])

    return Dataset({"train": rows("train"), "test": rows("dev")})


@loader("hle")
def hle(spark: SparkSession, folder: str, text_only: bool = True) -> Dataset:
    """Questions without a picture, unless ``text_only`` is off; pictures of previews and rationales are left out."""
    data = each_split(hub(spark, folder), lambda df: required(df, "image", "image_preview", "rationale_image").drop("image_preview", "rationale_image"))
    return each_split(data, lambda df: df.where("image is null or image = ''")) if text_only else data


@loader("iheval")
def iheval(spark: SparkSession, folder: str) -> Dataset:
    """A JSON file a cell (category/subtask/setting/variant); tools and answers stay JSON, as their shape varies."""
    paths = [p for s in ("reference", "aligned", "conflict") for p in listed(spark, f"{folder}/iheval/*/*/{s}/*/input_data.json")]
    if not paths:
        raise FileNotFoundError(f"{folder}: no cells")
    raw = spark.read.text(paths, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+/[^/]+/[^/]+)/input_data\.json$", 1).alias("cell"))
    rows = raw.select("cell", F.explode(F.from_json("value", "array<string>")).alias("v"))
    part = F.split("cell", "/")
    field = lambda k: F.get_json_object("v", f"$.{k}")
    history = F.coalesce(F.from_json(field("conversation_history"), "array<string>"), F.array().cast("array<string>"))
    return Dataset({"test": rows.select(
        F.concat("cell", F.lit("#"), field("id")).alias("uid"), *[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("category", "subtask", "setting", "variant"))], field("id").alias("sample_id"),
        F.coalesce(field("system"), F.lit("")).alias("system"), history.alias("conversation_history"), field("instruction").alias("instruction"), F.coalesce(field("tool"), F.lit("")).alias("tool_json"),
        field("answer").alias("answer_json"),
    )})


@loader("inverse_ifeval")
def inverse_ifeval(spark: SparkSession, folder: str, language: str | None = None) -> Dataset:
    if language not in (None, "chinese", "english"):
        raise ValueError(f"unknown language {language}")
    rows = required(spark.read.option("multiLine", True).json(f"{folder}/Inverse_IFEval_Dataset.json"), "instruction_types", "prompt", "response_reference", "language", "judge_prompt_template", "judge_system_prompt")
    return Dataset({"test": rows.where(F.col("language") == language) if language else rows})


RELEASES = {f"release_v{n}": ["test.jsonl", *[f"test{i}.jsonl" for i in range(2, n + 1)]] for n in range(1, 7)}


@loader("livecodebench_code_generation")
def livecodebench(spark: SparkSession, folder: str, version_tag: str = "release_v6", start_date: str | None = None, end_date: str | None = None) -> Dataset:
    """A release's files, or what came from one version to another (v2_v4), within dates."""
    if version_tag in RELEASES:
        files = RELEASES[version_tag]
    elif m := re.fullmatch(r"v(\d)_v(\d)", version_tag):
        before = RELEASES.get(f"release_v{int(m[1]) - 1}", [])
        files = [f for f in RELEASES[f"release_v{m[2]}"] if f not in before]
    else:
        raise ValueError(f"no release {version_tag}")
    rows = spark.read.json([f"{folder}/{f}" for f in files]).withColumn("contest_date", F.col("contest_date").cast("timestamp"))
    for date, keep in ((start_date, lambda c, d: c >= d), (end_date, lambda c, d: c <= d)):
        rows = rows.where(keep(F.col("contest_date"), F.lit(date).cast("timestamp"))) if date else rows
    return Dataset({"test": rows})


@loader("multi_if")
def multi_if(spark: SparkSession, folder: str) -> Dataset:
    """The columns of up to three turns become one array; a turn without a prompt ends it, and the first must have one."""
    rows = csv(spark, f"{folder}/multiIF_20241018.csv")
    turns = []
    for i in (1, 2, 3):
        prompt = F.col(f"turn_{i}_prompt")
        ids = F.from_json(f"turn_{i}_instruction_id_list", "array<string>")
        kwargs = F.from_json(f"turn_{i}_kwargs", "array<string>")
        turns.append(F.when(prompt.isNotNull() & ~prompt.isin("", "None"), F.struct(F.get_json_object(prompt, "$.content").alias("prompt"), ids.alias("instruction_id_list"), kwargs.alias("kwargs"))))
    first = F.when(turns[0].isNull(), F.raise_error(F.lit("a conversation without a first turn"))).otherwise(F.array(turns[0]))
    both = F.when(turns[1].isNull(), first).when(turns[2].isNull(), F.array(turns[0], turns[1])).otherwise(F.array(*turns))
    return Dataset({"test": rows.select("key", "language", both.alias("turns"))})


@loader("scicode")
def scicode(spark: SparkSession, folder: str) -> Dataset:
    return Dataset({s: spark.read.json(f"{folder}/problems_{f}.jsonl") for s, f in (("test", "all"), ("dev", "dev"))})


@loader("sysbench")
def sysbench(spark: SparkSession, folder: str) -> Dataset:
    """One row a session: its turns (user, assistant, alignment, criteria) as JSON, in order of the session's id."""
    path = folder if folder.endswith(".json") else f"{folder}/system_benchmark_eval_datas.json"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    field = lambda k: F.get_json_object("v", f"$.{k}")
    said = F.from_json(field("messages"), "array<struct<role:string,content:string>>")
    info = F.from_json(field("prompt_infos"), "map<string,string>")
    indexed = F.filter(F.transform(said, lambda m, i: F.struct(m.alias("m"), F.get(said, i - 1)["content"].alias("user"))), lambda x: x["m"]["role"] == "assistant")

    def turn(x: Column) -> Column:
        about = F.try_element_at(info, x["user"])
        criteria = F.coalesce(F.from_json(F.get_json_object(about, "$.criteria"), "map<string,string>"), F.create_map().cast("map<string,string>"))
        return F.struct(x["user"].alias("user"), x["m"]["content"].alias("assistant"), F.coalesce(F.get_json_object(about, "$.alignment"), F.lit("")).alias("alignment"), criteria.alias("criteria"))

    def text(k: str) -> Column:
        return F.when(field(k) == "NaN", "").otherwise(F.coalesce(field(k), F.lit("")))

    turns = F.transform(indexed, turn)
    rows = raw.select(field("system_id").cast("int").alias("session_id"), text("领域").alias("domain"), text("场景").alias("scenario"), text("system_prompt").alias("system_prompt"), F.size(turns).alias("n_turns"), F.to_json(turns).alias("turns_json"))
    return Dataset({"train": rows.orderBy("session_id"), "test": rows.orderBy("session_id")})


@loader("t_eval_before_calling")
def t_eval(spark: SparkSession, folder: str, lang: str = "cn", form: str = "json", legacy: bool = False) -> Dataset:
    """One JSON object of samples; for older models function messages are the user's."""
    path = f"{folder}/data/reason_retrieve_understand_{form}_v2{'_zh' if lang == 'cn' else ''}.json"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", "map<string,string>"))).alias("v"))
    field = lambda k: F.get_json_object("v", f"$.{k}")
    said = F.coalesce(F.from_json(field("origin_prompt"), "array<struct<role:string,content:string>>"), F.array().cast("array<struct<role:string,content:string>>"))
    if legacy:
        said = F.transform(said, lambda m: F.struct(F.when(m["role"] == "function", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    return Dataset({"test": raw.select(field("template").alias("template"), field("meta_data").alias("meta_data"), said.alias("origin_prompt"), F.coalesce(field("ground_truth"), F.lit("{}")).alias("ground_truth"))})


@loader("ugmathbench")
def ugmathbench(spark: SparkSession, folder: str, subjects: list[str] | None = None, versions: int = 3) -> Dataset:
    """A row for each version of each problem."""
    rows = united([hub(spark, folder, s).splits["test"] for s in selected(subjects, subjects_of(spark, folder), "subjects")])
    version = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), *[F.col(f"{c}_v{v}").alias(c) for c in ("problem", "answer", "answer_type", "options")]) for v in range(1, versions + 1)])).alias("of")
    return Dataset({"test": rows.select("id", "subject", "topic", "subtopic", "level", "keywords", version).select("id", "subject", "topic", "subtopic", "level", "keywords", "of.*")})


#: Tokens that each kind of long-context task may generate.
BUDGETS = {"niah": 128, "vt": 30, "cwe": 120, "fwe": 50, "qa": 32}


def _essay(spark: SparkSession, folder: str, most: int) -> DataFrame | None:
    """One row: the first words of the staged essays (a text, or JSON with a field ``text``), no more than a budget has tokens; None if nothing is staged."""
    found = listed(spark, f"{folder}/PaulGrahamEssays.json*") or listed(spark, f"{folder}/essay.txt")
    if not found:
        return None
    whole = spark.read.text(found[0], wholetext=True).select(F.coalesce(F.get_json_object("value", "$.text"), "value").alias("text"))
    return whole.select(F.slice(F.regexp_extract_all("text", F.lit(r"(\S+)")), 1, most).alias("haystack")).limit(1)


@loader("ruler")
def ruler(spark: SparkSession, folder: str, lengths: tuple[int, ...] = (4096, 8192), n: int = 100, seed: int = 0, reserve: int = 0) -> Dataset:
    """Generated samples of each subtask and length: needles (eight kinds), chains, common and frequent words, questions.

    Needles and chains fill a length in tokens, less what is generated and what is in reserve for a model's template (see haystacks).
    Essays are read from PaulGrahamEssays.json.gz or essay.txt; without them, needles of several keys, values or queries stand in noise
    and the single ones in essays aren't made. If the folder holds words.txt, common words are drawn from it; if it holds questions
    and documents ((hotpot)qa.parquet: sample_id, gold, question, outputs; (hotpot)documents.parquet: doc_id, text), questions over
    drawn documents are made too. How many words and documents these have follows from a length at about four characters to a token.
    """
    from tallywright.operators import generators, haystacks

    parts = []
    words = spark.read.text(f"{folder}/words.txt").select(F.col("value").alias("word")) if listed(spark, f"{folder}/words.txt") else spark.range(2000).select(F.concat(F.lit("w"), F.substring(F.md5(F.col("id").cast("string")), 1, 5)).alias("word"))
    for k, length in enumerate(lengths):
        own, essay = seed + 100 * k, _essay(spark, folder, length)
        ids = spark.range(n).select(F.col("id").alias("sample_id"))
        made = {}
        for j, (subtask, spec) in enumerate(haystacks.SUBTASKS.items()):
            if spec.haystack != "essay":
                made[subtask] = haystacks.needle_samples(ids, spec, length, BUDGETS["niah"], reserve, own + j)
            elif essay is not None:  # one row, no longer than the budget
                made[subtask] = haystacks.needle_samples(ids.crossJoin(F.broadcast(essay)), spec, length, BUDGETS["niah"], reserve, own + j)
            elif spec.keys * spec.values > 1:
                made[subtask] = haystacks.needle_samples(ids, replace(spec, haystack="noise"), length, BUDGETS["niah"], reserve, own + j)
        chained = generators.chains(spark, n, 1, 4, own + 10).withColumn("value", generators.number_of(5, F.lit(own + 10), F.col("sample_id"), F.lit(0)))
        made["vt"] = haystacks.chain_samples(chained, 5, length, BUDGETS["vt"], reserve, own + 10)
        made["cwe"] = generators.common_words(words, n, 10, max(10, length // 40), 30, 3, own + 11)
        made["fwe"] = generators.frequent_words(spark, n, length // 3, 50, 2.0, own + 12)
        for subtask, prefix in (("qa_squad", ""), ("qa_hotpotqa", "hotpot")):
            if listed(spark, f"{folder}/{prefix}qa.parquet"):
                asked, documents = spark.read.parquet(f"{folder}/{prefix}qa.parquet"), spark.read.parquet(f"{folder}/{prefix}documents.parquet")
                dealt = generators.with_distractors(asked.select("sample_id", "gold"), documents, max(1, length // 512), own + 13)
                texts = dealt.select("sample_id", F.posexplode("context").alias("at", "doc_id")).join(documents.select("doc_id", "text"), "doc_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("all"))
                body = F.array_join(F.transform("all", lambda x, i: F.concat(F.lit("Document "), i + 1, F.lit(":\n"), x["text"])), "\n\n")
                made[subtask] = texts.join(asked, "sample_id").select("sample_id", F.concat(body, F.lit("\n\nQuestion: "), "question").alias("input"), "outputs")
        for subtask, rows in made.items():
            others = {"length": F.lit(length), "answer_prefix": F.lit("Answer:"), "token_position_answer": F.lit(None).cast("int")}
            filled = [(F.col(c) if c in rows.columns else other).alias(c) for c, other in others.items()]
            parts.append(rows.select(F.col("sample_id").alias("index"), "input", F.col("outputs").cast("array<string>").alias("outputs"), *filled, F.lit(subtask).alias("subtask"), F.lit(length).alias("context_length"), F.lit(BUDGETS[subtask.split("_")[0]]).alias("gen_budget")))
    return Dataset({"test": united(parts)})
