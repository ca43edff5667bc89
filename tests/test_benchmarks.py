"""Loaders over small files in the benchmarks' own formats."""

import base64
import gzip
import hashlib
import json
import zipfile

import pytest

from tallywright.sources import benchmarks


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def rows(spark, name, folder, **options):
    return benchmarks.load(spark, name, str(folder), **options).test.collect()


def test_documents_of_questions(spark, tmp_path):
    put(tmp_path, "AA-LCR_Dataset.csv", 'question_id,document_category,document_set_id,question,answer,data_source_filenames,input_tokens\n1, law ,s1,"a, ""b""?",x,b’s.txt; a.txt,12\n')
    path = tmp_path / "extracted_text/AA-LCR_extracted-text.zip"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("lcr/law/s1/a.txt", "first")
        z.writestr("lcr/law/s1/b’s.txt", "second")
    (r,) = rows(spark, "aa_lcr", tmp_path)
    assert (r.question_id, r.question, r.documents, r.input_tokens) == (1, 'a, "b"?', ["second", "first"], 12)


def test_archive_of_subjects(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for split in ("dev", "test"):
            for subject in ("law", "arts"):
                z.writestr(f"CMMLU-1/data/{split}/{subject}.csv", f',Question,A,B,C,D,Answer\n0,"{split} q",a,b,c,d,B\n')
    assert {(r.subject, r.question, r.answer) for r in rows(spark, "cmmlu", tmp_path)} == {("law", "test q", "B"), ("arts", "test q", "B")}
    assert {r.subject for r in rows(spark, "cmmlu", tmp_path, subjects=["law"])} == {"law"}


def test_encrypted_columns(spark, tmp_path):
    def hide(text):
        raw, key = text.encode(), hashlib.sha256(b"pw").digest()
        return base64.b64encode(bytes(a ^ key[i % 32] for i, a in enumerate(raw))).decode()

    put(tmp_path, "browse_comp_test_set.csv", f"problem,answer,problem_topic,canary\n{hide('é' * 40)},{hide('yes')},t,pw\n")
    (r,) = rows(spark, "browsecomp", tmp_path)
    assert (r.problem, r.answer, r.problem_topic) == ("é" * 40, "yes", "t")


def test_exams(spark, tmp_path):
    for subset in benchmarks.EXAMS:
        cloze = subset in ("math", "gaokao-mathcloze")
        label = ["A"] if subset.startswith("jec") else "B"
        put(tmp_path, f"{subset}.jsonl", json.dumps({"passage": None, "question": "q", "options": None if cloze else ["(A)x"], "label": None if cloze else label, "answer": "7" if cloze else None, "other": {"level": 3}}) + "\n")
    got = {r.subset: r for r in rows(spark, "agieval", tmp_path)}
    assert len(got) == 21 and got["jec-qa-kd"].label == "A" and got["math"].options == [] and json.loads(got["math"].other) == {"level": 3}
    assert [r.subset for r in rows(spark, "agieval", tmp_path, subsets=["sat-en"])] == ["sat-en"]
    with pytest.raises(ValueError):
        rows(spark, "agieval", tmp_path, subsets=["none"])
    put(tmp_path, "sat-en.jsonl", json.dumps({"question": "q", "options": None, "label": "A"}))
    with pytest.raises(Exception, match="options"):
        rows(spark, "agieval", tmp_path, subsets=["sat-en"])


def test_pictures_are_left_out(spark, tmp_path):
    frame = spark.createDataFrame([("1", "", "p", "r"), ("2", "data:x", "p", "r")], "id string, image string, image_preview string, rationale_image string")
    frame.write.parquet(f"{tmp_path}/test.parquet")
    assert [r.id for r in rows(spark, "hle", tmp_path)] == ["1"] and len(rows(spark, "hle", tmp_path, text_only=False)) == 2
    frame.drop("image").write.parquet(f"{tmp_path}/bad/test.parquet")
    with pytest.raises(ValueError, match="image"):
        rows(spark, "hle", tmp_path / "bad")


def test_cells_sessions_and_calls(spark, tmp_path):
    put(tmp_path, "iheval/task/translation/conflict/v1/input_data.json", json.dumps([{"id": 3, "system": None, "instruction": "do", "answer": {"a": 1}, "conversation_history": ["x"]}]))
    put(tmp_path, "iheval/task/translation/other/v1/input_data.json", "[]")
    (r,) = rows(spark, "iheval", tmp_path)
    assert (r.uid, r.setting, r.system, r.conversation_history, json.loads(r.answer_json), r.tool_json) == ("task/translation/conflict/v1#3", "conflict", "", ["x"], {"a": 1}, "")
    session = {"system_id": 7, "领域": "d", "场景": float("nan"), "system_prompt": "s", "messages": [{"role": "user", "content": "u1"}, {"role": "assistant", "content": "a1"}], "prompt_infos": {"u1": {"alignment": "aligned", "criteria": {"1": "c"}}}}
    put(tmp_path, "system_benchmark_eval_datas.json", json.dumps([session]))
    (r,) = rows(spark, "sysbench", tmp_path)
    assert (r.session_id, r.domain, r.scenario, r.n_turns) == (7, "d", "", 1) and json.loads(r.turns_json) == [{"user": "u1", "assistant": "a1", "alignment": "aligned", "criteria": {"1": "c"}}]
    put(tmp_path, "data/reason_retrieve_understand_json_v2_zh.json", json.dumps({"0": {"template": "t", "meta_data": {"a": 1}, "origin_prompt": [{"role": "function", "content": "c"}], "ground_truth": {"name": "f"}}}))
    (r,) = rows(spark, "t_eval_before_calling", tmp_path, legacy=True)
    assert r.origin_prompt[0].role == "user" and json.loads(r.ground_truth) == {"name": "f"}


def test_releases_and_dates(spark, tmp_path):
    for i, name in enumerate(benchmarks.RELEASES["release_v6"]):
        put(tmp_path, name, json.dumps({"question_content": f"q{i}", "contest_date": f"2024-0{i + 1}-01T00:00:00"}) + "\n")
    assert len(rows(spark, "livecodebench_code_generation", tmp_path, version_tag="release_v2")) == 2
    assert {r.question_content for r in rows(spark, "livecodebench_code_generation", tmp_path, version_tag="v2_v3")} == {"q1", "q2"}
    assert {r.question_content for r in rows(spark, "livecodebench_code_generation", tmp_path, start_date="2024-02-01", end_date="2024-03-01")} == {"q1", "q2"}
    with pytest.raises(ValueError, match="empty"):
        rows(spark, "livecodebench_code_generation", tmp_path, start_date="2030-01-01")


def test_single_files(spark, tmp_path):
    put(tmp_path, "answerbench_v2.csv", "Problem,Short Answer\np,007\n")
    put(tmp_path, "simpleqa_verified.csv", "original_index,problem,answer,multi_step\n3,p,a,True\n")
    put(tmp_path, "gpqa_diamond.csv", "Question,Correct Answer,Incorrect Answer 1,Incorrect Answer 2,Incorrect Answer 3\nq,a,b,c,d\n")
    put(tmp_path, "Inverse_IFEval_Dataset.json", json.dumps([{"instruction_types": "x", "prompt": "p", "response_reference": "r", "language": lang, "judge_prompt_template": "j", "judge_system_prompt": "s"} for lang in ("english", "chinese")]))
    assert rows(spark, "imo_answer_bench", tmp_path)[0].answer == "007" and rows(spark, "simpleqa_verified", tmp_path)[0].multi_step is True and rows(spark, "gpqa_diamond", tmp_path)[0]["Correct Answer"] == "a"
    assert len(rows(spark, "inverse_ifeval", tmp_path)) == 2 and len(rows(spark, "inverse_ifeval", tmp_path, language="chinese")) == 1
    with pytest.raises(ValueError):
        rows(spark, "inverse_ifeval", tmp_path, language="french")


def test_hub_layouts(spark, tmp_path):
    spark.createDataFrame([("q", "1")], "question string, answer string").coalesce(1).write.json(f"{tmp_path}/main/test-00000-of-00001.json")
    with gzip.open(tmp_path / "extra.jsonl.gz", "wt") as f:
        f.write("{}\n")
    assert rows(spark, "gsm8k", tmp_path)[0].answer == "1"
    for part in ("I", "II"):
        put(tmp_path, f"AIME2025-{part}/test.jsonl", json.dumps({"question": f" {part} ", "answer": " 1"}) + "\n")
    assert {(r.question, r.answer) for r in rows(spark, "aime_2025", tmp_path)} == {("I", "1"), ("II", "1")}
    with pytest.raises(ValueError, match="no benchmark"):
        benchmarks.load(spark, "none", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        rows(spark, "gsm1k", tmp_path / "nowhere")


def test_long_contexts(spark, tmp_path):
    got = rows(spark, "ruler", tmp_path, lengths=(1024,), n=2)
    assert {r.subtask for r in got} == {"niah_single_1", "niah_multikey_1", "niah_multikey_2", "niah_multikey_3", "niah_multivalue", "niah_multiquery", "vt", "cwe", "fwe"} and len(got) == 18
    assert all(o in r.input for r in got if r.subtask.startswith(("niah", "vt")) for o in r.outputs)


def test_long_contexts_of_all_subtasks(spark, tmp_path):
    (tmp_path / "essay.txt").write_text("A mill stood by the river. It was old. Nobody knew who had built it! " * 3)
    for prefix in ("", "hotpot"):
        spark.createDataFrame([(1, 5, "Who?", ["x"])], "sample_id long, gold long, question string, outputs array<string>").write.parquet(f"{tmp_path}/{prefix}qa.parquet")
        spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/{prefix}documents.parquet")
    got = rows(spark, "ruler", tmp_path, lengths=(512, 1024), n=2)
    assert len({r.subtask for r in got}) == 13 and len(got) == 2 * (11 * 2 + 2)
    filled = [r for r in got if r.subtask.startswith(("niah", "vt"))]
    assert all(r.context_length - 110 < r.length <= r.context_length and all(o in r.input for o in r.outputs) for r in filled)
    assert all("mill" in r.input for r in filled if r.subtask in ("niah_single_2", "niah_single_3", "niah_multivalue"))
