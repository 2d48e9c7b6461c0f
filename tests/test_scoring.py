"""Scoring of prediction files on disk."""

import json
from pathlib import Path

import pytest

from tandem.plans import scoring as S

TRUTH = [f"answer {i}" for i in range(6)]
SCHEMAS = ("answer string", "response string")


def write(path, lines):
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("".join(line + "\n" for line in lines))


def answers(values):
    return [v if v is None or v.startswith("{broken") else json.dumps({"response": v}) for v in values]


@pytest.fixture
def place(tmp_path):
    write(tmp_path / "truth.jsonl", [json.dumps({"answer": a}) for a in TRUTH])
    write(tmp_path / "runs/zero_shot/gpt_v1_postgresql_to_pandas.jsonl", answers([f"```python\nanswer {i}\n```" for i in range(6)]))
    write(tmp_path / "runs/rag/gpt_v2_pandas_to_postgresql.jsonl", answers(["answer 0", "wrong", "{broken", "answer 3"]))
    write(tmp_path / "runs/other/x_v1.jsonl", answers(["no"] * 5 + ["answer 5", "more", "lines"]))
    return tmp_path


def score(spark, place, folder="runs"):
    S.score_files(spark, str(place / "truth.jsonl"), SCHEMAS[0], str(place / folder), SCHEMAS[1], "query", S.same_text("answer", "response"), str(place / "out"))
    rows = {r["run"]: r for r in S.read_scores(spark, str(place / "out"), "accuracy").collect()}
    log = S.read_scores(spark, str(place / "out"), "cases").collect()
    return rows, log


def test_runs_are_scored_by_their_files(spark, place):
    rows, log = score(spark, place)
    first, second, third = (rows[r] for r in ("zero_shot/gpt_v1_postgresql_to_pandas", "rag/gpt_v2_pandas_to_postgresql", "other/x_v1"))
    assert [first[c] for c in S.RUN[1:]] == ["zero_shot", "gpt", "v1", "PostgreSQL", "Pandas"] and first["accuracy"] == 100.0
    assert [second[c] for c in S.RUN[1:]] == ["rag", "gpt", "v2", "Pandas", "PostgreSQL"]
    assert [second[c] for c in ("n_cases", "n_passed", "execution_errors", "assertion_errors", "accuracy", "n_truth_only")] == [4, 2, 1, 1, 50.0, 2]
    assert [third[c] for c in ("n_cases", "n_passed", "n_truth_only", "n_prediction_only")] == [6, 1, 0, 2]
    assert {r["run"] for r in log} == {"zero_shot/gpt_v1_postgresql_to_pandas", "rag/gpt_v2_pandas_to_postgresql"} and len(log) == 10
    by_line = {r["line_no"]: r for r in log if r["run"].startswith("rag")}
    assert [by_line[i]["error_result"] for i in range(4)] == ["correct", "Assertion failed: mismatch", S.BROKEN_LINE, "correct"]
    assert by_line[1]["ground_truth"]["answer"] == "answer 1" and by_line[1]["prediction"]["response"] == "wrong" and by_line[2]["prediction"] is None


def test_a_run_scored_again_replaces_its_own_rows(spark, place):
    before = score(spark, place)
    again = score(spark, place)
    assert before[0] == again[0] and sorted(map(str, before[1])) == sorted(map(str, again[1]))
    write(place / "more/rag/gpt_v2_pandas_to_postgresql.jsonl", answers([f"answer {i}" for i in range(6)]))
    rows, log = score(spark, place, "more")
    assert rows["rag/gpt_v2_pandas_to_postgresql"]["accuracy"] == 100.0 and len(log) == 12
    assert {k: v for k, v in rows.items() if "rag" not in k} == {k: v for k, v in before[0].items() if "rag" not in k}


def test_broken_truth_is_an_error(spark, place):
    write(place / "truth.jsonl", ['{"answer": "a"}', "{"])
    with pytest.raises(ValueError, match="broken"):
        score(spark, place)
