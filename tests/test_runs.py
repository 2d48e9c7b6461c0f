"""Runs over prompt files: stopped, started again, with files added."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tandem.plans import runs as W
from tandem.plans.inference import batch_infer, retrieve_and_translate

SCHEMA = "item_id long, prompt string"


def write_files(folder, names, rows=3):
    for name in names:
        path = Path(folder) / f"{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(json.dumps({"item_id": i, "prompt": f"{name} {i}"}) + "\n" for i in range(rows)))


def asking(log, model, broken=()):
    """Answers in upper case, writes down every prompt, and stops the run at a broken one."""
    def load():
        import uuid

        def ask(prompts):
            (Path(log) / uuid.uuid4().hex).write_text("\n".join(f"{model}|{p}" for p in prompts))
            return [f"{model}: {p.upper()}" for p in prompts]

        return ask

    def answer(rows, _):
        answered = batch_infer(rows, load)
        bad = F.col("prompt").rlike("|".join(broken) or "^$")
        return answered.withColumn("response", F.when(bad, F.raise_error(F.lit("stopped here"))).otherwise(F.col("response")))

    return answer


def asked(log):
    return Counter(line for f in Path(log).iterdir() for line in f.read_text().split("\n"))


def wanted(names, models, rows=3):
    return {(m, n, i, f"{m}: {n} {i}".replace(f"{n} {i}", f"{n} {i}".upper())) for m in models for n in names for i in range(rows)}


@pytest.fixture
def place(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "prompts").mkdir()
    return {k: str(tmp_path / k) for k in ("prompts", "output", "checkpoint", "log")}


def run(spark, place, models, **settings):
    return W.answer_files(spark, place["prompts"], SCHEMA, place["output"], place["checkpoint"], models, **settings)


def answers(spark, place):
    return {(r["model"], r["prompt_file"], r["item_id"], r["response"]) for r in W.read_answers(spark, place["output"]).collect()}


def test_files_are_answered_once(spark, place):
    models = {m: asking(place["log"], m) for m in ("m1", "007")}
    write_files(place["prompts"], ["rag/a", "rag/b", "intent/a"])
    assert run(spark, place, models, files_at_once=2) == 2
    first = answers(spark, place)
    assert first == wanted(["rag/a", "rag/b", "intent/a"], models)
    assert run(spark, place, models) == 0
    write_files(place["prompts"], ["c d+e", "123"])
    run(spark, place, models)
    assert answers(spark, place) == wanted(["rag/a", "rag/b", "intent/a", "c d+e", "123"], models)
    assert set(asked(place["log"]).values()) == {1}


def test_a_stopped_run_goes_on(spark, place):
    names = [f"f{i}" for i in range(6)]
    write_files(place["prompts"], names)
    with pytest.raises(Exception, match="stopped here"):
        run(spark, place, {"m": asking(place["log"], "m", ["f3 1"])}, files_at_once=1)
    half = answers(spark, place)
    done = {n for _, n, _, _ in half}
    assert 0 < len(done) < 6 and "f3" not in done and half == wanted(done, ["m"])
    run(spark, place, {"m": asking(place["log"], "m")}, files_at_once=1)
    assert answers(spark, place) == wanted(names, ["m"])
    times = asked(place["log"])
    assert all(n == 1 for line, n in times.items() if line.split("|")[1].split()[0] in done)
    assert {line.split("|")[1].split()[0] for line, n in times.items() if n > 1} <= {"f3"}


def test_a_model_that_is_done_is_not_asked_again(spark, place):
    """The second model stops the batch; the first one's answers to the same files are there already."""
    write_files(place["prompts"], ["a", "b"])
    first = asking(place["log"], "m1")
    with pytest.raises(Exception, match="stopped here"):
        run(spark, place, {"m1": first, "m2": asking(place["log"], "m2", ["b 0"])})
    run(spark, place, {"m1": first, "m2": asking(place["log"], "m2")})
    assert answers(spark, place) == wanted(["a", "b"], ["m1", "m2"])
    assert all(n == 1 for line, n in asked(place["log"]).items() if line.startswith("m1"))


def test_a_new_checkpoint_skips_what_has_an_output(spark, place):
    write_files(place["prompts"], ["a"])
    models = {"m": asking(place["log"], "m")}
    run(spark, place, models)
    run(spark, {**place, "checkpoint": place["checkpoint"] + "2"}, models)
    assert set(asked(place["log"]).values()) == {1} and answers(spark, place) == wanted(["a"], ["m"])


def test_the_whole_chain_goes_on_where_it_stopped(spark, place):
    """Identify, look up and translate for each file; the guide is there for the second run only."""
    for name in ("a", "b"):
        path = Path(place["prompts"]) / f"{name}.jsonl"
        asks = ["stop" if name == "b" else "[]", '["Sorting"]', '["Sorting"]']
        rows = [{"item_id": i, "identify_prompt": a, "translate_prompt": f"{name} {i}: [GUIDELINES]"} for i, a in enumerate(asks)]
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    guide = spark.createDataFrame([(1, "Sorting", "ORDER BY", "sort_values")], "line_no long, operation string, postgreSQL string, pandas string")

    def chain(fails):
        def load():
            def model(prompts):
                if fails and any(p == "stop" for p in prompts):
                    raise SystemExit("the model is gone")
                return [f"```\n{p}\n```" for p in prompts]

            return model

        return lambda rows, _: retrieve_and_translate(rows, guide, load)

    schema = "item_id long, identify_prompt string, translate_prompt string"
    go = lambda fails: W.answer_files(spark, place["prompts"], schema, place["output"], place["checkpoint"], {"m": chain(fails)}, files_at_once=1)
    with pytest.raises(Exception):
        go(True)
    half = {r["prompt_file"] for r in W.read_answers(spark, place["output"]).collect()} if Path(place["output"]).exists() else set()
    assert half <= {"a"}
    go(False)
    text = "1. Sorting:\nPostgreSQL Solution: ORDER BY\nPandas Solution: sort_values"
    got = {(r["prompt_file"], r["item_id"]): r["code"] for r in W.read_answers(spark, place["output"]).collect()}
    assert got == {(f, i): f"{f} {i}: {text if i else ''}".strip() for f in ("a", "b") for i in range(3)}


def test_names_below_the_folder(spark):
    paths = spark.createDataFrame([("file:///x/p/a%20b/c+d.jsonl",), ("hdfs://h:1/x/p/q.tar.json",)], "f string")
    got = [r[0] for r in paths.select(W.file_below(F.col("f"), "/x/p/")).collect()]
    assert got == ["a b/c+d", "q.tar"]
