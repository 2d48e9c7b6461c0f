"""The vector path, from names to prompts."""

from pathlib import Path

import pytest

from tandem.plans import documents as D, inference as I

DOCUMENTS = [
    (1, "NumPy", "np.sort", "Sorts. ", [0.0, 0.0]), (2, "NumPy", "np.dot", "Multiplies. ", [5.0, 5.0]),
    (3, "Pandas", "df.sort_values", "Sorts rows. ", [0.0, 0.0]), (4, "NumPy", "np.sort", "Sorts again. ", [0.0, 3.0]),
    (5, "NumPy", "broken", "no", [float("nan"), 0.0]), (6, "NumPy", "none", "no", None),
]
PLACES = {"sort": [0.1, 0.1], "sorting": [0.0, 2.9], "dot": [4.0, 4.0], "": [9.0, 9.0]}


def documents(spark):
    return spark.createDataFrame(DOCUMENTS, "doc_id long, library string, api_name string, docstring string, embedding array<float>")


def places():
    """Loads an embedder that knows where some names are."""
    known = dict(PLACES)
    return lambda: lambda names: [known.get(n, [4.9, 4.9]) for n in names]


ROWS = [
    (1, "NumPy", '["sort", "dot", "sorting"]'), (2, "Pandas", '["dot"]'), (3, "Rust", '["sort"]'), (4, None, "sort"), (5, "NumPy", None),
    (1, "NumPy", '["dot"]'), (None, "NumPy", '["sort", "dot", "sorting"]'),
]


def test_texts(spark):
    rows = spark.createDataFrame(ROWS, "item_id long, lib string, response string")
    got = {(r["item_id"], r["lib"], r["response"]): r["found"] for r in D.add_documents(rows, documents(spark), places(), "response", "lib", "found").collect()}
    # np.sort is found twice: it stands where it came first, with the text of the last one.
    whole = "1.np.sort:\n Sorts again. 2.np.dot:\n Multiplies."
    assert got == {ROWS[0]: whole, ROWS[6]: whole, ROWS[1]: "1.df.sort_values:\n Sorts rows.", ROWS[5]: "1.np.dot:\n Multiplies.",
                   ROWS[2]: "", ROWS[3]: "", ROWS[4]: ""}


def test_two_nearest(spark):
    rows = spark.createDataFrame([(1, "NumPy", "dot")], "item_id long, lib string, response string")
    got = D.add_documents(rows, documents(spark), places(), "response", "lib", "found", k=2).first()["found"]
    assert got == "1.np.dot:\n Multiplies. 2.np.sort:\n Sorts again."


def test_a_name_is_embedded_once(spark, tmp_path):
    """With a store, also over several runs."""
    calls = str(tmp_path / "calls")
    Path(calls).mkdir()

    def load():
        import uuid

        def embed(names):
            (Path(calls) / uuid.uuid4().hex).write_text("\n".join(names))
            return [[float(len(n)), 1.0] for n in names]

        return embed

    store = str(tmp_path / "store")
    for names in (["a", "bb", "a", None], ["bb", "ccc"], ["a"]):
        df = spark.createDataFrame([(n,) for n in names], "n string").repartition(3)
        got = D.name_vectors(df, load, store).collect()
        assert sorted((r["name"], list(r["embedding"])) for r in got) == sorted((n, [len(n), 1.0]) for n in {*names} - {None})
    assert sorted(n for f in Path(calls).iterdir() for n in f.read_text().split("\n")) == ["a", "bb", "ccc"]


def test_a_failed_run_adds_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    names = spark.createDataFrame([("a",), ("b",)], "n string")
    with pytest.raises(Exception, match="zip"):
        D.name_vectors(names, lambda: lambda n: [], store)
    assert D.name_vectors(names, lambda: lambda n: [[1.0]] * len(n), store).count() == 2


def test_whole_chain(spark):
    items = spark.createDataFrame([
        (i, d, '["sort", "sorting"]', f"do {i}: [APIs]!") for i, d in enumerate(["pd_to_np", "np_to_pd", "unknown"])],
        "item_id long, direction string, identify_prompt string, translate_prompt string")
    load = lambda: lambda prompts: [f"```\n{p}\n```" for p in prompts]
    out = I.retrieve_apis_and_translate(items, documents(spark), places(), load)
    assert {r["item_id"]: r["code"] for r in out.collect()} == {
        0: "do 0: 1.np.sort:\n Sorts again.!", 1: "do 1: 1.df.sort_values:\n Sorts rows.!", 2: "do 2: !"}


def test_no_rows(spark):
    none = spark.createDataFrame([], "item_id long, lib string, response string")
    assert D.add_documents(none, documents(spark), places(), "response", "lib").count() == 0
    some = spark.createDataFrame(ROWS, none.schema)
    assert {r["documents"] for r in D.add_documents(some, documents(spark).limit(0), places(), "response", "lib").collect()} == {""}
