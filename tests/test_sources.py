"""Reading, writing, profiles and keys."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tandem.session import scratch_path, shared_dir
from tandem.sources import jsonl, profile as P, progress, sketches as S
from tandem.sources.tables import load_tables


def test_jsonl_round_trip_keeps_nulls_and_text(spark, tmp_path):
    rows = [(1, "é\n\"q\" \u2028", None), (2, None, ["a", None])]
    df = spark.createDataFrame(rows, "item_id long, SQL string, tables array<string>")
    jsonl.write_jsonl(df, f"{tmp_path}/new/deep/out")
    jsonl.write_jsonl(df, f"{tmp_path}/new/deep/out")
    back = jsonl.read_jsonl(spark, f"{tmp_path}/new", df.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows
    jsonl.write_jsonl(df, f"{tmp_path}/new/deep/out", append=True)
    assert jsonl.read_jsonl(spark, f"{tmp_path}/new", df.schema).count() == 4
    names = jsonl.with_source_file(jsonl.read_jsonl(spark, f"{tmp_path}/new", df.schema))
    assert all("/new/deep/out/" in r["source_file"] for r in names.collect())


def test_nested_items_read_by_schema(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text(
        '{"item_id": 1, "question": "q", "extra": 1, '
        '"pytorch_test_code": {"setup_code": "s", "test_cases": ["a", "b"]}}\n')
    row = jsonl.read_jsonl(spark, str(tmp_path), jsonl.FRAMEWORK_ITEM).first()
    assert row["pytorch_test_code"]["test_cases"] == ["a", "b"] and row["tensorflow_library"] is None


def test_broken_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path), "a long").collect()
    assert jsonl.read_jsonl(spark, str(tmp_path), "a long", strict=False).count() == 2


@pytest.fixture
def small_blocks(spark):
    """Files of a few hundred bytes are several blocks, some in one task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


BAD = ["{", "not json", "[1]", '[{"a": 1}]', '{"a": "text"}', '{"a": 1', "null", "7"]


@pytest.mark.parametrize("end", ["\n", ""])
def test_lines_keep_their_place(spark, tmp_path, small_blocks, end):
    files = {}
    for name, n in (("a.jsonl", 200), ("deep/b c.jsonl", 57), ("one.jsonl", 1), ("none.jsonl", 0)):
        lines = [BAD[i % len(BAD)] if i % 9 == 4 else " \t" if i % 13 == 6 else '{"a": %d, "b": "é%s"}' % (i, "x" * (i % 40)) for i in range(n)]
        files[name] = lines
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines) + end if lines else "")
    rows, bad = jsonl.read_numbered(spark, str(tmp_path / "in"), "a long, b string")
    name_of = lambda r: r["file"].split("/in/")[1].replace("%20", " ")
    want = {(n, i): line for n, lines in files.items() for i, line in enumerate(lines) if line.strip()}
    assert {(name_of(r), r["line_no"]): r["text"] for r in bad.collect()} == {k: v for k, v in want.items() if v in BAD}
    good = {(name_of(r), r["line_no"]): (r["a"], r["b"]) for r in rows.collect()}
    assert good == {k: (k[1], "é" + "x" * (k[1] % 40)) for k, v in want.items() if v not in BAD}


def test_lines_of_a_folder_that_spark_wrote(spark, tmp_path, small_blocks):
    """Its parts are one file, in the order of their names."""
    df = spark.range(500).repartitionByRange(4, "id").sortWithinPartitions("id")
    jsonl.write_jsonl(df, str(tmp_path / "run.jsonl"))
    rows, bad = jsonl.read_numbered(spark, str(tmp_path), "id long")
    got = rows.collect()
    assert {r["file"].split("/")[-1] for r in got} == {"run.jsonl"} and bad.isEmpty()
    assert all(r["line_no"] == r["id"] for r in got) and len(got) == 500


def test_missing_table_fails_at_once(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_tables(spark, "/root/testdata/sf0.001", ["orders", "nowhere"])


def test_folders_are_pruned(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, "v1", "a"), (2, "v2", "a")], "id long, version string, direction string")
    jsonl.write_by(df, f"{tmp_path}/p", "version", "direction")
    read = spark.read.schema("id long, version string, direction string").json(f"{tmp_path}/p")
    read.filter("version = 'v1'").explain()
    assert "PartitionFilters: [isnotnull(version" in capsys.readouterr().out


@pytest.mark.parametrize("exact", [True, False])
def test_profile(spark, exact):
    df = spark.createDataFrame(
        [(1, "a", 0.0, [1]), (None, "b" * 100, -0.0, None), (3, "b" * 100, None, [1]), (1, None, float("nan"), [2])],
        "k int, `odd ``'name` string, d double, v array<int>")
    got = {r["column_name"]: r for r in P.profile_tables({"t": df, "skipped": df}, exact, ["skipped"]).collect()}
    assert {n: (r["n_rows"], r["n_nulls"], r["n_distinct"]) for n, r in got.items()} == {
        "k": (4, 1, 2), "odd `'name": (4, 1, 2), "d": (4, 1, 2), "v": (4, 1, 2)}
    assert [r["ordinal"] for r in sorted(got.values(), key=lambda r: r["ordinal"])] == [1, 2, 3, 4]
    assert (got["k"]["smallest"], got["k"]["largest"], got["v"]["smallest"]) == ("1.000000", "3.000000", None)


def test_profile_of_extreme_numbers(spark):
    df = spark.createDataFrame(
        [(1e35, 1e-9, float("nan")), (-1e35, 0.5, 1.0)], "big double, small double, nan double")
    got = {r["column_name"]: (r["smallest"], r["largest"]) for r in P.profile_tables({"t": df}).collect()}
    assert got == {"big": ("-1.0E35", "1.0E35"), "small": ("1.0E-9", "0.500000"), "nan": ("1.000000", "NaN")}


def test_keys(spark):
    child = spark.createDataFrame([(1, 1), (1, 9), (2, 9), (3, None)], "id long, ref long")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    assert P.check_primary_key(child, "pk", ["id"]).first()["violations"] == 1
    assert P.check_foreign_key(child, "fk", "ref", parent, "id").first()["violations"] == 2
    assert P.check_foreign_key(parent, "fk", "id", parent, "id").first()["violations"] == 0


def test_all_keys_at_once(spark, capsys):
    tables = {
        "child": spark.createDataFrame([(1, 1, "a"), (1, 9, "b"), (2, 9, None), (3, None, "1:a"), (4, 1, "a")], "id long, ref int, t string"),
        "parent": spark.createDataFrame([(1, "a"), (2, "zz"), (2, "b"), (None, None)], "id long, name string"),
        "lines": spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("a", "b:c"), (None, "x"), (None, "x")], "x string, y string"),
        "empty": spark.createDataFrame([], "id long"),
    }
    primary = {"child": ["id"], "parent": ["id"], "lines": ["x", "y"], "empty": ["id"]}
    foreign = [("child", "ref", "parent", "id"), ("child", "t", "parent", "name"), ("parent", "id", "child", "ref"),
               ("child", "id", "empty", "id"), ("empty", "id", "child", "id"), ("parent", "id", "parent", "id")]
    checked = P.check_keys(tables, primary, foreign)
    want = {f"{t}_pk": P.check_primary_key(tables[t], "", c).first()["violations"] for t, c in primary.items()}
    want |= {f"{c}_{x}_fk": P.check_foreign_key(tables[c], "", x, tables[p], y).first()["violations"] for c, x, p, y in foreign[:-1]}
    want["parent_id_fk"] = None
    got = {r["constraint_name"]: r["violations"] for r in checked.collect() if r["constraint_name"] != "parent_id_fk"}
    assert {**got, "parent_id_fk": None} == want
    assert sorted(r["violations"] for r in checked.collect() if r["constraint_name"] == "parent_id_fk") == [0, 2]
    assert got == {"child_pk": 1, "parent_pk": 2, "lines_pk": 2, "empty_pk": 0, "child_ref_fk": 2, "child_t_fk": 1, "child_id_fk": 5, "empty_id_fk": 0}
    files = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("orders", "customer", "nation")}
    P.check_keys(files, {"orders": ["o_orderkey"], "customer": ["c_custkey"]},
                 [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]).explain()
    assert capsys.readouterr().out.count("FileScan") == 3


def test_skip_done(spark):
    pending = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "model string, file string")
    done = spark.createDataFrame([("m", "a"), ("m", "a")], "model string, file string")
    got = progress.skip_done(pending, done, ["model", "file"])
    assert sorted(tuple(r) for r in got.collect()) == [("m", "b"), ("n", "a")]


def test_stats_accumulate(spark, tmp_path):
    stats = spark.createDataFrame([("a", "b", 1.0)], "source string, target string, accuracy double")
    for day in ("2024-01-01", "2024-01-02"):
        progress.append_stats(stats, f"{tmp_path}/r", f"{day} 00:00:00")
    rows = progress.read_stats(spark, f"{tmp_path}/r").orderBy("run_time").collect()
    assert [str(r["run_time"])[:10] for r in rows] == ["2024-01-01", "2024-01-02"]


def test_compacted_record_keeps_its_rows(spark, tmp_path):
    path = f"{tmp_path}/r"
    for day in range(1, 5):
        rows = [("a", "b", day / 2), ("a", "c", 1.0)][: day % 2 + 1]
        progress.append_stats(spark.createDataFrame(rows, "source string, target string, accuracy double"), path, f"2024-01-0{day} 00:00:00")
    before = sorted(map(str, progress.read_stats(spark, path).collect()))
    assert len(list(tmp_path.rglob("*.parquet"))) == 6
    progress.compact_stats(spark, path)
    assert sorted(map(str, progress.read_stats(spark, path).collect())) == before and len(list(tmp_path.rglob("*.parquet"))) == 2


def test_scratch_is_below_the_configured_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named


def numbers(n, start=0):
    """Rows of every kind of column, with nulls, NaN, -0.0 and texts that sort by bytes."""
    return [(i, None if i % 5 == 0 else i % 90, float("nan") if i % 97 == 0 else (i % 400) / 8 - 10, f"é{i % 33}" if i % 4 else None,
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), Decimal(i % 21) / 4, [i % 3], bool(i % 2)) for i in range(start, start + n)]


KINDS = "id long, k int, d double, `odd ``name` string, t timestamp_ntz, m decimal(9,2), v array<int>, b boolean"


def test_sketches_merge_to_the_profile(spark, tmp_path):
    folder, store = str(tmp_path / "table"), str(tmp_path / "store")
    for round_, n in enumerate((900, 2100)):
        part = spark.createDataFrame(numbers(n, 900 * round_), KINDS)
        part.repartition(3).write.mode("append").parquet(folder)
        assert S.update_sketches(spark, store, "t", folder) == 3
        assert S.update_sketches(spark, store, "t", folder) == 0
        whole = spark.read.parquet(folder)
        exact = {r["column_name"]: r for r in P.profile_columns(whole, "t", exact=True).collect()}
        got = {r["column_name"]: r for r in S.merged_profile(spark, store, "t", folder).collect()}
        assert set(got) == set(exact)
        for name, row in got.items():
            same = ["table_name", "ordinal", "data_type", "n_rows", "n_nulls", "smallest", "largest"]
            assert [row[c] for c in same] == [exact[name][c] for c in same], name
            assert abs(row["n_distinct"] - exact[name]["n_distinct"]) <= S.DISTINCT_ERROR * exact[name]["n_distinct"], name
        assert {n for n, r in got.items() if r["median"] is not None} == {"id", "k", "d", "m"}
        below = whole.where(F.col("id") <= got["id"]["median"]).count()
        assert abs(below / whole.count() - 0.5) < S.RANK_ERROR


def test_sketches_of_changed_and_removed_files(spark, tmp_path):
    folder, store = tmp_path / "table", str(tmp_path / "store")
    write = lambda n, name: spark.createDataFrame([(i,) for i in range(n)], "a long").coalesce(1).write.mode("overwrite").parquet(str(folder / name))
    for name, n in (("x y", 5), ("z", 7)):
        write(n, name)
    S.update_sketches(spark, store, "t", str(folder))
    write(50, "z")
    rows = lambda: [tuple(r) for r in S.merged_profile(spark, store, "t", str(folder)).select("n_rows", "largest").collect()]
    assert rows() == [(5, "4.000000")]  # the new file has no sketch yet, and the old one is gone
    assert S.update_sketches(spark, store, "t", str(folder)) == 1
    assert rows() == [(55, "49.000000")]
    assert S.update_sketches(spark, store, "other", str(folder / "z")) == 1 and rows() == [(55, "49.000000")]


def test_lines_of_one_language_are_many_tasks(spark, tmp_path, monkeypatch):
    """One language, null and repeated ids: its file is written in several parts, and lines keep their order by id."""
    from tandem.catalog import QUERIES, sources

    monkeypatch.setattr(sources, "scratch_path", lambda *_: str(tmp_path / "lines"))
    spark.createDataFrame([(i if i < 300 else None, f"text {i}", "en") for i in range(400)], "doc_id long, text string, lang string").coalesce(
        1).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = QUERIES["s01_line_numbers"](spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "lines" / "lang=en").glob("part-*"))) > 1
    assert sorted(r["line_no"] for r in rows) == list(range(400))
    known = {r["line_no"]: r["doc_id"] for r in rows if r["line_no"] >= 100}
    assert all(known[100 + i] == (None if i % 7 == 0 or i % 11 == 0 else i) for i in range(300))
