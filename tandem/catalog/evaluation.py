"""Scoring of results and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.catalog.prompts import SPACE, SQL_RESPONSES, responses
from tandem.catalog.registry import query, quote
from tandem.functions import text as X
from tandem.operators.ordering import number_rows
from tandem.plans import evaluation as E
from tandem.plans.scoring import read_scores, same_text, score_files
from tandem.plans.sql_pairs import score_pairs
from tandem.session import scratch_path, settle
from tandem.sources.tables import table

# -- cases derived from events ---------------------------------------------------------

SQL_CASES = """(SELECT *, outcome IN ('passed', 'correct') AS passed FROM (SELECT event_id, user_id, value, props,
    'model' || (user_id % 5) AS model, CASE WHEN user_id % 2 = 0 THEN 'pandas' ELSE 'numpy' END AS source,
    CASE WHEN user_id % 2 = 0 THEN 'numpy' ELSE 'pandas' END AS target,
    CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'signup' THEN 'correct'
      WHEN 'error' THEN CASE WHEN value < 30 THEN 'failed: ' || props ELSE 'Execution failed: ' || props END
      WHEN 'click' THEN CASE WHEN value < 40 THEN 'Assertion failed: ' || props ELSE 'timed out' END
      ELSE CASE WHEN value < 25 THEN 'passed' ELSE 'no output' END END AS outcome,
    event_type || '/' || CASE WHEN value < 20 THEN 'zero_shot' WHEN value < 40 THEN 'zero_shot_cot'
      WHEN value < 60 THEN 'rag' ELSE 'other' END || '/run.jsonl' AS path FROM events))"""

SQL_KIND = """CASE WHEN outcome IN ('passed', 'correct') THEN 'passed'
    WHEN outcome LIKE 'failed:%' OR outcome LIKE 'Execution failed:%' THEN 'execution_error'
    WHEN outcome LIKE 'Assertion failed:%' THEN 'assertion_error'
    WHEN outcome = 'timed out' THEN 'timeout' ELSE 'other' END"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    kind, value, props = F.col("event_type"), F.col("value"), F.col("props")
    even = F.col("user_id") % 2 == 0
    outcome = (
        F.when(kind == "purchase", F.lit("passed")).when(kind == "signup", F.lit("correct"))
        .when((kind == "error") & (value < 30), F.concat(F.lit("failed: "), props))
        .when(kind == "error", F.concat(F.lit("Execution failed: "), props))
        .when((kind == "click") & (value < 40), F.concat(F.lit("Assertion failed: "), props))
        .when(kind == "click", F.lit("timed out"))
        .when(value < 25, F.lit("passed")).otherwise(F.lit("no output")))
    folder = (
        F.when(value < 20, "zero_shot").when(value < 40, "zero_shot_cot")
        .when(value < 60, "rag").otherwise("other"))
    return table(spark, d, "events").select(
        "event_id", "user_id", "value", "props",
        F.concat(F.lit("model"), (F.col("user_id") % 5).cast("string")).alias("model"),
        F.when(even, "pandas").otherwise("numpy").alias("source"),
        F.when(even, "numpy").otherwise("pandas").alias("target"),
        outcome.alias("result"),
        outcome.isin(*E.PASSED).alias("passed"),
        F.concat(kind, F.lit("/"), folder, F.lit("/run.jsonl")).alias("path"),
        F.struct("event_id", "user_id").alias("ground_truth"),
        F.struct("event_id", "props").alias("prediction"),
    )


@query("e01_pair", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, d):
    return E.pair(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select(
        "doc_id", "lang", "quality")


@query("e01_pair_report", """
    SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n_paired,
           count(*) FILTER (l.doc_id IS NULL) AS n_truth_only,
           count(*) FILTER (d.doc_id IS NULL) AS n_prediction_only
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, d):
    return E.pairing_report(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("e02_clean_prediction", f"""
    SELECT doc_id, md5(trim(replace(replace(replace(response, '```', ''), 'Python', ''), 'python', ''), {SPACE}))
    AS code_md5 FROM {SQL_RESPONSES}""")
def _(spark, d):
    return responses(spark, d).select(
        "doc_id", F.md5(X.clean_prediction(F.col("response"))).alias("code_md5"))


SQL_QUIET = quote(E.QUIET_TENSORFLOW)


@query("e03_program_text", f"""
    SELECT doc_id, md5(CASE WHEN lang = 'en' THEN {SQL_QUIET} ELSE '' END || 'import ' || source || chr(10)
      || 'x = ' || n_chars || chr(10) || text || chr(10) || 'setup()' || chr(10)
      || 'assert ' || doc_id || chr(10) || 'assert ' || lang || chr(10)) AS program_md5 FROM documents""")
def _(spark, d):
    number = lambda c: F.col(c).cast("string")
    test = F.struct(
        F.lit("setup()").alias("setup_code"),
        F.array(F.concat(F.lit("assert "), number("doc_id")), F.concat(F.lit("assert "), "lang")).alias("test_cases"))
    program = E.framework_program(
        F.when(F.col("lang") == "en", "tensorflow").otherwise("pytorch"),
        F.concat(F.lit("import "), "source"), F.concat(F.lit("x = "), number("n_chars")),
        F.col("text"), test)
    return table(spark, d, "documents").select("doc_id", F.md5(program).alias("program_md5"))


@query("e03_program_text_library", """
    SELECT p_partkey, p_brand || chr(10) || 'def test_' || CASE WHEN p_size > 25 THEN 'string(s)' ELSE 'other()' END
      || chr(10) || 'code = ''' || p_name || '''' || chr(10) || 'test_execution(code)' || chr(10)
      || CASE WHEN p_size > 25 THEN 'test_string(code)' || chr(10) ELSE chr(10) END AS program FROM part""")
def _(spark, d):
    test = F.concat(
        F.lit("def test_"), F.when(F.col("p_size") > 25, F.lit("string(s)")).otherwise(F.lit("other()")))
    program = E.library_program(test, F.col("p_brand"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", program.alias("program"))


# -- result comparison -----------------------------------------------------------------

@query("e04_normalise", """
    SELECT round(CAST(event_id AS DOUBLE) + 1e-10, 1) AS event_id,
      strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END
        AS ts,
      strftime(ts, '%Y-%m-%d') AS day, event_type, round(value / 3 + 1e-10, 1) AS third,
      round(CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) + 1e-10, 1) AS exact,
      CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS large,
      CASE WHEN event_type = 'error' THEN NULL ELSE round(CAST(user_id AS DOUBLE) + 1e-10, 1) END AS user_id
    FROM events""")
def _(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", "ts", F.to_date("ts").alias("day"), "event_type", (F.col("value") / 3).alias("third"),
        F.col("value").cast("decimal(12,2)").alias("exact"), (F.col("value") > 50).alias("large"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"))
    return E.normalise(raw)


@query("e05_coerce_shape", """
    SELECT o_orderpriority AS _c0, count(*) AS _c1 FROM orders GROUP BY o_orderpriority""")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").count()
    return E.positional(counts)


# Two answers to one question; the second calls the largest orders by another name.
SQL_LEFT = "(SELECT o_orderstatus AS a, o_orderpriority AS b, year(o_orderdate) AS y FROM orders)"
SQL_RIGHT = """(SELECT o_orderstatus AS a, CASE WHEN o_totalprice > 490000 THEN '9-OTHER' ELSE o_orderpriority END AS b,
    year(o_orderdate) AS y FROM orders)"""


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders")
    other = F.when(F.col("o_totalprice") > 490000, F.lit("9-OTHER")).otherwise(F.col("o_orderpriority"))
    status, year = F.col("o_orderstatus").alias("a"), F.year("o_orderdate").cast("long").alias("y")
    return (orders.select(status, F.col("o_orderpriority").alias("b"), year), orders.select(status, other.alias("b"), year))


def _runs_sql(rows: str) -> str:
    return f"""(SELECT a, b, y, n, CAST(sum(n) OVER (ORDER BY y DESC, a, b) - n AS BIGINT) AS start
      FROM (SELECT a, b, y, count(*) AS n FROM {rows} GROUP BY a, b, y))"""


@query("e06_equal_ordered", f"""
    SELECT coalesce(l.start, r.start) AS start, l.n AS left_n, l.a AS left_a, l.b AS left_b, l.y AS left_y,
      r.n AS right_n, r.a AS right_a, r.b AS right_b, r.y AS right_y
    FROM {_runs_sql(SQL_LEFT)} l FULL JOIN {_runs_sql(SQL_RIGHT)} r ON l.start = r.start
    WHERE l.start IS NULL OR r.start IS NULL OR (l.n, l.a, l.b, l.y) IS DISTINCT FROM (r.n, r.a, r.b, r.y)""")
def _(spark, d):
    left, right = _answers(spark, d)
    return E.differing_runs(left, right, [F.col("y").desc()], [F.col("y").desc()])


def _ordered_sql(order: str) -> str:
    return f"""(SELECT row(a, b, y, n) AS run, CAST(sum(n) OVER (ORDER BY {order}) - n AS BIGINT) AS start
      FROM (SELECT a, b, y, count(*) AS n FROM {SQL_LEFT} GROUP BY a, b, y))"""


# The same answer in orders of its own: reversed, the same, and the same but for ties.
RIGHT_ORDERS = {
    "reversed": ("y, a, b", lambda: [F.col("y").asc()]),
    "same": ("y DESC, a, b", lambda: [F.col("y").desc()]),
    "other_ties": ("y DESC, a DESC, b", lambda: [F.col("y").desc(), F.col("a").desc()]),
}


@query("e06_orders", " UNION ALL ".join(f"""
    SELECT {quote(name)} AS case_name, count(*) AS n_differing FROM {_ordered_sql("y DESC, a, b")} l
      FULL JOIN {_ordered_sql(order)} r ON l.start = r.start WHERE l.run IS DISTINCT FROM r.run"""
    for name, (order, _) in RIGHT_ORDERS.items()))
def _(spark, d):
    """One result against itself in three declared orders; only the same order has no differing place."""
    left, _ = _answers(spark, d)
    found = [
        E.differing_runs(left, left.repartition(5), [F.col("y").desc()], order(), places=512, fan=4).agg(
            F.lit(name).alias("case_name"), F.count("*").alias("n_differing"))
        for name, (_, order) in RIGHT_ORDERS.items()]
    return reduce(DataFrame.unionByName, found)


@query("e07_equal_bag", f"""
    SELECT a, b, y, CAST(sum(sign) AS BIGINT) AS surplus FROM
      (SELECT a, b, y, 1 AS sign FROM {SQL_LEFT} UNION ALL SELECT a, b, y, -1 FROM {SQL_RIGHT})
    GROUP BY a, b, y HAVING sum(sign) <> 0""")
def _(spark, d):
    return E.differing_rows(*_answers(spark, d))


# -- outcomes and roll-ups -------------------------------------------------------------

@query("e08_classify", f"SELECT event_id, {SQL_KIND} AS kind FROM {SQL_CASES}")
def _(spark, d):
    return cases(spark, d).select("event_id", E.classify(F.col("result")).alias("kind"))


@query("e09_accuracy", f"""
    SELECT model, source, target, count(*) AS n_cases, count(*) FILTER (passed) AS n_passed,
      count(*) FILTER (kind = 'execution_error') AS execution_errors, count(*) FILTER (kind = 'timeout') AS timeouts,
      count(*) FILTER (kind = 'assertion_error') AS assertion_errors, count(*) FILTER (NOT passed) AS total_errors,
      count(*) FILTER (passed) * 100.0::DOUBLE / count(*) AS accuracy
    FROM (SELECT *, {SQL_KIND} AS kind FROM {SQL_CASES}) GROUP BY model, source, target""")
def _(spark, d):
    return E.accuracy(cases(spark, d), ["model", "source", "target"])


@query("e10_failures", f"""
    SELECT event_id, user_id, props, outcome AS error_result FROM {SQL_CASES} WHERE NOT passed""")
def _(spark, d):
    return E.failures(cases(spark, d)).select(
        "ground_truth.event_id", "ground_truth.user_id", "prediction.props", "error_result")


def _log_sql(domain: str) -> str:
    wanted, vetoes = E.LOGGED_RUNS[domain]
    rule = "(" + " OR ".join(f"contains(path, {quote(p)})" for p in wanted) + ")"
    rule += "".join(f" AND NOT contains(path, {quote(p)})" for p in vetoes)
    return (f"SELECT {quote(domain)} AS domain, model, source, target, event_id, props, passed, "
            f"outcome AS error_result FROM {SQL_CASES} WHERE {rule}")


@query("e11_case_log", " UNION ALL ".join(_log_sql(domain) for domain in E.LOGGED_RUNS))
def _(spark, d):
    logs = [
        E.case_log(cases(spark, d), domain).select(
            F.lit(domain).alias("domain"), "model", "source", "target", "ground_truth.event_id",
            "prediction.props", "passed", "error_result")
        for domain in E.LOGGED_RUNS
    ]
    return reduce(DataFrame.unionByName, logs)


SQL_RUN_PATHS = """(SELECT doc_id, 'runs/' || source || '/' || lang || '-model_v' || (n_chars % 4) || '_' ||
    CASE WHEN n_chars < 300 THEN 'postgresql_to_pandas' WHEN n_chars < 600 THEN 'np_to_pd'
      WHEN n_chars < 1200 THEN 'pytorch_to_tensorflow' ELSE 'other' END || '.jsonl' AS path FROM documents)"""


def _metadata_sql(domain: str) -> str:
    parts, (a, b) = E.RUN_DIRECTIONS[domain]
    forward = "(" + " OR ".join(f"contains(path, {quote(p)})" for p in parts) + ")"
    name = "string_split(path, '/')[-1]"
    first = f"split_part({name}, '_', 1)"
    if domain == "query":
        model, version = first, f"split_part({name}, '_', 2)"
    else:
        model, version = f"{first} || '_' || {name}", name
    return (f"SELECT doc_id, {quote(domain)} AS domain, string_split(path, '/')[-2] AS folder, {model} AS model, "
            f"{version} AS version, CASE WHEN {forward} THEN {quote(a)} ELSE {quote(b)} END AS source, "
            f"CASE WHEN {forward} THEN {quote(b)} ELSE {quote(a)} END AS target FROM {SQL_RUN_PATHS}")


@query("e12_run_metadata", " UNION ALL ".join(_metadata_sql(domain) for domain in E.RUN_DIRECTIONS))
def _(spark, d):
    way = (
        F.when(F.col("n_chars") < 300, "postgresql_to_pandas").when(F.col("n_chars") < 600, "np_to_pd")
        .when(F.col("n_chars") < 1200, "pytorch_to_tensorflow").otherwise("other"))
    paths = table(spark, d, "documents").select(
        "doc_id", F.concat(
            F.lit("runs/"), "source", F.lit("/"), "lang", F.lit("-model_v"),
            (F.col("n_chars") % 4).cast("string"), F.lit("_"), way, F.lit(".jsonl")).alias("path"))
    domains = F.array(*[
        F.struct(F.lit(domain).alias("domain"), E.run_metadata(F.col("path"), domain).alias("m"))
        for domain in E.RUN_DIRECTIONS])
    return paths.select("doc_id", F.explode(domains).alias("r")).select("doc_id", "r.domain", "r.m.*")


# Part names as the truth; every run has another kind of mistake in every so many lines.
RUN_FILES = {
    # path: (lines of the run per truth line that are wrong, lines it stops before the end)
    "zero_shot/alpha_v1_postgresql_to_pandas": (5, 0), "rag/alpha_v2_pandas_to_postgresql": (3, 40), "drafts/beta_v1_other": (2, 7),
}
SQL_TRUTH = "(SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, count(*) OVER () AS n FROM part)"


def _run_sql(path: str) -> str:
    wrong, short = RUN_FILES[path]
    folder, name = path.split("/")
    source, target = ("PostgreSQL", "Pandas") if "postgresql_to_pandas" in path else ("Pandas", "PostgreSQL")
    return f"""SELECT {quote(path)} AS run, {quote(folder)} AS folder, {quote(name.split("_")[0])} AS model, {quote(name.split("_")[1])} AS version,
      {quote(source)} AS source, {quote(target)} AS target, count(*) AS n_cases,
      count(*) FILTER (line_no % {wrong} > 0 AND line_no % 10 <> 9) AS n_passed, count(*) FILTER (line_no % 10 = 9) AS execution_errors,
      CAST(0 AS BIGINT) AS timeouts, count(*) FILTER (line_no % {wrong} = 0 AND line_no % 10 <> 9) AS assertion_errors,
      count(*) FILTER (line_no % {wrong} = 0 OR line_no % 10 = 9) AS total_errors,
      count(*) FILTER (line_no % {wrong} > 0 AND line_no % 10 <> 9) * 100.0::DOUBLE / count(*) AS accuracy,
      CAST({short} AS BIGINT) AS n_truth_only, CAST(0 AS BIGINT) AS n_prediction_only,
      CAST({f"count(*)" if folder != "drafts" else "0"} AS BIGINT) AS n_logged
      FROM {SQL_TRUTH} WHERE line_no < n - {short}"""


@query("e12_scores_from_files", " UNION ALL ".join(map(_run_sql, RUN_FILES)))
def _(spark, d):
    """Runs in files, paired by line, scored twice: the second time replaces the first."""
    root = scratch_path(spark, "scores")
    numbered, n = number_rows(table(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_partkey")], "line_no")
    numbered = settle(numbered)

    def write(rows: DataFrame, path: str) -> None:
        rows.repartitionByRange(3, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)

    write(numbered.select("line_no", F.to_json(F.struct(F.col("p_name").alias("answer"))).alias("value")), f"{root}/truth.jsonl")
    for path, (wrong, short) in RUN_FILES.items():
        answer = F.concat(F.lit("```python\n"), "p_name", F.when(F.col("line_no") % wrong == 0, F.lit("?")).otherwise(F.lit("")), F.lit("\n```"))
        line = F.when(F.col("line_no") % 10 == 9, F.lit("{")).otherwise(F.to_json(F.struct(answer.alias("response"))))
        write(numbered.where(F.col("line_no") < n - short).select("line_no", line.alias("value")), f"{root}/runs/{path}.jsonl")
    for _ in range(2):
        score_files(spark, f"{root}/truth.jsonl", "answer string", f"{root}/runs", "response string", "query",
                    same_text("answer", "response"), f"{root}/out", "*.txt")
    logged = read_scores(spark, f"{root}/out", "cases").groupBy("run").agg(F.count("*").alias("n_logged"))
    return read_scores(spark, f"{root}/out", "accuracy").join(logged, "run", "left").fillna(0, ["n_logged"])


# -- SQL pairs -------------------------------------------------------------------------

BY_CUSTOMER = "SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS decimal(18,2))) AS v FROM orders GROUP BY 1"
PAIRS = [
    # (reference, candidate, order places)
    (BY_CUSTOMER,
     "SELECT c_custkey, count(*), sum(CAST(o_totalprice AS decimal(18,2))) FROM customer "
     "JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    (BY_CUSTOMER, BY_CUSTOMER.replace("orders", "orders WHERE o_orderstatus <> 'F'"), None),
    ("SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name DESC", None),
    ("SELECT l_returnflag, avg(l_quantity) FROM lineitem GROUP BY 1",
     "SELECT l_returnflag, sum(l_quantity) / count(*) FROM lineitem GROUP BY 1", None),
    ("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000",
     "SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", None),
    ("SELECT o_orderkey, o_totalprice FROM orders", "SELECT o_orderkey, o_totalprice FROM orders", [-2, 1]),
    ("SELECT count(*) FROM orders", "SELECT count(DISTINCT o_custkey), 1 FROM orders", None),
    ("SELECT count(*) FROM orders", "SELECT count(no_such_column) FROM orders", None),
    ("SELECT count(*) FROM orders", "DROP TABLE orders", None),
]


def _pair_sql(at: int, reference: str, candidate: str) -> str:
    """DuckDB's verdict for the pairs that run: no row left over on either side."""
    if "ORDER BY" in reference:  # one sort column, the first: its values must come in the same order
        return f"""SELECT CAST({at} AS BIGINT) AS pair_id, (SELECT list(COLUMNS(*)) FROM ({reference}))
            = (SELECT list(COLUMNS(*)) FROM ({candidate})) AS passed"""
    return f"""SELECT CAST({at} AS BIGINT) AS pair_id, NOT EXISTS (
        (SELECT * FROM ({reference}) EXCEPT ALL SELECT * FROM ({candidate})) UNION ALL
        (SELECT * FROM ({candidate}) EXCEPT ALL SELECT * FROM ({reference}))) AS passed"""


SQL_PAIRS = " UNION ALL ".join(
    [_pair_sql(i, r, c) for i, (r, c, _) in enumerate(PAIRS[:6])]
    + [f"SELECT CAST({i} AS BIGINT), false" for i in (6, 7, 8)])


@query("e13_sql_pair_harness", f"""
    SELECT pair_id, passed, CASE WHEN passed THEN 'passed' WHEN pair_id >= 7 THEN 'execution_error'
      ELSE 'assertion_error' END AS kind FROM ({SQL_PAIRS})""")
def _(spark, d):
    texts = [
        {"pair_id": i, "reference_sql": r, "candidate_sql": c, "order_by": o}
        for i, (r, c, o) in enumerate(PAIRS)
    ]
    scored = score_pairs(spark, d, ["orders", "customer", "nation", "lineitem"], texts, seconds=600)
    return scored.select("pair_id", "passed", E.classify(F.col("result")).alias("kind"))


ORDERED = [
    # One column each, so that equal lists are equal results, ties included.
    ("SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC", "SELECT o_totalprice FROM orders ORDER BY 1 DESC", None),
    ("SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC", "SELECT o_totalprice FROM orders ORDER BY 1", None),
    ("SELECT o_totalprice FROM orders ORDER BY o_totalprice", "SELECT o_totalprice FROM orders", None),
    ("SELECT o_orderpriority FROM orders ORDER BY 1", "SELECT o_orderpriority AS p FROM orders ORDER BY p, o_orderkey DESC", None),
    ("SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_regionkey, n_name", None),
]


@query("e13_sql_pair_ordered", " UNION ALL ".join(_pair_sql(i, r, c) for i, (r, c, _) in enumerate(ORDERED)))
def _(spark, d):
    """Reversed, missing and other orders fail; equal orders and ties pass."""
    texts = [{"pair_id": i, "reference_sql": r, "candidate_sql": c} for i, (r, c, _) in enumerate(ORDERED)]
    return score_pairs(spark, d, ["orders", "nation"], texts, seconds=600).select("pair_id", "passed")
