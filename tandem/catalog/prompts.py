"""Prompt building and response handling."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandem.catalog.registry import query, quote
from tandem.functions import text as X
from tandem.plans import prompts as P
from tandem.plans.inference import batch_infer, in_order, number_batches
from tandem.plans.templates import SIDES, TEMPLATES, VERSIONS
from tandem.sources.tables import table

SPACE = quote(X.PY_SPACE)

# -- items derived from the tables -----------------------------------------------------

SQL_QUERY_ITEMS = """(SELECT p_partkey AS item_id,
    'SELECT p_name FROM part WHERE p_brand = ''' || p_brand || ''' AND p_size > ' || p_size AS "SQL",
    'result = part[(part.p_brand == "' || p_brand || '") & (part.p_size > ' || p_size || ')].p_name' AS pandas_query,
    'db/' || p_type || '.sqlite' AS db_path FROM part)"""
SQL_SCHEMAS = """(SELECT 'db/' || p_type || '.sqlite' AS db_path,
    'Table: ' || string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS pandas_schema,
    'CREATE TABLE ' || string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS postgresql_schema
    FROM part GROUP BY p_type)"""


def query_items(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit("SELECT p_name FROM part WHERE p_brand = '"), "p_brand",
                 F.lit("' AND p_size > "), size).alias("SQL"),
        F.concat(F.lit('result = part[(part.p_brand == "'), "p_brand",
                 F.lit('") & (part.p_size > '), size, F.lit(")].p_name")).alias("pandas_query"),
        F.concat(F.lit("db/"), "p_type", F.lit(".sqlite")).alias("db_path"),
    )


def schema_texts(spark: SparkSession, d: str) -> DataFrame:
    """One schema text per database; a database has few distinct brands."""
    brands = table(spark, d, "part").select("p_type", "p_brand").distinct()
    names = F.array_sort(F.collect_set("p_brand"))
    return brands.groupBy("p_type").agg(names.alias("names")).select(
        F.concat(F.lit("db/"), "p_type", F.lit(".sqlite")).alias("db_path"),
        F.concat(F.lit("Table: "), F.array_join("names", ", ")).alias("pandas_schema"),
        F.concat(F.lit("CREATE TABLE "), F.array_join("names", "; ")).alias("postgresql_schema"),
    )


def _wide(key: Column, word: Column, sides: tuple[str, str], question: Column | None) -> list[Column]:
    columns = []
    for side in sides:
        s = side.lower()
        fields = {"example_input": "x = ", "start_code": f"import {s} as ", "sol_code": f"{s}.run("}
        if question is None:
            fields["question"] = f"How does {s} show "
        columns += [
            F.concat(F.lit(lead), word, F.lit(" # "), key.cast("string")).alias(f"{s}_{name}")
            for name, lead in fields.items()
        ]
    return columns if question is None else [*columns, question.alias("question")]


def _sql_side(side: str, name: str, key: str, word: str, question: str | None) -> str:
    s = side.lower()
    if name == "question" and question is not None:
        return question
    lead = {"example_input": "x = ", "start_code": f"import {s} as ", "sol_code": f"{s}.run(",
            "question": f"How does {s} show "}[name]
    return f"{quote(lead)} || {word} || ' # ' || {key}"


def library_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("item_id"),
        *_wide(F.col("c_custkey"), F.col("c_mktsegment"), SIDES["library"], None))


def framework_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"),
        *_wide(F.col("doc_id"), F.col("source"), SIDES["framework"], F.col("text")))


# -- oracle texts ----------------------------------------------------------------------

def _fill_sql(template: str, slots: dict[str, str]) -> str:
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(quote(text))
        if name:
            parts.append(f"coalesce({slots[name]}, '')")
    return " || ".join(parts)


def _prompt_sql(domain: str, items: str, side, question) -> str:
    """All prompts as a UNION of one SELECT per version and direction."""
    selects = []
    first, second = SIDES[domain]
    for a, b in ((first, second), (second, first)):
        for version, folder in VERSIONS.items():
            if domain == "query":
                kind = {"PostgreSQL": "'PostgreSQL query'", "Pandas": "'pandas query'"}
                slots = {
                    "source_name": quote(a), "target_name": quote(b),
                    "source_kind": kind[a], "target_kind": kind[b],
                    "source_query": '"SQL"' if a == "PostgreSQL" else "pandas_query",
                    "source_schema": f"{a.lower()}_schema", "target_schema": f"{b.lower()}_schema",
                    "fence": "'Python'" if b == "Pandas" else "'SQL'",
                    "note": quote(" Leave the outcome in a variable called `result`." if b == "Pandas" else ""),
                }
            else:
                slots = {
                    "source_name": quote(a), "target_name": quote(b),
                    "source_start": side(a, "start_code"), "source_code": side(a, "sol_code"),
                    "target_input": side(b, "example_input"), "target_start": side(b, "start_code"),
                    "source_question": side(a, "question"), "target_question": side(b, "question"),
                }
            prompt = _fill_sql(TEMPLATES[domain][version], slots)
            selects.append(
                f"SELECT item_id, {quote(version)} AS version, {quote(folder)} AS folder, "
                f"{quote(f'{a.lower()}_to_{b.lower()}')} AS direction, {prompt} AS prompt FROM {items}"
            )
    return ("SELECT item_id, version, direction, folder || '/' || version || '_' || direction || '.jsonl' "
            "AS file, md5(prompt) AS prompt_md5, length(prompt) AS prompt_length FROM ("
            + " UNION ALL ".join(selects) + ")")


def _digest(prompts: DataFrame) -> DataFrame:
    return prompts.select(
        "item_id", "version", "direction",
        P.prompt_file(F.col("version"), F.col("folder"), F.col("direction")).alias("file"),
        F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("prompt_length"))


def _lib_side(side, name):
    return _sql_side(side, name, "c_custkey", "c_mktsegment", None)


def _fw_side(side, name):
    return _sql_side(side, name, "doc_id", "source", "text")


@query("p01_field_split", " UNION ALL ".join(
    f"SELECT c_custkey AS item_id, {quote(side)} AS name, " + ", ".join(
        f"{_lib_side(side, name)} AS {name}" for name in P.FIELDS) + " FROM customer"
    for side in SIDES["library"]))
def _(spark, d):
    return P.split_fields(library_items(spark, d), "library")


SQL_QUERY_SOURCE = f"(SELECT * FROM {SQL_QUERY_ITEMS} i JOIN {SQL_SCHEMAS} s USING (db_path))"


@query("p02_template_fanout", _prompt_sql("query", SQL_QUERY_SOURCE, None, None))
def _(spark, d):
    items = P.attach_schemas(query_items(spark, d), schema_texts(spark, d))
    return _digest(P.build_prompts(items, "query"))


@query("p03_template_render_library", _prompt_sql(
    "library", "(SELECT *, c_custkey AS item_id FROM customer)", _lib_side, None))
def _(spark, d):
    return _digest(P.build_prompts(library_items(spark, d), "library"))


@query("p03_template_render_framework", _prompt_sql(
    "framework", "(SELECT *, doc_id AS item_id FROM documents)", _fw_side, None))
def _(spark, d):
    return _digest(P.build_prompts(framework_items(spark, d), "framework"))


@query("p04_version_args", " UNION ALL ".join(
    f"SELECT c_custkey AS item_id, {quote(v)} AS version, {quote(a.lower() + '_to_' + b.lower())} AS direction, "
    + (f"{_lib_side(a, 'question')} AS source_question, {_lib_side(b, 'question')} AS target_question"
       if v == "intent" else "CAST(NULL AS VARCHAR) AS source_question, CAST(NULL AS VARCHAR) AS target_question")
    + " FROM customer"
    for v in VERSIONS for a, b in (SIDES["library"], SIDES["library"][::-1])))
def _(spark, d):
    pairs = P.by_direction(library_items(spark, d), "library")
    versions = F.explode(F.array(*[F.lit(v) for v in VERSIONS])).alias("version")
    rows = pairs.select("*", versions)
    given = P.version_arguments(F.col("version"), "library")
    return rows.select("item_id", "version", "direction", *[c.alias(n) for n, c in given.items()])


# -- responses -------------------------------------------------------------------------

SQL_FILES = """(SELECT doc_id, 'out/' || source || '_ragv1_' ||
    CASE lang WHEN 'en' THEN 'pd_to_np' WHEN 'de' THEN 'py_to_tf' WHEN 'fr' THEN 'pandas_to_postgresql'
    ELSE 'identify_other' END || '_' || CASE WHEN n_chars > 1000 THEN 'postgresql' ELSE 'np_to_pd' END
    || '.jsonl' AS file FROM documents)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    middle = (
        F.when(F.col("lang") == "en", "pd_to_np").when(F.col("lang") == "de", "py_to_tf")
        .when(F.col("lang") == "fr", "pandas_to_postgresql").otherwise("identify_other"))
    last = F.when(F.col("n_chars") > 1000, "postgresql").otherwise("np_to_pd")
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("out/"), "source", F.lit("_ragv1_"), middle, F.lit("_"), last,
                           F.lit(".jsonl")).alias("file"))


@query("p12_direction_of", f"""
    SELECT doc_id, library_direction, query_direction, intent_direction,
      CASE library_direction WHEN 'pd_to_np' THEN 'NumPy' WHEN 'np_to_pd' THEN 'Pandas'
        WHEN 'py_to_tf' THEN 'TensorFlow' ELSE 'PyTorch' END AS library
    FROM (SELECT doc_id,
      CASE WHEN contains(file, 'pd_to_np') THEN 'pd_to_np' WHEN contains(file, 'np_to_pd') THEN 'np_to_pd'
        WHEN contains(file, 'py_to_tf') THEN 'py_to_tf' ELSE 'tf_to_py' END AS library_direction,
      CASE WHEN contains(file, 'pandas_to_postgresql') THEN 'pandas_to_postgresql'
        ELSE 'postgresql_to_pandas' END AS query_direction,
      CASE WHEN contains(file, 'pd_to_np') THEN 'pd_to_np' WHEN contains(file, 'np_to_pd') THEN 'np_to_pd'
        WHEN contains(file, 'py_to_tf') THEN 'py_to_tf' WHEN contains(file, 'tf_to_py') THEN 'tf_to_py'
        WHEN contains(file, 'pandas_to_postgresql') THEN 'pandas_to_postgresql'
        ELSE 'postgresql_to_pandas' END AS intent_direction
    FROM {SQL_FILES})""")
def _(spark, d):
    name = F.col("file")
    found = _files(spark, d).select(
        "doc_id", X.library_direction(name).alias("library_direction"),
        X.query_direction(name).alias("query_direction"),
        X.intent_direction(name).alias("intent_direction"))
    return found.withColumn("library", X.library_of(F.col("library_direction")))


@query("p13_target_language", f"""
    SELECT doc_id, CASE WHEN string_split(split_part(name, '.', 1), '_')[-1] = 'postgresql' THEN 'SQL'
      WHEN contains(name, 'identify') THEN 'JSON' ELSE 'Python' END AS language
    FROM (SELECT doc_id, string_split(file, '/')[-1] AS name FROM {SQL_FILES})""")
def _(spark, d):
    return _files(spark, d).select("doc_id", X.target_language(F.col("file")).alias("language"))


@query("p14_chat_messages", """
    SELECT doc_id, 1 AS n_messages, 'user' AS role, md5(text) AS content_md5 FROM documents""")
def _(spark, d):
    chats = table(spark, d, "documents").select("doc_id", P.chat_messages(F.col("text")).alias("m"))
    return chats.select(
        "doc_id", F.size("m").alias("n_messages"), F.col("m")[0]["role"].alias("role"),
        F.md5(F.col("m")[0]["content"]).alias("content_md5"))


@query("p15_batching", """
    SELECT event_id, CAST(least((row_number() OVER (ORDER BY event_id) - 1) // 64,
        greatest(count(*) OVER () // 64, 1) - 1) AS BIGINT) AS batch_no FROM events""")
def _(spark, d):
    return number_batches(table(spark, d, "events").select("event_id"), "event_id", 64)


def _load_echo():
    """Stands for a model: echoes, but answers prompts of some lengths with blanks."""
    def model(prompts: list[str]) -> list[str]:
        return [" " if len(p) % 7 == 0 else "echo: " + p for p in prompts]

    return model


@query("p16_batch_infer", """
    SELECT doc_id, md5(CASE WHEN length(text) % 7 = 0 THEN '[INVALID]' ELSE 'echo: ' || text END) AS response_md5
    FROM documents""")
def _(spark, d):
    answered = batch_infer(table(spark, d, "documents"), _load_echo, prompt="text", tries=3)
    return answered.select("doc_id", F.md5("response").alias("response_md5"))


SQL_RESPONSES = """(SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN text
    WHEN 1 THEN 'Here:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 2 THEN '```python' || chr(10) || text || chr(10) || '...' || chr(10) || 'x = 1' || chr(10) || '```'
    WHEN 3 THEN '```PYTHON' || chr(10) || text || chr(10) || '```'
    WHEN 4 THEN chr(160) || '```python' || chr(10) || 'python sql Python SQL ' || text || ' '
    WHEN 5 THEN '```' || chr(10) || text || chr(10) || '```' || chr(10) || '```' || chr(10) || 'two' || chr(10) || '```'
    WHEN 6 THEN '```python' || chr(10) || chr(10) || '```' || text
    ELSE ' ' || chr(9) END AS response FROM documents)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Model answers with every kind of fence around the documents' texts."""
    text = F.col("text")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kinds = [
        text,
        join("Here:\n```\n", text, "\n```\nDone."),
        join("```python\n", text, "\n...\nx = 1\n```"),
        join("```PYTHON\n", text, "\n```"),
        join("\xa0```python\npython sql Python SQL ", text, " "),
        join("```\n", text, "\n```\n```\ntwo\n```"),
        join("```python\n\n```", text),
        F.lit(" \t"),
    ]
    answer = kinds[7]
    for i in range(6, -1, -1):
        answer = F.when(F.col("doc_id") % 8 == i, kinds[i]).otherwise(answer)
    return table(spark, d, "documents").select("doc_id", answer.alias("response"))


@query("p17_validity", f"""
    SELECT doc_id, md5(CASE WHEN length(response) <= 1 OR length(trim(response, {SPACE})) = 0
      THEN '[INVALID]' ELSE response END) AS response_md5 FROM {SQL_RESPONSES}""")
def _(spark, d):
    return responses(spark, d).select("doc_id", F.md5(X.mark_invalid(F.col("response"))).alias("response_md5"))


def _replace_sql(expression: str, words: list[str]) -> str:
    for word in words:
        expression = f"replace({expression}, {quote(word)}, '')"
    return expression


def _code_sql(language: str, words: list[str]) -> str:
    pattern = quote(rf"(?i)```(?:{language})?\n([\s\S]*?)\n```")
    bare = _replace_sql(f"trim(response, {SPACE})", words)
    return f"""
    SELECT doc_id, md5(trim(array_to_string(list_filter(string_split(code, chr(10)),
        lambda line: NOT contains(line, '...')), chr(10)), {SPACE})) AS code_md5
    FROM (SELECT doc_id, CASE WHEN regexp_matches(response, {pattern})
      THEN regexp_extract(response, {pattern}, 1) ELSE {bare} END AS code FROM {SQL_RESPONSES})"""


@query("p18_code_extract", _code_sql("Python", ["```", "sql", "SQL", "Python", "python"]))
def _(spark, d):
    return responses(spark, d).select("doc_id", F.md5(X.extract_code(F.col("response"))).alias("code_md5"))


@query("p18_code_extract_api", _code_sql("SQL", ["```", "sql", "SQL"]))
def _(spark, d):
    code = X.extract_code(F.col("response"), "SQL", "api")
    return responses(spark, d).select("doc_id", F.md5(code).alias("code_md5"))


@query("p19_reorder", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id")
def _(spark, d):
    mixed = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return in_order(mixed.repartition("user_id"), "event_id")
