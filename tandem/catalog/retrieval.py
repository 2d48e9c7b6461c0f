"""Operation lists, guide lookup, nearest neighbours, slots, and the whole chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.catalog.registry import query, quote
from tandem.functions import text as X
from tandem.plans import neighbours as N, retrieval as R, runs as W
from tandem.plans.inference import batch_infer, retrieve_and_translate, retrieve_apis_and_translate
from tandem.session import scratch_path, settle
from tandem.sources.tables import table

SPACE = quote(X.PY_SPACE)

# Lists with a repeated name, odd spacing and case, and names no guide has.
SQL_LISTS = """(SELECT p_partkey AS item_id,
    '["' || p_brand || '", "' || p_type || '" ,  ' || lower(p_type) || ', "' || p_brand || '", "' || p_name || '"]'
    AS response FROM part)"""
SQL_OPERATIONS = f"""(SELECT item_id, CAST(unnest(range(len(ops))) AS INTEGER) AS position, unnest(ops) AS operation
    FROM (SELECT item_id, list_transform(list_filter(list_transform(range(len(raw)), lambda i:
        struct_pack(i := i, o := raw[i + 1])), lambda s: list_position(raw, s.o) = s.i + 1), lambda s: s.o) AS ops
    FROM (SELECT item_id, list_transform(string_split(replace(replace(response, '[', ''), ']', ''), ','),
        lambda p: trim(trim(p, {SPACE}), '"')) AS raw FROM {SQL_LISTS})))"""

# Guide rows: one per brand and per type, and a second row for each type in lower case,
# which the first one hides.
SQL_GUIDE = """(SELECT min(p_partkey) AS line_no, p_brand AS operation,
      'SELECT ' || max(p_size) AS "postgreSQL", 'df.max() == ' || max(p_size) AS pandas FROM part GROUP BY p_brand
    UNION ALL SELECT min(p_partkey), p_type, 'SELECT ' || min(p_size), 'df.min() == ' || min(p_size)
      FROM part GROUP BY p_type
    UNION ALL SELECT 1000000000 + min(p_partkey), lower(p_type) || ' ', 'hidden', 'hidden' FROM part GROUP BY p_type)"""
SQL_ENTRIES = f"""(SELECT lower(trim(operation, {SPACE})) AS match_key, arg_min(operation, line_no) AS name,
    arg_min("postgreSQL", line_no) AS sql, arg_min(pandas, line_no) AS frame FROM {SQL_GUIDE} GROUP BY 1)"""
SQL_HITS = f"""(SELECT item_id, position, operation, name, sql, frame FROM {SQL_OPERATIONS} o
    JOIN {SQL_ENTRIES} e ON lower(trim(o.operation, {SPACE})) = e.match_key)"""
SQL_SINGLE = f"""(SELECT item_id, name, min(position) AS position, arg_max(sql, position) AS sql,
    arg_max(frame, position) AS frame FROM {SQL_HITS} GROUP BY item_id, name)"""
SQL_TEXTS = f"""(SELECT item_id, trim(string_agg(n || '. ' || name || ':' || chr(10) || 'PostgreSQL Solution: ' || sql
      || chr(10) || 'Pandas Solution: ' || frame || chr(10) || chr(10), '' ORDER BY n), {SPACE}) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY position) AS n FROM {SQL_SINGLE})
    GROUP BY item_id)"""


def operation_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('" ,  '), F.lower("p_type"),
                 F.lit(', "'), "p_brand", F.lit('", "'), "p_name", F.lit('"]')).alias("response"))


def guide(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    size = lambda f: f("p_size").cast("string")
    first = F.min("p_partkey")

    def rows(name, line, sql, frame, key):
        return parts.groupBy(key).agg(line.alias("line_no"), sql.alias("postgreSQL"), frame.alias("pandas")).select(
            "line_no", name.alias("operation"), "postgreSQL", "pandas")

    brands = rows(F.col("p_brand"), first, F.concat(F.lit("SELECT "), size(F.max)),
                  F.concat(F.lit("df.max() == "), size(F.max)), "p_brand")
    types = rows(F.col("p_type"), first, F.concat(F.lit("SELECT "), size(F.min)),
                 F.concat(F.lit("df.min() == "), size(F.min)), "p_type")
    hidden = rows(F.concat(F.lower("p_type"), F.lit(" ")), first + 1_000_000_000,
                  F.first(F.lit("hidden")), F.first(F.lit("hidden")), "p_type")
    return brands.unionByName(types).unionByName(hidden)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    found = R.keyword_join(
        R.explode_operations(operation_lists(spark, d), "item_id", "response"), guide(spark, d))
    return found.select(
        "item_id", "position", "operation", F.col("entry.operation").alias("name"),
        F.col("entry.postgreSQL").alias("sql"), F.col("entry.pandas").alias("frame"))


def _single(spark: SparkSession, d: str) -> DataFrame:
    return R.last_by_name(_hits(spark, d), "item_id", "name", F.struct("name", "sql", "frame"), "position")


@query("p05_oplist_parse", f"SELECT item_id, position, operation FROM {SQL_OPERATIONS}")
def _(spark, d):
    return R.explode_operations(operation_lists(spark, d), "item_id", "response")


@query("p06_keyword_join", f"SELECT item_id, position, operation, name, sql, frame FROM {SQL_HITS}")
def _(spark, d):
    return _hits(spark, d)


@query("p07_knn_filtered", """
    SELECT query_id, doc_id, round(distance, 6) AS distance FROM (
      SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
        list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY
          list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), c.vec_id) AS rank
      FROM embeddings q JOIN embeddings c ON (q.label + 1) % 10 = c.label) WHERE rank = 1""")
def _(spark, d):
    """Nearest vector of the following label, for every vector."""
    vectors = table(spark, d, "embeddings")
    asking = vectors.withColumn("label", (F.col("label") + 1) % 10)
    best = R.nearest(asking, vectors, "label", "vec_id", "vec_id")
    return best.select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


@query("p07_knn_filtered_top3", """
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(distance, 6) AS distance FROM (
      SELECT q.vec_id AS query_id, c.vec_id AS doc_id,
        list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY
          list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), c.vec_id) AS rank
      FROM embeddings q JOIN embeddings c USING (label)) WHERE rank <= 3""")
def _(spark, d):
    """Three nearest of each vector's own label, itself included."""
    vectors = table(spark, d, "embeddings")
    best = R.nearest(vectors, vectors, "label", "vec_id", "vec_id", k=3)
    return best.select("query_id", "rank", "doc_id", F.round("distance", 6).alias("distance"))


def _nearest_sql(queries: str, corpus: str, match: str, k: int) -> str:
    return f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(distance, 6) AS distance FROM (
      SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_distance(q.e, c.e) AS distance,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, c.e), c.vec_id) AS rank
      FROM {queries} q JOIN {corpus} c ON {match}) WHERE rank <= {k}"""


SQL_VECTORS = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("p07_knn_balls", _nearest_sql(SQL_VECTORS, SQL_VECTORS, "(q.label + 3) % 10 = c.label", 2))
def _(spark, d):
    """Two nearest vectors of another label, by balls that are skipped where they are too far away."""
    vectors = table(spark, d, "embeddings")
    asking = N.balls(vectors.withColumn("label", (F.col("label") + 3) % 10), "label", "vec_id", "embedding", 32)
    found = N.nearest_by_balls(asking, N.balls(vectors, "label", "vec_id", "embedding", 128), k=2)
    return found.rows.withColumn("distance", F.round("distance", 6))


# Every seventh vector has no distance, in one of five ways; the odd ones are asked for and searched too.
SQL_ODD = """(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id % 7 > 0 AND label IS NOT NULL)"""


@query("p07_knn_odd_vectors", _nearest_sql(SQL_ODD, SQL_ODD, "q.label = c.label", 2))
def _(spark, d):
    """Null vectors, null, NaN and infinite entries and other lengths in the groups of good vectors."""
    v = F.col("embedding")
    put = lambda x: F.transform(v, lambda e, i: F.when(i == 3, F.lit(x).cast("float")).otherwise(e))
    ways = [F.lit(None).cast("array<float>"), put(None), put(float("nan")), put(float("-inf")), F.slice(v, 1, 0)]
    kind = F.floor(F.col("vec_id") / 7) % 5
    odd = F.coalesce(*(F.when(kind == i, F.struct(w.alias("v"))) for i, w in enumerate(ways)))
    vectors = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, odd["v"]).otherwise(v))
    best = R.nearest(vectors, vectors, "label", "vec_id", "vec_id", k=2)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.round("distance", 6).alias("distance"))


@query("p08_dedupe_by_name", f"SELECT item_id, name, position, sql, frame FROM {SQL_SINGLE}")
def _(spark, d):
    return _single(spark, d).select("item_id", "name", "position", "value.sql", "value.frame")


@query("p09_numbered_list", f"SELECT item_id, text FROM {SQL_TEXTS}")
def _(spark, d):
    return R.numbered_list(_single(spark, d), "item_id", "position", F.col("value"), "guide")


@query("p09_numbered_list_documents", f"""
    SELECT conv_id, md5(trim(string_agg(n || '.' || role || ':' || chr(10) || ' ' || text, '' ORDER BY n), {SPACE}))
    AS text_md5 FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
      FROM (SELECT conv_id, role, min(turn) AS turn, arg_max(text, turn) AS text FROM conversations
            GROUP BY conv_id, role)) GROUP BY conv_id""")
def _(spark, d):
    """Roles stand for document names: one entry per role, the last text under it."""
    hits = table(spark, d, "conversations")
    single = R.last_by_name(
        hits, "conv_id", "role", F.struct(F.col("role").alias("name"), "text"), "turn")
    texts = R.numbered_list(single, "conv_id", "position", F.col("value"), "document")
    return texts.select("conv_id", F.md5("text").alias("text_md5"))


@query("p10_slot_substitute", f"""
    SELECT c_custkey AS item_id, replace('Use $1 \\ ' || c_name || ': [GUIDELINES] / [GUIDELINES]', '[GUIDELINES]',
      coalesce(text, '')) AS prompt FROM customer LEFT JOIN {SQL_TEXTS} t ON c_custkey = t.item_id""")
def _(spark, d):
    prompts = table(spark, d, "customer").select(
        F.col("c_custkey").alias("item_id"),
        F.concat(F.lit("Use $1 \\ "), "c_name", F.lit(": [GUIDELINES] / [GUIDELINES]")).alias("prompt"))
    texts = R.numbered_list(_single(spark, d), "item_id", "position", F.col("value"), "guide")
    return R.fill_slot(prompts, texts, "item_id", "[GUIDELINES]")


@query("p11_intent_attach", """
    SELECT d.doc_id AS item_id, d.lang AS direction,
      md5(replace('Intent: [INTENT] for ' || d.source, '[INTENT]', coalesce(x.text, ''))) AS prompt_md5
    FROM documents d LEFT JOIN (SELECT l.doc_id, o.lang, o.text FROM labels l JOIN documents o USING (doc_id)) x
      ON d.doc_id = x.doc_id AND d.lang = x.lang""")
def _(spark, d):
    """Documents with a label play the intent answers; the others have none."""
    documents = table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("direction"), "source", "text")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    answers = documents.join(labels, "item_id", "left_semi").withColumnRenamed("text", "response")
    prompts = documents.select(
        "item_id", "direction", F.concat(F.lit("Intent: [INTENT] for "), "source").alias("prompt"))
    return R.attach_intents(prompts, answers).select(
        "item_id", "direction", F.md5("prompt").alias("prompt_md5"))


def _load_scripted():
    """Stands for a model: repeats a marked list, or answers with fenced code."""
    def model(prompts: list[str]) -> list[str]:
        answers = []
        for p in prompts:
            if "<<" in p:
                answers.append("```json\n" + p.split("<<", 1)[1].split(">>", 1)[0] + "\n```")
            else:
                answers.append(f"```python\nsize = {len(p)}\n...\n```\nprompt: {p}")
        return answers

    return model


SQL_CHAIN = f"""
    SELECT l.item_id AS item_id, 'size = ' || length('Translate [' || l.item_id || ']:' || chr(10) || coalesce(text, ''))
      AS code, md5('Translate [' || l.item_id || ']:' || chr(10) || coalesce(text, '')) AS prompt_md5
    FROM {SQL_LISTS} l LEFT JOIN {SQL_TEXTS} t ON l.item_id = t.item_id"""


@query("p20_rag_translate", SQL_CHAIN)
def _(spark, d):
    items = operation_lists(spark, d).select(
        "item_id",
        F.concat(F.lit("Name the operations <<"), "response", F.lit(">>")).alias("identify_prompt"),
        F.concat(F.lit("Translate ["), F.col("item_id").cast("string"),
                 F.lit("]:\n[GUIDELINES]")).alias("translate_prompt"))
    done = retrieve_and_translate(items, guide(spark, d), _load_scripted)
    return done.select("item_id", "code", F.md5("prompt").alias("prompt_md5"))


@query("p20_rag_lookup_by_join", f"""
    SELECT l.item_id AS item_id, coalesce(text, '') AS guidelines
    FROM {SQL_LISTS} l LEFT JOIN {SQL_TEXTS} t ON l.item_id = t.item_id""")
def _(spark, d):
    """The lookup alone."""
    out = R.add_guidelines(operation_lists(spark, d), guide(spark, d), "item_id", "response")
    return out.select("item_id", "guidelines")


@query("p20_rag_lookup_repeated_ids", f"""
    SELECT CASE WHEN l.item_id % 3 > 0 THEN l.item_id % 7 END AS item_id, coalesce(text, '') AS guidelines
    FROM {SQL_LISTS} l LEFT JOIN {SQL_TEXTS} t ON l.item_id = t.item_id""")
def _(spark, d):
    """Repeated and null item ids: each row has the text of its own list."""
    lists = operation_lists(spark, d).withColumn(
        "item_id", F.when(F.col("item_id") % 3 > 0, F.col("item_id") % 7))
    return R.add_guidelines(lists, guide(spark, d), "item_id", "response").select("item_id", "guidelines")


# The vector path: a name's vector is made of the hex digits of two MD5 sums.
LIBRARIES = ["NumPy", "Pandas", "TensorFlow", "PyTorch"]
DIRECTIONS = ["pd_to_np", "np_to_pd", "py_to_tf", "tf_to_py"]
SQL_LIBRARY = "['NumPy', 'Pandas', 'TensorFlow', 'PyTorch']"
SQL_DIRECTION = "['pd_to_np', 'np_to_pd', 'py_to_tf', 'tf_to_py']"
SQL_API_NAMES = f"""(SELECT DISTINCT item_id % 4 AS side, operation FROM {SQL_OPERATIONS})"""
SQL_API_NEAREST = f"""(SELECT side, operation, arg_min(vec_id, row(distance, vec_id)) AS doc_id FROM (
    SELECT n.side, n.operation, v.vec_id, list_distance(list_transform(range(64), lambda i:
        ((('0x' || substr(md5(n.operation) || md5('again ' || n.operation), i + 1, 1))::INT - 7.5) / 30)::FLOAT::DOUBLE), v.e) AS distance
    FROM {SQL_API_NAMES} n JOIN {SQL_VECTORS} v ON n.side = v.label % 4) GROUP BY side, operation)"""
SQL_API_TEXTS = f"""(SELECT item_id, trim(string_agg(n || '.' || name || ':' || chr(10) || ' Vector ' || doc_id || ' of its library. ', '' ORDER BY n), {SPACE}) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY position) AS n FROM (
      SELECT item_id, 'api_' || doc_id % 40 AS name, min(position) AS position, arg_max(doc_id, position) AS doc_id
      FROM {SQL_OPERATIONS} o JOIN {SQL_API_NEAREST} h ON o.item_id % 4 = h.side AND o.operation = h.operation GROUP BY 1, 2))
    GROUP BY item_id)"""
SQL_API_PROMPT = f"""('Use for ' || {SQL_DIRECTION}[item_id % 4 + 1] || ' of ' || item_id || ':' || chr(10) || coalesce(text, ''))"""


def _load_digits():
    """Stands for an embedding model."""
    from hashlib import md5

    def embed(names: list[str]) -> list[list[float]]:
        digits = [md5(n.encode()).hexdigest() + md5(f"again {n}".encode()).hexdigest() for n in names]
        return [[(int(x, 16) - 7.5) / 30 for x in row] for row in digits]

    return embed


def _pick(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


@query("p20_rag_apis", f"""
    SELECT l.item_id AS item_id, 'size = ' || length({SQL_API_PROMPT.replace("item_id", "l.item_id")}) AS code,
      md5({SQL_API_PROMPT.replace("item_id", "l.item_id")}) AS prompt_md5
    FROM {SQL_LISTS} l LEFT JOIN {SQL_API_TEXTS} t ON l.item_id = t.item_id""")
def _(spark, d):
    """Names to vectors, to the nearest document of the target library, to one text, into the prompt."""
    documents = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), _pick(LIBRARIES, F.col("label")).alias("library"),
        F.concat(F.lit("api_"), (F.col("vec_id") % 40).cast("string")).alias("api_name"),
        F.concat(F.lit("Vector "), F.col("vec_id").cast("string"), F.lit(" of its library. ")).alias("docstring"), "embedding")
    direction = _pick(DIRECTIONS, F.col("item_id"))
    items = operation_lists(spark, d).select(
        "item_id", direction.alias("direction"),
        F.concat(F.lit("Name the functions <<"), "response", F.lit(">>")).alias("identify_prompt"),
        F.concat(F.lit("Use for "), direction, F.lit(" of "), F.col("item_id").cast("string"), F.lit(":\n[APIs]")).alias("translate_prompt"))
    done = retrieve_apis_and_translate(items, documents, _load_digits, _load_scripted)
    return done.select("item_id", "code", F.md5("prompt").alias("prompt_md5"))


def _load_echo():
    return lambda prompts: [p.upper() for p in prompts]


@query("p20_resume", """
    SELECT m.model, 'direction=' || (p_partkey % 6) AS prompt_folder, p_partkey AS item_id,
      upper('Part ' || p_name || ' for ' || m.model) AS response
    FROM part, (VALUES ('small'), ('large')) m(model)""")
def _(spark, d):
    """Prompt files in six folders: a run over the first three, then a run that finds all six."""
    prompts, output, checkpoint = (scratch_path(spark, f"runs-{n}") for n in ("prompts", "output", "checkpoint"))
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.concat(F.lit("Part "), "p_name").alias("prompt"), (F.col("p_partkey") % 6).alias("direction"))

    def ask(batch: DataFrame, model: str) -> DataFrame:
        return batch_infer(batch.withColumn("prompt", F.concat("prompt", F.lit(f" for {model}"))), _load_echo)

    for some in (F.col("direction") < 3, F.col("direction") >= 3):
        rows.where(some).repartition(1, "direction").write.mode("append").partitionBy("direction").json(prompts)
        W.answer_files(spark, prompts, "item_id long, prompt string", output, checkpoint, {"small": ask, "large": ask}, files_at_once=2)
    answers = W.read_answers(spark, output)
    return answers.select("model", F.split("prompt_file", "/")[0].alias("prompt_folder"), "item_id", "response")


@query("p20_rag_files", f"""
    SELECT m.model, l.item_id AS item_id, 'size = ' || length('Translate [' || l.item_id || ']:' || chr(10) || coalesce(text, ''))
      AS code FROM {SQL_LISTS} l LEFT JOIN {SQL_TEXTS} t ON l.item_id = t.item_id, (VALUES ('a'), ('b')) m(model)""")
def _(spark, d):
    """The whole chain for each model and prompt file, in two runs; the second finds more files."""
    prompts, output, checkpoint = (scratch_path(spark, f"rag-{n}") for n in ("prompts", "output", "checkpoint"))
    items = operation_lists(spark, d).select(
        "item_id", F.concat(F.lit("Name the operations <<"), "response", F.lit(">>")).alias("identify_prompt"),
        F.concat(F.lit("Translate ["), F.col("item_id").cast("string"), F.lit("]:\n[GUIDELINES]")).alias("translate_prompt"),
        (F.col("item_id") % 3).alias("lot"))
    book = settle(guide(spark, d))

    def translate(rows: DataFrame, model: str) -> DataFrame:
        return retrieve_and_translate(rows, book, _load_scripted)

    schema = "item_id long, identify_prompt string, translate_prompt string"
    for some in (F.col("lot") == 0, F.col("lot") > 0):
        items.where(some).write.mode("append").partitionBy("lot").json(prompts)
        W.answer_files(spark, prompts, schema, output, checkpoint, {"a": translate, "b": translate})
    return W.read_answers(spark, output).select("model", "item_id", "code")
