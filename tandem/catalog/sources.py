"""Sources, sinks and table facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tandem.catalog.registry import query, quote
from tandem.operators.containment import contain_join, table_mentions
from tandem.session import scratch_path, settle
from tandem.sources import jsonl, profile as P, progress, sketches as S
from tandem.sources.tables import load_tables, run_sql, table

# Columns of the test tables, as Spark names their types.
TABLE_TYPES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
SQL_DOCUMENT = "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents"


def _digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("s01_jsonl_scan", SQL_DOCUMENT)
def _(spark, d):
    path = scratch_path(spark, "scan")
    jsonl.write_by(table(spark, d, "documents").withColumn("part", F.col("lang")), path, "part")
    return _digest(jsonl.read_jsonl(spark, path, DOCUMENT))


# Documents as lines of one file a language; every seventh is cut off, every eleventh has a text for a number.
SQL_LINES = """(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line_no,
    CASE WHEN doc_id % 7 = 0 THEN '{"doc_id": ' || doc_id WHEN doc_id % 11 = 0 THEN '{"doc_id": "no ' || doc_id || '"}' END AS bad
    FROM documents WHERE lang IS NOT NULL)"""


@query("s01_line_numbers", f"""
    SELECT lang, line_no, CASE WHEN bad IS NULL THEN doc_id END AS doc_id, CASE WHEN bad IS NULL THEN md5(text) END AS text_md5,
      bad AS bad_line FROM {SQL_LINES}""")
def _(spark, d):
    """Rows by file and line, and the broken lines by theirs."""
    path = scratch_path(spark, "lines")
    number = F.col("doc_id").cast("string")
    line = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"doc_id": '), number))
        .when(F.col("doc_id") % 11 == 0, F.concat(F.lit('{"doc_id": "no '), number, F.lit('"}')))
        .otherwise(F.to_json(F.struct("doc_id", "text"))))
    documents = table(spark, d, "documents").where("lang IS NOT NULL").select("lang", "doc_id", line.alias("value"))
    # A language's lines go to many tasks by ranges, whose parts follow by name; copies of one id are dealt out by their line.
    place = ["lang", "doc_id", F.xxhash64("value")]
    one_file = documents.repartitionByRange(*place).sortWithinPartitions(*place).select("lang", "value")
    one_file.write.partitionBy("lang").text(path)
    rows, bad = jsonl.read_numbered(spark, path, "doc_id long, text string", "*.txt")
    lang = F.regexp_extract("file", "lang=(.*)$", 1).alias("lang")
    none = F.lit(None).cast("string")
    return rows.select(lang, "line_no", "doc_id", F.md5("text").alias("text_md5"), none.alias("bad_line")).unionByName(
        bad.select(lang, "line_no", none.cast("long").alias("doc_id"), none.alias("text_md5"), F.col("text").alias("bad_line")))


@query("s02_jsonl_overwrite", SQL_DOCUMENT)
def _(spark, d):
    path = scratch_path(spark, "overwrite")
    documents = table(spark, d, "documents")
    jsonl.write_jsonl(documents.withColumn("lang", F.lit("old")), path)
    jsonl.write_jsonl(documents, path)
    return _digest(jsonl.read_jsonl(spark, path, DOCUMENT))


@query("s03_jsonl_append", f"{SQL_DOCUMENT} UNION ALL {SQL_DOCUMENT}")
def _(spark, d):
    path = scratch_path(spark, "append")
    for _ in range(2):
        jsonl.write_jsonl(table(spark, d, "documents"), path, append=True)
    return _digest(jsonl.read_jsonl(spark, path, DOCUMENT))


@query("s04_parquet_tables", " UNION ALL ".join(
    f"SELECT {quote(name)} AS table_name, count(*) AS n_rows FROM {name}" for name in TABLE_TYPES))
def _(spark, d):
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        for name, df in load_tables(spark, d, TABLE_TYPES).items()
    ]
    return reduce(DataFrame.unionByName, counts)


SEGMENT_SQL = """
    SELECT c_mktsegment, r_name, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS DOUBLE) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderstatus <> 'P'
    GROUP BY c_mktsegment, r_name ORDER BY value DESC, c_mktsegment, r_name"""


@query("s05_sql_text", SEGMENT_SQL)
def _(spark, d):
    return run_sql(spark, d, ["orders", "customer", "nation", "region"], SEGMENT_SQL)


def _profile_sql(name: str) -> str:
    rows = []
    for at, column in enumerate(TABLE_TYPES[name].split(", ")):
        column, kind = column.split(" ")
        if kind.startswith("array"):
            low = high = "CAST(NULL AS VARCHAR)"
        elif kind == "string":
            low, high = f"min({column})", f"max({column})"
        elif kind == "timestamp_ntz":
            low, high = (f"strftime({f}({column}), '%Y-%m-%d %H:%M:%S.%f')" for f in ("min", "max"))
        else:
            low, high = (f"CAST(CAST({f}({column}) AS DECIMAL(38,6)) AS VARCHAR)" for f in ("min", "max"))
        rows.append(
            f"SELECT {quote(name)} AS table_name, CAST({at + 1} AS BIGINT) AS ordinal, "
            f"{quote(column)} AS column_name, {quote(kind)} AS data_type, count(*) AS n_rows, "
            f"count(*) FILTER ({column} IS NULL) AS n_nulls, count(DISTINCT {column}) AS n_distinct, "
            f"{low} AS smallest, {high} AS largest FROM {name}"
        )
    return " UNION ALL ".join(rows)


@query("s06_column_profile", " UNION ALL ".join(_profile_sql(name) for name in TABLE_TYPES))
def _(spark, d):
    return P.profile_tables(load_tables(spark, d, TABLE_TYPES), exact=True)


SKETCHED = ["part", "orders", "events", "labels"]


@query("s06_sketch_profile", f"""
    SELECT * EXCLUDE (n_distinct), true AS distinct_within,
      CASE WHEN data_type IN ('int', 'bigint', 'double') THEN true END AS median_within
    FROM ({" UNION ALL ".join(_profile_sql(name) for name in SKETCHED)})""")
def _(spark, d):
    """Profiles merged from sketches of files that came in two lots, and whether the estimates are as near as stated."""
    store, found = scratch_path(spark, "sketches"), []
    for name, df in load_tables(spark, d, SKETCHED).items():
        folder = scratch_path(spark, f"lots-{name}")
        for lot in (0, 1):
            half = F.pmod(F.xxhash64(*df.columns), F.lit(2)) == lot
            df.where(half).repartition(2).write.mode("append").parquet(folder)
            S.update_sketches(spark, store, name, folder)
        merged = S.merged_profile(spark, store, name, folder)
        medians = {r["column_name"]: r["median"] for r in merged.where("median IS NOT NULL").collect()}
        near = [F.struct(
            F.lit(c).alias("column_name"),
            ((F.count_if(F.col(c) < m) <= (0.5 + S.RANK_ERROR) * F.count(c))
             & (F.count_if(F.col(c) <= m) >= (0.5 - S.RANK_ERROR) * F.count(c))).alias("median_within"))
            for c, m in medians.items()]
        ranks = df.agg(F.array(*near).alias("r")).select(F.inline("r"))
        exact = P.count_distinct_values(df).withColumnRenamed("n_distinct", "truth")
        within = F.abs(F.col("n_distinct") - F.col("truth")) <= S.DISTINCT_ERROR * F.col("truth")
        found.append(merged.join(exact, "ordinal").join(ranks, "column_name", "left").select(
            "table_name", "ordinal", "column_name", "data_type", "n_rows", "n_nulls", "smallest", "largest",
            within.alias("distinct_within"), "median_within"))
    return reduce(DataFrame.unionByName, found)


PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "documents": ["doc_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
FOREIGN_KEYS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    # Not a declared key: half of the documents have no label, so orphans do occur.
    ("documents", "doc_id", "labels", "doc_id"),
]


def _key_sql() -> str:
    rows = [
        f"SELECT {quote(t + '_pk')} AS constraint_name, 'PRIMARY KEY' AS kind, "
        f"count(*) FILTER (n > 1) AS violations FROM "
        f"(SELECT count(*) AS n FROM {t} GROUP BY {', '.join(cols)})"
        for t, cols in PRIMARY_KEYS.items()
    ]
    rows += [
        f"SELECT {quote(f'{child}_{column}_fk')}, 'FOREIGN KEY', count(*) FROM {child} "
        f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {parent_column} FROM {parent})"
        for child, column, parent, parent_column in FOREIGN_KEYS
    ]
    return " UNION ALL ".join(rows)


@query("s09_key_check", _key_sql())
def _(spark, d):
    return P.check_keys(load_tables(spark, d, TABLE_TYPES), PRIMARY_KEYS, FOREIGN_KEYS)


SQL_TEXTS = """(SELECT p_partkey, p_type AS db_id,
    'SELECT p_name FROM ' || p_brand || ' WHERE p_size = ' || p_size AS sql FROM part)"""
SQL_CATALOGUE = """(SELECT DISTINCT p_type AS db_id, p_brand AS table_name,
    CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS ordinal FROM part)"""


@query("s10_table_mentions", f"""
    SELECT p_partkey, t.db_id AS db_id, table_name, ordinal FROM {SQL_TEXTS} t
    JOIN {SQL_CATALOGUE} c ON t.db_id = c.db_id AND contains(t.sql, c.table_name)""")
def _(spark, d):
    parts = table(spark, d, "part")
    texts = parts.select(
        "p_partkey", F.col("p_type").alias("db_id"),
        F.concat(F.lit("SELECT p_name FROM "), "p_brand", F.lit(" WHERE p_size = "),
                 F.col("p_size").cast("string")).alias("sql"))
    # A brand number is a prefix of longer ones, so short names over-match.
    brand = F.regexp_extract("p_brand", r"\d+", 0).cast("long")
    catalogue = parts.select(
        F.col("p_type").alias("db_id"), F.col("p_brand").alias("table_name"), brand.alias("ordinal")
    ).distinct()
    return table_mentions(texts, catalogue).select("p_partkey", "db_id", "table_name", "ordinal")


SQL_CONTAINED = """SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"""


@query("s11_text_contain_join", SQL_CONTAINED)
def _(spark, d):
    return contain_join(
        table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@query("s11_text_contain_join_many_items", SQL_CONTAINED)
def _(spark, d):
    """As if there were so many items that sketch and filter could hardly tell their keys apart."""
    return contain_join(
        table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text",
        cells=1 << 10, most_bits=1 << 10)


@query("s13_skip_done", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return progress.skip_done(
        table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("s14_stats_append", """
    SELECT source, lang AS target, count(*) AS n_cases, sum(n_chars)::BIGINT AS n_chars,
           unnest([TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-02 00:00:00']) AS run_time
    FROM documents GROUP BY source, lang""")
def _(spark, d):
    path = scratch_path(spark, "record")
    stats = table(spark, d, "documents").groupBy("source", F.col("lang").alias("target")).agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum("n_chars").alias("n_chars"))
    stats = settle(stats)
    for run_time in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        progress.append_stats(stats, path, run_time)
    progress.compact_stats(spark, path)
    return progress.read_stats(spark, path).select("source", "target", "n_cases", "n_chars", "run_time")
