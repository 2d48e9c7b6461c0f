"""JSON-lines data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tandem.functions.text import strip_space
from tandem.session import settle

QUERY_ITEM = "item_id long, SQL string, pandas_query string, db_path string, tables array<string>"

LIBRARY_ITEM = "item_id long, " + ", ".join(
    f"{side}_{field} string"
    for side in ("numpy", "pandas")
    for field in ("question", "example_input", "start_code", "sol_code", "test_code")
)

FRAMEWORK_ITEM = "item_id long, question string, " + ", ".join(
    f"{side}_{field} {kind}"
    for side in ("pytorch", "tensorflow")
    for field, kind in (
        ("example_input", "string"),
        ("start_code", "string"),
        ("sol_code", "string"),
        ("library", "string"),
        ("test_code", "struct<setup_code:string,test_cases:array<string>>"),
    )
)

GUIDE = "operation string, postgreSQL string, pandas string"


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True
) -> DataFrame:
    """Rows of every `*.jsonl`/`*.json` part below `path`, in no promised order.

    The schema is given, so there is no inference pass and unread fields are skipped.
    `strict` fails on a broken line; otherwise such a line gives a row of nulls.
    """
    return (
        spark.read.schema(schema)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json*")
        .json(path)
    )


def numbered_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.json*") -> DataFrame:
    """Every line of the text files below `path`: file, line_no (from 0) and text; stored.

    Large files are read in blocks by many tasks. A block's lines come in order, so a line's number is
    its place in the block plus the lines of the blocks before, of which only the counts are
    added up: no line is sorted or shuffled. A folder that Spark wrote counts as one file, whose
    parts follow by name; `file` is the folder then.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    meta = F.col("_metadata")
    part = F.regexp_like(meta["file_name"], F.lit(r"^part-\d+-"))
    whole = meta["file_path"]
    # The number of a row within its task tells rows of a block apart; it is stored before it is used twice.
    read = settle(lines.select(
        F.when(part, F.regexp_replace(whole, "/[^/]*$", "")).otherwise(whole).alias("file"), whole.alias("_part"),
        meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text")))
    blocks = read.groupBy("file", "_part", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    placed = read.join(starts, ["file", "_part", "_block"])
    return placed.select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "text")


def read_numbered(
    spark: SparkSession, path: str | list[str], schema: StructType | str, pattern: str = "*.json*",
) -> tuple[DataFrame, DataFrame]:
    """JSON lines with their place, and the lines that are no such rows.

    The first result has file, line_no and the fields of `schema`; the second file, line_no and text of
    lines that are no JSON object or hold a value of another type. Lines of white space are
    neither, but are counted. So (file, line_no) names an item without any id of its own.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = numbered_lines(spark, path, pattern).where(F.length(strip_space(F.col("text"))) > 0)
    tried = StructType([*kind.fields, StructField("_bad", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.withColumn("_row", F.from_json("text", tried, options))
    # A list of objects would be taken for its first one.
    bad = F.col("_row._bad").isNotNull() | ~F.startswith(strip_space(F.col("text")), F.lit("{"))
    rows = parsed.where(~bad).select("file", "line_no", *(F.col("_row")[f.name].alias(f.name) for f in kind.fields))
    return rows, parsed.where(bad).select("file", "line_no", "text")


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Add the path each row was read from (directly on a file scan)."""
    return df.select("*", F.col("_metadata.file_path").alias(name))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per line; parent folders are made, nulls are written out."""
    mode = "append" if append else "overwrite"
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by(df: DataFrame, path: str, *keys: str, append: bool = False) -> None:
    """One folder per key value, so later reads of one version prune the others.

    Rows of one folder come from many tasks; nothing is gathered to make one file.
    """
    mode = "append" if append else "overwrite"
    df.write.mode(mode).partitionBy(*keys).option("ignoreNullFields", "false").json(path)
