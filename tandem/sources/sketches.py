"""Column profiles of growing tables: a sketch for each file and column, stored and merged.

A file is read once, when it is new; profiles of the whole table come from the stored rows. Rows,
nulls, minima and maxima add up exactly; distinct values and medians come from sketches that merge
without the values.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, DataType, DecimalType, DoubleType, FractionalType, IntegralType, MapType, NumericType, StructType,
)

from tandem.sources.profile import literal, text_of

# Fixed by the sketch's size: 2^12 registers, a standard error of 1.04 / 64; three of these.
LG_REGISTERS = 12
DISTINCT_ERROR = 0.05
# Of a quantile sketch with 200 items a level, in ranks.
RANK_ERROR = 0.03

FILE = ["file", "modified", "size"]
FLOAT = DoubleType()
STORED = (
    "file string, modified timestamp, size long, ordinal long, column_name string, data_type string, n_rows long, n_nulls long, "
    "low_exact decimal(38,6), high_exact decimal(38,6), low_float double, high_float double, low_text string, high_text string, "
    "distinct binary, quantiles binary, table_name string"
)


def _nested(dtype: DataType) -> bool:
    return isinstance(dtype, (ArrayType, MapType, StructType))


def _facts(name: str, at: int, label: str, dtype: DataType) -> str:
    """One column's facts as a struct of aggregates, in SQL text."""
    column = f"`{name.replace('`', '``')}`"
    number = isinstance(dtype, NumericType)
    whole = isinstance(dtype, (IntegralType, DecimalType))
    exact = f"CAST({column} AS DECIMAL(38,6))" if whole else "CAST(NULL AS DECIMAL(38,6))"
    # 0.0 for -0.0 as well: both are one value.
    real = f"CAST({column} AS DOUBLE) + 0.0D" if isinstance(dtype, FractionalType) and not whole else "CAST(NULL AS DOUBLE)"
    text = "CAST(NULL AS STRING)" if number or _nested(dtype) else text_of(column, dtype)
    value = f"CAST({column} AS STRING)" if not number else f"CAST({real if not whole else exact} AS STRING)"
    quantiles = f"kll_sketch_agg_double(CAST({column} AS DOUBLE))" if number else "CAST(NULL AS BINARY)"
    return (
        f"struct({at}L AS ordinal, {label} AS column_name, '{dtype.simpleString()}' AS data_type, count(1) AS n_rows, "
        f"count_if({column} IS NULL) AS n_nulls, min({exact}) AS low_exact, max({exact}) AS high_exact, "
        f"min({real}) AS low_float, max({real}) AS high_float, min({text}) AS low_text, max({text}) AS high_text, "
        f"hll_sketch_agg({value}, {LG_REGISTERS}) AS distinct, {quantiles} AS quantiles)")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, file, modified and size of the table's files; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select("path", F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def stored_sketches(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def update_sketches(spark: SparkSession, store: str, table_name: str, folder: str) -> int:
    """Add sketches of the Parquet files below `folder` that `store` lacks; returns how many files were read.

    A file that was written again has another time or size and is read again. A run that fails
    adds nothing; one run at a time may add.
    """
    known = stored_sketches(spark, store).where(F.col("table_name") == table_name).select(*FILE).distinct()
    new = [r["path"] for r in _listed(spark, folder).join(known, FILE, "left_anti").select("path").collect()]
    if not new:
        return 0
    df = spark.read.parquet(*new)
    columns = [(at, f) for at, f in enumerate(df.schema.fields, 1)]
    rows = ", ".join(_facts(f.name, at, literal(f.name), f.dataType) for at, f in columns)
    meta = F.col("_metadata")
    keyed = df.select("*", *(meta[c].alias(f"_{k}") for k, c in zip(
        FILE, ("file_path", "file_modification_time", "file_size"))))
    facts = keyed.groupBy(*(f"_{k}" for k in FILE)).agg(F.expr(f"array({rows})").alias("rows"))
    flat = facts.selectExpr(*(f"_{k} AS {k}" for k in FILE), "inline(rows)").withColumn("table_name", F.lit(table_name))
    flat.write.mode("append").partitionBy("table_name").parquet(store)
    return len(new)


def merged_profile(spark: SparkSession, store: str, table_name: str, folder: str) -> DataFrame:
    """One row per column of the table's present files, from their sketches alone.

    Columns as of `profile_columns`, plus `median` (null for columns without numbers). `n_distinct` is
    within `DISTINCT_ERROR` of the truth, `median` within `RANK_ERROR` of the middle rank, both with a probability above
    99 percent. Files without a sketch yet, or changed since, do not count; nor do files without rows.
    """
    present = _listed(spark, folder).select(*FILE)
    sketches = stored_sketches(spark, store).where(F.col("table_name") == table_name).join(present, FILE, "left_semi")
    ends = {f"{end}_{kind}": f"{f}({end}_{kind})" for kind in ("exact", "float", "text") for end, f in (("low", "min"), ("high", "max"))}
    merged = sketches.groupBy("ordinal", "column_name", "data_type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), *(F.expr(e).alias(n) for n, e in ends.items()),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))

    def spelled(end: str) -> str:
        number = text_of(f"{end}_exact", DecimalType(38, 6))
        return f"coalesce({number}, {text_of(f'{end}_float', FLOAT)}, {end}_text)"

    return merged.select(
        F.lit(table_name).alias("table_name"), "ordinal", "column_name", "data_type", "n_rows", "n_nulls", "n_distinct",
        F.expr(spelled("low")).alias("smallest"), F.expr(spelled("high")).alias("largest"),
        F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"))
