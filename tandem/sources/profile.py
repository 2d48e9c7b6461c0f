"""Column facts and key checks of stored tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, DataType, DecimalType, FractionalType, IntegralType, MapType, NumericType, StructType,
    TimestampNTZType,
)


PROFILE = (
    "table_name string, ordinal long, column_name string, data_type string, n_rows long, "
    "n_nulls long, n_distinct long, smallest string, largest string"
)


# Tables profiled at a time; their small last stages then overlap.
TABLES_AT_ONCE = 4


# The expressions below are SQL text: a wide table takes hundreds of them, and building
# each from Python calls would take longer than small tables' jobs.

def text_of(value: str, dtype: DataType) -> str:
    """One spelling per type, so minima of all columns fit one text column."""
    if isinstance(dtype, (ArrayType, MapType, StructType)):
        return "CAST(NULL AS STRING)"
    if isinstance(dtype, FractionalType) and not isinstance(dtype, DecimalType):
        # Six decimals where they say something, else the value's own text (NaN, 1.0E35, 1.0E-9).
        plain = f"CAST(try_cast({value} AS DECIMAL(38,6)) AS STRING)"
        return f"coalesce(IF({value} <> 0 AND abs({value}) < 1e-6, NULL, {plain}), CAST({value} AS STRING))"
    if isinstance(dtype, DecimalType):
        return f"coalesce(CAST(try_cast({value} AS DECIMAL(38,6)) AS STRING), CAST({value} AS STRING))"
    if isinstance(dtype, NumericType):
        return f"CAST(CAST({value} AS DECIMAL(38,6)) AS STRING)"
    if isinstance(dtype, TimestampNTZType):
        return f"date_format({value}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    return f"CAST({value} AS STRING)"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _key_kind(dtype: DataType) -> str:
    """Type a column's values are grouped as; columns of one kind share a grouping."""
    return "bigint" if isinstance(dtype, IntegralType) else dtype.simpleString()


def _by_kind(df: DataFrame) -> dict[str, list[tuple[int, str, DataType]]]:
    kinds: dict[str, list[tuple[int, str, DataType]]] = {}
    for at, field in enumerate(df.schema.fields):
        column = (at + 1, field.name.replace("`", "``"), field.dataType)
        kinds.setdefault(_key_kind(field.dataType), []).append(column)
    return kinds


def count_distinct_values(df: DataFrame) -> DataFrame:
    """(ordinal, n_distinct) of every column that holds a value.

    Columns of one type become (ordinal, value) rows and are regrouped with partial
    combining, so a value that fills a third of a column travels once per task, and no
    row carries other columns along. Long texts are grouped by their SHA-256,
    marked so that no short text equals it.
    """
    parts = []
    for kind, columns in _by_kind(df).items():
        cells = []
        for at, name, _ in columns:
            key = f"CAST(`{name}` AS {kind})"
            if kind == "string":
                key = f"IF(length(`{name}`) > 64, concat('#', sha2(`{name}`, 256)), concat('=', `{name}`))"
            cells.append(f"struct({at}L AS ordinal, {key} AS key)")
        values = df.selectExpr(f"inline(array({', '.join(cells)}))").filter("key IS NOT NULL")
        counts = values.distinct().groupBy("ordinal").agg(F.expr("count(1) AS n_distinct"))
        parts.append(counts)
    return reduce(DataFrame.unionByName, parts)


def _figures(df: DataFrame, columns: list[tuple[int, str, DataType]], exact: bool) -> DataFrame:
    """Figures of some columns from one aggregate, a row per column."""
    rows = []
    for at, name, dtype in columns:
        sketch = "" if exact else f"approx_count_distinct(`{name}`) AS n_distinct, "
        rows.append(
            f"struct({at}L AS ordinal, {literal(df.columns[at - 1])} AS column_name, "
            f"'{dtype.simpleString()}' AS data_type, count(1) AS n_rows, "
            f"count_if(`{name}` IS NULL) AS n_nulls, {sketch}"
            f"{text_of(f'min(`{name}`)', dtype)} AS smallest, "
            f"{text_of(f'max(`{name}`)', dtype)} AS largest)"
        )
    return df.agg(F.expr(f"array({', '.join(rows)}) AS rows")).selectExpr("inline(rows)")


def profile_columns(df: DataFrame, table_name: str, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, smallest, largest.

    Types come from the schema alone. Distinct counts are sketches unless `exact`, which
    groups all values. Nested columns have no minimum or maximum.
    """
    # Text minima keep an aggregate out of generated code, so texts get their own one.
    texts, others = [], []
    for kind, columns in _by_kind(df).items():
        (texts if kind == "string" else others).extend(columns)
    facts = reduce(
        DataFrame.unionByName, [_figures(df, columns, exact) for columns in (others, texts) if columns]
    )
    if exact:
        counts = count_distinct_values(df)
        facts = facts.join(counts, "ordinal", "left").fillna(0, ["n_distinct"])
    return facts.select(
        F.lit(table_name).alias("table_name"), "ordinal", "column_name", "data_type", "n_rows",
        "n_nulls", "n_distinct", "smallest", "largest")


def profile_tables(
    tables: dict[str, DataFrame], exact: bool = False, skip: Iterable[str] = ()
) -> DataFrame:
    """Profiles of several tables, leaving out internal ones named in `skip`.

    Each table is a job of its own; what comes back is one row per column. One plan
    over all tables would be re-planned as a whole after each of its many stages.
    """
    spark = next(iter(tables.values())).sparkSession

    @inheritable_thread_target(spark)
    def run(name: str) -> list:
        return profile_columns(tables[name], name, exact).collect()

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        found = pool.map(run, [name for name in tables if name not in skip])
        rows = [row for part in found for row in part]
    return spark.createDataFrame(rows, PROFILE)


def check_primary_key(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """One row: how many key values occur more than once or hold a null."""
    missing = F.lit(False)
    for column in columns:
        missing = missing | F.col(column).isNull()
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.lit(name).alias("constraint_name"),
        F.lit("PRIMARY KEY").alias("kind"),
        F.count_if((F.col("n") > 1) | missing).alias("violations"),
    )


def check_foreign_key(
    child: DataFrame, name: str, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """One row: how many child rows point at no parent (null points nowhere, allowed)."""
    # Child rows are counted per key first: a hot key is one row in the join.
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    keys = parent.select(F.col(parent_column).alias("_parent"))
    orphans = used.join(keys, used["_key"] == keys["_parent"], "left_anti")
    return orphans.agg(
        F.lit(name).alias("constraint_name"),
        F.lit("FOREIGN KEY").alias("kind"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"),
    )


def _slot_value(columns: Sequence[str]) -> str:
    """One text for a key's values, other for other values; a null has its own."""
    parts = []
    for name in columns:
        text = f"CAST(`{name.replace('`', '``')}` AS STRING)"
        parts.append(f"coalesce(concat(length({text}), ':', {text}), '-')")
    return f"concat({', '.join(parts)})"


def key_values(tables: dict[str, DataFrame], slots: Sequence[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Columns value, slot and n: how many rows of a slot's table have each value in its columns.

    A slot is a table and some of its columns. Each table is scanned once for all its slots, and
    rows are counted where they are read, so a hot value travels once per task.
    """
    parts = []
    for name, df in tables.items():
        own = [(at, columns) for at, (table, columns) in enumerate(slots) if table == name]
        if own:
            cells = ", ".join(
                f"struct({at} AS slot, {_slot_value(columns)} AS value, {' OR '.join(f'`{c}` IS NULL' for c in columns)} AS missing)"
                for at, columns in own)
            parts.append(df.selectExpr(f"inline(array({cells}))"))
    each = reduce(DataFrame.unionByName, parts)
    return each.groupBy("slot", "value", "missing").agg(F.count(F.lit(1)).alias("n"))


def check_keys(
    tables: dict[str, DataFrame],
    primary: dict[str, Sequence[str]],
    foreign: Iterable[tuple[str, str, str, str]],
) -> DataFrame:
    """Violations of all declared keys at once: constraint_name, kind, violations.

    `primary` names each table's key columns; `foreign` lists child, column, parent and parent
    column. A primary key is violated by each value that occurs more than once or holds a
    null, a foreign key by each child row whose value no parent row has (null points nowhere).

    Every value is brought together with the slots that have it, as inclusion dependencies
    are found: one look at a value settles all keys it matters to. Tables are scanned once, and a
    value's list is no longer than the number of slots.
    """
    foreign = list(foreign)
    slots = list(dict.fromkeys(
        [(table, tuple(columns)) for table, columns in primary.items()]
        + [(table, (column,)) for child, c, parent, p in foreign for table, column in ((child, c), (parent, p))]))
    at = {slot: i for i, slot in enumerate(slots)}
    keys = [(f"{table}_pk", "PRIMARY KEY", at[table, tuple(columns)], -1) for table, columns in primary.items()]
    keys += [(f"{child}_{c}_fk", "FOREIGN KEY", at[child, (c,)], at[parent, (p,)]) for child, c, parent, p in foreign]
    counted = key_values(tables, slots).groupBy("value").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("n", "missing")))).alias("has"))
    # Sums of all keys in one row: as many as there are constraints.
    sums = []
    for i, (_, kind, own, parent) in enumerate(keys):
        cell = F.element_at("has", F.lit(own))
        if kind == "PRIMARY KEY":
            bad = F.when((cell["n"] > 1) | cell["missing"], F.lit(1).cast("long"))
        else:
            bad = F.when(~cell["missing"] & ~F.map_contains_key("has", F.lit(parent)), cell["n"])
        sums.append(F.coalesce(F.sum(bad), F.lit(0).cast("long")).alias(f"k{i}"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("constraint_name"), F.lit(kind).alias("kind"), F.col(f"k{i}").alias("violations"))
        for i, (name, kind, _, _) in enumerate(keys)])
    return counted.agg(*sums).select(F.inline(rows))
