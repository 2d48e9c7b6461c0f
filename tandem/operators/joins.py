"""Equi-joins under SQL and dataframe rules.

No join is forced to broadcast: Spark does that itself below its size threshold, and
AQE again from measured sizes. Hot keys are split by AQE's skew rule; `salt` spreads
them by hand where the plan runs without AQE or one key's rows exceed a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tandem.functions.values import check_semantics, is_float
from tandem.operators.aggregates import _operand

# Rows without a key never match in an outer join but still have to be kept; this many
# extra key values keep them from landing in one task.
NULL_SPREAD = 1024


# Copies of each entry that many rows are joined with, so that a very frequent key is looked up in many tasks.
SPREAD = 16


def spread_join(rows: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of many rows with few `entries` by `keys`.

    Rows of one key go by `SPREAD` extra key values unless Spark broadcasts the entries, so a
    hot key is no single task.
    """
    spread = rows.withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    copies = entries.withColumn(
        "_spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return spread.join(copies, [*keys, "_spread"]).drop("_spread")


def _salted(
    many: DataFrame, one: DataFrame, many_key: str, one_key: str, how: str, salt: int, null_safe: bool
) -> DataFrame:
    """`many` joined with `one` (inner or left), each key split in `salt` parts by copying `one`.

    Rows are dealt out by a number of their own, so no column is read for it. Where null keys
    match nothing, those that have to be kept go to parts of their own.
    """
    own = F.monotonically_increasing_id()
    spread = F.pmod(own, F.lit(salt)) if salt > 1 else F.lit(0).cast("long")
    if how == "left" and not null_safe:
        spread = F.when(F.col(many_key).isNull(), F.pmod(own, F.lit(NULL_SPREAD))).otherwise(spread)
    left = many.withColumn("_spread_l", spread)
    if salt > 1:
        copies = one.withColumn("_spread_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    else:
        # Not a literal, or the optimizer would fold it away and drop the second key.
        copies = one.withColumn("_spread_r", F.when(F.col(one_key).isNull(), -1).otherwise(0).cast("long"))
    same = left[many_key].eqNullSafe(copies[one_key]) if null_safe else left[many_key] == copies[one_key]
    joined = left.join(copies, same & (left["_spread_l"] == copies["_spread_r"]), how)
    return joined.drop("_spread_l", "_spread_r")


def _joined(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, salt: int, null_safe: bool
) -> DataFrame:
    if salt == 1 and (how == "inner" or null_safe):
        same = left[left_key].eqNullSafe(right[right_key]) if null_safe else left[left_key] == right[right_key]
        return left.join(right, same, how)
    if how == "right":
        flipped = _salted(right, left, right_key, left_key, "left", salt, null_safe)
        return flipped.select(*left.columns, *right.columns)
    return _salted(left, right, left_key, right_key, how, salt, null_safe)


def join_on(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str | None = None,
    how: str = "inner",
    semantics: str = "sql",
    salt: int = 1,
) -> DataFrame:
    """Inner, left or right equi-join.

    sql: null keys match nothing; every column of both sides is kept, so the two sides
    must not share names. frame: null keys match null keys; keys of one name become one
    column, other shared names get `_x` and `_y`.

    `salt` > 1 splits each key of the row-preserving side (left for inner) into that
    many tasks by copying the other side, under both rules; the result is the same.
    """
    right_key = right_key or left_key
    if check_semantics(semantics) == "sql":
        return _joined(left, right, left_key, right_key, how, salt, null_safe=False)
    one_key = left_key == right_key
    shared = [c for c in left.columns if c in right.columns and not (one_key and c == left_key)]
    for name in shared:
        left = left.withColumnRenamed(name, f"{name}_x")
        right = right.withColumnRenamed(name, f"{name}_y")
    left_on = f"{left_key}_x" if left_key in shared else left_key
    right_on = f"{right_key}_y" if right_key in shared else right_key
    if one_key:
        right = right.withColumnRenamed(right_key, "_key_r")
        right_on = "_key_r"
    joined = _joined(left, right, left_on, right_on, how, salt, null_safe=True)
    if not one_key:
        return joined
    if how == "right":
        joined = joined.withColumn(left_on, F.col("_key_r"))
    return joined.drop("_key_r")


def keep_members(
    df: DataFrame,
    column: str,
    other: DataFrame,
    other_column: str,
    negate: bool = False,
    semantics: str = "sql",
) -> DataFrame:
    """Rows whose value is (not) among another table's values.

    sql: null is never a member, and "not" means NOT EXISTS. frame: null is found in a
    list that holds null.
    """
    # distinct combines map-side, so a hot value reaches the join once; its exchange is
    # the one the join needs.
    values = other.select(F.col(other_column).alias("_member")).distinct()
    if check_semantics(semantics) == "sql":
        match = df[column] == values["_member"]
    else:
        match = df[column].eqNullSafe(values["_member"])
    return df.join(values, match, "left_anti" if negate else "left_semi")


def join_group_total(
    facts: DataFrame,
    fact_key: str,
    value: str,
    groups: DataFrame,
    group_key: str,
    group_by: str,
    semantics: str = "sql",
    total: str = "total",
) -> DataFrame:
    """Sum of `value` per `group_by` over facts joined to groups.

    Facts are summed per key before the join: the partial sums combine map-side, so a
    hot key crosses the network as one row per task, and the join reuses the exchange.
    """
    per_key = facts.groupBy(F.col(fact_key).alias("_fact_key")).agg(F.sum(_operand(facts, value, semantics)).alias("_part"))
    sides = groups.select(F.col(group_key).alias("_group_key"), F.col(group_by).alias(group_by))
    if check_semantics(semantics) == "sql":
        match = sides["_group_key"] == per_key["_fact_key"]
    else:
        match = sides["_group_key"].eqNullSafe(per_key["_fact_key"])
    joined = sides.join(per_key, match, "inner")
    if semantics == "sql":
        return joined.groupBy(group_by).agg(F.sum("_part").alias(total))
    known = joined.filter(F.col(group_by).isNotNull())
    if is_float(groups.schema[group_by].dataType):
        known = known.filter(~F.isnan(group_by))
    return known.groupBy(group_by).agg(F.coalesce(F.sum("_part"), F.lit(0)).alias(total)).orderBy(group_by)
