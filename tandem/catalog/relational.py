"""Relational operations over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.catalog.registry import query
from tandem.functions import values as V
from tandem.operators import aggregates as A, filters as S, joins as J, mapping as M, ordering as O
from tandem.sources.tables import table

MONEY = "decimal(18,2)"

# The test tables hold no nulls; these derive some, the same way on both sides.
SQL_PART = "(SELECT *, nullif(p_type, 'ECONOMY') AS kind FROM part)"
SQL_READING = (
    "(SELECT *, CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE "
    "WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS reading FROM lineitem)"
)
SQL_OWNED = (
    "(SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_custkey END AS owner FROM orders)"
)
SQL_CLIENT = "(SELECT *, nullif(c_custkey, 0) AS client FROM customer)"
SQL_F96 = (
    "(SELECT * FROM orders WHERE o_orderstatus = 'F' "
    "AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01')"
)


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("kind", F.nullif("p_type", F.lit("ECONOMY")))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    reading = (
        F.when(F.col("l_linenumber") == 3, F.lit(float("nan")))
        .when(F.col("l_linenumber") == 5, F.lit(None).cast("double"))
        .otherwise(F.col("l_quantity"))
    )
    return table(spark, d, "lineitem").withColumn("reading", reading)


def _owned(spark: SparkSession, d: str) -> DataFrame:
    owner = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey"))
    return table(spark, d, "orders").withColumn("owner", owner)


def _clients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").withColumn("client", F.nullif("c_custkey", F.lit(0).cast("long")))


def _f96(spark: SparkSession, d: str) -> DataFrame:
    """A side that leaves many customers without a match."""
    orders = S.filter_equal(table(spark, d, "orders"), "o_orderstatus", "F")
    return S.between_dates(orders, "o_orderdate", "1996-01-01", "1996-12-31")


# -- filters ---------------------------------------------------------------------------

@query("r01_filter_eq", "SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'PROMO'")
def _(spark, d):
    return S.filter_equal(table(spark, d, "part"), "p_type", "PROMO").select(
        "p_partkey", "p_name", "p_size")


@query("r01_filter_ne", f"SELECT p_partkey, kind FROM {SQL_PART} WHERE kind <> 'PROMO'")
def _(spark, d):
    return S.filter_equal(_part(spark, d), "kind", "PROMO", negate=True).select("p_partkey", "kind")


@query("r01_filter_ne_frame",
       f"SELECT p_partkey, kind FROM {SQL_PART} WHERE kind IS DISTINCT FROM 'PROMO'")
def _(spark, d):
    return S.filter_equal(_part(spark, d), "kind", "PROMO", negate=True, semantics="frame").select(
        "p_partkey", "kind")


@query("r02_filter_and",
       "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_type = 'PROMO' AND p_size > 25")
def _(spark, d):
    return S.filter_all(
        table(spark, d, "part"), F.col("p_type") == "PROMO", F.col("p_size") > 25
    ).select("p_partkey", "p_size", "p_retailprice")


@query("r03_filter_or",
       "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 400000")
def _(spark, d):
    return S.filter_any(
        table(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 400000
    ).select("o_orderkey", "o_orderstatus")


# -- joins -----------------------------------------------------------------------------

@query("r04_inner_join",
       "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer "
       "INNER JOIN orders ON c_custkey = o_custkey")
def _(spark, d):
    return J.join_on(
        table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey"
    ).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("r04_inner_join_frame",
       f"SELECT owner, c_name, o_orderkey FROM {SQL_OWNED} o INNER JOIN {SQL_CLIENT} c "
       "ON o.owner IS NOT DISTINCT FROM c.client")
def _(spark, d):
    clients = _clients(spark, d).withColumnRenamed("client", "owner")
    return J.join_on(_owned(spark, d), clients, "owner", semantics="frame").select(
        "owner", "c_name", "o_orderkey")


@query("r04_inner_join_salted",
       "SELECT l_orderkey, l_linenumber, l_quantity, s_name FROM lineitem "
       "INNER JOIN supplier ON l_suppkey = s_suppkey")
def _(spark, d):
    return J.join_on(
        table(spark, d, "lineitem"), table(spark, d, "supplier"), "l_suppkey", "s_suppkey", salt=4
    ).select("l_orderkey", "l_linenumber", "l_quantity", "s_name")


@query("r05_left_join",
       f"SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN {SQL_F96} o ON c_custkey = o_custkey")
def _(spark, d):
    return J.join_on(
        table(spark, d, "customer"), _f96(spark, d), "c_custkey", "o_custkey", "left"
    ).select("c_custkey", "c_name", "o_orderkey")


@query("r05_left_join_null_keys",
       f"SELECT o_orderkey, owner, c_name FROM {SQL_OWNED} o LEFT JOIN {SQL_CLIENT} c ON o.owner = c.client")
def _(spark, d):
    return J.join_on(_owned(spark, d), _clients(spark, d), "owner", "client", "left").select(
        "o_orderkey", "owner", "c_name")


@query("r05_left_join_frame",
       f"SELECT o_orderkey, owner, c_name FROM {SQL_OWNED} o LEFT JOIN {SQL_CLIENT} c "
       "ON o.owner IS NOT DISTINCT FROM c.client")
def _(spark, d):
    clients = _clients(spark, d).withColumnRenamed("client", "owner")
    return J.join_on(_owned(spark, d), clients, "owner", how="left", semantics="frame").select(
        "o_orderkey", "owner", "c_name")


@query("r06_right_join",
       f"SELECT o_orderkey, c_custkey, c_name FROM {SQL_F96} o RIGHT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    return J.join_on(
        _f96(spark, d), table(spark, d, "customer"), "o_custkey", "c_custkey", "right"
    ).select("o_orderkey", "c_custkey", "c_name")


@query("r06_right_join_frame",
       f"SELECT c.client AS client, o_orderkey, c_name FROM {SQL_OWNED} o RIGHT JOIN {SQL_CLIENT} c "
       "ON o.owner IS NOT DISTINCT FROM c.client")
def _(spark, d):
    owned = _owned(spark, d).withColumnRenamed("owner", "client")
    return J.join_on(owned, _clients(spark, d), "client", how="right", semantics="frame").select(
        "client", "o_orderkey", "c_name")


@query("r23_in_subquery",
       "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN "
       "(SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(spark, d):
    rich = table(spark, d, "orders").filter(F.col("o_totalprice") > 450000)
    return J.keep_members(table(spark, d, "customer"), "c_custkey", rich, "o_custkey").select(
        "c_custkey", "c_name")


@query("r23_in_subquery_frame",
       f"SELECT o_orderkey, owner FROM {SQL_OWNED} o WHERE EXISTS "
       f"(SELECT 1 FROM {SQL_CLIENT} c WHERE c_acctbal > 0 AND c.client IS NOT DISTINCT FROM o.owner)")
def _(spark, d):
    solvent = _clients(spark, d).filter(F.col("c_acctbal") > 0)
    return J.keep_members(_owned(spark, d), "owner", solvent, "client", semantics="frame").select(
        "o_orderkey", "owner")


@query("r23_not_in_subquery",
       "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS "
       "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 450000)")
def _(spark, d):
    rich = table(spark, d, "orders").filter(F.col("o_totalprice") > 450000)
    return J.keep_members(
        table(spark, d, "customer"), "c_custkey", rich, "o_custkey", negate=True
    ).select("c_custkey", "c_name")


@query("r30_join_agg", f"""
    SELECT n_name, CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name""")
def revenue_by_nation(spark, d):
    """Each step sums per key before the next join, so hot keys shrink map-side."""
    lines = table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice").cast(MONEY))
    by_customer = J.join_group_total(
        lines, "l_orderkey", "price", table(spark, d, "orders"), "o_orderkey", "o_custkey")
    by_nation = J.join_group_total(
        by_customer, "o_custkey", "total", table(spark, d, "customer"), "c_custkey", "c_nationkey")
    named = J.join_group_total(
        by_nation, "c_nationkey", "total", table(spark, d, "nation"), "n_nationkey", "n_name")
    return named.select("n_name", F.col("total").cast("double").alias("revenue"))


@query("r30_join_agg_frame", f"""
    SELECT kind, CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) AS revenue
    FROM lineitem JOIN {SQL_PART} ON l_partkey = p_partkey
    WHERE kind IS NOT NULL GROUP BY kind""")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice").cast(MONEY))
    out = J.join_group_total(
        lines, "l_partkey", "price", _part(spark, d), "p_partkey", "kind", semantics="frame")
    return out.select("kind", F.col("total").cast("double").alias("revenue"))


# -- aggregates ------------------------------------------------------------------------

@query("r07_global_agg",
       f"SELECT CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) AS total FROM lineitem")
def _(spark, d):
    priced = table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice").cast(MONEY))
    return A.total(priced, "price").select(F.col("total").cast("double").alias("total"))


@query("r07_global_agg_frame",
       f"SELECT coalesce(sum(reading) FILTER (NOT isnan(reading)), 0) AS total FROM {SQL_READING}")
def _(spark, d):
    return A.total(_readings(spark, d), "reading", "frame")


@query("r08_group_agg", f"SELECT kind, CAST(sum(p_size) AS BIGINT) AS total FROM {SQL_PART} GROUP BY kind")
def _(spark, d):
    return A.group_total(_part(spark, d), "kind", "p_size")


@query("r08_group_agg_frame",
       f"SELECT kind, CAST(sum(p_size) AS BIGINT) AS total FROM {SQL_PART} WHERE kind IS NOT NULL GROUP BY kind")
def _(spark, d):
    return A.group_total(_part(spark, d), "kind", "p_size", "frame")


@query("r09_filter_group_agg", f"""
    SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) AS total
    FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_returnflag""")
def _(spark, d):
    lines = table(spark, d, "lineitem").filter(
        F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    out = A.group_total(
        lines.withColumn("price", F.col("l_extendedprice").cast(MONEY)), "l_returnflag", "price")
    return out.select("l_returnflag", F.col("total").cast("double").alias("total"))


@query("r13_count_distinct", "SELECT count(DISTINCT l_partkey) AS n_unique FROM lineitem")
def _(spark, d):
    return A.unique_count(table(spark, d, "lineitem"), "l_partkey")


@query("r19_percentage", """
    SELECT count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / nullif(count(*), 0) AS percentage
    FROM orders""")
def _(spark, d):
    return A.percentage(table(spark, d, "orders"), F.col("o_orderstatus") == "F")


@query("r22_cond_agg", f"""
    SELECT CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS {MONEY}) ELSE 0 END) AS DOUBLE)
    AS total FROM lineitem""")
def _(spark, d):
    priced = table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice").cast(MONEY))
    out = A.conditional_total(priced, F.col("l_returnflag") == "R", "price")
    return out.select(F.col("total").cast("double").alias("total"))


@query("r22_cond_agg_frame", f"""
    SELECT coalesce(sum(reading) FILTER (l_returnflag = 'R' AND NOT isnan(reading)), 0) AS total
    FROM {SQL_READING}""")
def _(spark, d):
    return A.conditional_total(_readings(spark, d), F.col("l_returnflag") == "R", "reading", "frame")


@query("r25_max", f"SELECT max(reading) AS largest FROM {SQL_READING}")
def _(spark, d):
    return A.largest(_readings(spark, d), "reading")


@query("r25_max_frame", f"SELECT max(reading) FILTER (NOT isnan(reading)) AS largest FROM {SQL_READING}")
def _(spark, d):
    return A.largest(_readings(spark, d), "reading", "frame")


@query("r26_min", f"SELECT min(reading) AS smallest FROM {SQL_READING}")
def _(spark, d):
    return A.smallest(_readings(spark, d), "reading")


@query("r26_min_frame", f"SELECT min(reading) FILTER (NOT isnan(reading)) AS smallest FROM {SQL_READING}")
def _(spark, d):
    return A.smallest(_readings(spark, d), "reading", "frame")


@query("r27_avg", "SELECT avg(p_size) AS mean FROM part")
def _(spark, d):
    return A.mean(table(spark, d, "part"), "p_size")


@query("r27_avg_frame", f"SELECT avg(reading) FILTER (NOT isnan(reading)) AS mean FROM {SQL_READING}")
def _(spark, d):
    return A.mean(_readings(spark, d), "reading", "frame")


@query("r28_count_where", "SELECT count(*) AS n_rows FROM orders WHERE o_totalprice > 250000")
def _(spark, d):
    return A.row_count(table(spark, d, "orders"), F.col("o_totalprice") > 250000)


# -- order and limits ------------------------------------------------------------------

@query("r10_sort_desc", f"SELECT p_partkey, kind FROM {SQL_PART} ORDER BY kind DESC NULLS FIRST, p_partkey")
def _(spark, d):
    return O.sort_rows(_part(spark, d), "kind", tiebreak=["p_partkey"]).select("p_partkey", "kind")


@query("r10_sort_desc_frame",
       f"SELECT p_partkey, kind FROM {SQL_PART} ORDER BY kind DESC NULLS LAST, p_partkey")
def _(spark, d):
    return O.sort_rows(_part(spark, d), "kind", semantics="frame", tiebreak=["p_partkey"]).select(
        "p_partkey", "kind")


@query("r11_group_sort", f"""
    SELECT kind, CAST(sum(p_size) AS BIGINT) AS total FROM {SQL_PART}
    GROUP BY kind ORDER BY total DESC NULLS FIRST, kind""")
def _(spark, d):
    return O.sort_rows(A.group_total(_part(spark, d), "kind", "p_size"), "total", tiebreak=["kind"])


@query("r11_group_sort_frame", f"""
    SELECT kind, CAST(sum(p_size) AS BIGINT) AS total FROM {SQL_PART} WHERE kind IS NOT NULL
    GROUP BY kind ORDER BY total DESC NULLS LAST, kind""")
def _(spark, d):
    summed = A.group_total(_part(spark, d), "kind", "p_size", "frame")
    return O.sort_rows(summed, "total", semantics="frame", tiebreak=["kind"])


@query("r12_distinct", f"SELECT DISTINCT kind FROM {SQL_PART}")
def _(spark, d):
    return A.unique_values(_part(spark, d), "kind")


@query("r12_distinct_frame",
       f"SELECT kind, min(p_partkey) AS first_position FROM {SQL_PART} GROUP BY kind ORDER BY 2")
def _(spark, d):
    return A.unique_values(_part(spark, d), "kind", "frame", position="p_partkey")


@query("r29_limit",
       "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return O.first_rows(orders, 20, [O.sort_key("o_totalprice", descending=True), F.col("o_orderkey")])


@query("r31_filter_group_count_topk", """
    SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F'
    GROUP BY o_custkey ORDER BY n_orders DESC, o_custkey LIMIT 10""")
def _(spark, d):
    done = S.filter_equal(table(spark, d, "orders"), "o_orderstatus", "F")
    counts = done.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return O.first_rows(counts, 10, [F.col("n_orders").desc(), F.col("o_custkey")])


# -- strings, dates, nulls -------------------------------------------------------------

SLICES = [(1, 8), (0, 2), (-1, 4), (5, 3), (17, 9)]


def _sql_slice(start: int, length: int) -> str:
    first = max(start, 1)
    return f"substring(c_name, {first}, {max(0, start + length - first)})"


def _frame_slice(start: int, length: int) -> str:
    def bound(at: int) -> str:
        return f"least({at}, length(c_name))" if at >= 0 else f"greatest(length(c_name) + ({at}), 0)"

    low, high = bound(start - 1), bound(start - 1 + length)
    return f"substring(c_name, {low} + 1, greatest({high} - {low}, 0))"


@query("r14_substring", "SELECT c_custkey, " + ", ".join(
    f"{_sql_slice(*s)} AS s{i}" for i, s in enumerate(SLICES)) + " FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", *[
        V.slice_text(F.col("c_name"), *s).alias(f"s{i}") for i, s in enumerate(SLICES)])


@query("r14_substring_frame", "SELECT c_custkey, " + ", ".join(
    f"{_frame_slice(*s)} AS s{i}" for i, s in enumerate(SLICES)) + " FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", *[
        V.slice_text(F.col("c_name"), *s, semantics="frame").alias(f"s{i}")
        for i, s in enumerate(SLICES)])


@query("r15_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def _(spark, d):
    return S.match_text(table(spark, d, "part"), "p_name", "ring").select("p_partkey", "p_name")


@query("r15_like_pattern", """
    SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r_n%t'
    UNION ALL SELECT p_partkey, p_name FROM part WHERE replace(p_name, ' ', '_') LIKE '%d!_%' ESCAPE '!'""")
def _(spark, d):
    """A place for any character, and one that is escaped and stands for itself."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    joined = parts.withColumn("joined", F.replace("p_name", F.lit(" "), F.lit("_")))
    return S.match_text(parts, "p_name", "%r_n%t", "like").unionByName(
        S.match_text(joined, "joined", "%d\\_%", "like").drop("joined"))


@query("r15_like_frame", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^r.d|bolt$')")
def _(spark, d):
    return S.match_text(table(spark, d, "part"), "p_name", "^r.d|bolt$", "regex").select(
        "p_partkey", "p_name")


@query("r16_date_eq", "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def _(spark, d):
    return S.on_date(table(spark, d, "events"), "ts", "2024-01-05").select("event_id", "ts")


@query("r17_year_extract", """
    SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
           CAST(extract(dow FROM ts) AS INTEGER) AS dow FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", *[
        V.date_field(F.col("ts"), f).alias(f) for f in ("year", "month", "day", "hour", "dow")])


@query("r17_weekday_frame", """
    SELECT event_id, CAST((extract(dow FROM ts) + 6) % 7 AS INTEGER) AS weekday FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", V.date_field(F.col("ts"), "dow", "frame").alias("weekday"))


@query("r18_date_range", """
    SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'""")
def _(spark, d):
    return S.between_dates(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-06").select(
        "event_id", "ts")


@query("r18_date_range_frame", """
    SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06'""")
def _(spark, d):
    return S.between_dates(
        table(spark, d, "events"), "ts", "2024-01-05", "2024-01-06", "frame"
    ).select("event_id", "ts")


@query("r20_not_null", f"SELECT l_orderkey, l_linenumber, reading FROM {SQL_READING} WHERE reading IS NOT NULL")
def _(spark, d):
    return S.keep_known(_readings(spark, d), "reading").select("l_orderkey", "l_linenumber", "reading")


@query("r20_not_null_frame", f"""
    SELECT l_orderkey, l_linenumber, reading FROM {SQL_READING}
    WHERE reading IS NOT NULL AND NOT isnan(reading)""")
def _(spark, d):
    return S.keep_known(_readings(spark, d), "reading", "frame").select(
        "l_orderkey", "l_linenumber", "reading")


@query("r21_is_null", f"SELECT l_orderkey, l_linenumber FROM {SQL_READING} WHERE reading IS NULL")
def _(spark, d):
    return S.keep_missing(_readings(spark, d), "reading").select("l_orderkey", "l_linenumber")


@query("r21_is_null_frame", f"""
    SELECT l_orderkey, l_linenumber FROM {SQL_READING} WHERE reading IS NULL OR isnan(reading)""")
def _(spark, d):
    return S.keep_missing(_readings(spark, d), "reading", "frame").select("l_orderkey", "l_linenumber")


# -- functions and arithmetic ----------------------------------------------------------

@query("r24_apply_function", "SELECT p_partkey, upper(p_name) AS loud FROM part")
def _(spark, d):
    return M.apply_function(table(spark, d, "part"), "p_name", "loud", F.upper).select(
        "p_partkey", "loud")


def _mirror(text: str | None) -> str | None:
    return None if text is None else text[::-1]


@query("r24_apply_function_frame", "SELECT p_partkey, reverse(p_name) AS mirrored FROM part")
def _(spark, d):
    return M.apply_function(table(spark, d, "part"), "p_name", "mirrored", _mirror, "string").select(
        "p_partkey", "mirrored")


@query("r24_apply_function_series", "SELECT p_partkey, round(p_retailprice * 2 - p_size, 4) AS score FROM part")
def _(spark, d):
    """A function of a whole Series, here of two columns packed in one."""
    packed = table(spark, d, "part").withColumn("both", F.struct("p_retailprice", "p_size"))
    scored = M.apply_function(
        packed, "both", "score", lambda both: (both["p_retailprice"] * 2 - both["p_size"]).round(4), "double", of_series=True)
    return scored.select("p_partkey", "score")


@query("r32_column_product", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS rebate FROM lineitem""")
def _(spark, d):
    out = M.column_product(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", "rebate")
    return out.select("l_orderkey", "l_linenumber", F.round("rebate", 4).alias("rebate"))


SQL_PAIRED = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)"


@query("r33_array_elementwise", f"""
    SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos,
           round(a[pos] * a[32 + pos], 9) AS product, round(a[pos] - a[32 + pos], 9) AS difference
    FROM {SQL_PAIRED}, range(1, 33) r(pos)""")
def _(spark, d):
    a = F.col("embedding").cast("array<double>")
    first, second = V.array_slice(a, 0, 32), V.array_slice(a, 32, 64)
    both = F.arrays_zip(
        V.elementwise(first, second, "*").alias("product"),
        V.elementwise(first, second, "-").alias("difference"))
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("pos", "v"))
    return out.select(
        "vec_id", "pos", F.round("v.product", 9).alias("product"),
        F.round("v.difference", 9).alias("difference"))


@query("r34_affine_array", f"""
    SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(a[pos] * 2 + 1, 9) AS value
    FROM {SQL_PAIRED}, range(1, 65) r(pos)""")
def _(spark, d):
    a = F.col("embedding").cast("array<double>")
    out = table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(V.affine(a, 2.0, 1.0)).alias("pos", "value"))
    return out.select("vec_id", "pos", F.round("value", 9).alias("value"))


# -- NaN in frames -----------------------------------------------------------------------

SQL_KNOWN = f"(SELECT *, CASE WHEN NOT isnan(reading) THEN reading END AS known FROM {SQL_READING})"


@query("r10_sort_desc_frame_nan", f"""
    SELECT l_orderkey, l_linenumber, reading, row_number() OVER (
      ORDER BY known DESC NULLS LAST, l_orderkey, l_linenumber) - 1 AS position FROM {SQL_KNOWN}""")
def _(spark, d):
    """The position makes the order itself part of the result: NaN and null come last."""
    rows = _readings(spark, d).select("l_orderkey", "l_linenumber", "reading")
    order = [O.sort_key("reading", True, "frame", holds_nan=True), F.col("l_orderkey"), F.col("l_linenumber")]
    return O.number_rows(rows, order)[0]


@query("r09_filter_group_agg_frame", f"""
    SELECT kind, CAST(sum(p_size) AS BIGINT) AS total FROM {SQL_PART} WHERE p_size < 25 AND kind IS NOT NULL GROUP BY kind""")
def _(spark, d):
    return A.group_total(_part(spark, d).filter(F.col("p_size") < 25), "kind", "p_size", "frame")


@query("r11_group_sort_frame_nan", f"""
    SELECT key, total, row_number() OVER (ORDER BY total DESC, key) - 1 AS position FROM (
      SELECT round(known) AS key, CAST(sum(l_linenumber) AS BIGINT) AS total FROM {SQL_KNOWN} WHERE known IS NOT NULL GROUP BY 1)""")
def _(spark, d):
    """NaN and null keys drop out of the groups, and the position makes their order part of the result."""
    keyed = _readings(spark, d).withColumn("key", F.round("reading"))
    summed = A.group_total(keyed, "key", "l_linenumber", "frame")
    return O.number_rows(summed, [O.sort_key("total", True, "frame"), F.col("key")])[0]


@query("r13_count_distinct_frame", f"SELECT count(DISTINCT known) AS n_unique FROM {SQL_KNOWN}")
def _(spark, d):
    return A.unique_count(_readings(spark, d), "reading", semantics="frame")


@query("r30_join_agg_frame_nan", f"""
    SELECT kind, coalesce(sum(known), 0) AS total FROM {SQL_KNOWN} JOIN {SQL_PART} ON l_partkey = p_partkey
    WHERE kind IS NOT NULL GROUP BY kind""")
def _(spark, d):
    return J.join_group_total(_readings(spark, d), "l_partkey", "reading", _part(spark, d), "p_partkey", "kind", "frame")
