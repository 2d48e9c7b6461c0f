"""Mix sources to target token shares by repeating documents.

Tokens are summed per source, each source gets a target, and the ratio of the two is its
repetition rate. A document is emitted floor(rate) times, plus once more with probability
equal to the fraction; the draw comes from an MD5 of seed, id, source, text and the number among
equal rows, so reruns, retries and other engines agree on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.llm.frames import free_name, others, quoted, stored, word_count

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
BLOCK_ROWS = 2_000  # equal rows that one ordered window is made for, on average


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT, most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """One row per source: `source`, `source_size`, `target`, `rate`.

    Weights repeat over the sources in code-point order, null last. All targets sum to
    `share_percent` of all sizes. A target stops at `most_repeats` times its source's size and
    the excess goes to the others by weight until none is above: every other target is then
    weight times one common level, which sorting the sources by cap per weight finds directly.
    The table has one row per source; only it passes the one ordered window.
    A source of size 0 has target and rate 0.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    table = (
        sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
        .withColumn("place", (F.row_number().over(ordered) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * most_repeats)
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        (F.sum("source_size").over(every) * share_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (100 * (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    )
    table = table.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    table = table.withColumn("common", F.first(fits, ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap").cast("double")))
    return table.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw_key(docs: DataFrame, source: str, text: str, key: str) -> Column:
    """What tells rows apart in a draw: id, source, MD5 of the text and a hash of all other columns.

    Maps cannot be hashed and are left out.
    """
    rest = [F.col(quoted(c)) for c in others(docs, source, text, key) if "map<" not in docs.schema[c].dataType.simpleString()]
    own = F.concat(F.lit("="), F.col(source).cast("string"))
    return F.concat_ws(
        ":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(own, F.lit("-")),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.xxhash64(*rest).cast("string") if rest else F.lit(""))


def numbered(rows: DataFrame, group: str, nth: str) -> DataFrame:
    """`rows` plus `nth`: 1, 2, 3 ... within rows of one `group`, in no particular order.

    Groups of one row need no number and only their hash is shuffled. The rows of larger ones are
    numbered in blocks of about `BLOCK_ROWS`, so that a group of any size is many small windows.
    """
    repeated = stored(rows.groupBy(group).agg(F.count("*").alias("size")).where("size > 1"), "mix-repeated")
    if repeated.isEmpty():
        return rows.withColumn(nth, F.lit(1).cast("long"))
    own, uid, block = (free_name(rows, n) for n in ("row", "uid", "block"))
    more = rows.select(F.struct(*map(quoted, rows.columns)).alias(own)).join(
        repeated.select(F.col(group).alias("__group"), "size"), F.col(own)[group] == F.col("__group"))
    more = more.withColumn(uid, F.monotonically_increasing_id())
    more = stored(more.withColumn(block, F.pmod(F.xxhash64(uid), F.ceil(F.col("size") / BLOCK_ROWS))), "mix-copies")
    counts = more.groupBy("__group", block).agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("__group").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0).cast("long"))), "mix-blocks")
    inside = Window.partitionBy("__group", block).orderBy(uid)
    more = more.withColumn("place", F.row_number().over(inside)).join(counts, ["__group", block])
    more = more.select(f"{own}.*", (F.col("before") + F.col("place")).alias(nth))
    single = rows.join(repeated.select(F.col(group)), group, "left_anti").select(*map(quoted, rows.columns))
    return single.withColumn(nth, F.lit(1).cast("long")).unionByName(more)


def draw(key: Column, nth: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5(seed:key:nth)."""
    text = F.concat_ws(":", F.lit(str(seed)), key, nth.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def with_copies(
    docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = 8,
    weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """`docs` plus a struct `mix` of size, source_size, target, rate and copies; a column `mix` is replaced.

    Null source is a source of its own, last in order. Null or empty text has size 0 and is
    repeated like any document. Every row draws for itself: rows with one id, or without, by
    source, text and other columns, and wholly equal ones by a number among them, so that
    sources come near their targets whatever the ids; the rows of a rerun are the same. The
    table of targets is stored first, so Spark knows its size and broadcasts it only under its
    own limit; else AQE splits the hot sources of the join.
    """
    docs = docs.select(*map(quoted, others(docs, "mix")))
    sizes = docs.select(F.col(source).alias("source"), word_count(text).alias("size"))
    targets = stored(source_targets(sizes, "source", "size", weights, share_percent, most_repeats), "mix-targets")
    name, drawn, nth = (free_name(docs, n) for n in ("__mix", "__draw", "__nth"))
    keyed = numbered(docs.withColumn(drawn, draw_key(docs, source, text, key)), drawn, nth)
    joined = keyed.join(targets.select(F.struct("*").alias(name)), F.col(source).eqNullSafe(F.col(f"{name}.source")), "left")
    rate = F.col(f"{name}.rate")
    copies = F.floor(rate) + (draw(F.col(drawn), F.col(nth), seed) < rate - F.floor(rate)).cast("long")
    return joined.select(*map(quoted, docs.columns), F.struct(
        word_count(text).alias("size"), F.col(f"{name}.source_size").alias("source_size"),
        F.col(f"{name}.target").alias("target"), rate.alias("rate"), copies.alias("copies")).alias("mix"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with its own columns, also one called `mix`."""
    hidden = free_name(docs, "__own_mix")
    renamed = docs.withColumnsRenamed({c: hidden for c in docs.columns if c.lower() == "mix"})
    counted = with_copies(renamed, **settings)
    times = F.array_repeat(F.lit(True), F.col("mix.copies").cast("int"))
    taken = counted.select(*map(quoted, renamed.columns), F.explode(times).alias(free_name(renamed, "__taken")))
    return taken.select(*map(quoted, renamed.columns)).toDF(*docs.columns)
