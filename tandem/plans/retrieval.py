"""Retrieval: operation names to guide entries or nearest documents, and into prompts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.functions.text import parse_operations, strip_space
from tandem.operators.joins import spread_join

# Vectors per block in nearest-neighbour search: a block of 1,000 floats is 8 MB.
BLOCK_ROWS = 2048


def match_key(name: Column) -> Column:
    """Names are compared without outer white space and case."""
    return F.lower(strip_space(name))


def explode_operations(df: DataFrame, item: str, response: str) -> DataFrame:
    """One row per distinct operation of each response: (item, position, operation).

    Responses are dealt out before they fan out, so that no task has as many operations as one
    block of the input happens to hold responses.
    """
    own = list(dict.fromkeys((item, response)))
    return df.select(*own).repartition(*own).select(
        item, F.posexplode(parse_operations(F.col(response))).alias("position", "operation")
    )


def first_entries(guide: DataFrame, name: str = "operation", line: str = "line_no") -> DataFrame:
    """Guide keyed for lookup; of equal names the first line counts."""
    row = F.struct(*[F.col(c) for c in guide.columns])
    return (
        guide.groupBy(match_key(F.col(name)).alias("match_key"))
        .agg(F.min_by(row, F.col(line)).alias("entry"))
        .where(F.col("match_key").isNotNull())
    )


def keyword_join(operations: DataFrame, guide: DataFrame, name: str = "operation") -> DataFrame:
    """Operations with their guide entry; names the guide lacks drop out.

    The guide has one row per key after `first_entries`, so a hot operation never multiplies.
    """
    keyed = operations.withColumn("match_key", match_key(F.col(name)))
    return spread_join(keyed, first_entries(guide), ["match_key"]).drop("match_key")


def last_by_name(hits: DataFrame, item: str, name: str, value: Column, position: str) -> DataFrame:
    """One hit per (item, name): the first position, the last value."""
    return hits.groupBy(item, name).agg(
        F.min(position).alias("position"), F.max_by(value, F.col(position)).alias("value")
    )


def guide_entry(number: Column, name: Column, sql: Column, frame: Column) -> Column:
    """Fixed format of a numbered guide entry."""
    return F.concat(
        number.cast("string"), F.lit(". "), name, F.lit(":\nPostgreSQL Solution: "), sql,
        F.lit("\nPandas Solution: "), frame, F.lit("\n\n"),
    )


def document_entry(number: Column, name: Column, text: Column) -> Column:
    """Fixed format of a numbered document; entries follow without a separator."""
    return F.concat(number.cast("string"), F.lit("."), name, F.lit(":\n "), text)


def join_entries(entries: Column, style: str) -> Column:
    """Array of (name, texts...) structs in order to one numbered text."""
    if style == "guide":
        lines = F.transform(
            entries, lambda e, i: guide_entry(i + 1, e["name"], e["sql"], e["frame"])
        )
    else:
        lines = F.transform(entries, lambda e, i: document_entry(i + 1, e["name"], e["text"]))
    return strip_space(F.array_join(lines, ""))


def numbered_list(hits: DataFrame, item: str, position: str, entry: Column, style: str) -> DataFrame:
    """One numbered text per item, entries by position.

    After `last_by_name` an item has at most one hit per guide name, so the list it
    gathers is as short as the text it becomes.
    """
    gathered = hits.groupBy(item).agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), entry.alias("e")))).alias("all")
    )
    entries = F.transform("all", lambda row: row["e"])
    return gathered.select(item, join_entries(entries, style).alias("text"))


def fill_slot(
    prompts: DataFrame, texts: DataFrame, item: str, slot: str,
    prompt: str = "prompt", text: str = "text",
) -> DataFrame:
    """Put each item's text where its prompt holds `slot` (literally, everywhere).

    Items without a text get an empty one.
    """
    found = texts.select(item, F.col(text).alias("_text"))
    filled = F.replace(F.col(prompt), F.lit(slot), F.coalesce(F.col("_text"), F.lit("")))
    return prompts.join(found, item, "left").withColumn(prompt, filled).drop("_text")


def attach_intents(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses of the extract step as the intent text of the same item and direction."""
    keys = ["direction", "item_id"]
    found = responses.select(*keys, F.col("response").alias("_text"))
    filled = F.replace(F.col("prompt"), F.lit("[INTENT]"), F.coalesce(F.col("_text"), F.lit("")))
    return prompts.join(found, keys, "left").withColumn("prompt", filled).drop("_text")


def add_guidelines(
    df: DataFrame, guide: DataFrame, item: str, response: str, name: str = "guidelines"
) -> DataFrame:
    """Numbered guide text for each row's operation list; empty where nothing is found.

    The text depends on the list alone, so each different list is looked up once and its
    text joined back by the list: item ids may be null or repeated, and a guide of any size
    gives the same rows. `guide` has columns line_no, operation, postgreSQL, pandas.
    """
    lists = df.select(F.col(response).alias("_list")).where(F.col("_list").isNotNull()).distinct()
    hits = keyword_join(explode_operations(lists, "_list", "_list"), guide)
    named = hits.select(
        "_list", "position",
        F.struct(
            F.col("entry.operation").alias("name"),
            F.col("entry.postgreSQL").alias("sql"),
            F.col("entry.pandas").alias("frame"),
        ).alias("e"),
    ).withColumn("name", F.col("e.name"))
    single = last_by_name(named, "_list", "name", F.col("e"), "position")
    texts = numbered_list(single, "_list", "position", F.col("value"), "guide").withColumnRenamed("text", name)
    found = df.join(texts, F.col(response) == F.col("_list"), "left").drop("_list")
    return found.withColumn(name, F.coalesce(F.col(name), F.lit("")))


def usable_vectors(df: DataFrame, group: str, row: str, vector: str) -> DataFrame:
    """Columns grp (group and length), id and v of the rows that can be near to something.

    Rows without a group go, and vectors that are null, empty or hold a null, NaN or infinite
    entry: they have no distance. Vectors of different lengths never meet.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return kept.select(
        F.struct(F.col(group).alias("name"), F.size(vector).alias("length")).alias("grp"),
        F.col(row).cast("long").alias("id"), F.col(vector).alias("v"))


def _block_counts(rows: DataFrame, block_rows: int) -> DataFrame:
    return rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("n_blocks"))


def packed_rows(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Vectors packed by group into blocks: grp, block, ids and flat, which run in the same order.

    A block is named by a hash of the row id, so a hot group is many blocks and no task
    gathers more than one of them.
    """
    named = rows.join(counts, "grp").select(
        "grp", F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("block"), F.struct("id", "v").alias("r"))
    packed = named.groupBy("grp", "block").agg(F.collect_list("r").alias("rows"))
    return packed.select(
        "grp", "block", F.transform("rows", lambda r: r["id"]).alias("ids"),
        F.flatten(F.transform("rows", lambda r: r["v"])).alias("flat"))


def matrix_of(ids: pa.Array, flat: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray]:
    names = ids[at].values.to_numpy(zero_copy_only=False)
    values = flat[at].values.to_numpy(zero_copy_only=False).astype(np.float64)
    return names, values.reshape(len(names), -1)


def best_in_block(
    q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """k nearest documents of one block for each query: ids and exact distances."""
    d_norm = (d * d).sum(axis=1)
    scale = d_norm.max(initial=0.0)
    for start in range(0, len(q_ids), 64):
        part = q[start : start + 64]
        q_norm = (part * part).sum(axis=1)
        # The product form is fast but rounds; it only shortlists, with a margin wide
        # enough to keep every true neighbour and tie.
        rough = q_norm[:, None] + d_norm[None, :] - 2.0 * (part @ d.T)
        kth = np.partition(rough, min(k, len(d_ids)) - 1, axis=1)[:, min(k, len(d_ids)) - 1]
        margin = 1e-9 * (q_norm + scale + 1.0)
        rows, cols = np.nonzero(rough <= (kth + margin)[:, None])
        exact = np.sqrt(((part[rows] - d[cols]) ** 2).sum(axis=1))
        order = np.lexsort((d_ids[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < k
        yield q_ids[start + rows[keep]], d_ids[cols[keep]], exact[keep]


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    group: str,
    query_id: str,
    doc_id: str,
    vector: str = "embedding",
    k: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest corpus vectors of each query within its group (L2).

    The group filter holds before ranking, so a query finds k neighbours whenever its
    group has them. Returns (query_id, rank, doc_id, distance); ties go to the smaller
    id.

    Rows that `usable_vectors` leaves out get no neighbours and are none. Both sides are packed
    into blocks, and a query block meets each document block of its group once: the rows that
    cross the network are blocks and, per query and block, k candidates - never query/document
    pairs. Tasks are keyed by document block, so a hot group spreads over as many tasks as it
    has blocks. `neighbours.nearest_by_balls` leaves out blocks that are too far away.
    """
    asking, known = usable_vectors(queries, group, query_id, vector), usable_vectors(corpus, group, doc_id, vector)
    d_counts = _block_counts(known, block_rows)
    q = packed_rows(asking, _block_counts(asking, block_rows)).select(
        "grp", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    d = packed_rows(known, d_counts).withColumnsRenamed({"ids": "d_ids", "flat": "d_flat"})
    # Hashing may leave a block number unused; the join below simply misses it.
    last = F.col("n_blocks") - 1
    routed = q.join(d_counts, "grp").select(*q.columns, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    met = routed.join(d, ["grp", "block"]).select("q_ids", "q_flat", "d_ids", "d_flat")
    out_schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("distance", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for at in range(batch.num_rows):
                q_ids, q_matrix = matrix_of(columns[0], columns[1], at)
                d_ids, d_matrix = matrix_of(columns[2], columns[3], at)
                for found in best_in_block(q_ids, q_matrix, d_ids, d_matrix, k):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in found], schema=out_schema)

    found = met.mapInArrow(search, "query_id long, doc_id long, distance double")
    return k_best(found, k)


def k_best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, distance) of the k nearest candidates of each query; ties go to the smaller id."""
    if k == 1:
        top = found.groupBy("query_id").agg(F.min(F.struct("distance", "doc_id")).alias("b"))
        return top.select("query_id", F.lit(1).alias("rank"), "b.doc_id", "b.distance")
    # The rank filter also prunes before the exchange, to k rows per query and task.
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "distance")
