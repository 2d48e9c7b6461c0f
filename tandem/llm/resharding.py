"""Reshard by minimum-cost flow.

From the bytes in each old shard and the capacity of each new one, a minimum-cost flow says how
many bytes go from where to where; staying in the shard of the same number is free, all else
costs its bytes. Each old shard is an ordered run of documents; the flow cuts it into
intervals, and a document goes where its middle byte falls, so every shard's size is its
capacity up to the documents at the cuts. Only shards that gain or lose rows are rewritten.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.llm.frames import discard, others, quoted, stored

OVERHEAD = 8
BLOCK_ROWS = 2_000   # rows that one ordered window is made for, on average
CROWD_ROWS = 10_000  # rows equal in id and text from which they are several blocks


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def flow(old: Sequence[int], new: Sequence[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j: all of `old`, none above `new`, fewest moved (i != j).

    Successive shortest paths on source, old, new, sink. The network has one node per shard.
    """
    if sum(old) > sum(new):
        raise ValueError("the new shards hold less than the old ones have")
    m, n = len(old), len(new)
    source, sink = m + n, m + n + 1
    room: dict[int, dict[int, int]] = {v: {} for v in range(m + n + 2)}
    cost = {}

    def edge(a: int, b: int, capacity: int, price: int) -> None:
        room[a][b], room[b][a] = capacity, 0
        cost[a, b], cost[b, a] = price, -price

    for i, size in enumerate(old):
        edge(source, i, size, 0)
        for j in range(n):
            edge(i, m + j, size, int(i != j))
    for j, size in enumerate(new):
        edge(m + j, sink, size, 0)
    while True:
        best, came, todo, queued = {source: 0}, {}, deque([source]), {source}
        while todo:
            a = todo.popleft()
            queued.discard(a)
            for b, free in room[a].items():
                if free and best[a] + cost[a, b] < best.get(b, 1 << 60):
                    best[b], came[b] = best[a] + cost[a, b], a
                    if b not in queued:
                        todo.append(b)
                        queued.add(b)
        if sink not in best:
            break
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        amount = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= amount
            room[b][a] += amount
    return {(i, j): room[m + j][i] for i in range(m) for j in range(n) if room[m + j][i]}


def cuts(moves: dict[tuple[int, int], int], old: Sequence[int]) -> dict[int, list[tuple[int, int]]]:
    """By old shard: (byte where the interval ends, new shard), what stays first."""
    result: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(old)):
        at, parts = 0, sorted(((j, b) for (a, j), b in moves.items() if a == i), key=lambda p: (p[0] != i, p[0]))
        for j, amount in parts:
            at += amount
            result.setdefault(i, []).append((at, j))
    return result


def _with_blocks(rows: DataFrame) -> DataFrame:
    """`rows` plus old and block, which orders the blocks of an old shard.

    A block is what a hash of id and text deals out. More equal rows than `CROWD_ROWS` are blocks of their
    own behind that one, dealt out by the number of the row, as any order of them is the same.
    """
    old, order = F.col("place.old").alias("old"), F.col("place.order").alias("order")
    crowds = stored(rows.groupBy(old, order).agg(F.count("*").alias("size")).where(F.col("size") > CROWD_ROWS), "reshard-crowds")
    alone = F.struct(F.col("place.block").alias("hash"), F.lit(0).cast("long").alias("crowd"), F.lit(-1).cast("long").alias("part"))
    if crowds.isEmpty():
        return rows.withColumns({"old": old, "block": alone})
    crowds = crowds.select(F.col("old").alias("_old"), F.col("order").alias("_order"), "size")
    found = rows.join(crowds, (F.col("place.old") == F.col("_old")) & (F.col("place.order") == F.col("_order")), "left")
    part = F.pmod(F.xxhash64("place.nth"), F.ceil(F.col("size") / BLOCK_ROWS))
    own = F.struct(F.col("place.block").alias("hash"), F.col("_order").alias("crowd"), part.alias("part"))
    return found.withColumns({"old": old, "block": F.when(F.col("size").isNull(), alone).otherwise(own)}).drop("_old", "_order", "size")


def reshard(
    docs: DataFrame, old_shard: Column, old_count: int, shards: int, key: str = "doc_id", text: str = "text",
    keep: Sequence[str] | None = None, capacities: Sequence[int] | None = None,
) -> DataFrame:
    """Columns `keep` (default: all) of `docs` plus a struct `place`: size, text_crc32, old_shard, shard, slot.

    A kept column called `place` is replaced; no other name clashes with one used inside.

    `old_shard` gives each row's shard of 0 to `old_count` - 1; `capacities` are bytes by new
    shard (default: equal). Size is the bytes of the text plus 8; null text has none and its
    checksum is that of an empty one. Rows stand in their old shard by a hash of id and text,
    so a huge shard, also one of copies of one text or of one row, is many small blocks: running sums
    go over block totals and inside blocks, never over a whole shard in one task. Null and repeated
    ids are rows like others; equal rows are interchangeable. Only sums per old shard come to
    the driver.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "place"]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    blocks = max(16, -(-docs.count() // (BLOCK_ROWS * old_count)))
    order = F.xxhash64(F.col(key), F.col(text))
    base = stored(docs.select(
        F.struct(*map(quoted, keep)).alias("own") if keep else F.lit(None).cast("string").alias("own"), F.struct(
            size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            old_shard.cast("int").alias("old"), F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int").alias("block"),
            order.alias("order"), F.col(key).cast("string").alias("id"), F.monotonically_increasing_id().alias("nth")).alias("place")),
        "reshard-rows")
    rows = _with_blocks(base)
    totals = rows.groupBy("old", "block").agg(F.sum("place.size").alias("bytes"))
    before = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored(totals.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "reshard-blocks")
    held = {r["old"]: r["bytes"] for r in totals.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    old = [held.get(i, 0) for i in range(old_count)]
    target = list(capacities) if capacities else even_capacities(sum(old), shards)
    parts = cuts(flow(old, target), old)
    if not parts:  # no rows at all
        parts = {0: [(0, 0)]}
    ends = F.create_map(*(x for i, cut in parts.items() for x in (
        F.lit(i), F.array(*(F.struct(F.lit(end).cast("long").alias("end"), F.lit(j).alias("shard")) for end, j in cut)))))
    inside = Window.partitionBy("old", "block").orderBy("place.order", "place.id", "place.text_crc32")
    running = F.sum("place.size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("before") + running - F.floor(F.col("place.size") / 2) - 1
    placed = rows.join(totals, ["old", "block"])
    placed = placed.withColumn("middle", middle)
    shard = F.element_at(F.filter(F.element_at(ends, F.col("old")), lambda cut: F.col("middle") < cut["end"]), 1)["shard"]
    placed = placed.withColumn("shard", shard)
    in_part = Window.partitionBy("old", "block", "shard").orderBy("middle")
    placed = stored(placed.withColumn("nth", F.row_number().over(in_part) - 1).drop("bytes", "before", "middle"), "reshard-placed")
    discard(base, totals)
    counts = placed.groupBy("shard", "old", "block").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stored(counts.withColumn("first", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows"), "reshard-slots")
    return placed.join(firsts, ["shard", "old", "block"]).select(*(F.col("own")[c].alias(c) for c in keep), F.struct(
        F.col("place.size").alias("size"), F.col("place.text_crc32").alias("text_crc32"), F.col("old").alias("old_shard"),
        F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("nth")).cast("long").alias("slot")).alias("place"))


def rewrite(resharded: DataFrame, path: str) -> list[int]:
    """Write the shards that gained or lost rows under `path` (`shard=N` folders); returns their numbers.

    A column called `shard` is the folder's number afterwards. Folders of other shards stay as they are. `path` may be the old layout: folders of shards
    that lost all their rows are removed once the others are written, so no document is there
    twice. The list of shards is bounded by their number.
    """
    resharded = stored(resharded, "reshard-result")
    moved = resharded.where("place.shard <> place.old_shard")
    pairs = moved.select(F.explode(F.array("place.shard", "place.old_shard")).alias("shard")).distinct()
    touched = sorted(r["shard"] for r in pairs.collect())
    filled = {r["shard"] for r in resharded.select("place.shard").distinct().collect()}
    rows = resharded.where(F.col("place.shard").isin(touched)).repartition("place.shard", F.pmod(F.xxhash64("place.slot"), F.lit(8)))
    # A column of the rows that is called like the folders gives way to them.
    (rows.select(*map(quoted, others(resharded, "place", "shard")), F.col("place.shard").alias("shard")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path))
    context = resharded.sparkSession.sparkContext
    for shard in sorted(set(touched) - filled):  # the overwrite leaves folders without new rows in place
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
