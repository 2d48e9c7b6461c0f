"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are cut into words, every 6 consecutive words get a hash, and of each 8 consecutive
hashes the smallest is kept: any 13 words shared by a document and a benchmark item keep the
same hash on both sides. A join of the kept hashes names the texts that can share something;
for those alone every 13-word window is hashed, joined with the items' windows and compared
word by word. Items of fewer than 13 words are one window each and are joined by whole length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.frames import discard, free_name, quoted, small_enough, stored, text_key

WINDOW = 13
GRAM = 6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> Column:
    """A-Z in lower case, all else as it is; the quick function serves where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(F.col(text))
    return F.when(plain, F.lower(text)).otherwise(F.translate(F.col(text), UPPER, LOWER))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` plus `words`, their number `n_words` and their hashes `h1`; null has no words."""
    words = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    df = df.withColumn("words", F.coalesce(words, F.array().cast("array<string>")))
    return df.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "h1", F.transform("words", lambda w: F.xxhash64(w)))


def _merged(df: DataFrame, name: str, left: str, right: str, shift: int, how) -> DataFrame:
    """`name`[i] = how(left[i], right[i + shift]), as long as both are there; later entries are of no meaning."""
    later = F.slice(F.col(right), shift + 1, F.greatest(F.size(right), F.lit(1)))
    return df.withColumn(name, F.zip_with(left, later, how))


def with_grams(df: DataFrame, size: int) -> DataFrame:
    """`df` plus `h{size}`: hashes of `size` consecutive words, made from those of half the size."""
    have, done = 1, None
    while True:
        if size & have:
            if done is None:
                done = have
            else:
                df = _merged(df, f"h{done + have}", f"h{done}", f"h{have}", done, lambda a, b: F.xxhash64(a, b))
                done += have
        if have * 2 > size:
            return df
        df = _merged(df, f"h{have * 2}", f"h{have}", f"h{have}", have, lambda a, b: F.xxhash64(a, b))
        have *= 2


def with_fingerprints(df: DataFrame) -> DataFrame:
    """`df` plus `prints`: the different smallest hashes of all 13-word windows."""
    df = with_grams(df, GRAM)
    size, name = 1, f"h{GRAM}"
    while size < WINDOW - GRAM + 1:
        df = _merged(df, f"least{size * 2}", name, name, size, lambda a, b: F.least(a, b))
        size, name = size * 2, f"least{size * 2}"
    full = F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")
    return df.withColumn("prints", F.array_distinct(F.slice(F.col(name), F.lit(1), full)))


def _hashes_of(size: int) -> Column:
    """Different hashes of all windows of `size` words, each with the size; from `with_grams`."""
    full = F.slice(F.col(f"h{size}"), F.lit(1), F.greatest(F.col("n_words") - size + 1, F.lit(0)).cast("int"))
    return F.transform(F.array_distinct(full), lambda h: F.struct(F.lit(size).alias("size"), h.alias("h")))


def _windows_of(items: DataFrame, size: int) -> DataFrame:
    """Windows of `size` words of `items`: h, window text, item."""
    windows = F.transform(
        F.slice(F.col(f"h{size}"), F.lit(1), (F.col("n_words") - size + 1).cast("int")),
        lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice("words", i + 1, size), " ").alias("window")))
    rows = with_grams(items, size).select("item", F.explode(windows).alias("w"))
    return rows.select(F.lit(size).alias("size"), "w.h", "w.window", "item")


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Columns `keep` of `docs` plus a struct `leak`: leak_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window of an item is hit; contaminated are documents
    with 20 * n_hit >= n_words and a hit. Items without words are in nothing. A null item id
    counts as an empty one; rows with the same id are one item. Null and empty documents have no
    words. Results depend on the text alone, so copies are looked at once. A benchmark of any
    size works: both hash tables are joined, and Spark broadcasts them only below its own limit.
    """
    items = with_words(benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
                                        F.col(item_text).alias("text"))).where("n_words > 0")
    items = stored(items, "leak-items")
    short = sorted(r["n_words"] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    parts = [_windows_of(items.where(F.col("n_words") >= WINDOW), WINDOW)]
    parts += [_windows_of(items.where(F.col("n_words") == size), size) for size in short]
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    windows = stored(windows.distinct(), "leak-windows")
    wanted = stored(with_fingerprints(items).select(F.explode("prints").alias("h")).distinct(), "leak-prints")

    # One pass over all texts keeps their key, word count and fingerprints.
    named = docs.select(F.struct(*map(quoted, keep)).alias("own") if keep else F.lit(None).cast("string").alias("own"),
                        F.col(text).alias("text"), text_key(text).alias("leak_key"))
    prints = stored(with_fingerprints(with_words(named)).select("own", "leak_key", "n_words", "prints"), "leak-documents")
    suspects = prints.select("leak_key", F.explode("prints").alias("h")).join(wanted, "h", "left_semi").select("leak_key")
    if short:
        # Short items are whole windows: one more pass over the texts, for all their lengths at once.
        all_of = with_words(named.select("leak_key", "text"))
        for size in short:
            all_of = with_grams(all_of, size)
        hashes = all_of.select("leak_key", F.explode(F.concat(*(_hashes_of(size) for size in short))).alias("w"))
        of_items = windows.where(F.col("size") < WINDOW).select("size", "h").distinct()
        suspects = suspects.unionByName(hashes.select("leak_key", "w.*").join(of_items, ["size", "h"], "left_semi").select("leak_key"))
    suspects = stored(suspects.distinct(), "leak-suspects")

    texts = named.join(small_enough(suspects, 16), "leak_key", "left_semi").groupBy("leak_key").agg(F.min("text").alias("text"))
    texts = stored(with_words(texts).drop("text"), "leak-texts")
    found = None
    for size in (*short, WINDOW):
        full = F.slice(F.col(f"h{size}"), F.lit(1), F.greatest(F.col("n_words") - size + 1, F.lit(0)).cast("int"))
        at = with_grams(texts, size).select("leak_key", F.posexplode(full).alias("at", "h"))
        keys = windows.where(F.col("size") == size).select("h").distinct()
        hits = at.join(keys, "h", "left_semi").select("leak_key", "at", F.lit(size).alias("size"))
        found = hits if found is None else found.unionByName(hits)
    places = found.groupBy("leak_key").agg(F.collect_list(F.struct("at", "size")).alias("places"))
    # The words decide, not the hashes.
    spans = texts.join(places, "leak_key").select("leak_key", F.explode(F.transform("places", lambda p: F.struct(
        p["at"].alias("at"), p["size"].alias("size"),
        F.array_join(F.slice("words", p["at"] + 1, p["size"]), " ").alias("window")))).alias("s"))
    spans = spans.select("leak_key", "s.*").join(windows.select("size", "window").distinct(), ["size", "window"], "left_semi")
    spans = stored(spans, "leak-spans")
    covered = F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)))
    hit = spans.select("leak_key", "at", "size").groupBy("leak_key").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    named_items = spans.select("leak_key", "size", "window").distinct().join(
        windows.select("size", "window", "item"), ["size", "window"]).groupBy("leak_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = stored(hit.join(named_items, "leak_key"), "leak-result")
    discard(items, windows, wanted, suspects, texts, spans)
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    named_as = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return prints.drop("prints").join(result, "leak_key", "left").select(*(F.col("own")[c].alias(c) for c in keep), F.struct(
        "leak_key", "n_words", n_hit.alias("n_hit"), F.size(named_as).cast("long").alias("n_items"),
        F.sha2(F.array_join(named_as, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")).alias("leak"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """`docs` without contaminated rows, columns as they are."""
    leaks = stored(contamination(docs, benchmark, text, keep=(), **settings).where("leak.contaminated")
                   .select("leak.leak_key").distinct(), "leak-removed")
    name = free_name(docs, "leak_key")
    clean = docs.withColumn(name, text_key(text)).join(small_enough(leaks.toDF(name), 16), name, "left_anti")
    return clean.select(*map(quoted, docs.columns))
