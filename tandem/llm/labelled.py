"""Bounded samples of labelled documents for training, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRAIN_BYTES = 32_000  # labelled rows with longer texts are not trained on (they are scored whole)


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text",
) -> list[tuple[bytes, int]]:
    """At most `rows` different labelled texts, none held out, as (bytes, 0 or 1).

    Rows come in the order of a hash of the id, so the sample is the same in every run. A null
    label, id or text gives no example; of contradicting labels the larger counts, of several
    texts of one id the one with the smallest hash. So no more than `rows` texts of `TRAIN_BYTES`
    come to the driver, however many rows an id has.
    """
    chosen = (
        labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
        .where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).where(
        F.length("text") <= TRAIN_BYTES)
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    found = one.select("y", "text", F.xxhash64("id").alias("place"), "id").collect()
    seen: dict[bytes, int] = {}
    for row in sorted(found, key=lambda r: (r["place"], r["id"], bytes(r["text"]))):
        seen.setdefault(bytes(row["text"]), row["y"])
    return list(seen.items())[:rows]
