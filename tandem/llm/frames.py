"""Small helpers on DataFrames that the operators of this subpackage share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, functions as F

from tandem.session import scratch_path

# A side is broadcast only when its measured bytes are below this; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 32 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute once into the shared folder (zstd) and read back: later steps see the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by `stored` that no later step reads any more.

    A lost executor needs none of them again: whatever was made of them is stored itself. The same
    holds for the shuffle files behind them, which Spark removes when the driver's garbage
    collector finds that nothing refers to them; it is asked to look now, not in half an hour.
    """
    for table in tables:
        files = table.inputFiles()
        if files:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def small_enough(df: DataFrame, width: Column | int) -> DataFrame:
    """`df`, marked for broadcast if rows times `width` bytes are proven to be few."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores added until no column of `df` is called that, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of `df` that are not called one of `names`, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_key(text: str = "text") -> Column:
    """128-bit key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def word_count(text: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
