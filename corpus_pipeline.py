"""A training corpus in five stages: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents; the last adds each row's place among the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.llm import decontamination, jaccard_join, mixing, quality_cnn, resharding
from tandem.llm.frames import discard, free_name, others, quoted, stored
from tandem.llm.queries import OLD_SHARDS, SHARDS, old_shard
from tandem.session import ship_package

LEAST_QUALITY = 0.3
SHINGLE, PERCENT = 5, 80  # of near duplicates; op7 has its own contract


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network rejects go. It is trained on labelled rows of `docs` itself."""
    ship_package(spark)
    net = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "__quality")
    return quality_cnn.with_score(docs, net, name=name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: 80 percent of five-word shingles shared."""
    ship_package(spark)
    return jaccard_join.one_of_each(docs, size=SHINGLE, percent=PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    ship_package(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    ship_package(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-equal shards, moving the fewest bytes from the layout by text hash.

    Adds size, shard and slot, in place of columns of these names.
    """
    ship_package(spark)
    placed = resharding.reshard(docs, old_shard(), OLD_SHARDS, SHARDS)
    own = others(docs, "place", "size", "shard", "slot")
    return placed.select(*map(quoted, own), "place.size", "place.shard", "place.slot")


STAGES = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate),
    ("mixing sources", mix), ("sharding", shard),
]

# The byte network has no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:  # a stage's table is not read any more once the next one's is there
            discard(before)
        before = docs
    return docs
