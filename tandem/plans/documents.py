"""The vector path: operation names to vectors, to the nearest documents of a library, to a text.

A name is embedded once, however many lists it is in, and a list is looked up once for each library,
however many items have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from tandem.operators.joins import spread_join
from tandem.plans.retrieval import explode_operations, last_by_name, nearest, numbered_list
from tandem.session import settle

Embedder = Callable[[list[str]], list[list[float]]]

EMBED_ROWS = 64  # names in one call
VECTORS = "name string, embedding array<float>"


def embed_names(names: DataFrame, load_embedder: Callable[[], Embedder], batch_rows: int = EMBED_ROWS) -> DataFrame:
    """Columns name and embedding for each row of the one column of `names`.

    `load_embedder` runs once a task, on the executor; names go to it in batches. A null name is
    not embedded and has no row. An embedder that gives another number of vectors fails the job.
    """
    schema = pa.schema([("name", pa.string()), ("embedding", pa.list_(pa.float32()))])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = None
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            for start in range(0, len(texts), batch_rows):
                embedder = embedder or load_embedder()
                part = texts[start : start + batch_rows]
                rows = [{"name": t, "embedding": v} for t, v in zip(part, embedder(part), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return names.mapInArrow(embed, VECTORS)


def _stored_vectors(names: DataFrame, store: str) -> DataFrame | None:
    try:
        return names.sparkSession.read.schema(VECTORS).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def name_vectors(names: DataFrame, load_embedder: Callable[[], Embedder], store: str | None = None) -> DataFrame:
    """One row (name, embedding) for each different name of the one column of `names`.

    With `store`, a folder that keeps vectors from run to run, only names that it lacks are
    embedded, and are added to it; a run that fails adds nothing. One run at a time may add.
    """
    wanted = names.toDF("name").where("name IS NOT NULL").distinct()
    if store is None:
        return settle(embed_names(wanted, load_embedder))
    known = _stored_vectors(names, store)
    new = wanted if known is None else wanted.join(known, "name", "left_anti")
    embed_names(new, load_embedder).write.mode("append").parquet(store)
    return _stored_vectors(names, store).join(wanted, "name", "left_semi")


def nearest_documents(
    asked: DataFrame, documents: DataFrame, vectors: DataFrame, k: int = 1,
    search: Callable[..., DataFrame] = nearest,
) -> DataFrame:
    """The k nearest documents of the same library, for each different (library, operation) of `asked`.

    Returns library, operation, rank, api_name and docstring; see `nearest` for ties and for
    vectors without a distance. `documents`: doc_id, library, api_name, docstring, embedding.
    """
    pairs = asked.select("library", "operation").where("library IS NOT NULL").distinct()
    queries = settle(pairs.withColumn("query_id", F.monotonically_increasing_id()))
    placed = queries.join(vectors, queries["operation"] == vectors["name"]).select("query_id", "library", "embedding")
    found = search(placed, documents, "library", "query_id", "doc_id", k=k)
    texts = documents.select("doc_id", "api_name", "docstring")
    return found.join(texts, "doc_id").join(queries, "query_id").select("library", "operation", "rank", "api_name", "docstring")


def add_documents(
    df: DataFrame, documents: DataFrame, load_embedder: Callable[[], Embedder], response: str, library: str,
    name: str = "documents", k: int = 1, store: str | None = None,
) -> DataFrame:
    """Numbered texts of the documents nearest to the names in each row's operation list.

    Documents of one name count once: where they come first, with the last one's text. The text
    depends on list and library alone, so each different pair is looked up once and joined back;
    rows without a list, library or document get an empty text.
    """
    lists = df.select(F.col(response).alias("_list"), F.col(library).alias("library")).distinct()
    lists = settle(lists.where("_list IS NOT NULL AND library IS NOT NULL").withColumn("_pair", F.monotonically_increasing_id()))
    asked = explode_operations(lists, "_pair", "_list").join(lists.select("_pair", "library"), "_pair")
    vectors = name_vectors(asked.select("operation"), load_embedder, store)
    entries = settle(nearest_documents(asked, documents, vectors, k))
    hits = spread_join(asked, entries, ["library", "operation"]).select(
        "_pair", (F.col("position") * k + F.col("rank")).alias("position"), F.col("api_name").alias("name"),
        F.struct(F.col("api_name").alias("name"), F.col("docstring").alias("text")).alias("e"))
    single = last_by_name(hits, "_pair", "name", F.col("e"), "position")
    texts = numbered_list(single, "_pair", "position", F.col("value"), "document")
    keyed = lists.join(texts, "_pair").select("_list", F.col("library").alias("_library_of"), F.col("text").alias(name))
    joined = df.join(keyed, (df[response] == keyed["_list"]) & (df[library] == keyed["_library_of"]), "left")
    return joined.drop("_list", "_library_of").withColumn(name, F.coalesce(F.col(name), F.lit("")))
