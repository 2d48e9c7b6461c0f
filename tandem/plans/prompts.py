"""Prompt building: every version and direction of every item in one narrow job."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from tandem.plans.templates import SIDES, TEMPLATES, VERSIONS

FIELDS = ("question", "example_input", "start_code", "sol_code")


def _side(domain: str, side: str) -> Column:
    """One side's fields as a struct, whatever the wide columns are called."""
    if domain == "query":
        query = F.col("SQL") if side == "PostgreSQL" else F.col("pandas_query")
        schema = F.col("postgresql_schema") if side == "PostgreSQL" else F.col("pandas_schema")
        return F.struct(
            F.lit(side).alias("name"), query.alias("query"), schema.alias("schema")
        )
    prefix = side.lower()
    question = F.col("question") if domain == "framework" else F.col(f"{prefix}_question")
    return F.struct(
        F.lit(side).alias("name"),
        question.alias("question"),
        *[F.col(f"{prefix}_{field}").alias(field) for field in FIELDS[1:]],
    )


def split_fields(items: DataFrame, domain: str) -> DataFrame:
    """Wide per-library columns to one row per (item, library)."""
    sides = F.array(*[_side(domain, side) for side in SIDES[domain]])
    return items.select("item_id", F.explode(sides).alias("side")).select("item_id", "side.*")


def attach_schemas(items: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add the schema texts of each item's database.

    `schemas` has one row per `db_path`, so a text is made once per database and not
    once per item. Items of unknown databases keep empty texts.
    """
    texts = [c for c in schemas.columns if c != "db_path"]
    joined = items.join(schemas, "db_path", "left")
    return joined.select(*items.columns, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts])


def render(template: str, slots: dict[str, Column]) -> Column:
    """Fill `{name}` slots; a missing value counts as empty text."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(slots[name], F.lit("")))
    return F.concat(*parts)


def version_arguments(version: Column, domain: str) -> dict[str, Column]:
    """Which question texts a version is given: only `intent`, never for queries."""
    if domain == "query":
        none = F.lit(None).cast("string")
        return {"source_question": none, "target_question": none}
    given = version == "intent"
    return {
        "source_question": F.when(given, F.col("source.question")),
        "target_question": F.when(
            given & F.lit(domain == "library"), F.col("target.question")
        ),
    }


def _query_slots() -> dict[str, Column]:
    def kind(side: str) -> Column:
        return F.when(F.col(f"{side}.name") == "PostgreSQL", F.lit("PostgreSQL query")).otherwise(
            F.lit("pandas query")
        )

    to_frame = F.col("target.name") == "Pandas"
    return {
        "source_name": F.col("source.name"),
        "target_name": F.col("target.name"),
        "source_kind": kind("source"),
        "target_kind": kind("target"),
        "source_query": F.col("source.query"),
        "source_schema": F.col("source.schema"),
        "target_schema": F.col("target.schema"),
        "fence": F.when(to_frame, F.lit("Python")).otherwise(F.lit("SQL")),
        "note": F.when(to_frame, F.lit(" Leave the outcome in a variable called `result`.")),
    }


def _code_slots(domain: str, version: str) -> dict[str, Column]:
    return {
        "source_name": F.col("source.name"),
        "target_name": F.col("target.name"),
        "source_start": F.col("source.start_code"),
        "source_code": F.col("source.sol_code"),
        "target_input": F.col("target.example_input"),
        "target_start": F.col("target.start_code"),
        **version_arguments(F.lit(version), domain),
    }


def by_direction(items: DataFrame, domain: str) -> DataFrame:
    """One row per (item, direction) with `source` and `target` structs."""
    first, second = SIDES[domain]
    ways = [
        F.struct(
            F.lit(f"{a.lower()}_to_{b.lower()}").alias("direction"),
            _side(domain, a).alias("source"),
            _side(domain, b).alias("target"),
        )
        for a, b in ((first, second), (second, first))
    ]
    return items.select("item_id", F.explode(F.array(*ways)).alias("way")).select("item_id", "way.*")


def build_prompts(items: DataFrame, domain: str, versions: list[str] | None = None) -> DataFrame:
    """All prompts of a data set: (item_id, version, folder, direction, prompt).

    The fan-out is an explode inside each row: no join and no shuffle, however many
    items there are. Store it with `write_by(df, path, "version", "direction")`.
    """
    made = []
    for version in versions or list(VERSIONS):
        slots = _query_slots() if domain == "query" else _code_slots(domain, version)
        made.append(
            F.struct(
                F.lit(version).alias("version"),
                F.lit(VERSIONS[version]).alias("folder"),
                render(TEMPLATES[domain][version], slots).alias("prompt"),
            )
        )
    pairs = by_direction(items, domain)
    return pairs.select("item_id", "direction", F.explode(F.array(*made)).alias("p")).select(
        "item_id", "p.version", "p.folder", "direction", "p.prompt"
    )


def prompt_file(version: Column, folder: Column, direction: Column) -> Column:
    """Name a prompt set is stored under."""
    return F.concat(folder, F.lit("/"), version, F.lit("_"), direction, F.lit(".jsonl"))


def chat_messages(prompt: Column) -> Column:
    """A prompt as the single user turn of a chat."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
