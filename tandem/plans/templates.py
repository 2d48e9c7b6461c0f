"""Prompt texts, one per domain and version.

`{name}` is filled from columns when a prompt is built; `[GUIDELINES]`, `[APIs]` and
`[INTENT]` stay in the stored prompt and are filled by a later join.
"""

from __future__ import annotations

# Version names and the folder each is stored under.
VERSIONS = {
    "zero_shot_complete": "zero_shot",
    "intent_extract": "intent",
    "intent": "intent",
    "rag_op_identify": "rag",
    "rag": "rag",
}

# The two sides of each domain, first direction first.
SIDES = {
    "query": ("PostgreSQL", "Pandas"),
    "library": ("Pandas", "Numpy"),
    "framework": ("PyTorch", "TensorFlow"),
}

# The operation names of the guide book; retrieval matches them exactly.
OPERATIONS = [
    "Filtering Rows",
    "Filtering with Multiple Conditions",
    "Filtering with OR",
    "Joining Tables",
    "Left Join",
    "Right Join",
    "Aggregations",
    "Group By with Aggregation",
    "Complex Aggregation with Filtering",
    "Sorting",
    "Sorting with Aggregation",
    "Finding Unique Values",
    "Count Unique Values",
    "String Operations",
    "String Matching",
    "Date Conversion",
    "Date Extraction",
    "Date Range Filtering",
    "Calculating Percentages",
    "Handling NULL Values",
    "Handling NULL Values with Condition",
    "Conditional Aggregation",
    "Nested Queries",
    "Applying Functions",
    "Finding Maximum Value",
    "Finding Minimum Value",
    "Finding Averages",
    "Row Count",
    "Limit Rows",
    "Complex Joins and Aggregations",
]

_OPERATION_LIST = "\n".join(f"* {name}" for name in OPERATIONS)

_ONLY_CODE = "Answer with {target_kind} code alone: no imports, no remarks.{note}"

QUERY = {
    "zero_shot_complete": (
        "Rewrite this {source_kind} as an equivalent {target_kind}.\n\n"
        "{source_kind}:\n{source_query}\n\n"
        "Tables on the {target_name} side:\n{target_schema}\n\n"
        + _ONLY_CODE + "\n```{fence}\n"
    ),
    "intent_extract": (
        "Read this {source_kind} and say in one plain sentence what it is for. Name the "
        "filters, joins, groupings and sort order it relies on. No code.\n\n"
        "{source_kind}:\n{source_query}\n\n"
        "Tables on the {source_name} side:\n{source_schema}\n\nPurpose:\n"
    ),
    "intent": (
        "Rewrite this {source_kind} as an equivalent {target_kind}.\n\n"
        "What it is for:\n[INTENT]\n\n"
        "{source_kind}:\n{source_query}\n\n"
        "Tables on the {target_name} side:\n{target_schema}\n\n"
        + _ONLY_CODE + "\n```{fence}\n"
    ),
    "rag_op_identify": (
        "Which of the operations below does this {source_kind} use? List them in the "
        "order they occur, as a JSON array of names and nothing else.\n\n"
        + _OPERATION_LIST
        + "\n\nA query that joins orders to customers and takes the mean price would give\n"
        '["Joining Tables", "Finding Averages"]\n\n'
        "{source_kind}:\n{source_query}\n\n```json\n"
    ),
    "rag": (
        "Rewrite this {source_kind} as an equivalent {target_kind}.\n\n"
        "How the two sides write the operations involved:\n[GUIDELINES]\n\n"
        "Where a way above does not fit the tables below, the tables decide.\n\n"
        "{source_kind}:\n{source_query}\n\n"
        "Tables on the {target_name} side:\n{target_schema}\n\n"
        + _ONLY_CODE + "\n```{fence}\n"
    ),
}


def _code_domain(noun: str, question_part: str) -> dict[str, str]:
    """Texts of the two code domains, which differ in a noun and the question part."""
    source = (
        "{source_name} set-up:\n{source_start}\n{source_name} solution:\n{source_code}\n\n"
    )
    target = (
        "{target_name} example input:\n{target_input}\n"
        "{target_name} set-up:\n{target_start}\n\n"
    )
    ask = f"Carry this {{source_name}} {noun} code over to {{target_name}}.\n\n"
    only = "Answer with the {target_name} solution alone: no imports, no remarks.\n```Python\n"
    return {
        "zero_shot_complete": ask + source + target + only,
        "intent_extract": (
            f"Read this {{source_name}} {noun} code and say in one plain sentence what it "
            "is for. No code.\n\n" + source + "Purpose:\n"
        ),
        "intent": ask + question_part + source + target + only,
        "rag_op_identify": (
            f"Which {{target_name}} calls would this {{source_name}} {noun} code need? "
            "Reply with a JSON array of names, three at most.\n\n"
            + source + target + "```json\n"
        ),
        "rag": (
            ask + source + "{target_name} calls that may help:\n[APIs]\n\n" + target + only
        ),
    }


LIBRARY = _code_domain(
    "library",
    "{source_name} task:\n{source_question}\n{target_name} task:\n{target_question}\n\n",
)
FRAMEWORK = _code_domain("framework", "Task:\n{source_question}\n\n")

TEMPLATES = {"query": QUERY, "library": LIBRARY, "framework": FRAMEWORK}
