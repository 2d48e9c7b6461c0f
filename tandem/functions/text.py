"""Text expressions: operation lists, fenced code, file-name rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The mark put in place of an unusable model answer.
INVALID = "[INVALID]"

# File-name parts and the direction each stands for, tested in order.
# The last pair of a family is also what an unknown name falls through to.
LIBRARY_DIRECTIONS = [
    ("pd_to_np", "pd_to_np"),
    ("np_to_pd", "np_to_pd"),
    ("py_to_tf", "py_to_tf"),
]
QUERY_DIRECTIONS = [("pandas_to_postgresql", "pandas_to_postgresql")]
INTENT_DIRECTIONS = LIBRARY_DIRECTIONS + [("tf_to_py", "tf_to_py")] + QUERY_DIRECTIONS

# The library documents are looked up in for each direction.
TARGET_LIBRARY = {
    "pd_to_np": "NumPy",
    "np_to_pd": "Pandas",
    "py_to_tf": "TensorFlow",
    "tf_to_py": "PyTorch",
}


def strip_space(text: Column) -> Column:
    """Trim all Unicode white space (Spark's own trim only takes blanks)."""
    return F.btrim(text, F.lit(PY_SPACE))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def remove_all(text: Column, *parts: str) -> Column:
    """Delete literal parts one after the other."""
    for part in parts:
        text = F.replace(text, F.lit(part))
    return text


def parse_operations(text: Column) -> Column:
    """`["a", "b"]`-like text to distinct names in order of first appearance."""
    bare = F.translate(text, "[]", "")
    names = F.transform(
        F.split(bare, ","), lambda part: F.btrim(strip_space(part), F.lit('"'))
    )
    return F.array_distinct(names)


def first_match(name: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Value of the first rule whose literal occurs in `name`."""
    value = F.lit(default)
    for part, result in reversed(rules):
        value = F.when(F.contains(name, F.lit(part)), F.lit(result)).otherwise(value)
    return value


def library_direction(file_name: Column) -> Column:
    return first_match(file_name, LIBRARY_DIRECTIONS, "tf_to_py")


def query_direction(file_name: Column) -> Column:
    return first_match(file_name, QUERY_DIRECTIONS, "postgresql_to_pandas")


def intent_direction(file_name: Column) -> Column:
    return first_match(file_name, INTENT_DIRECTIONS, "postgresql_to_pandas")


def library_of(direction: Column) -> Column:
    value = F.lit(None).cast("string")
    for name, library in TARGET_LIBRARY.items():
        value = F.when(direction == name, F.lit(library)).otherwise(value)
    return value


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def target_language(path: Column, override: Column | None = None) -> Column:
    """SQL, JSON or Python by the prompt file's name.

    An identify file whose stem ends in `_postgresql` counts as SQL; pass `override`
    (null where the rule should decide) to say otherwise.
    """
    name = base_name(path)
    stem = F.split_part(name, F.lit("."), F.lit(1))
    language = (
        F.when(F.element_at(F.split(stem, "_"), -1) == "postgresql", F.lit("SQL"))
        .when(F.contains(name, F.lit("identify")), F.lit("JSON"))
        .otherwise(F.lit("Python"))
    )
    return language if override is None else F.coalesce(override, language)


def is_invalid(response: Column) -> Column:
    """True where a response has no word, or at most one character, or is null."""
    return (
        response.isNull()
        | (F.length(response) <= 1)
        | (F.length(strip_space(response)) == 0)
    )


def mark_invalid(response: Column) -> Column:
    return F.when(is_invalid(response), F.lit(INVALID)).otherwise(response)


def drop_elided_lines(code: Column) -> Column:
    """Lines holding three dots are dropped, the rest is trimmed."""
    kept = F.filter(F.split(code, "\n"), lambda line: ~F.contains(line, F.lit("...")))
    return strip_space(F.array_join(kept, "\n"))


def extract_code(response: Column, language: str = "Python", fallback: str = "batch") -> Column:
    """Body of the first fenced block, else the text without fence marks.

    `fallback` names the words deleted when no block is found: `batch` drops both
    spellings of SQL and Python, `api` only the target language's own.
    """
    pattern = rf"(?iu)```(?:{language})?\n[\s\S]*?\n```"
    words = {
        "batch": ["```", "sql", "SQL", "Python", "python"],
        "api": ["```", language.lower(), language],
    }[fallback]
    bare = remove_all(strip_space(response), *words)

    def body(block: Column) -> Column:
        # A match is never empty, so an empty body and "no block" stay apart; its first
        # line break ends the opening fence.
        start = F.instr(block, "\n")
        inside = F.substring(block, start + 1, F.length(block) - start - F.lit(4))
        return F.when(block != "", inside).otherwise(bare)

    return drop_elided_lines(bind(F.regexp_extract(response, pattern, 0), body))


def clean_prediction(response: Column) -> Column:
    """Delete fence marks and the word Python before scoring."""
    return strip_space(remove_all(response, "```", "Python", "python"))
