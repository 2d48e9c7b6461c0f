"""Text expressions against plain Python."""

import pytest
from pyspark.sql import functions as F

from tandem.functions import text as X

RESPONSES = [
    "no fence", "  python x = 1 sql ", "```python\nx = 1\n```", "```PYTHON\nx\n```\n```\ny\n```",
    "pre\n```\na\n...\nb\n```\npost", "```python\nunclosed", "```\n\n```", "```\n```", "```java\nx\n```",
    "\xa0 padded　", "", " ", "```python\n  keep $1 \\n inside  \n```", "x...\ny", "```Python\r\nx\n```",
    "a\n\n```python\n" + "z = 1\n" * 5000 + "```",
]


LONG = "\n".join(["z = 1"] * 5000)


def apply(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r[1] for r in df.select("i", expression(F.col("t"))).orderBy("i").collect()]


def test_extract_code(spark):
    assert apply(spark, RESPONSES, X.extract_code) == [
        "no fence", "x = 1", "x = 1", "x", "a\nb", "unclosed", "", "", "java\nx", "padded", "", "",
        "keep $1 \\n inside", "y", "x", LONG]
    assert apply(spark, RESPONSES, lambda c: X.extract_code(c, "SQL", "api")) == [
        "no fence", "python x = 1", "python\nx = 1", "```\ny", "a\nb", "python\nunclosed", "", "", "java\nx", "padded", "", "",
        "python\n  keep $1 \\n inside", "y", "Python\r\nx", "a\n\npython\n" + LONG]


def test_clean_and_validity(spark):
    assert apply(spark, RESPONSES, X.clean_prediction) == [
        "no fence", "x = 1 sql", "x = 1", "PYTHON\nx\n\n\ny", "pre\n\na\n...\nb\n\npost", "unclosed", "", "", "java\nx",
        "padded", "", "", "keep $1 \\n inside", "x...\ny", "x", "a\n\n\n" + LONG]
    texts = ["", "a", "ab", " \t", "\xa0\xa0", None]
    assert apply(spark, texts, X.mark_invalid) == [X.INVALID, X.INVALID, "ab", X.INVALID, X.INVALID, X.INVALID]


def test_parse_operations(spark):
    texts = ['["A", "B", "A"]', "", "[x,, y ]", ' "p" q" ', "a[b]c,\xa0d\u2003"]
    want = [["A", "B"], [""], ["x", "", "y"], ['p" q'], ["abc", "d"]]
    assert [list(x) for x in apply(spark, texts, X.parse_operations)] == want


@pytest.mark.parametrize("name,want", [
    ("rag_pd_to_np.jsonl", ("pd_to_np", "postgresql_to_pandas", "pd_to_np")),
    ("rag_np_to_pd.jsonl", ("np_to_pd", "postgresql_to_pandas", "np_to_pd")),
    ("m_pandas_to_postgresql.jsonl", ("tf_to_py", "pandas_to_postgresql", "pandas_to_postgresql")),
    ("m_tf_to_py.jsonl", ("tf_to_py", "postgresql_to_pandas", "tf_to_py")),
    ("other.jsonl", ("tf_to_py", "postgresql_to_pandas", "postgresql_to_pandas")),
])
def test_directions(spark, name, want):
    for rule, expected in zip((X.library_direction, X.query_direction, X.intent_direction), want):
        assert apply(spark, [name], rule) == [expected]


def test_target_language(spark):
    names = ["a/x_to_postgresql.jsonl", "a/identify_x.jsonl", "a/identify_to_postgresql.jsonl", "postgresql/x.jsonl"]
    assert apply(spark, names, X.target_language) == ["SQL", "JSON", "SQL", "Python"]
    forced = lambda c: X.target_language(c, F.when(F.contains(c, F.lit("identify")), F.lit("JSON")))
    assert apply(spark, names, forced) == ["SQL", "JSON", "JSON", "Python"]
