"""Relational operations, DataFrame in and DataFrame out.

Where SQL and dataframe code disagree on missing values or order, the operation takes
`semantics="sql"` or `semantics="frame"`.
"""
