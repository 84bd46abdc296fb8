from __future__ import annotations


def rows(df, *columns):
    """Sorted tuples of the given (or all) columns."""
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def pairs(df):
    """{first column: second column}."""
    return {r[0]: r[1] for r in df.collect()}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
