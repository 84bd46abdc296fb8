"""The operators bound to the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from . import (
    aggregate_queries,
    branch_queries,
    join_queries,
    profile_queries,
    quality_queries,
    ranking_queries,
    report_queries,
    row_queries,
)

MODULES = (
    row_queries,
    aggregate_queries,
    ranking_queries,
    join_queries,
    profile_queries,
    quality_queries,
    report_queries,
    branch_queries,
)

BINDINGS = {name: bound for module in MODULES for name, bound in module.BINDINGS.items()}
