"""Independent SQL for the registered queries, in the DuckDB dialect.

The texts follow the definitions literally (double joins, window frames over whole tables, range self
joins), not the rewrites used on Spark, so a match checks the rewrites.
"""

from __future__ import annotations

from riskloom.checks.operators import OPERATORS
from riskloom.checks.reports import REPORTS
from riskloom.checks.views import with_views


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body) for name, body in {**REPORTS, **OPERATORS}.items()}
