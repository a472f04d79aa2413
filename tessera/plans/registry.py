"""All queries over the operators, gathered from the plan modules."""

from __future__ import annotations

from . import codestream, colour, compose, draw, lossless, rate, reports, statistics, synthesis, trees

MODULES = (lossless, colour, compose, statistics, rate, draw, trees, codestream, synthesis, reports)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
