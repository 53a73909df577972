"""All queries of the engine's own operators, by name, with their DuckDB twins."""

from __future__ import annotations

from .plans import queries_answers, queries_corpus, queries_evaluation, queries_files, queries_runs, queries_text

MODULES = (queries_text, queries_corpus, queries_evaluation, queries_runs, queries_answers, queries_files)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
