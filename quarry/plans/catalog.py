"""All queries of the engine by name, with their oracle SQL."""

from __future__ import annotations

from quarry.plans import answer_queries, answering_queries, learning_queries, retrieval_queries, store_queries, study_queries, table_queries, text_queries

MODULES: tuple = (text_queries, retrieval_queries, table_queries, study_queries, answer_queries, learning_queries, answering_queries, store_queries)


def queries() -> dict:
    return {name: build for module in MODULES for name, (build, _) in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
