"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL for the same rows where there is one."""

    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def _load() -> None:
    from embedlens.plans import q_corpus, q_dedup_runs, q_models, q_retrieval, q_streams  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict:
    _load()
    return dict(_sql)
