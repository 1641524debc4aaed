"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from runloom.plans.catalog import QueryFn, shipped

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = shipped(fn)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    import importlib
    for name in ("mixing", "token_counts", "pieces", "langid", "fingerprints", "toxicity", "dedup_embeddings", "html_main", "ngram_join", "licenses", "collocations",
                 "hard_negatives", "url_filters"):
        importlib.import_module(f"runloom.llm.{name}")
