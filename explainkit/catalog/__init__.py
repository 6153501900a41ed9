"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

from explainkit.catalog import clustering, files, graphs, modelling, ranking, scans, texts

FLAGSHIP = "eval_itempop_item"
_MODULES = (scans, ranking, clustering, texts, modelling, files, graphs)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
