"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "pip2_bars_labels_weights"
MODULES = (
    "tape_queries",
    "label_queries",
    "feature_queries",
    "strategy_queries",
    "market_queries",
    "evidence_queries",
    "stream_queries",
)


def load():
    from tapeloom.catalog.registry import ORACLES, QUERIES

    for m in MODULES:
        import_module(f"tapeloom.catalog.{m}")
    return QUERIES, {n: sql if isinstance(sql, str) else sql() for n, sql in ORACLES.items()}
