"""Canonical inputs, end-to-end plans and the registered queries."""

import importlib

MODULES = ("queries_series", "queries_tables", "queries_reports", "queries_files", "queries_live", "queries_spans", "queries_mitigation", "queries_payloads")


def load_queries() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
