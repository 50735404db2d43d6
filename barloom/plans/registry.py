"""All registered queries and the SQL each one is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "bar_queries", "backtest_queries", "panel_queries", "model_queries", "spectral_queries", "text_queries", "report_queries",
)

QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _m = import_module(f"barloom.plans.{_name}")
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
