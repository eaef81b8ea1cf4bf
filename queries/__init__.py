"""Registered queries: a DataFrame function and its oracle SQL side by side."""

from importlib import import_module

MODULES = [
    "trace_queries", "profile_queries", "partition_queries", "encoding_queries", "metric_queries", "run_queries",
    "source_queries",
]


def load_all() -> None:
    """Import every query module so its queries register."""
    for name in MODULES:
        import_module(f"queries.{name}")
