"""Registered queries over the shared tables and the SQL that checks them."""


def all_queries():
    """Every registered query by name, in order of registration."""
    import importlib

    from checks.registry import REGISTRY

    for module in ("queries_grid", "queries_features", "queries_series", "queries_tests",
                   "queries_models"):
        importlib.import_module(f"checks.{module}")
    return dict(REGISTRY)
