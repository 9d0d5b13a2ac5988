"""Composed jobs and the query registry."""


def all_entries():
    """Every registered query by name."""
    from shelfweave.plans import forecast_queries, model_queries, panel_queries  # noqa: F401
    from shelfweave.plans.catalog import CATALOG

    return dict(CATALOG)
