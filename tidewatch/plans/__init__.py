"""All registered queries."""

from tidewatch.plans import business, catalog, cleaning, drift, evaluation, learning, streams  # noqa: F401


def all_queries():
    return dict(catalog.QUERIES)


def all_oracles():
    return dict(catalog.ORACLES)
