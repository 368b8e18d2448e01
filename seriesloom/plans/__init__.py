"""Registered queries: each module holds ``QUERIES`` (name to Spark job over the given tables) and
``ORACLES`` (name to the SQL that must give the same rows)."""

from . import catalog, cleaning, conversations, features, forecasts, panels, retrieval, streams, tables

MODULES = (panels, cleaning, features, catalog, forecasts, retrieval, conversations, tables, streams)


def queries():
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
