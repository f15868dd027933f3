"""One entry per operator: `queries()` for Spark, `oracle_sql()` for the independent check."""

import importlib

from sparkroll.catalog.base import ORACLES, QUERIES

SECTIONS = ["evaluation", "sampling", "credit", "logprobs", "trees", "pairs", "texts", "episodes", "records", "composites", "streams"]


def _load():
    for section in SECTIONS:
        importlib.import_module(f"sparkroll.catalog.{section}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
