"""Registration of the catalogue: a Spark query and, where SQL can say it, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroll.fixtures import oracle
from sparkroll.operators.sampling import FEISTEL_ROUNDS, WALKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, fixtures: str = "", sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under `key`."""

    def register(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = oracle(tuple(fixtures.split()), sql)
        return fn

    return register


def feistel_sql(seed: str, key: str, size: str) -> str:
    """Columns `digest`, `high` and `wide` of `permuted_picks`, for the oracle."""
    return f"md5(concat({seed}, '|', {key}::varchar)) as digest, ceil(sqrt({size}))::bigint as high, (({size}) + ceil(sqrt({size}))::bigint - 1) // ceil(sqrt({size}))::bigint as wide"


def pick_sql(j: str, size: str) -> str:
    """The pick number `j` of `permuted_picks` where the columns of `feistel_sql` are."""

    def permuted(x: str) -> str:
        left, right = f"(({x}) // wide)", f"(({x}) % wide)"
        for k in range(FEISTEL_ROUNDS):
            shift = f"('0x' || substr(md5(concat(digest, '|{k}|', {right if k % 2 == 0 else left})), 1, 8))::bigint"
            if k % 2 == 0:
                left = f"(({left} + {shift}) % high)"
            else:
                right = f"(({right} + {shift}) % wide)"
        return f"({left} * wide + {right})"

    return f"list_reduce(range(least(high * wide - ({size}), {WALKS}) + 1), lambda x, i: case when x < ({size}) then x else {permuted('x')} end, {permuted(j)})"


def r4(col):
    """Round to the 4 decimals both engines agree on."""
    return F.round(col, 4)


def r9(col):
    """For averages of averages: fractions like 21/32 sit on the border of 4 decimals."""
    return F.round(col, 9)


def big(col):
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")
