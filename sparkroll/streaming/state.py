"""State per run in Spark's state store: one value a run, moved on iteration by iteration.

The input has one row for each run and iteration, as a batch aggregation or
`jobs.moments` leaves it. Rows of a micro-batch are taken in the order of their
iterations. A row at or before the last iteration of its run was seen already
and changes nothing, so a source may repeat what it sent. Null runs are a run of their own; rows without an
iteration are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkroll.streaming.jobs import INITIAL_COUNT, INITIAL_VARIANCE, KL_CLIP, NOW

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunFold(StatefulProcessor):
    """A fold over the iterations of a run; subclasses say what is kept and what one row does to it."""

    kept: str  # columns of the state behind the last iteration
    start: tuple
    needed: tuple[str, ...]  # columns of a row that `step` reads
    given: Mapping[str, str]  # columns that `step` returns, with their types

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple]:
        """The state after the row, and the columns it gives."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("run", f"last bigint, {self.kept}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, *state = self.value.get() if self.value.exists() else (None, *self.start)
        batch = pd.concat(list(rows)).sort_values("iteration", kind="stable")
        out = []
        for iteration, *row in batch[["iteration", *self.needed]].itertuples(index=False):
            if last is None or iteration > last:
                state, given = self.step(tuple(state), tuple(row))
                last = int(iteration)
                out.append((key[0], last, *given))
        self.value.update((last, *state))
        yield pd.DataFrame(out, columns=["run", "iteration", *self.given])

    def close(self) -> None:
        pass


class KlCoefficient(RunFold):
    """The coefficient in force at each iteration, then its update by the measured `kl` over `n_steps` steps."""

    kept, needed, given = "coef double", ("kl", "n_steps"), {"n_steps": "bigint", "kl_coef": "double"}

    def __init__(self, initial: float, target: float, horizon: float):
        self.start, self.target, self.horizon = (float(initial),), target, horizon

    def step(self, state, row):
        (coef,), (kl, n_steps) = state, row
        if pd.isna(kl) or pd.isna(n_steps):
            return (coef,), (None if pd.isna(n_steps) else int(n_steps), coef)
        error = max(min(kl / self.target - 1, KL_CLIP), -KL_CLIP)
        return (coef * (1 + error * float(n_steps) / self.horizon),), (int(n_steps), coef)


class RunningMoments(RunFold):
    """Count, mean, variance and sample deviation of all values up to each iteration, from its moments."""

    kept, needed = "n double, mean double, m2 double", ("n", "mean", "m2")
    start = (0.0, 0.0, 0.0)
    given = {"count": "bigint", "mean": "double", "var": "double", "std": "double"}

    def step(self, state, row):
        n, mean, m2 = state
        if row[0] > 0:
            more, its_mean, its_m2 = (float(x) for x in row)
            away, both = its_mean - mean, n + more
            mean, m2, n = mean + away * more / both, m2 + its_m2 + away * away * n * more / both, both
        count = n + INITIAL_COUNT
        var = (m2 + INITIAL_VARIANCE * INITIAL_COUNT) / count
        return (n, mean, m2), (int(n), mean, var, math.sqrt(var * count / (n - 1)) if n > 1 else None)


def fold_runs(stream: DataFrame, run: str, iteration: str, fold: RunFold, table: str, progress: str, trigger: dict | None = None):
    """Append what the fold gives for each new iteration to a table; `progress` keeps the state over restarts."""
    spark = stream.sparkSession
    rows = stream.where(F.col(iteration).isNotNull()).select(F.col(run).alias("run"), F.col(iteration).cast("bigint").alias("iteration"), *fold.needed)
    schema = ", ".join([f"run {stream.schema[run].dataType.simpleString()}", "iteration bigint", *(f"{n} {t}" for n, t in fold.given.items())])
    folded = rows.groupBy("run").transformWithStateInPandas(fold, schema, "Append", "None")
    writer = folded.writeStream.format("parquet").option("path", table).option("checkpointLocation", progress).outputMode("append").trigger(**(trigger or NOW))
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # value state needs it; a query keeps the setting it was started with
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
