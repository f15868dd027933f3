"""Named extension points and the Arrow wrappers for user code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V = TypeVar("V")


class Registry(Generic[V]):
    """Names chosen in a configuration, mapped to column or DataFrame functions."""

    def __init__(self, kind: str):
        self.kind = kind
        self._items: dict[str, V] = {}

    def register(self, name: str, exist_ok: bool = False):
        def add(item: V) -> V:
            if name in self._items and not exist_ok:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._items[name] = item
            return item

        return add

    def __getitem__(self, name: str) -> V:
        try:
            return self._items[name]
        except KeyError:
            raise KeyError(f"no {self.kind} named {name!r}; known: {', '.join(sorted(self._items))}") from None

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)


Scorer = Callable[[pd.Series, pd.Series], tuple[pd.Series, pd.Series]]


def reward_udf(scorer: Scorer) -> Callable[[Column, Column], Column]:
    """A user reward (queries, responses) -> (rewards, unfinished) as a struct column."""

    @F.pandas_udf("reward double, is_unfinished boolean")
    def score(queries: pd.Series, responses: pd.Series) -> pd.DataFrame:
        rewards, unfinished = scorer(queries, responses)
        return pd.DataFrame({"reward": rewards.astype("float64"), "is_unfinished": unfinished.astype("bool")})

    return score


def model_score_batch(df: DataFrame, query: str, response: str, load: Callable[[], Callable[[list[str]], list[float]]], score: str = "score") -> DataFrame:
    """Score query + response with a user model loaded once per worker; a score that is there stays."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            wanted = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype="float64")
            if wanted.any():
                out[wanted] = model(texts[wanted].tolist())
            yield out

    text = F.concat(query, response)
    if score not in df.columns:
        return df.withColumn(score, scored(text))
    # rows with a score send null, so the model only sees the others
    return df.withColumn(score, F.coalesce(F.col(score), scored(F.when(F.col(score).isNull(), text))))


def row_generator(produce: Callable[[str, int], str], stop: Callable[[str], bool]):
    """A deterministic prefix -> continuation function as a batch generator for `expand_frontier`."""

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for requests in batches:
            texts = [produce(p, int(i)) for p, i in zip(requests["prefix"], requests["child_idx"])]
            ids = [f"{p}.{i}" for p, i in zip(requests["parent_id"], requests["child_idx"])]
            yield pd.DataFrame({
                "tree_id": requests["tree_id"], "node_id": ids, "parent_id": requests["parent_id"], "depth": requests["depth"], "child_idx": requests["child_idx"],
                "text": texts, "full_text": requests["prefix"] + pd.Series(texts, index=requests.index), "closed": [stop(t) for t in texts]})

    return generate


def analyze(df: DataFrame, prefix: str, **metrics: Column) -> DataFrame:
    """Metrics of a result table as (key, value) rows under a prefix."""
    row = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(f"{prefix}/{k}").alias("key"), F.col(k).alias("value")) for k in metrics])
    return row.select(F.inline(pairs))


def merge_logs(logs: list[DataFrame]) -> DataFrame:
    """Several metric logs in one; for a repeated key the last log wins."""
    merged = None
    for order, log in enumerate(logs):
        tagged = log.withColumn("__order", F.lit(order))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return merged.groupBy("key").agg(F.max_by("value", "__order").alias("value"))
