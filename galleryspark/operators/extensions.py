"""Extension points: named strategies, embedders, evaluators, filters and metadata extractors."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from galleryspark.operators import embedding, evaluation, inventory
from galleryspark.operators.vector_stats import max_pool, weighted_sum
from galleryspark.functions import text as T


class Registry:
    """Names to factories of one kind."""

    def __init__(self, kind: str, entries: dict[str, Callable[..., Any]]):
        self.kind, self._entries = kind, dict(entries)

    def register(self, name: str, factory: Callable[..., Any]) -> None:
        self._entries[name] = factory

    def get(self, name: str, **options: Any) -> Any:
        if name not in self._entries:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {sorted(self._entries)}")
        return self._entries[name](**options)


def pandas_strategy(function: Callable[[pd.Series, pd.Series], float]) -> Callable[[Column, Column], Column]:
    """A score strategy from a Python function of (scores, component types) of one document.

    For what built-in aggregates cannot say: the scores of a document, at most k per query component, are
    collected in the task.
    """

    @F.pandas_udf("double")
    def aggregate(scores: pd.Series, kinds: pd.Series) -> float:
        return float(function(scores, kinds))

    def build(score: Column, kind: Column) -> Column:
        return aggregate(score, kind)

    build.function = function  # called for many documents of a batch in turn
    return build


STRATEGIES = Registry("strategy", {"weighted_sum": weighted_sum, "max_pool": max_pool})
EMBEDDERS = Registry("embedder", {"cosine_projection": embedding.cosine_projection})
EVALUATORS = Registry(
    "evaluator",
    {
        "per_item": lambda ks=(1, 5, 10): lambda df: evaluation.loo_metrics(df, ks),
        "grouped": lambda n_groups=50: lambda df: evaluation.group_metrics(df, n_groups),
    },
)
FILTERS = Registry(
    "filter",
    {
        "artifacts": lambda: lambda df: df.where(T.is_artifact(F.col("path"))),
        "suffixes": lambda suffixes=inventory.IMAGE_SUFFIXES: lambda df: inventory.select_files(df, suffixes),
    },
)
EXTRACTORS = Registry("extractor", {"artifacts": lambda category: lambda df: inventory.artifacts(df, category)})


def apply(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Filters and extractors one after the other."""
    for step in steps:
        df = df.transform(step)
    return df
