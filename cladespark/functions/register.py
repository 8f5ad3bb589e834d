"""Functions for SQL: table functions over Newick text and grouped statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.trees import edges_of, parse_newick
from .scalar import percentile_of
from .stats import ess_of


class NewickEdges:
    """``newick_edges(text)``: parent, child, length, is_tip, depth."""

    def eval(self, newick: str):
        if newick:
            yield from edges_of(parse_newick(newick))


class NewickSplits:
    """``newick_splits(text, trivial)``: the side without taxon 1, and the length."""

    def eval(self, newick: str, trivial: bool):
        if newick:
            for side, length in parse_newick(newick).splits(bool(trivial)).items():
                yield sorted(side), length


def ess(place: pd.Series, value: pd.Series) -> float:
    """Effective sample size; values are put in the order of their places, as grouping keeps none."""
    return ess_of(value.to_numpy()[np.argsort(place.to_numpy(), kind="stable")])


def ref_percentile(values: pd.Series, p: pd.Series) -> float:
    """The percentile one rank above the nearest."""
    return float(percentile_of(values.dropna().tolist(), float(p.iloc[0]), compat=True)) if values.notna().any() else float("nan")


def ref_skewness(values: pd.Series) -> float:
    """Third moment over n, against the sample variance."""
    d = values - values.mean()
    n = len(d)
    return float((d**3).sum() / n / ((d**2).sum() / (n - 1)) ** 1.5) if n > 1 else float("nan")


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("newick_edges", F.udtf(NewickEdges, returnType="parent int, child int, length double, is_tip boolean, depth int"))
    spark.udtf.register("newick_splits", F.udtf(NewickSplits, returnType="split array<int>, length double"))
    spark.udf.register("ref_percentile", F.pandas_udf(ref_percentile, "double"))
    spark.udf.register("ref_skewness", F.pandas_udf(ref_skewness, "double"))
    spark.udf.register("ess", F.pandas_udf(ess, "double"))
