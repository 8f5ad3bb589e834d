"""Statistics of sampled values as Spark expressions and grouped operators.

``compat=True`` reproduces a historical definition where it differs from the documented one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lags that the autocovariance sum of the effective sample size looks at.
MOST_LAGS = 2000
#: Samples of a trace that are one block of lagged products, and lags that one step of an aggregation takes.
LAG_BLOCK, UNROLLED = 4096, 24


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean(x) -> Column:
    return F.avg(_c(x))


def variance(x) -> Column:
    """Sample variance; that of a single value is 0."""
    return F.when(F.count(_c(x)) == 1, F.lit(0.0)).otherwise(F.var_samp(_c(x)))


def sd(x) -> Column:
    return F.sqrt(variance(x))


def coefficient_of_variation(x) -> Column:
    return F.try_divide(sd(x), F.avg(_c(x)))


def skewness(x) -> Column:
    """Third moment over n against the sample variance's 3/2 power, from the population skewness."""
    n = F.count(_c(x)).cast("double")
    return F.skewness(_c(x)) * F.pow((n - 1) / n, F.lit(1.5))


def percentile(x, p: float, compat: bool = False) -> Column:
    """Nearest rank: the value at rank ceil(n p). With ``compat`` one rank above, at most the largest value.

    The plain form is an aggregate that sorts distinct values with counts and can be summed up in parts.
    """
    if not compat:
        return F.expr(f"percentile_disc({p}) within group (order by {x})") if isinstance(x, str) else F.percentile(_c(x), F.lit(p))
    values = F.array_sort(F.collect_list(_c(x)))
    n = F.size(values)
    return F.element_at(values, F.least(F.ceil(n * F.lit(p)) + 1, n).cast("int"))


def autocorrelation(samples: DataFrame, keys: list[str], order: str, value: str, lag: int) -> DataFrame:
    """``keys, autocorrelation``: lagged products about the mean over the squares about it."""
    w = W.partitionBy(*keys)
    d = samples.withColumn("__d", F.col(value) - F.avg(value).over(w)).withColumn("__l", F.lead("__d", lag).over(w.orderBy(order)))
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.col("__d") * F.col("__l")), F.sum(F.col("__d") * F.col("__d"))).alias("autocorrelation"))


def pearson(a, b, compat: bool = False) -> Column:
    """Pearson's r; with ``compat`` times n - 1, as the undivided cross sum gives it."""
    r = F.corr(_c(a), _c(b))
    return r * (F.count(F.lit(1)) - 1) if compat else r


def psrf(samples: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """``keys, psrf``: the potential scale reduction over runs of unequal length. One run gives 1; runs without any
    variance within give null.

    Two aggregations: the first makes a row for each key and run, so a long run is summed in parts.
    """
    per = samples.groupBy(*keys, run).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), variance(value).alias("v"))
    whole = per.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("k"), F.avg("v").alias("w"), F.avg("n").alias("n"), F.avg("m").alias("mm"), F.collect_list(F.struct("n", "m")).alias("runs"))
    between = F.try_divide(F.aggregate("runs", F.lit(0.0), lambda s, r: s + r["n"] * (r["m"] - F.col("mm")) * (r["m"] - F.col("mm"))), F.col("k") - 1)
    value_ = F.when(F.col("k") == 1, F.lit(1.0)).otherwise(F.sqrt(F.try_divide((1 - 1 / F.col("n")) * F.col("w") + between / F.col("n"), F.col("w"))))
    return whole.select(*keys, value_.alias("psrf"))


def ess_of(values: np.ndarray, most_lags: int = MOST_LAGS) -> float:
    """Effective sample size by the initial positive sequence of paired autocovariances."""
    x = np.asarray(values, float)
    n = len(x)
    if n < 2:
        return float(n)
    d = x - x.mean()
    lags = min(n - 1, most_lags)
    first = float(d @ d) / n
    total, odd = first, 0.0
    for lag in range(1, lags):
        g = float(d[:-lag] @ d[lag:]) / (n - lag)
        if lag % 2:
            odd = g
        elif odd + g > 0:
            total += 2 * (odd + g)
        else:
            break
    return first * n / total if total else float("nan")


def ess(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, ess``. A trace is a sequence, so each is one task's work; only order and value travel."""
    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].head(1).copy()
        out["ess"] = ess_of(pdf.sort_values(order)[value].to_numpy())
        return out

    return samples.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kinds}, ess double")


def lag_products(samples: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """``keys, lag, gamma``: autocovariances of lags 0 to ``lags``, divisor n - lag, products with a null left out. Positions
    are whole numbers without gaps.

    Traces are cut into blocks, and a block also gets the samples up to ``lags`` after it, so a sample is shuffled at
    most twice. Samples meet those after them as elements of their block, ``UNROLLED`` lags at a time, and the products
    go into sums where they are made.
    """
    w = W.partitionBy(*keys)
    size = max(lags, LAG_BLOCK)
    at, block, i = F.col("__at"), F.col("__block"), F.col("__i")
    d = samples.select(*keys, (F.col(order) - F.min(order).over(w)).alias("__at"), (F.col(value) - F.avg(value).over(w)).alias("__d"))
    own = F.floor(at / size)
    placed = d.select(*keys, "__at", "__d", F.explode(F.when((own > 0) & (at % size < lags), F.array(own, own - 1)).otherwise(F.array(own))).alias("__block"))
    blocks = placed.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list(F.struct("__at", "__d")))["__d"].alias("__x"))
    # Few bytes make many products, so the number of partitions must not follow from bytes.
    blocks = blocks.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__block")
    steps = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(lags // UNROLLED))).alias("__step"))
    heads = steps.select("*", F.posexplode(F.slice("__x", 1, size)).alias("__i", "__d"))
    sums = heads.groupBy(*keys, "__step").agg(F.max(block * size + i).alias("__last"), *[F.avg(F.col("__d") * F.get("__x", i + F.col("__step") * UNROLLED + j)).alias(f"__{j}") for j in range(UNROLLED)])
    rows = sums.select(*keys, "__step", "__last", F.posexplode(F.array(*[f"__{j}" for j in range(UNROLLED)])).alias("__j", "gamma"))
    lag = (F.col("__step") * UNROLLED + F.col("__j")).alias("lag")
    return rows.select(*keys, lag, "gamma", "__last").filter((F.col("lag") <= lags) & (F.col("lag") <= F.col("__last"))).drop("__last")


def ess_sql_form(samples: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """The effective sample size from ``lag_products`` in built-in expressions; ``lags`` bounds the lags looked at."""
    g = lag_products(samples, keys, order, value, lags)
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    lists = g.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lag", "gamma"))).alias("g")).join(n, keys)
    top = F.least(F.col("n") - 1, F.lit(lags)).cast("int")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(1, lags // 2))), lambda i: F.when(i * 2 < top, F.coalesce(F.col("g")[i * 2 - 1], F.lit(0.0)) + F.coalesce(F.col("g")[i * 2], F.lit(0.0)))), lambda v: v.isNotNull())
    step = F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(True).alias("on")), lambda a, v: F.struct(F.when(a["on"] & (v > 0), a["s"] + 2 * v).otherwise(a["s"]).alias("s"), (a["on"] & (v > 0)).alias("on")), lambda a: a["s"])
    return lists.select(*keys, F.when(F.col("n") < 2, F.col("n").cast("double")).otherwise(F.try_divide(F.col("g")[F.lit(0)] * F.col("n"), F.col("g")[F.lit(0)] + step)).alias("ess"))


def acceptance(counters: DataFrame, keys: list[str], accepted: str = "accepted") -> DataFrame:
    """``keys, ratio, seen``: the part of proposals that were accepted, and how many there were."""
    return counters.groupBy(*keys).agg((F.count_if(accepted) / F.count(F.lit(1))).alias("ratio"), F.count(F.lit(1)).alias("seen"))


def merged_counts(counters: DataFrame, keys: list[str], accepted: str = "accepted") -> DataFrame:
    """``keys, acc, rej``: accepted and rejected proposals over all chains and processes."""
    return counters.groupBy(*keys).agg(F.count_if(accepted).alias("acc"), F.count_if(~F.col(accepted)).alias("rej"))


def tuning_batches(counters: DataFrame, keys: list[str], order: str, size: int, accepted: str = "accepted") -> DataFrame:
    """``keys, batch, ratio``: acceptance since the last tuning, which comes after every ``size`` proposals of a key."""
    batch = F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size)
    return acceptance(counters.withColumn("batch", batch), [*keys, "batch"], accepted).drop("seen")


def discrete_distribution(values: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, distribution``: ``label:share`` of each label, the most frequent first, joined by commas."""
    keys = keys or []
    n = values.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))))
    one = F.struct((-F.col("p")).alias("o"), F.col(label).alias("l"), F.col("p").alias("p"))
    return share.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat(x["l"], F.lit(":"), F.format_number(x["p"], 4))), ",").alias("distribution"))


def parameter_table(trace: DataFrame, burnin: float = 0.25, compat: bool = False, with_ess: bool = True) -> DataFrame:
    """One row per parameter over all runs after burn-in: mean, sd, percentiles, effective size and scale reduction.

    Parameters are those of the smallest run id; the column Gen is no parameter.
    """
    kept = drop_burnin(trace.filter(F.col("param") != "Gen"), ["run_id", "param"], burnin)
    first = kept.join(kept.agg(F.min("run_id").alias("run_id")), "run_id", "left_semi").select("param").distinct()
    kept = kept.join(first, "param", "left_semi")
    p5 = 0.5 if compat else 0.05
    rows = kept.groupBy("param").agg(mean("value").alias("mean"), sd("value").alias("sd"), percentile("value", p5, compat).alias("perc5"), percentile("value", 0.25, compat).alias("perc25"), percentile("value", 0.5, compat).alias("median"), percentile("value", 0.75, compat).alias("perc75"), percentile("value", 0.95, compat).alias("perc95"))
    rows = rows.join(psrf(kept, ["param"], "run_id", "value"), "param")
    if with_ess:
        joined = kept.withColumn("place", F.struct("run_id", "ordinal")).withColumn("at", F.row_number().over(W.partitionBy("param").orderBy("place")))
        rows = rows.join(ess(joined, ["param"], "at", "value"), "param")
    return rows


def drop_burnin(samples: DataFrame, keys: list[str], share: float, ordinal: str = "ordinal") -> DataFrame:
    """Without the first floor(share n) samples of each key; ordinals count from 1 without gaps."""
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return samples.join(n, keys).filter(F.col(ordinal) > F.floor(F.col("__n") * F.lit(share))).drop("__n")


def kahan_sum(values: np.ndarray) -> float:
    """Compensated sum, for checks of what plain sums lose."""
    total = lost = 0.0
    for v in np.asarray(values, float):
        y = v - lost
        t = total + y
        lost = (t - total) - y
        total = t
    return total
