"""Places of all rows in an order, worked out by ranges, so that no task sorts or counts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with its rows' places from 0, in the order of ``order``, which must tell rows apart.

    Rows are dealt into ranges of the order; the ranges' sizes, a row each, give where each of them starts, and places are
    counted within. The sample that sets the ranges is drawn alike whenever the plan is run on the same rows, and a given
    number of ranges is kept, so both uses of the ranges agree.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    every = W.partitionBy(F.lit(0)).orderBy("__part")  # a row for each range
    starts = sizes.select("__part", (F.sum("__n").over(every) - F.col("__n")).alias("__start"))
    within = W.partitionBy("__part").orderBy(*order)
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.row_number().over(within) - 1).cast("long")).drop("__part", "__start")
