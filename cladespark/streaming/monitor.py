"""Convergence while samples arrive: a structured stream over the sample folder, one report for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from ..operators.trees import splits_table

SAMPLES = "gen long, lnl double, lnpr double, body string, run_id int"


def convergence(samples: DataFrame, run) -> DataFrame:
    """``(asdsf, msdsf, trees)`` of samples after the burn-in of ``run``; nulls with fewer than four trees a run.

    Burn-in grows with the sample, so early trees leave it again: the report is worked out anew from the stored rows,
    skipping burn-in before any tree is parsed.
    """
    trees = samples.select(F.col("run_id").alias("file_id"), F.col("gen").alias("tree_id"), F.get_json_object("body", "$.newick").alias("newick"))
    last = trees.groupBy("file_id").agg(F.max("tree_id").alias("last"), F.count(F.lit(1)).alias("n"))
    cut = F.lit(run.burninGen) if run.burninGen else F.floor(F.col("last") * F.lit(run.burninProportion))
    kept = trees.join(last.filter("n >= 4").withColumn("cut", cut), "file_id").filter(F.col("tree_id") >= F.col("cut")).select("file_id", "tree_id", "newick")
    obs = splits_table(kept).withColumn("split_id", F.array_join(F.col("split").cast("array<string>"), ","))
    return splits.asdsf(obs, run.sdsfIgnoreFreq).crossJoin(last.agg(F.sum("n").alias("trees")))


def watch(spark: SparkSession, path: str, run, report: str, checkpoint: str, trigger: dict | None = None):
    """Start the monitor: whenever the sample folder grows, a row ``(batch, asdsf, msdsf, trees, converged)`` is
    appended to ``report``. A batch that is run again writes its own folder over, so reports are never doubled."""

    def one(batch: DataFrame, number: int) -> None:
        seen = batch.sparkSession.read.parquet(path)
        value = F.col("msdsf" if run.convergenceCriterion == "max" else "asdsf")
        out = convergence(seen, run).select(F.lit(number).cast("long").alias("batch"), "asdsf", "msdsf", "trees", F.coalesce(value < run.sdsfConvergence, F.lit(False)).alias("converged"))
        out.write.mode("overwrite").parquet(f"{report}/batch={number}")

    stream = spark.readStream.schema(SAMPLES).parquet(path)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_counts(stream: DataFrame, key: str = "param", late: str = "10 minutes", width: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts and sums of a stream of timed values by window and key, with a watermark that lets windows close."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
