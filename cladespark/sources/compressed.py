"""Compressed alignments as Parquet: patterns and weights by partition, and the partitions' dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alignment import contributions, patterns
from .formats import encoded, long_form, read_alignment, scheme_faults_of, scheme_sites


def compress(seqs: DataFrame, schemes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(patterns, partitions)`` of sequences under a scheme. Sites without exactly one partition are an error, as are
    sequences of unequal length and characters that a data type does not know."""
    lengths = [r.n for r in seqs.select(F.length("seq").alias("n")).distinct().limit(2).collect()]
    if len(lengths) != 1:
        raise ValueError("sequences of unequal length" if lengths else "no sequences")
    if bad := scheme_faults_of(schemes, lengths[0]).limit(5).collect():
        raise ValueError(f"sites in no or several partitions: {[(r.site, r.n) for r in bad]}")
    states = encoded(long_form(seqs), scheme_sites(schemes))
    if wrong := states.filter("state is null").select("site").limit(1).collect():
        raise ValueError(f"an unknown character at site {wrong[0].site}")
    p = patterns(states, ["name", "data_type"])
    dims = schemes.groupBy("name").agg(F.first("data_type").alias("data_type"), F.first("model").alias("model"), F.first("empirical").alias("empirical"), F.min("lo").alias("lower"), F.max("hi").alias("upper"))
    return p, dims.join(contributions(p, "name"), "name")


def write(seqs: DataFrame, schemes: DataFrame, path: str) -> None:
    """Two tables under a path, which must not exist. Parquet stores weights in as few bits as they need."""
    p, dims = compress(seqs, schemes)
    p.write.mode("errorifexists").partitionBy("name").parquet(f"{path}/patterns")
    dims.write.mode("errorifexists").parquet(f"{path}/partitions")


def read(spark: SparkSession, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables, or those of one partition alone, whose folder is the only one read."""
    p, dims = spark.read.parquet(f"{path}/patterns"), spark.read.parquet(f"{path}/partitions")
    return (p.filter(F.col("name") == name), dims.filter(F.col("name") == name)) if name else (p, dims)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return read_alignment(spark, path)
