"""Views that read the driver's tables as traces, split observations, topologies and alignments.

Only integer arithmetic and built-in functions are used, so another SQL engine can define the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, param, ordinal, value)``: events as samples of parameters in four runs."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("param"), (F.col("user_id") % 4).cast("int").alias("run_id"), "value")
    order = W.partitionBy("run_id", "param").orderBy("ts", "event_id")
    return e.select("run_id", "param", F.row_number().over(order).cast("long").alias("ordinal"), "value")


def split_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, tree_id, split_id, length)``: order lines as splits of trees in three files."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 3).cast("int").alias("file_id"), F.col("l_orderkey").alias("tree_id"), F.floor(F.sqrt((F.col("l_partkey") % 100).cast("double"))).cast("int").alias("split_id")).agg((F.min("l_quantity") / 100).alias("length"))


def tree_sample(obs: DataFrame) -> DataFrame:
    """``(file_id, tree_id, ordinal)``: trees in the order of their ids, from 0."""
    return obs.select("file_id", "tree_id").distinct().withColumn("ordinal", F.row_number().over(W.partitionBy("file_id").orderBy("tree_id")).cast("long") - 1)


def topology(obs: DataFrame) -> DataFrame:
    """``(file_id, tree_id, topology)``: a tree's sorted split ids, joined."""
    return obs.groupBy("file_id", "tree_id").agg(F.array_join(F.sort_array(F.collect_set("split_id")).cast("array<string>"), ",").alias("topology"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(taxon_id, site, state)``: signs of the embeddings as a binary alignment, sites from 1, states 1 and 2."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("taxon_id"), F.posexplode("embedding").alias("p", "x")).select("taxon_id", (F.col("p") + 1).cast("int").alias("site"), F.when(F.col("x") >= 0, 2).otherwise(1).alias("state"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, name, gen, accepted)``: clicks and errors as accepted and rejected proposals of each user."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error"))
    return e.select((F.col("user_id") % 4).cast("int").alias("run_id"), F.col("user_id").alias("name"), F.col("event_id").alias("gen"), (F.col("event_type") == "click").alias("accepted"))


TRACE_SQL = """trace as (
  select (user_id % 4)::int as run_id, event_type as param, row_number() over (partition by user_id % 4, event_type order by ts, event_id) as ordinal, value from events)"""
OBS_SQL = """obs as (
  select (l_suppkey % 3)::int as file_id, l_orderkey as tree_id, floor(sqrt((l_partkey % 100)::double))::int as split_id, min(l_quantity) / 100 as length
  from lineitem group by all)"""
TREES_SQL = OBS_SQL + """, trees as (
  select file_id, tree_id, row_number() over (partition by file_id order by tree_id) - 1 as ordinal from (select distinct file_id, tree_id from obs))"""
TOPOLOGY_SQL = OBS_SQL + """, topologies as (
  select file_id, tree_id, string_agg(split_id::varchar, ',' order by split_id) as topology from obs group by all)"""
ALIGNMENT_SQL = """aln as (
  select (vec_id + 1)::int as taxon_id, p::int as site, case when embedding[p] >= 0 then 2 else 1 end as state
  from embeddings, range(1, 65) as r(p))"""
COUNTERS_SQL = """counters as (
  select (user_id % 4)::int as run_id, user_id as name, event_id as gen, event_type = 'click' as accepted from events where event_type in ('click', 'error'))"""
