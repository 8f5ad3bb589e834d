"""Command line: ``python -m cladespark.cli TOOL ...`` for the tools over tree files, traces and alignments."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import consensus, splits
from .operators.trees import splits_table
from .sources import compressed, formats, sinks


def percent_range(text: str, lo: float, hi: float, low_in: bool = True, high_in: bool = True) -> float:
    value = float(text)
    if not (lo <= value if low_in else lo < value) or not (value <= hi if high_in else value < hi):
        raise argparse.ArgumentTypeError(f"{text} is out of range")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladespark")
    sub = p.add_subparsers(dest="tool", required=True)
    share = lambda t: percent_range(t, 0, 1, high_in=False)

    def tool(name: str, files: bool = True) -> argparse.ArgumentParser:
        t = sub.add_parser(name)
        if files:
            t.add_argument("-f", "--files", nargs="+", required=True)
        t.add_argument("-n", "--name", help="output path; without it results are printed")
        t.add_argument("--compat", action="store_true", help="historical definitions where they differ")
        return t

    t = tool("sdsf")
    t.add_argument("-r", "--relative", type=share)
    t.add_argument("-b", "--burnin", type=int)
    t.add_argument("-i", "--ignore", type=share, default=0.1)
    t = tool("consense")
    t.add_argument("-t", "--threshold", default="MR")
    t.add_argument("-b", "--burnin", type=share, default=0.25)
    t = tool("credibleset")
    t.add_argument("-c", "--credible", type=lambda x: percent_range(x, 0, 100, low_in=False), default=50.0)
    t = tool("extractbips")
    t.add_argument("-b", "--burnin", type=share, default=0.25)
    t = tool("postprocparam")
    t.add_argument("-b", "--burnin", type=share, default=0.25)
    t = tool("parse", files=False)
    t.add_argument("-s", "--alignment", required=True)
    g = t.add_mutually_exclusive_group(required=True)
    g.add_argument("-q", "--scheme")
    g.add_argument("-m", "--model", choices=("DNA", "PROT", "BIN"))
    return p


def load(spark: SparkSession, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(trees, taxa)`` of tree files numbered as given; files that name taxa differently are refused."""
    trees = taxa = None
    for k, path in enumerate(files):
        lines = formats.tree_lines(spark, path)
        t = formats.read_trees(lines).select(F.lit(k).alias("file_id"), F.col("ordinal").alias("tree_id"), "ordinal", "newick")
        x = formats.read_taxa(lines).withColumn("file", F.lit(str(k)))
        trees, taxa = (t, x) if trees is None else (trees.union(t), taxa.union(x))
    if taxa_conflict := formats.taxa_conflicts(taxa).limit(1).collect():
        raise ValueError(f"taxon {taxa_conflict[0].taxon_id} has several names: {taxa_conflict[0].names}")
    return trees, taxa.filter("file = '0'")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("cladespark").getOrCreate()

    def put(df: DataFrame, suffix: str = "") -> None:
        if a.name:
            sinks.write_table(df, a.name + suffix)
        else:
            print("\t".join(df.columns))
            for r in df.toLocalIterator():
                print("\t".join("NA" if v is None else str(v) for v in r))

    if a.tool == "postprocparam":
        trace = None
        for k, path in enumerate(a.files):
            t = formats.read_trace(spark, path, k)
            trace = t if trace is None else trace.unionByName(t)
        numbers = trace.filter("label is null")
        put(stats.parameter_table(numbers, a.burnin, a.compat))
        labels = stats.drop_burnin(trace.filter("label is not null"), ["run_id", "param"], a.burnin)
        put(stats.discrete_distribution(labels, "label", ["param"]), ".discrete")
        return 0
    if a.tool == "parse":
        seqs = formats.read_alignment(spark, a.alignment)
        length = seqs.select(F.max(F.length("seq"))).first()[0]
        scheme = formats.read_scheme(spark, a.scheme) if a.scheme else formats.single_scheme(spark, a.model, length)
        if a.name:
            compressed.write(seqs, scheme, a.name)
        else:
            put(compressed.compress(seqs, scheme)[1])
        return 0
    trees, taxa = load(spark, a.files)
    names = {r.taxon_id: r["name"] for r in taxa.collect()}
    n = len(names)
    keyed = lambda s: s.withColumn("split_id", F.array_join(F.col("split").cast("array<string>"), ","))
    if a.tool == "sdsf":
        if a.burnin is not None and a.relative is not None:
            raise SystemExit("give either a relative or a constant burn-in")
        kept = splits.burnin_each(trees, constant=a.burnin, compat=a.compat) if a.burnin is not None else splits.burnin_each(trees, a.relative if a.relative is not None else 0.25, compat=a.compat)
        put(splits.asdsf(keyed(splits_table(kept, with_length=False)), a.ignore))
    elif a.tool == "consense":
        obs = splits_table(splits.burnin_smallest(trees, a.burnin, a.compat), trivial=True)
        threshold, greedy = consensus.threshold_of(a.threshold)
        newick = consensus.consensus(obs, n, a.threshold, names, compat=a.compat)
        text = consensus.nexus_document(consensus.consensus(obs, n, a.threshold, annotated=True, compat=a.compat), names, consensus.type_name(threshold, greedy))
        if a.name:
            for suffix, x in ((".newick", newick), (".nexus", text)):
                spark.createDataFrame([(x,)], "value string").coalesce(1).write.mode("errorifexists").text(a.name + suffix)
        else:
            print(newick)
    elif a.tool == "credibleset":
        key = splits_table(trees, with_length=False).groupBy("file_id", "tree_id").agg(F.array_join(F.sort_array(F.collect_list(F.array_join(F.col("split").cast("array<string>"), " "))), "|").alias("topology"))
        put(splits.credible_set(key, a.credible / 100).orderBy(F.desc("freq"), "topology"))
    else:
        obs = keyed(splits_table(splits.burnin_first(trees, a.burnin, a.compat), trivial=True))
        ids = splits.split_ids(obs).join(obs.select("split_id", "split").distinct(), "split_id").select(F.col("rank").alias("id"), "split", "split_id")
        put(sinks.split_listing(ids, names, n), ".splits")
        put(splits.statistics(obs, a.compat).join(ids, "split_id").drop("split_id", "split"), ".statistics")
        put(obs.join(ids, "split_id").select("id", "file_id", "length"), ".lengths")
        put(spark.createDataFrame(list(enumerate(a.files)), "id int, file_name string"), ".files")
    return 0


if __name__ == "__main__":
    sys.exit(main())
