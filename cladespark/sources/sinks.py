"""Writers of tree files, traces, diagnostics and result tables. Every one refuses to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import smaller_side


def write_table(df: DataFrame, path: str) -> None:
    """A result table as tab-separated text with a header; missing values read NA. It errs if the path exists."""
    df.write.mode("errorifexists").options(sep="\t", header=True, nullValue="NA").csv(path)


def write_samples(df: DataFrame, path: str, append: bool = False) -> None:
    """Samples by run, so that a restart or a burn-in reads only the folders it needs."""
    df.write.mode("append" if append else "errorifexists").partitionBy("run_id").parquet(path)


def tree_header(names: dict[int, str], some_id: str, param: str = "tree") -> str:
    table = ",\n".join(f"\t{k}\t{v}" for k, v in sorted(names.items()))
    return f"#NEXUS\n[ID: {some_id}]\n[Param: {param}]\nbegin trees;\n\ttranslate\n{table};"


def tree_text(trees: DataFrame, names: dict[int, str], some_id: str) -> DataFrame:
    """``(value)`` lines of a tree file in order: header, a line for each tree by generation, ``end;``."""
    spark = trees.sparkSession
    rows = trees.select(F.lit(1).alias("o"), F.col("gen").alias("g"), F.concat(F.lit("\ttree gen."), F.col("gen").cast("string"), F.lit(".{0} = [&U] "), "newick").alias("value"))
    ends = spark.createDataFrame([(0, 0, tree_header(names, some_id)), (2, 0, "end;")], "o int, g long, value string")
    return rows.union(ends).orderBy("o", "g").select("value")


def write_tree_file(trees: DataFrame, names: dict[int, str], some_id: str, path: str) -> None:
    """One text file, as other programs expect; for large samples ``write_samples`` is the sink."""
    tree_text(trees, names, some_id).coalesce(1).write.mode("errorifexists").text(path)


def trace_wide(trace: DataFrame, params: list[str]) -> DataFrame:
    """A row for each generation and a column for each parameter, given by name so that no extra job looks for them."""
    return trace.groupBy("gen").pivot("param", params).agg(F.coalesce(F.first(F.col("value").cast("string")), F.first("label"))).withColumnRenamed("gen", "Gen")


def write_trace_file(trace: DataFrame, params: list[str], some_id: str, path: str) -> None:
    wide = trace_wide(trace, params)
    spark = trace.sparkSession
    rows = wide.select(F.lit(1).alias("o"), F.col("Gen").alias("g"), F.concat_ws("\t", F.col("Gen").cast("string"), *[F.coalesce(F.col(f"`{p}`"), F.lit("NA")) for p in params]).alias("value"))
    head = spark.createDataFrame([(0, 0, f"[ID: {some_id}]\n" + "\t".join(["Gen", *params]))], "o int, g long, value string")
    rows.union(head).orderBy("o", "g").select("value").coalesce(1).write.mode("errorifexists").text(path)


def diagnostics_wide(diag: DataFrame, names: list[str]) -> DataFrame:
    """A row for each generation, each cell ``ratio,count``."""
    cell = F.concat_ws(",", F.round("ratio", 6).cast("string"), F.col("seen").cast("string"))
    return diag.withColumn("cell", cell).groupBy("gen").pivot("name", names).agg(F.first("cell"))


def split_listing(splits: DataFrame, taxa: dict[int, str], n: int) -> DataFrame:
    """``(id, taxa)``: each split's smaller side by names."""
    table = F.create_map(*[F.lit(x) for kv in sorted(taxa.items()) for x in kv])
    return splits.select("id", F.array_join(F.transform(F.sort_array(smaller_side(F.col("split"), n)), lambda t: F.try_element_at(table, t)), ",").alias("taxa"))
