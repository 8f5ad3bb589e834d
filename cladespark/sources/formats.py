"""Readers of alignments, schemes, tree files, traces and diagnostics as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.alignment import encode, scheme_faults, sites_of
from ..operators.ranking import numbered

#: Names of protein matrices that a scheme may give, fixed values.
PROTEIN_MODELS = (
    "DAYHOFF", "DCMUT", "JTT", "MTREV", "WAG", "RTREV", "CPREV", "VT", "BLOSUM62", "MTMAM", "LG", "MTART", "MTZOA",
    "PMB", "HIVB", "HIVW", "JTTDCMUT", "FLU",
)


# Alignments.


def guess_format(spark: SparkSession, path: str) -> str:
    """``fasta`` if the first character that is not white space is ``>``, else ``phylip``."""
    row = spark.read.text(path).filter(F.trim("value") != "").select(F.ltrim("value").startswith(">").alias("f")).limit(1).first()
    return "fasta" if row is not None and row.f else "phylip"


def parse_phylip(text: str) -> list[tuple[str, str]]:
    """Taxa and sequences. The header gives their number and length; blocks are interleaved or sequential."""
    lines = [x for x in text.splitlines() if x.strip()]
    n, length = map(int, lines[0].split()[:2])
    body = lines[1:]
    if len(body) % n == 0:
        first = [x.split(None, 1) for x in body[:n]]
        if all(len(x) == 2 for x in first):
            seqs = ["".join(s.split()) for _, s in first]
            for at in range(n, len(body), n):
                seqs = [s + "".join(x.split()) for s, x in zip(seqs, body[at : at + n], strict=True)]
            if all(len(s) == length for s in seqs):
                return [(x[0], s) for x, s in zip(first, seqs, strict=True)]
    out: list[tuple[str, str]] = []
    at = 0
    while len(out) < n:
        if at >= len(body):
            raise ValueError("the alignment ends early")
        name, *rest = body[at].split(None, 1)
        seq = "".join(rest[0].split()) if rest else ""
        at += 1
        while len(seq) < length and at < len(body):
            seq += "".join(body[at].split())
            at += 1
        if len(seq) != length:
            raise ValueError(f"{name} has {len(seq)} characters where {length} are expected")
        out.append((name, seq))
    return out


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """``(file, taxon_id, taxon, seq)``; each file is parsed as a whole, by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, text in pdf.itertuples(index=False):
                rows = parse_phylip(text)
                yield pd.DataFrame({"file": file, "taxon_id": range(1, len(rows) + 1), "taxon": [r[0] for r in rows], "seq": [r[1] for r in rows]})

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInPandas(run, "file string, taxon_id int, taxon string, seq string")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(file, taxon_id, taxon, seq)``. Entries are split at ``>`` by the reader, so a large file is read by many tasks."""
    entries = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at")).filter(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    body = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    rows = entries.select("file", "at", F.trim(F.get(lines, 0)).alias("taxon"), body.alias("seq"))
    return rows.select("file", F.row_number().over(W.partitionBy("file").orderBy("at")).alias("taxon_id"), "taxon", "seq")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path) if guess_format(spark, path) == "fasta" else read_phylip(spark, path)


def long_form(seqs: DataFrame) -> DataFrame:
    """``(taxon_id, taxon, site, ch)``, sites from 1."""
    chars = F.split("seq", "")
    return seqs.select("taxon_id", "taxon", F.posexplode(chars).alias("p", "ch")).filter(F.col("ch") != "").select("taxon_id", "taxon", (F.col("p") + 1).alias("site"), "ch")


def encoded(aln: DataFrame, sites: DataFrame) -> DataFrame:
    """``(name, data_type, taxon_id, site, state)``: characters by the data type of their site's partition.

    The scheme is a row per site and meets the alignment by an equi-join. Unknown characters give null states.
    """
    j = aln.join(sites, "site")
    state = F.when(F.col("data_type") == "DNA", encode(F.col("ch"), "DNA")).when(F.col("data_type") == "BIN", encode(F.col("ch"), "BIN")).otherwise(encode(F.col("ch"), "PROT"))
    return j.select("name", "data_type", "taxon_id", "site", state.alias("state"))


# Schemes.

_LINE = re.compile(r"^\s*(ASC_)?([A-Za-z0-9]+)\s*,\s*([^=\s]+)\s*=\s*(.+?)\s*$")
_PART = re.compile(r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*(?:[/\\]\s*(\d+))?\s*$")


def scheme_type(token: str) -> tuple[str, str | None, bool, bool]:
    """``(data type, protein model, empirical frequencies, estimated frequencies)`` of a scheme's type token."""
    t = token.upper()
    if t.rstrip("X") in ("DNA", "BIN"):
        return t.rstrip("X"), None, False, t.endswith("X")
    for model in (*PROTEIN_MODELS, "GTR", "AUTO"):
        if t in (model, model + "F", model + "X"):
            return "PROT", model, t.endswith("F") and t != model, t.endswith("X") and t != model
    if t == "PROT":
        return "PROT", None, False, False
    raise ValueError(f"unknown data type {token}")


def parse_scheme(text: str) -> list[dict]:
    """Ranges of a scheme, a dict each: ``TYPE, name = a-b/stride, c-d``."""
    out = []
    for line in text.splitlines():
        if not line.strip():
            continue
        m = _LINE.match(line)
        if not m:
            raise ValueError(f"not a partition: {line}")
        kind, model, empirical, estimated = scheme_type(m[2])
        for part in m[4].split(","):
            p = _PART.match(part)
            if not p:
                raise ValueError(f"not a range: {part}")
            lo, hi = int(p[1]), int(p[2] or p[1])
            if hi < lo:
                raise ValueError(f"an empty range: {part}")
            out.append({"name": m[3], "data_type": kind, "model": model, "empirical": empirical, "estimated": estimated, "ascertained": bool(m[1]), "lo": lo, "hi": hi, "stride": int(p[3] or 1)})
    return out


SCHEME = "name string, data_type string, model string, empirical boolean, estimated boolean, ascertained boolean, lo int, hi int, stride int"


def scheme(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_scheme(text), SCHEME)


def read_scheme(spark: SparkSession, path: str) -> DataFrame:
    """A scheme file; it is a few lines that describe columns, so the driver reads it."""
    return scheme(spark, "\n".join(r.value for r in spark.read.text(path).collect()))


def single_scheme(spark: SparkSession, data_type: str, length: int) -> DataFrame:
    """One partition over all sites."""
    return scheme(spark, f"{data_type}, unnamedPartition = 1 - {length}")


def scheme_sites(schemes: DataFrame) -> DataFrame:
    return sites_of(schemes)


def scheme_faults_of(schemes: DataFrame, length: int) -> DataFrame:
    return scheme_faults(sites_of(schemes), length)


# Tree files.


def tree_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, at, value)`` of all lines of some files; ``at`` grows along a file."""
    # Blocks of a file may be read in any order, so a line's place is its block's start and then its number within.
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"), "value")


def read_taxa(lines: DataFrame) -> DataFrame:
    """``(file, taxon_id, name)`` from the lines between ``translate`` and the one that ends in a semicolon."""
    v = F.trim(F.col("value"), F.lit(" \t\r"))
    head = lines.withColumn("v", v).filter(~F.lower("v").rlike(r"^tree\b"))  # trees, nearly all lines, need no order
    w = W.partitionBy("file").orderBy("at")
    marked = head.withColumn("inside", F.max(F.when(F.lower("v") == "translate", 1).otherwise(0)).over(w)).withColumn("closed", F.coalesce(F.max(F.when((F.col("inside") == 1) & F.col("v").endswith(";"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = marked.filter((F.col("inside") == 1) & (F.col("closed") == 0) & (F.lower("v") != "translate") & F.col("v").rlike(r"^\d+\s"))
    return rows.select("file", F.regexp_extract("v", r"^(\d+)", 1).cast("int").alias("taxon_id"), F.regexp_extract("v", r"^\d+\s+(.*?)[,;]?$", 1).alias("name"))


def taxa_conflicts(taxa: DataFrame) -> DataFrame:
    """``(taxon_id, names)`` of the numbers that name different taxa in different files."""
    return taxa.groupBy("taxon_id").agg(F.sort_array(F.collect_set("name")).alias("names"), F.count_distinct("file").alias("files")).filter(F.size("names") > 1).select("taxon_id", "names")


def read_trees(lines: DataFrame) -> DataFrame:
    """``(file, ordinal, gen, partitions, newick)``: lines ``tree gen.G.{P} = [&U] newick``, ordinals from 0 by place."""
    v = F.trim(F.col("value"), F.lit(" \t\r"))
    t = lines.select("file", "at", v.alias("v")).filter(F.lower("v").rlike(r"^tree\b"))
    out = t.select("file", "at", F.regexp_extract("v", r"gen\.(\d+)", 1).try_cast("long").alias("gen"), F.regexp_extract("v", r"\.\{([0-9,]*)\}", 1).alias("partitions"), F.regexp_extract("v", r"=\s*(?:\[[^\]]*\])?\s*(.*)$", 1).alias("newick"))
    return out.select("file", (F.row_number().over(W.partitionBy("file").orderBy("at")) - 1).cast("long").alias("ordinal"), "gen", "partitions", "newick")


def count_trees(lines: DataFrame) -> DataFrame:
    """``(file, n)``: lines with a semicolon before ``end;``, without the two of the header."""
    v = F.lower(F.trim(F.col("value"), F.lit(" \t\r")))
    return lines.filter(F.col("value").contains(";") & (v != "end;")).groupBy("file").agg((F.count(F.lit(1)) - 2).alias("n"))


def read_newick_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ordinal, newick)`` of a file with a tree a line."""
    t = tree_lines(spark, path).filter(F.trim("value") != "")
    return t.select("file", (F.row_number().over(W.partitionBy("file").orderBy("at")) - 1).cast("long").alias("ordinal"), F.trim("value").alias("newick"))


def with_names(newick: Column, names: dict[int, str]) -> Column:
    """Taxon numbers of a Newick text replaced by names, in one pass over its labels."""
    labels = F.regexp_extract_all(newick, F.lit(r"(?<=[(,])\d+"), F.lit(0))
    gaps = F.split(newick, r"(?<=[(,])\d+", -1)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in (str(kv[0]), kv[1])])
    return F.array_join(F.zip_with(gaps, labels, lambda g, l: F.concat(g, F.coalesce(F.try_element_at(table, l), F.coalesce(l, F.lit(""))))), "")


# Traces.


def read_trace_wide(spark: SparkSession, path: str) -> DataFrame:
    """A trace file as it is: a line with an id, a header, tab-separated rows. ``aaModel`` columns are text."""
    lines = [r.value for r in spark.read.text(path).limit(2).collect()]
    header = lines[1].rstrip("\t\r").split("\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("[")).filter(F.col("value") != lines[1])
    cells = F.split(F.rtrim("value"), "\t")
    cols = [F.get(cells, i) if c.startswith("aaModel") else F.get(cells, i).try_cast("double") for i, c in enumerate(header)]
    return rows.select(*[x.alias(c) for x, c in zip(cols, header, strict=True)])


def read_trace(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """``(run_id, ordinal, gen, param, value, label)``, long form; ordinals from 1 in the order of generations."""
    wide = read_trace_wide(spark, path)
    gen = f"`{wide.columns[0]}`"
    pairs = []
    for c in wide.columns[1:]:
        text = c.startswith("aaModel")
        pairs.append(F.struct(F.lit(c).alias("param"), (F.lit(None).cast("double") if text else F.col(f"`{c}`")).alias("value"), (F.col(f"`{c}`") if text else F.lit(None).cast("string")).alias("label")))
    placed = numbered(wide, [F.col(gen), F.xxhash64(*[F.col(f"`{c}`") for c in wide.columns])], "ordinal").withColumn("ordinal", F.col("ordinal") + 1)
    return placed.select(F.lit(run_id).alias("run_id"), "ordinal", F.col(gen).cast("long").alias("gen"), F.explode(F.array(*pairs)).alias("x")).select("run_id", "ordinal", "gen", "x.*")


def keep_until(rows: DataFrame, gen: int, compat: bool = False, kind: str = "trees") -> DataFrame:
    """Samples to keep on a restart: those up to the generation (``compat``: traces and diagnostics without it)."""
    return rows.filter(F.col("gen") < gen) if compat and kind != "trees" else rows.filter(F.col("gen") <= gen)


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name holds a pattern, in any case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if re.search(pattern, c, re.IGNORECASE)])
