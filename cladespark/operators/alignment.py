"""Alignments ``(taxon_id, site, state)`` and schemes: compression, coverage, informative sites, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Codes of characters, masks of the states that a character may be; fixed values. The bits are A, C, G, T for DNA, 0, 1 for
#: BIN and the order of AA_STATES for proteins, where B is N or D and Z is Q or E.
DNA_CODES = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12,
    "V": 7, "H": 11, "D": 13, "B": 14, "N": 15, "O": 15, "X": 15, "-": 15, "?": 15,
}
BIN_CODES = {"0": 1, "1": 2, "-": 3, "?": 3}
AA_STATES = "ARNDCQEGHILKMFPSTWYV"
_AA_BIT = {c: 1 << i for i, c in enumerate(AA_STATES)}
AA_CODES = _AA_BIT | {"B": _AA_BIT["N"] | _AA_BIT["D"], "Z": _AA_BIT["Q"] | _AA_BIT["E"]} | dict.fromkeys("X*-?", (1 << 20) - 1)
CODES = {"DNA": DNA_CODES, "BIN": BIN_CODES, "PROT": AA_CODES}


def encode(ch: Column, data_type: str) -> Column:
    """The code of a character, null if the type has none; case is ignored."""
    m = F.create_map(*[F.lit(x) for kv in CODES[data_type].items() for x in kv])
    return F.try_element_at(m, F.upper(ch))


def sites_of(schemes: DataFrame) -> DataFrame:
    """``(name, data_type, site)`` from ranges ``(name, data_type, lo, hi, stride)``: exploded, so that sites meet by
    an equi-join rather than a range join."""
    return schemes.select("name", "data_type", F.explode(F.expr("sequence(lo, hi, stride)")).alias("site"))


def scheme_faults(sites: DataFrame, length: int) -> DataFrame:
    """``(site, n)`` of the sites from 1 to ``length`` that are in no partition or in several, and of those outside."""
    n = sites.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    whole = sites.sparkSession.range(1, length + 1).select(F.col("id").cast("int").alias("site"))
    return whole.join(n, "site", "full").select("site", F.coalesce("n", F.lit(0)).cast("long").alias("n")).filter((F.col("n") != 1) | ~F.col("site").between(1, length))


def patterns(aln: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, pattern, weight, sites``: equal columns of a partition as one row. ``pattern`` is the array of states by
    taxon; columns are built by one aggregation on the site, and collapsed by one on the pattern."""
    keys = keys or []
    columns = aln.groupBy(*keys, "site").agg(F.transform(F.sort_array(F.collect_list(F.struct("taxon_id", "state"))), lambda x: x["state"]).alias("pattern"))
    return columns.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("weight"))


def contributions(weights: DataFrame, key: str) -> DataFrame:
    """``key, contribution``: a partition's part of all site weights."""
    s = weights.groupBy(key).agg(F.sum("weight").alias("w"))
    return s.select(key, (F.col("w") / F.sum("w").over(W.partitionBy(F.lit(0)))).alias("contribution"))


def informative(aln: DataFrame, single: list[int], strict: bool = False) -> DataFrame:
    """``(site, informative)``: whether at least two unambiguous states occur and one of them more than once; with
    ``strict`` two of them must, as the textbook has it."""
    n = aln.filter(F.col("state").isin(single)).groupBy("site", "state").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("site").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("twice"))
    rule = F.col("twice") >= 2 if strict else (F.col("k") > 1) & (F.col("most") > 1)
    return aln.select("site").distinct().join(per.select("site", rule.alias("informative")), "site", "left").select("site", F.coalesce("informative", F.lit(False)).alias("informative"))


def state_counts(aln: DataFrame) -> DataFrame:
    return aln.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def frequencies(counted: DataFrame, n_states: int, rounds: int = 8) -> DataFrame:
    """``(bit, frequency)`` after ``rounds`` passes that share ambiguity masks out by the frequencies so far.

    ``counted`` has a row per mask, at most 2^n_states, so the rounds are an array expression over one small list.
    """
    masks = counted.agg(F.collect_list(F.struct("state", F.col("n").cast("double").alias("n"))).alias("m"))
    bits = F.sequence(F.lit(0), F.lit(n_states - 1))
    has = lambda x, b: F.call_function("shiftright", x["state"].cast("long"), b.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    def one(f: Column) -> Column:
        whole = lambda x: F.aggregate(bits, F.lit(0.0), lambda s, b: s + F.when(has(x, b), F.get(f, b)).otherwise(0.0))
        raw = F.transform(bits, lambda b: F.aggregate("m", F.lit(0.0), lambda s, x: s + F.when(has(x, b), x["n"] * F.get(f, b) / whole(x)).otherwise(0.0)))
        return F.get(F.transform(F.array(raw), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda s, y: s + y))), F.lit(0))

    start = F.array_repeat(F.lit(1.0 / n_states), n_states)
    df = masks.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda f, _: one(f)))
    return df.select(F.posexplode("f").alias("bit", "frequency"))
