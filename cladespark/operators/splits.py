"""Analytics over split observations ``(file_id, tree_id, split_id, length)``: frequencies, deviation, credible sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from .ranking import numbered


# Burn-in. Trees are rows (file_id, tree_id, ordinal) with ordinals from 0.


def _sizes(trees: DataFrame) -> DataFrame:
    return trees.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def _after(trees: DataFrame, cuts: DataFrame, compat: bool) -> DataFrame:
    """Trees from the cut on. With ``compat`` two header marks count as skipped trees, so the window slides back by two
    (by one for a cut of one) and as many trees at the end are lost."""
    t = trees.join(cuts, "file_id")
    if compat:
        back = F.least(F.col("cut"), F.lit(2))
        return t.filter((F.col("ordinal") >= F.col("cut") - back) & (F.col("ordinal") < F.col("n") - back)).drop("cut", "n")
    return t.filter(F.col("ordinal") >= F.col("cut")).drop("cut", "n")


def burnin_smallest(trees: DataFrame, share: float, compat: bool = False) -> DataFrame:
    """One cut for all files: the share of the smallest file's number of trees."""
    n = _sizes(trees)
    least = n.agg(F.floor(F.min("n") * F.lit(share)).alias("cut"))
    return _after(trees, n.join(F.broadcast(least), F.col("n") >= F.col("cut")), compat)


def burnin_first(trees: DataFrame, share: float, compat: bool = False) -> DataFrame:
    """One cut for all files: the share of the first file's number of trees."""
    n = _sizes(trees)
    first = n.agg(F.floor(F.min_by("n", "file_id") * F.lit(share)).alias("cut"))
    return _after(trees, n.join(F.broadcast(first), F.col("cut") >= 0), compat)


def burnin_each(trees: DataFrame, share: float | None = None, constant: int | None = None, compat: bool = False) -> DataFrame:
    """A cut for each file: the share of its trees, or a constant number. Giving both, or a constant that some file
    does not have, is an error."""
    if (share is None) == (constant is None):
        raise ValueError("give either a relative or a constant burn-in")
    n = _sizes(trees)
    if constant is not None:
        if (short := n.agg(F.min("n")).first()[0]) is not None and short < constant:
            raise ValueError(f"a file has only {short} trees, fewer than the burn-in of {constant}")
        return _after(trees, n.withColumn("cut", F.lit(constant)), compat)
    return _after(trees, n.withColumn("cut", F.floor(F.col("n") * F.lit(share))), compat)


def online_window(n: int, gens: int | None, every: int, share: float, compat: bool = False) -> tuple[int, int] | None:
    """First and end ordinal that the running monitor looks at, or None while there are too few trees (under 4 in all,
    or under 2 after a burn-in in generations)."""
    if n < 4:
        return None
    cut = gens // every if gens else int(n * share)
    if gens and n - cut < 2:
        return None
    return (max(0, cut - 2), n - 1) if compat and cut >= 2 else (cut, n)


# Frequencies.


def counts(obs: DataFrame) -> DataFrame:
    """``(file_id, split_id, n)``: in how many of a file's trees a split is."""
    return obs.groupBy("file_id", "split_id").agg(F.count_distinct("tree_id").alias("n"))


def file_sizes(obs: DataFrame) -> DataFrame:
    """``(file_id, trees)``: a row per input file."""
    return obs.groupBy("file_id").agg(F.count_distinct("tree_id").alias("trees"))


def frequencies(obs: DataFrame) -> DataFrame:
    """``(split_id, freqs, files)``: relative frequencies in the files that have the split, and how many files there are.

    Files without the split are not made into rows; the statistics below pad with zeros instead of joining every
    split with every file.
    """
    sizes = file_sizes(obs)
    k = sizes.agg(F.count(F.lit(1)).cast("int").alias("files"))
    per = counts(obs).join(sizes, "file_id").select("split_id", (F.col("n") / F.col("trees")).alias("f"))
    return per.groupBy("split_id").agg(F.sort_array(F.collect_list("f")).alias("freqs")).join(F.broadcast(k), F.col("files") > 0)


def _padded(freqs: str = "freqs", files: str = "files") -> Column:
    return F.concat(F.col(freqs), F.array_repeat(F.lit(0.0), F.col(files) - F.size(freqs)))


def deviations(obs: DataFrame, ignore: float = 0.1) -> DataFrame:
    """``(split_id, largest, sd)`` of the splits whose frequency is over ``ignore`` in some file."""
    f = frequencies(obs).withColumn("all", _padded()).withColumn("m", F.aggregate("all", F.lit(0.0), lambda s, x: s + x) / F.col("files"))
    squares = F.aggregate("all", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m")))
    sd = F.when(F.col("files") == 1, F.lit(0.0)).otherwise(F.sqrt(squares / (F.col("files") - 1)))
    return f.select("split_id", F.array_max("freqs").alias("largest"), sd.alias("sd")).filter(F.col("largest") > ignore)


def asdsf(obs: DataFrame, ignore: float = 0.1) -> DataFrame:
    """``(asdsf, msdsf)``: mean and largest standard deviation of split frequencies; nulls if no split is relevant."""
    return deviations(obs, ignore).agg(F.avg("sd").alias("asdsf"), F.max("sd").alias("msdsf"))


def occurrences(obs: DataFrame) -> DataFrame:
    """``(split_id, occ, total)``: in how many trees of all files a split is, and how many trees there are."""
    trees = obs.select("file_id", "tree_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    return obs.groupBy("split_id").agg(F.count_distinct("file_id", "tree_id").alias("occ")).join(F.broadcast(trees), F.col("occ") <= F.col("total"))


def majority(obs: DataFrame, threshold: float, compat: bool = False) -> DataFrame:
    """``(split_id, occ, total)`` of the splits in over ``threshold`` of the trees; with ``compat`` a split at the
    threshold itself counts, so two conflicting splits at a half can both enter."""
    o = occurrences(obs)
    return o.filter(F.col("occ") >= F.ceil(F.col("total") * F.lit(threshold))) if compat else o.filter(F.col("occ") > F.col("total") * F.lit(threshold))


def split_ids(obs: DataFrame) -> DataFrame:
    """``(split_id, rank)``: dense ids of distinct splits in their own order, from 0."""
    return numbered(obs.select("split_id").distinct(), [F.col("split_id")], "rank").withColumn("rank", F.col("rank").cast("int"))


def presence(obs: DataFrame) -> DataFrame:
    """``(split_id, file_id, n)`` for every split and every file, 0 where a file lacks it: a pivot over files."""
    sizes = [r.file_id for r in file_sizes(obs).orderBy("file_id").collect()]
    wide = obs.groupBy("split_id").agg(*[F.count_distinct(F.when(F.col("file_id") == f, F.col("tree_id"))).alias(f"f{f}") for f in sizes])
    return wide.select("split_id", F.explode(F.array(*[F.struct(F.lit(f).alias("file_id"), F.col(f"f{f}").alias("n")) for f in sizes])).alias("x")).select("split_id", "x.*")


def lengths(obs: DataFrame) -> DataFrame:
    """``(split_id, file_id, lengths)``: every split and file with its branch lengths, an empty list where there are none."""
    have = obs.groupBy("split_id", "file_id").agg(F.sort_array(F.collect_list("length")).alias("lengths"))
    return presence(obs).select("split_id", "file_id").join(have, ["split_id", "file_id"], "left").withColumn("lengths", F.coalesce("lengths", F.expr("cast(array() as array<double>)")))


def statistics(obs: DataFrame, compat: bool = False) -> DataFrame:
    """One row per split: number of trees, and mean, sd, percentiles and scale reduction of its lengths over files.

    A split in one file only has no scale reduction (null), as do splits without variance.
    """
    p = lambda q: stats.percentile("length", q, compat)
    rows = obs.groupBy("split_id").agg(F.count_distinct("file_id", "tree_id").alias("count"), stats.mean("length").alias("mean"), stats.sd("length").alias("sd"), p(0.05).alias("perc5"), p(0.25).alias("perc25"), p(0.5).alias("median"), p(0.75).alias("perc75"), p(0.95).alias("perc95"), F.count_distinct("file_id").alias("files"))
    scale = stats.psrf(obs, ["split_id"], "file_id", "length")
    return rows.join(scale, "split_id").withColumn("psrf", F.when(F.col("files") > 1, F.col("psrf")))


def compatible(a: Column, b: Column) -> Column:
    """Whether two splits given as sorted arrays of the taxa away from taxon 1 can stand in one tree."""
    both = F.size(F.array_intersect(a, b))
    return (both == 0) | (both == F.size(a)) | (both == F.size(b))


def words(taxa: Column, n_words: int) -> Column:
    """A split as an array of 63-bit words; taxon t (from 1) is bit (t-1) mod 63 of word (t-1) div 63."""
    one = F.lit(1).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda w: F.aggregate(F.filter(taxa, lambda t: F.floor((t - 1) / 63) == w), F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(F.call_function("shiftleft", one, ((t - 1) % 63).cast("int")))))


def smaller_side(taxa: Column, n: int) -> Column:
    """The side with fewer taxa; of equal ones the side away from taxon 1."""
    every = F.sequence(F.lit(1), F.lit(n))
    return F.when(F.size(taxa) * 2 > n, F.array_except(every, taxa)).otherwise(taxa)


# Topologies.


def topology_counts(topologies: DataFrame) -> DataFrame:
    """``(topology, n, total)``."""
    n = topologies.groupBy("topology").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total"))), F.col("n") <= F.col("total"))


def running(counted: DataFrame) -> DataFrame:
    """``counted`` with ``before``: the sum over all topologies that are more frequent, or as frequent and before it by name.

    Sums are taken over cells of equal count and equal first letters, then within a cell. Cells sort like their
    topologies, so no task has to sort all of them, not even the many that were seen once.
    """
    part = F.substring("topology", 1, 12)
    cells = counted.withColumn("part", part).groupBy("n", "part").agg(F.count(F.lit(1)).alias("k"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("n"), "part")
    offsets = cells.withColumn("off", F.sum(F.col("n") * F.col("k")).over(order) - F.col("n") * F.col("k")).select("n", "part", "off")
    within = W.partitionBy("n", "part").orderBy("topology")
    return counted.withColumn("part", part).join(offsets, ["n", "part"]).withColumn("before", F.col("off") + (F.row_number().over(within) - 1) * F.col("n")).drop("part", "off")


def topology_places(topologies: DataFrame) -> DataFrame:
    """``(topology, place)``: all topologies from 1, the most frequent first, ties by name."""
    return numbered(topology_counts(topologies), [F.desc("n"), F.col("topology")]).select("topology", (F.col("place") + 1).alias("place"))


def occurrence_places(obs: DataFrame) -> DataFrame:
    """``(split_id, up, down)``: places from 1 of all splits by rising and by falling occurrence, ties by split."""
    o = occurrences(obs).select("split_id", "occ")
    up = numbered(o, [F.col("occ"), F.col("split_id")], "up").select("split_id", (F.col("up") + 1).alias("up"))
    return up.join(numbered(o, [F.desc("occ"), F.col("split_id")], "down").select("split_id", (F.col("down") + 1).alias("down")), "split_id")


def credible_set(topologies: DataFrame, share: float) -> DataFrame:
    """``(topology, n, freq)`` of the most frequent topologies, up to and with the one whose running sum first exceeds
    floor(total * share); ties are taken by name."""
    ranked = running(topology_counts(topologies))
    return ranked.filter(F.col("before") <= F.floor(F.col("total") * F.lit(share))).select("topology", "n", (F.col("n") / F.col("total")).alias("freq"))


def credible_size(topologies: DataFrame, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """``(share, topologies)``: how many topologies it takes to reach each share of all trees.

    Only counts of counts are sorted.
    """
    t = topology_counts(topologies)
    cells = t.groupBy("n", "total").agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("n"))
    c = cells.withColumns({"trees": F.sum(F.col("n") * F.col("k")).over(w) - F.col("n") * F.col("k"), "rows": F.sum("k").over(w) - F.col("k")})
    c = c.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    need = F.col("total") * F.col("share")
    # Within a count each topology adds the same, so the place where the sum reaches the need is a division.
    inside = F.ceil((need - F.col("trees")) / F.col("n"))
    c = c.filter((F.col("trees") < need) & (F.col("trees") + F.col("n") * F.col("k") >= need - 1e-9))
    return c.select("share", (F.col("rows") + inside).cast("long").alias("topologies"))


def rf_distances(splits: DataFrame, tree: str = "tree_id") -> DataFrame:
    """``(a, b, rf)``: the Robinson-Foulds distance of trees that share a split; other pairs have the sum of their sizes.

    Meant for the distinct topologies of a sample, of which a plot can show a few thousand.
    """
    s = splits.select(F.col(tree).alias("t"), "split_id").distinct()
    size = s.groupBy("t").agg(F.count(F.lit(1)).alias("k"))
    pairs = s.alias("x").join(s.alias("y"), (F.col("x.split_id") == F.col("y.split_id")) & (F.col("x.t") < F.col("y.t"))).groupBy(F.col("x.t").alias("a"), F.col("y.t").alias("b")).agg(F.count(F.lit(1)).alias("common"))
    return pairs.join(size.select(F.col("t").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("t").alias("b"), F.col("k").alias("kb")), "b").select("a", "b", (F.col("ka") + F.col("kb") - 2 * F.col("common")).alias("rf"))
