"""Consensus trees from split tables. What reaches the driver is at most the 2n-3 splits of one tree, or the candidates
of a greedy choice, which depends on their order."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats

TYPES = {"MR": 0.5, "STRICT": 1.0}


def threshold_of(kind: str) -> tuple[float, bool]:
    """Threshold and greediness of a consensus type: MR, MRE, STRICT, or a percentage from 50 to 100."""
    k = kind.upper()
    if k == "MRE":
        return 0.5, True
    if k in TYPES:
        return TYPES[k], False
    value = int(k)
    if not 50 <= value <= 100:
        raise ValueError("a consensus threshold is a percentage from 50 to 100")
    return value / 100, False


def type_name(threshold: float, greedy: bool) -> str:
    if greedy:
        return "ConsensusExtendedMajorityRule"
    return {0.5: "ConsensusMajorityRule", 1.0: "ConsensusStrict"}.get(threshold, f"ConsensusThreshold-{round(threshold * 100)}")


def split_support(obs: DataFrame, split: str = "split") -> DataFrame:
    """``(split, occ, total, lengths)`` over all files; ``obs`` holds trivial splits as well."""
    total = obs.select("file_id", "tree_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    return obs.groupBy(split).agg(F.count(F.lit(1)).alias("occ"), stats.mean("length").alias("mean"), stats.percentile("length", 0.5).alias("median"), stats.percentile("length", 0.05).alias("p5"), stats.percentile("length", 0.95).alias("p95")).join(F.broadcast(total), F.col("occ") <= F.col("total"))


def fits(a: frozenset[int], b: frozenset[int]) -> bool:
    """Splits by their sides without taxon 1 agree if one holds the other or they share nothing."""
    both = len(a & b)
    return both in (0, len(a), len(b))


def greedy(candidates: Iterable[tuple[frozenset[int], int]], accepted: Iterable[frozenset[int]], n: int, compat: bool = False) -> list[frozenset[int]]:
    """Accepted splits and then every candidate that agrees with all so far, the most frequent first (``compat``: the
    rarest first), ties by members, until there are 2n-3."""
    chosen = list(accepted)
    for side, _ in sorted(candidates, key=lambda c: (c[1] if compat else -c[1], sorted(c[0]))):
        if len(chosen) >= 2 * n - 3:
            break
        if all(fits(side, other) for other in chosen):
            chosen.append(side)
    return chosen


def choose(support: DataFrame, n: int, threshold: float, extend: bool = False, compat: bool = False) -> list[frozenset[int]]:
    """Splits over the threshold (``compat``: at it), extended greedily if asked for.

    Greedy choice depends on order, so it runs in one task over the candidates, which a grouped map receives already
    reduced to sides and counts.
    """
    enough = F.col("occ") >= F.ceil(F.col("total") * F.lit(threshold)) if compat or threshold == 1 else F.col("occ") > F.col("total") * F.lit(threshold)
    major = [frozenset(r.split) for r in support.filter(enough).select("split").collect()]
    if not extend:
        return sorted(major, key=lambda s: (len(s), sorted(s)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy([(frozenset(map(int, s)), int(o)) for s, o in zip(pdf["split"], pdf["occ"], strict=True)], major, n, compat)
        return pd.DataFrame({"split": [sorted(s) for s in got]})

    rest = support.filter(~enough).select("split", "occ")
    found = [frozenset(r.split) for r in rest.groupBy(F.lit(0).alias("g")).applyInPandas(run, "split array<int>").collect()]
    return sorted(set(found) | set(major), key=lambda s: (len(s), sorted(s)))


def children(sides: list[frozenset[int]], n: int) -> dict[frozenset[int], list[frozenset[int]]]:
    """Each side's direct members: a side goes to the smallest that holds it, the rest under all taxa."""
    every = frozenset(range(1, n + 1))
    ordered = sorted({*sides, *(frozenset([t]) for t in range(1, n + 1))} - {every}, key=lambda s: (len(s), sorted(s)))
    out: dict[frozenset[int], list[frozenset[int]]] = {every: []}
    for i, side in enumerate(ordered):
        holder = next((x for x in ordered[i + 1 :] if side < x), every)
        out.setdefault(holder, []).append(side)
        out.setdefault(side, [])
    return out


def build(sides: list[frozenset[int]], n: int, info: dict[frozenset[int], dict] | None = None, names: dict[int, str] | None = None, annotated: bool = False) -> str:
    """Newick text of a set of agreeing splits, with support and median length where ``info`` has them.

    ``annotated`` writes bracketed probabilities and length summaries, otherwise plain support numbers.
    """
    below = children(sides, n)
    every = frozenset(range(1, n + 1))

    def tail(side: frozenset[int]) -> str:
        x = (info or {}).get(side)
        if not x:
            return ""
        p = x["occ"] / x["total"]
        if annotated:
            return f'[&prob={p:.10e},prob(percent)="{p * 100:.0f}"]:{x["median"]:.10e}[&length_mean={x["mean"]:.10e},length_median={x["median"]:.10e},length_95%HDP={{{x["p5"]:.10e},{x["p95"]:.10e}}}]'
        return (f"{p:.2f}" if len(side) > 1 else "") + f":{x['median']:.10e}"

    text: dict[frozenset[int], str] = {}
    for side in sorted(below, key=len):
        inside = sorted(below[side], key=lambda s: (min(s) == 1, min(s)))
        own = "(" + ",".join(text[s] for s in inside) + ")" if inside else (names or {}).get(min(side), str(min(side)))
        text[side] = own + ("" if side == every else tail(side))
    return text[every] + ";"


def consensus(obs: DataFrame, n: int, kind: str = "MR", names: dict[int, str] | None = None, annotated: bool = False, compat: bool = False) -> str:
    """The consensus tree of split observations (with trivial splits) as Newick text."""
    threshold, extend = threshold_of(kind)
    support = split_support(obs)
    sides = choose(support, n, threshold, extend, compat)
    keys = [sorted(s) for s in {*sides, *(frozenset([t]) for t in range(1, n + 1))}]
    listed = obs.sparkSession.createDataFrame([(k,) for k in keys], "split array<int>")
    rows = support.join(F.broadcast(listed), "split", "left_semi").collect()  # at most 2n-3
    info = {frozenset(r.split): r.asDict() for r in rows}
    if len(sides) > 2 * n - 3:
        raise ValueError("conflicting splits reach the threshold")
    return build(sides, n, info, names, annotated)


def nexus_document(newick: str, names: dict[int, str], title: str) -> str:
    """A tree with its taxa and translate blocks."""
    taxa = "\n".join(f"\t\t{x}" for _, x in sorted(names.items()))
    table = ",\n".join(f"\t\t{k}\t{x}" for k, x in sorted(names.items()))
    return f"#NEXUS\n\nbegin taxa;\n\tdimensions ntax={len(names)};\n\ttaxlabels\n{taxa}\n\t;\nend;\n\nbegin trees;\n\ttranslate\n{table}\n\t;\n\ttree {title} = [&U] {newick}\nend;\n"
