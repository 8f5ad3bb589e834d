"""Parsimony and likelihood of site patterns on a fixed tree.

Patterns are rows ``(part_id, pattern, weight)`` and the tree travels with the closure, so patterns are scored in Arrow
batches where they lie and only sums are shuffled. A traversal plan of the tree is made once for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Tree


# Discrete gamma rates.


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: a series for small x, a continued fraction else."""
    from math import exp, lgamma, log

    if x <= 0:
        return 0.0
    lead = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * lead
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - lead * h


def _gamma_quantile(p: float, a: float) -> float:
    lo, hi = 0.0, max(1.0, a)
    while _gamma_p(a, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(a, mid) < p else (lo, mid)
        if hi - lo < 1e-14 * max(hi, 1e-300):
            break
    return (lo + hi) / 2


def gamma_rates(alpha: float, k: int = 4, median: bool = False) -> np.ndarray:
    """Mean (or rescaled median) rates of ``k`` equally likely categories of a gamma distribution of mean 1."""
    if median:
        r = np.array([_gamma_quantile((2 * i + 1) / (2 * k), alpha) / alpha for i in range(k)])
        return r * k / r.sum()
    cuts = [_gamma_quantile(i / k, alpha) for i in range(1, k)]
    share = np.array([0.0, *[_gamma_p(alpha + 1, c) for c in cuts], 1.0])
    return np.diff(share) * k


# Substitution models.


@dataclass
class Model:
    """A reversible model in spectral form: transition matrices of length t are ``left @ diag(exp(values t)) @ right``."""

    freqs: np.ndarray
    values: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rates: np.ndarray

    def transition(self, lengths: np.ndarray) -> np.ndarray:
        """Matrices for each length and rate category."""
        e = np.exp(np.multiply.outer(lengths, np.multiply.outer(self.rates, self.values)))
        return np.maximum(np.einsum("ij,bkj,jl->bkil", self.left, e, self.right), 0.0)


def reversible(exchange: np.ndarray, freqs: np.ndarray, alpha: float | None = None, k: int = 4, median: bool = False) -> Model:
    """The model of upper-triangle exchange rates and frequencies, scaled to one expected substitution.

    The generator is symmetrised by the square roots of the frequencies, so its spectrum is real.
    """
    n = len(freqs)
    q = np.zeros((n, n))
    q[np.triu_indices(n, 1)] = exchange
    q = (q + q.T) * freqs
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    q /= -(freqs * np.diag(q)).sum()
    root = np.sqrt(freqs)
    values, vectors = np.linalg.eigh((root[:, None] * q / root + (root[:, None] * q / root).T) / 2)
    return Model(np.asarray(freqs, float), values, vectors / root[:, None], vectors.T * root, np.ones(1) if alpha is None else gamma_rates(alpha, k, median))


def jukes_cantor(n: int = 4, alpha: float | None = None) -> Model:
    return reversible(np.ones(n * (n - 1) // 2), np.full(n, 1 / n), alpha)


# Scoring.


def mask_vectors(codes: np.ndarray, n: int) -> np.ndarray:
    """Tip vectors of codes that are bit masks of states."""
    return ((codes[..., None] >> np.arange(n)) & 1).astype(float)


@dataclass
class Traversal:
    """Nodes of a tree in an order in which each comes after its children, by level from the tips."""

    order: list[tuple[int, int | None]]
    level: dict[int, int]

    @classmethod
    def of(cls, tree: Tree, root: int | None = None) -> Traversal:
        root = root or next(iter(tree.adj[1]))
        order = tree.post_order(root)
        level: dict[int, int] = {}
        for a, p in order:
            level[a] = 1 + max((level[b] for b in tree.around(a, p)), default=-1)
        return cls(order, level)

    def stale(self, changed: set[int]) -> list[int]:
        """Nodes to work out again when some nodes changed: those and all above them."""
        out = set(changed)
        for a, p in self.order:
            if a in out and p is not None:
                out.add(p)
        return [a for a, _ in self.order if a in out]


def site_log_likelihoods(tree: Tree, model: Model, tips: np.ndarray) -> np.ndarray:
    """Log likelihood of each pattern; ``tips`` has shape (patterns, taxa, states). Vectors are scaled at each node,
    and the logs of the scales added up, so long trees do not underflow."""
    plan = Traversal.of(tree)
    p_count, k = tips.shape[0], len(model.rates)
    held: dict[int, np.ndarray] = {}
    scale = np.zeros(p_count)
    for a, p in plan.order:
        if tree.is_tip(a) and p is not None:
            own = np.repeat(tips[:, None, a - 1], k, 1)
        else:
            below = tree.around(a, p)
            own = np.ones((p_count, k, len(model.freqs)))
            mats = model.transition(np.array([tree.adj[a][b] for b in below]))
            for b, m in zip(below, mats, strict=True):
                own *= np.einsum("kij,pkj->pki", m, held.pop(b))
            top = own.max(axis=(1, 2))
            top = np.where(top > 0, top, 1.0)
            own /= top[:, None, None]
            scale += np.log(top)
        held[a] = own
    root = plan.order[-1][0]
    with np.errstate(divide="ignore"):
        return np.log((held[root] @ model.freqs).mean(1)) + scale


def fitch_scores(tree: Tree, masks: np.ndarray) -> np.ndarray:
    """Fitch's number of changes of each pattern; ``masks`` has shape (patterns, taxa)."""
    plan = Traversal.of(tree, next(iter(tree.adj[1])))
    cost = np.zeros(len(masks), np.int64)
    held: dict[int, np.ndarray] = {}
    for a, p in plan.order:
        if tree.is_tip(a) and p is not None:
            held[a] = masks[:, a - 1]
            continue
        own = None
        for b in tree.around(a, p):
            x = held.pop(b)
            if own is None:
                own = x
            else:
                both = own & x
                cost += both == 0
                own = np.where(both == 0, own | x, both)
        held[a] = own
    return cost


def _score(patterns: DataFrame, fn, kind: str, name: str, batch: int = 4096) -> DataFrame:
    """``part_id`` and the weighted sum of a score over patterns ``(part_id, pattern array<int>, weight)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                pdf = whole.iloc[at : at + batch]
                if len(pdf):
                    yield pd.DataFrame({"part_id": pdf["part_id"], name: fn(np.stack(pdf["pattern"].to_numpy()).astype(np.int64)) * pdf["weight"].to_numpy()})

    part = patterns.schema["part_id"].dataType.simpleString()
    return patterns.select("part_id", "pattern", "weight").mapInPandas(run, f"part_id {part}, {name} {kind}").groupBy("part_id").agg(F.sum(name).alias(name))


def log_likelihood(patterns: DataFrame, tree: Tree, models: dict, default: Model | None = None) -> DataFrame:
    """``(part_id, lnl)``; each partition has its model, or the default. All partitions of a batch share its pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for part, pdf in whole.groupby("part_id"):
                model = models.get(part, default)
                for at in range(0, len(pdf), 2048):
                    some = pdf.iloc[at : at + 2048]
                    tips = mask_vectors(np.stack(some["pattern"].to_numpy()).astype(np.int64), len(model.freqs))
                    yield pd.DataFrame({"part_id": some["part_id"], "lnl": site_log_likelihoods(tree, model, tips) * some["weight"].to_numpy()})

    part = patterns.schema["part_id"].dataType.simpleString()
    return patterns.select("part_id", "pattern", "weight").mapInPandas(run, f"part_id {part}, lnl double").groupBy("part_id").agg(F.sum("lnl").alias("lnl"))


def parsimony(patterns: DataFrame, tree: Tree) -> DataFrame:
    """``(part_id, score)``."""
    return _score(patterns, lambda m: fitch_scores(tree, m), "long", "score")


def caterpillar(n: int, length: float = 0.1) -> Tree:
    """The tree whose inner nodes form a chain, tips in order."""
    tree = Tree(n)
    inner = list(range(n + 1, 2 * n - 1))
    for a, b in zip(inner, inner[1:], strict=False):
        tree.link(a, b, length)
    for i, node in enumerate(inner):
        tree.link(node, i + 2, length)
    tree.link(inner[0], 1, length)
    tree.link(inner[-1], n, length)
    return tree


def parsimony_tree(masks: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> Tree:
    """Stepwise addition in random order, each taxon at the edge with the least score (the first of equals)."""
    n = masks.shape[1]
    order = (rng.permutation(n) + 1).tolist()
    tree = Tree(n)
    for a in order[:3]:
        tree.link(n + 1, a, 0.1)
    for k, taxon in enumerate(order[3:]):
        at = n + 2 + k
        best = None
        for e in tree.edges():
            trial = tree.copy()
            trial.cut(*e)
            for x in (*e, taxon):
                trial.link(at, x, 0.1)
            score = _partial_score(trial, masks, weights)
            if best is None or score < best[0]:
                best = (score, trial)
        tree = best[1]
    return tree


def _partial_score(tree: Tree, masks: np.ndarray, weights: np.ndarray) -> int:
    """The score over the taxa that the tree has so far."""
    root = tree.n + 1
    cost = np.zeros(len(masks), np.int64)
    held: dict[int, np.ndarray] = {}
    for a, p in tree.post_order(root):
        if tree.is_tip(a):
            held[a] = masks[:, a - 1]
            continue
        own = None
        for b in tree.around(a, p):
            x = held.pop(b)
            if own is None:
                own = x
            else:
                both = own & x
                cost += both == 0
                own = np.where(both == 0, own | x, both)
        held[a] = own
    return int((cost * weights).sum())
