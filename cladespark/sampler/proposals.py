"""Proposals: each changes a copy of a state and gives the log Hastings ratio."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from math import ceil, exp, floor, log, sqrt

import numpy as np

from ..functions import density
from ..functions.scalar import ALPHA_MAX, ALPHA_MIN, FREQ_MIN, RATE_MIN, clamp_simplex
from ..operators import likelihood as L
from ..operators.trees import Tree, draw_edge, draw_subtree, edge

LENGTH_MIN, LENGTH_MAX = 1e-6, 30.0


@dataclass
class State:
    """What a chain is at: a tree, and the parameters of one partition's model."""

    tree: Tree
    alpha: float = 1.0
    freqs: np.ndarray = field(default_factory=lambda: np.full(4, 0.25))
    rates: np.ndarray = field(default_factory=lambda: np.full(6, 1 / 6))
    matrix: str = ""
    ages: dict[int, float] = field(default_factory=dict)
    clock: np.ndarray = field(default_factory=lambda: np.ones(0))

    def copy(self) -> State:
        return replace(self, tree=self.tree.copy(), freqs=self.freqs.copy(), rates=self.rates.copy(), ages=dict(self.ages), clock=self.clock.copy())


@dataclass
class Data:
    """The compressed alignment, priors and fixed matrices that every chain shares; no data means prior sampling."""

    masks: np.ndarray | None
    weights: np.ndarray | None
    states: int = 4
    priors: dict[str, object] = field(default_factory=dict)
    matrices: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    gamma: bool = True

    def model(self, s: State) -> L.Model:
        rates, freqs = self.matrices[s.matrix] if s.matrix in self.matrices else (s.rates, s.freqs)
        return L.reversible(rates, freqs, s.alpha if self.gamma else None)

    def ln_likelihood(self, s: State) -> float:
        if self.masks is None:
            return 0.0
        return float(L.site_log_likelihoods(s.tree, self.model(s), L.mask_vectors(self.masks, self.states)) @ self.weights)

    def ln_prior(self, s: State) -> float:
        p = self.priors
        total = sum(map(p["brlens"].ln, (s.tree.length(e) for e in s.tree.edges()))) if "brlens" in p else 0.0
        total += p["ratehet"].ln(s.alpha) if "ratehet" in p else 0.0
        total += p["statefreq"].ln(s.freqs) if "statefreq" in p else 0.0
        total += p["revmat"].ln(s.rates) if "revmat" in p else 0.0
        total += p["aamodel"].ln(s.matrix) if "aamodel" in p else 0.0
        return total


Proposal = Callable[[State, Data, np.random.Generator, float, object], float]
REGISTRY: dict[str, tuple[Proposal, float]] = {}


def proposal(name: str, knob: float):
    """Register a proposal with the first value of the knob that tuning turns."""

    def put(f: Proposal) -> Proposal:
        REGISTRY[name] = (f, knob)
        return f

    return put


# Topology. Moves carry lengths along; those that split an edge at a drawn share count the change of scale.


@proposal("stNNI", 0.0)
def st_nni(s, data, rng, knob, config) -> float:
    e = draw_edge(s.tree, rng, inner=True)
    s.tree.nni(e, int(rng.integers(2)))
    return 0.0


def _regraft(tree: Tree, moved: int, at: int, onto: tuple[int, int]) -> float:
    """Regraft at half an edge; the way back halves the joined edge, so lengths of both count."""
    a, b = tree.around(at, moved)
    joined = tree.adj[at][a] + tree.adj[at][b]
    x, y = tree.adj[at][a], tree.adj[at][b]
    split = tree.length(onto)
    tree.prune(moved, at)
    share = x / joined if joined else 0.5
    tree.graft(at, onto, share)
    del y
    return log(split / joined) if joined > 0 and split > 0 else 0.0


def _walk(tree: Tree, moved: int, at: int, stop: float, rng) -> tuple[tuple[int, int] | None, float]:
    """A random walk away from where a subtree hangs, that stops with probability ``stop`` at each edge or must at a
    tip. The edge it ends on, and the log of the ratio of the chances of the way back and the way there."""
    sides = tree.around(at, moved)
    x, before = sides[int(rng.integers(2))], at
    if tree.is_tip(x):
        return None, 0.0
    start = x
    while True:
        nexts = tree.around(x, before)
        before, x = x, nexts[int(rng.integers(2))]
        if tree.is_tip(x) or rng.random() < stop:
            break
    other = sides[0] if sides[1] == start else sides[1]
    there = 0.0 if tree.is_tip(x) else log(stop)
    back = 0.0 if tree.is_tip(other) else log(stop)  # the way back ends on the edge to the other side
    return edge(before, x), back - there


@proposal("eSPR", 0.0)
def e_spr(s, data, rng, knob, config) -> float:
    moved, at = draw_subtree(s.tree, rng)
    onto, h = _walk(s.tree, moved, at, getattr(config, "esprStopProb", 0.5), rng)
    return h + _regraft(s.tree, moved, at, onto) if onto else 0.0


@proposal("eTBR", 0.0)
def e_tbr(s, data, rng, knob, config) -> float:
    a, b = draw_edge(s.tree, rng, inner=True)
    total = 0.0
    for at, moved in ((a, b), (b, a)):
        onto, h = _walk(s.tree, moved, at, getattr(config, "etbrStopProb", 0.5), rng)
        if onto:
            total += h + _regraft(s.tree, moved, at, onto)
    return total


def _targets(tree: Tree, moved: int, at: int, radius: int, score) -> tuple[list, np.ndarray]:
    """Regraft edges within a radius and their log weights by ``score`` of the resulting tree."""
    onto = tree.spr_targets(moved, at, radius)
    values = []
    for e in onto:
        t = tree.copy()
        _regraft(t, moved, at, e)
        values.append(score(t))
    return onto, np.array(values)


def _guided(s: State, rng, radius: int, weight) -> float:
    """Regraft to an edge drawn by weight; the way back is drawn from the weights as seen from there."""
    moved, at = draw_subtree(s.tree, rng)
    back = edge(*s.tree.around(at, moved))
    onto, w = _targets(s.tree, moved, at, radius, weight)
    if not onto:
        return 0.0
    p = np.exp(w - w.max())
    p /= p.sum()
    k = int(rng.choice(len(onto), p=p))
    scale = _regraft(s.tree, moved, at, onto[k])
    onto2, w2 = _targets(s.tree, moved, at, radius, weight)
    if back not in onto2:
        return float("-inf")
    q = np.exp(w2 - w2.max())
    return scale + log(max(q[onto2.index(back)] / q.sum(), 1e-300)) - log(max(p[k], 1e-300))


@proposal("parsimonySPR", 0.0)
def parsimony_spr(s, data, rng, knob, config) -> float:
    """Weights fall with Fitch's score, warped; within floor(2 ln n) steps unless configured."""
    if data.masks is None:
        return e_spr(s, data, rng, knob, config)
    given = getattr(config, "parsSPRRadius", -1)
    warp = getattr(config, "parsimonyWarp", 0.1)
    return _guided(s, rng, given if given > 0 else max(1, floor(2 * log(s.tree.n))), lambda t: -warp * float(L.fitch_scores(t, data.masks) @ data.weights))


@proposal("likeSPR", 0.0)
def like_spr(s, data, rng, knob, config) -> float:
    """Weights are warped likelihoods; within ceil(log2 n) steps unless configured."""
    given = getattr(config, "likeSprMaxRadius", -1)
    warp = getattr(config, "likeSprWarp", 1.0)
    return _guided(s, rng, given if given > 0 else ceil(log(s.tree.n, 2)), lambda t: warp * data.ln_likelihood(replace(s, tree=t)))


# Branch lengths.


def _fits(x: float) -> bool:
    return LENGTH_MIN <= x <= LENGTH_MAX


@proposal("branchMulti", 1.386294)
def branch_multi(s, data, rng, knob, config) -> float:
    e = draw_edge(s.tree, rng)
    m = density.draw_multiplier(rng, knob)
    new = s.tree.length(e) * m
    s.tree.set_length(e, new)
    return log(m) if _fits(new) else float("-inf")


@proposal("treeLengthMult", 1.386294)
def tree_length_mult(s, data, rng, knob, config) -> float:
    m = density.draw_multiplier(rng, knob)
    es = s.tree.edges()
    for e in es:
        s.tree.set_length(e, s.tree.length(e) * m)
    return len(es) * log(m) if all(_fits(s.tree.length(e)) for e in es) else float("-inf")


@proposal("nodeSlider", 0.191)
def node_slider(s, data, rng, knob, config) -> float:
    """Rescale two neighbouring branches together and split them anew."""
    a, b = draw_edge(s.tree, rng, inner=True)
    c = s.tree.around(a, b)[int(rng.integers(2))]
    old = s.tree.adj[a][b] + s.tree.adj[a][c]
    m = density.draw_multiplier(rng, knob)
    u = rng.random()
    s.tree.set_length(edge(a, b), old * m * u)
    s.tree.set_length(edge(a, c), old * m * (1 - u))
    return 2 * log(m) if _fits(old * m * u) and _fits(old * m * (1 - u)) else float("-inf")


def _side(tree: Tree, model: L.Model, tips: np.ndarray, a: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled conditional likelihoods at ``a`` of what lies beyond it."""
    k = len(model.rates)
    held, scale = {}, np.zeros(len(tips))
    for x, p in tree.post_order(a, above):
        below = tree.around(x, p)
        own = np.repeat(tips[:, None, x - 1], k, 1) if tree.is_tip(x) else np.ones((len(tips), k, len(model.freqs)))
        if not tree.is_tip(x):
            for y, m in zip(below, model.transition(np.array([tree.adj[x][y] for y in below])), strict=True):
                own = own * np.einsum("kij,pkj->pki", m, held.pop(y))
            top = own.max(axis=(1, 2))
            own /= top[:, None, None]
            scale += np.log(top)
        held[x] = own
    return held[a], scale


def branch_profile(s: State, data: Data, e: tuple[int, int]) -> Callable[[float], float]:
    """Log likelihood as a function of one branch's length, everything else fixed."""
    model = data.model(s)
    tips = L.mask_vectors(data.masks, data.states)
    (left, sl), (right, sr) = _side(s.tree, model, tips, e[0], e[1]), _side(s.tree, model, tips, e[1], e[0])
    front = left * model.freqs

    def at(t: float) -> float:
        m = model.transition(np.array([t]))[0]
        return float((np.log(np.maximum((front * np.einsum("kij,pkj->pki", m, right)).sum(2).mean(1), 1e-300)) + sl + sr) @ data.weights)

    return at


def branch_optimum(f: Callable[[float], float]) -> tuple[float, float]:
    """The best length, by golden sections on its log, and the curvature of the log likelihood there."""
    lo, hi = log(LENGTH_MIN), log(LENGTH_MAX)
    g = (sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(exp(a)), f(exp(b))
    for _ in range(40):
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(exp(a))
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(exp(b))
        if hi - lo < 1e-4:
            break
    t = exp((lo + hi) / 2)
    h = max(t * 1e-2, 1e-6)
    second = (f(t + h) - 2 * f(t) + f(max(t - h, 1e-9))) / h**2
    return t, second


def _fitted(s, data, rng, draw, ln) -> float:
    e = draw_edge(s.tree, rng)
    old = s.tree.length(e)
    t, second = branch_optimum(branch_profile(s, data, e))
    if second >= 0 or t <= 2 * LENGTH_MIN:  # no inner optimum: an exponential about the data's scale
        fit = (1.0, 1 / max(t, 0.01))
    else:
        variance = -1 / second
        # The gamma with the optimum as its mode and that curvature: (k-1)/rate = t and (k-1)/rate^2 = variance.
        rate = t / variance
        fit = (1 + t * rate, rate)
    new = draw(rng, fit)
    if not _fits(new):
        return float("-inf")
    s.tree.set_length(e, new)
    return ln(old, fit) - ln(new, fit)


@proposal("blDistGamma", 0.0)
def bl_dist_gamma(s, data, rng, knob, config) -> float:
    if data.masks is None:
        return branch_multi(s, data, rng, REGISTRY["branchMulti"][1], config)
    return _fitted(s, data, rng, lambda r, f: float(r.gamma(f[0], 1 / f[1])), lambda x, f: density.ln_gamma_of(x, *f))


def _weibull_of(fit: tuple[float, float]) -> tuple[float, float]:
    """Scale and shape of the Weibull with the mean and variance of a gamma, by bisection on the shape."""
    from math import gamma

    mean, cv2 = fit[0] / fit[1], 1 / fit[0]
    shape = density.bisect(lambda k: gamma(1 + 2 / k) / gamma(1 + 1 / k) ** 2 - 1 - cv2, 0.2, 100.0)
    return mean / gamma(1 + 1 / shape), shape


@proposal("blDistWeibull", 0.0)
def bl_dist_weibull(s, data, rng, knob, config) -> float:
    if data.masks is None:
        return branch_multi(s, data, rng, REGISTRY["branchMulti"][1], config)
    return _fitted(s, data, rng, lambda r, f: float(_weibull_of(f)[0] * r.weibull(_weibull_of(f)[1])), lambda x, f: density.ln_weibull_of(x, *_weibull_of(f)))


# Model parameters.


def _slide_two(v: np.ndarray, width: float, floor_: float, rng) -> np.ndarray:
    """Slide the share of two entries of a simplex, reflected at 0 and 1."""
    i, j = rng.choice(len(v), 2, replace=False)
    both = v[i] + v[j]
    p = density.draw_window(rng, v[i] / both, width, 0.0, 1.0)
    out = v.copy()
    out[i], out[j] = both * p, both * (1 - p)
    return out if out.min() >= floor_ else v * np.nan


def _dirichlet(v: np.ndarray, alpha: float, rng) -> tuple[np.ndarray, float]:
    new = clamp_simplex(density.draw_dirichlet(rng, v * len(v) * alpha), 1e-9)
    return new, density.ln_dirichlet_of(v, new * len(v) * alpha) - density.ln_dirichlet_of(new, v * len(v) * alpha)


@proposal("revMatSlider", 0.15)
def rev_mat_slider(s, data, rng, knob, config) -> float:
    new = _slide_two(s.rates, knob, RATE_MIN, rng)
    if np.isnan(new).any():
        return float("-inf")
    s.rates = new
    return 0.0


@proposal("revMatDirichlet", 100.0)
def rev_mat_dirichlet(s, data, rng, knob, config) -> float:
    s.rates, h = _dirichlet(s.rates, knob, rng)
    return h


@proposal("revMatRateDirich", 50.0)
def rev_mat_rate_dirich(s, data, rng, knob, config) -> float:
    """A Dirichlet over the rates of one state, the others kept."""
    from ..functions.scalar import triangle_indices

    at = triangle_indices(int(rng.integers(data.states)), data.states)
    part = s.rates[at]
    new, h = _dirichlet(part / part.sum(), knob, rng)
    s.rates[at] = new * part.sum()
    return h


@proposal("frequencySlider", 0.2)
def frequency_slider(s, data, rng, knob, config) -> float:
    new = _slide_two(s.freqs, knob, FREQ_MIN, rng)
    if np.isnan(new).any():
        return float("-inf")
    s.freqs = new
    return 0.0


@proposal("frequencyDirichlet", 100.0)
def frequency_dirichlet(s, data, rng, knob, config) -> float:
    s.freqs, h = _dirichlet(s.freqs, knob, rng)
    return h if s.freqs.min() >= FREQ_MIN else float("-inf")


@proposal("rateHetMulti", 0.811)
def rate_het_multi(s, data, rng, knob, config) -> float:
    m = density.draw_multiplier(rng, knob)
    s.alpha *= m
    return log(m) if ALPHA_MIN <= s.alpha <= ALPHA_MAX else float("-inf")


@proposal("aaModelJump", 0.0)
def aa_model_jump(s, data, rng, knob, config) -> float:
    """Another of the fixed matrices that were given, all alike."""
    others = sorted(set(data.matrices) - {s.matrix})
    if others:
        s.matrix = others[int(rng.integers(len(others)))]
    return 0.0


# Dated trees.


@proposal("divTimeSlider", 0.0)
def div_time_slider(s, data, rng, knob, config) -> float:
    """A node's age, uniform between its oldest child and its parent."""
    inner = [a for a in s.ages if a > s.tree.n]
    if not inner:
        return 0.0
    a = inner[int(rng.integers(len(inner)))]
    near = [s.ages[b] for b in s.tree.around(a) if b in s.ages]
    older = [x for x in near if x > s.ages[a]]
    younger = [x for x in near if x <= s.ages[a]]
    s.ages[a] = float(rng.uniform(max(younger, default=0.0), min(older, default=1.0)))
    return 0.0


@proposal("divRateSlider", 0.5)
def div_rate_slider(s, data, rng, knob, config) -> float:
    """One rate category, slid and reflected at zero."""
    if len(s.clock):
        k = int(rng.integers(len(s.clock)))
        s.clock[k] = density.draw_window(rng, s.clock[k], knob, 0.0, 1e6)
    return 0.0


def tuned(knob: float, batch: int, ratio: float, target: float = 0.25, inverse: bool = False) -> float:
    """A step of the knob's logarithm toward the target acceptance, smaller with each batch."""
    step = 1 / sqrt(batch + 1)
    up = (ratio > target) != inverse
    return min(max(exp(log(knob) + (step if up else -step)), 1e-4), 1e4) if knob > 0 else knob
