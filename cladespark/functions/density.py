"""Log densities, log-gamma as a column, counter-based draws and priors."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Lanczos' approximation with g = 7, fixed values.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def ln_gamma(x: Column) -> Column:
    """Log-gamma of positive values in built-in arithmetic, to about 14 digits."""
    y = x  # shifted up by one, so that small arguments keep their digits
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return 0.5 * F.log(F.lit(2 * np.pi)) + (y + 0.5) * F.log(t) - t + F.log(series) - F.log(y)


def ln_exponential(x: Column, rate: float) -> Column:
    return F.lit(log(rate)) - x * rate


def ln_gamma_density(x: Column, shape: float, rate: float) -> Column:
    return (shape - 1) * F.log(x) + (shape * log(rate) - lgamma(shape)) - x * rate


def ln_weibull(x: Column, scale: float, shape: float) -> Column:
    """Null below zero, where there is no density."""
    return F.when(x >= 0, F.lit(log(shape / scale)) + (shape - 1) * F.log(x / scale) - F.pow(x / scale, F.lit(shape)))


def ln_dirichlet(values: Column, alphas: list[float]) -> Column:
    """Null unless the values sum to 1 within 1e-6."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    terms = F.aggregate(F.zip_with(values, F.array(*[F.lit(float(a)) for a in alphas]), lambda x, a: (a - 1) * F.log(x)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.abs(total - 1) <= 1e-6, F.lit(ln_beta_inverse(alphas)) + terms)


def ln_beta_inverse(alphas) -> float:
    return lgamma(sum(alphas)) - sum(map(lgamma, alphas))


# Draws. A generator belongs to (seed, run, chain, generation), so a lost task draws the same again.


def generator(seed: int, run: int = 0, chain: int = 0, generation: int = 0) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (run << 32) + chain], counter=[0, 0, 0, generation]))


def draw_multiplier(rng: np.random.Generator, strength: float) -> float:
    return float(np.exp(strength * (rng.random() - 0.5)))


def draw_window(rng: np.random.Generator, x: float, width: float, lo: float, hi: float) -> float:
    """A value within ``width`` about ``x``, reflected at the bounds."""
    y = x + width * (rng.random() - 0.5)
    while not lo <= y <= hi:
        y = 2 * lo - y if y < lo else 2 * hi - y
    return y


def draw_dirichlet(rng: np.random.Generator, alphas) -> np.ndarray:
    g = np.maximum(rng.gamma(np.asarray(alphas, float)), 1e-32)
    return g / g.sum()


def ln_dirichlet_of(values, alphas) -> float:
    return ln_beta_inverse(alphas) + float(np.sum((np.asarray(alphas) - 1) * np.log(values)))


def ln_gamma_of(x: float, shape: float, rate: float) -> float:
    return (shape - 1) * log(x) + shape * log(rate) - lgamma(shape) - x * rate


def ln_weibull_of(x: float, scale: float, shape: float) -> float:
    return log(shape / scale) + (shape - 1) * log(x / scale) - (x / scale) ** shape


def bisect(f, lo: float, hi: float, steps: int = 200) -> float:
    """A root of a monotone function between two bounds."""
    flo = f(lo)
    for _ in range(steps):
        mid = (lo + hi) / 2
        if (fm := f(mid)) == 0 or hi - lo < 1e-12 * max(1.0, abs(mid)):
            return mid
        lo, hi, flo = (mid, hi, fm) if (fm > 0) == (flo > 0) else (lo, mid, flo)
    return (lo + hi) / 2


# Priors. ``column`` scores a column, ``ln`` a value; ``rescaled`` is what a change of all rates by a factor adds.


@dataclass(frozen=True)
class Exponential:
    rate: float = 10.0

    def column(self, x: Column) -> Column:
        return ln_exponential(x, self.rate)

    def ln(self, x: float) -> float:
        return log(self.rate) - self.rate * x

    def initial(self):
        return 1 / self.rate


@dataclass(frozen=True)
class Uniform:
    lo: float
    hi: float

    def column(self, x: Column) -> Column:
        return F.when(x.between(self.lo, self.hi), F.lit(self.ln(self.lo)))

    def ln(self, x: float) -> float:
        if self.lo == self.hi:
            return 0.0
        return -log(self.hi - self.lo) if self.lo <= x <= self.hi else float("-inf")

    def initial(self):
        return (self.lo + self.hi) / 2 if self.hi - self.lo < 10 else 1.0


@dataclass(frozen=True)
class Dirichlet:
    alphas: tuple[float, ...]

    def column(self, x: Column) -> Column:
        return ln_dirichlet(x, list(self.alphas))

    def ln(self, x) -> float:
        return ln_dirichlet_of(x, self.alphas)

    def initial(self):
        return np.array(self.alphas) / sum(self.alphas)


@dataclass(frozen=True)
class Fixed:
    value: object

    def column(self, x: Column) -> Column:
        return F.lit(0.0)

    def ln(self, x) -> float:
        return 0.0 if np.allclose(x, self.value) else float("-inf")

    def initial(self):
        return self.value


@dataclass(frozen=True)
class Discrete:
    weights: tuple[tuple[str, float], ...]

    def column(self, x: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, _ in self.weights:
            out = F.when(x == k, F.lit(self.ln(k))).otherwise(out)
        return out

    def ln(self, x: str) -> float:
        w = dict(self.weights)
        return log(w[x] / sum(w.values())) if w.get(x) else float("-inf")

    def initial(self):
        return max(self.weights, key=lambda kw: kw[1])[0]


def joint_prior(terms: Column) -> Column:
    """Log prior of a state: the sum over its parameters and branches."""
    return F.sum(terms)
