"""Scalar functions as column expressions, and small driver-side helpers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allowed ranges, fixed values.
Z_MIN, Z_MAX = 1e-15, 1 - 1e-6
RATE_MIN, RATE_MAX = 1e-7, 1e6
ALPHA_MIN, ALPHA_MAX = 0.02, 1000.0
FREQ_MIN = 1e-3


def to_z(length: Column, mu: Column | float = 1.0) -> Column:
    """Stored form of a branch length for a mean substitution rate."""
    return F.exp(-length / mu)


def from_z(z: Column, mu: Column | float = 1.0) -> Column:
    return -F.log(z) * mu


def mean_substitution_rate(fracchange: Column, contribution: Column) -> Column:
    """An aggregate over the partitions of a branch parameter."""
    return F.sum(fracchange * contribution)


def heat(delta: Column | float, index: Column) -> Column:
    """Power that chain ``index`` raises its posterior to; 1 for the cold chain."""
    return 1 / (1 + F.lit(delta) * index)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def to_sum(a: Column, total: float = 1.0) -> Column:
    return F.transform(a, lambda x: x / _sum(a) * total)


def relative_to_last(a: Column) -> Column:
    return F.transform(a, lambda x: x / F.element_at(a, -1))


def triangle(states: Column | int) -> Column:
    """Entries above the diagonal of a symmetric matrix."""
    s = F.lit(states)
    return ((s * s - s) / 2).cast("int")


def triangle_indices(state: int, n: int) -> list[int]:
    """Where the rates of one state stand among the rows of the triangle."""
    at = {}
    k = 0
    for i in range(n):
        for j in range(i + 1, n):
            at[i, j] = k
            k += 1
    return [at[min(state, j), max(state, j)] for j in range(n) if j != state]


def some_rates(a: Column, indices: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(a, i))


def insert_rates(a: Column, indices: list[int], values: Column) -> Column:
    place = F.array(*[F.lit(i) for i in indices])
    return F.transform(a, lambda x, i: F.coalesce(F.get(values, (F.array_position(place, i) - 1).cast("int")), x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def inside(x: Column, lo: float, hi: float) -> Column:
    return x.between(lo, hi)


def clamp_simplex(values, floor: float):
    """A vector of sum 1 whose entries are raised to a floor, the others shrunk in proportion until all fit."""
    import numpy as np

    v = np.asarray(values, float)
    v = v / v.sum()
    if floor * len(v) > 1:
        raise ValueError("the floor leaves no room")
    low = np.zeros(len(v), bool)
    while (v[~low] < floor).any():
        low |= v < floor
        rest = 1 - floor * low.sum()
        v = np.where(low, floor, v / v[~low].sum() * rest)
    return v


def format_range(values: list[int]) -> str:
    """Numbers with runs of three or more as ranges: ``0-2,4,6``."""
    out, i, xs = [], 0, sorted(values)
    while i < len(xs):
        j = i
        while j + 1 < len(xs) and xs[j + 1] == xs[j] + 1:
            j += 1
        out += [f"{xs[i]}-{xs[j]}"] if j - i >= 2 else map(str, xs[i : j + 1])
        i = j + 1
    return ",".join(out)


def percentile_of(values, p: float, compat: bool = False) -> float:
    """The nearest-rank percentile of a list; ``compat`` one rank above."""
    xs = sorted(values)
    k = ceil(round(len(xs) * p, 9))
    return xs[min(k if compat else max(k, 1) - 1, len(xs) - 1)]


def trim(text: Column, chars: str = " \t\r\n") -> Column:
    return F.trim(text, F.lit(chars))


def parse_flag(text: str) -> bool:
    t = text.strip().lower()
    if t in ("1", "true", "yes", "on"):
        return True
    if t in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"not a flag: {text}")


def clock(seconds: float) -> str:
    """Hours, minutes and seconds."""
    s = int(seconds)
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}"


#: Short names of parameter categories, fixed values.
SHORT_NAMES = {"topology": "topo", "brlens": "bl", "statefreq": "pi", "revmat": "r", "ratehet": "alpha", "aamodel": "aaModel"}


def run_name(name: str | Column, run: str | Column) -> Column:
    """A parameter's or proposal's name in a run: the name, a dollar sign and the run's number."""
    return F.concat_ws("$", F.lit(name) if isinstance(name, str) else name, (F.col(run) if isinstance(run, str) else run).cast("string"))


def short_name(category: Column) -> Column:
    """The short name of a category, null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv]), category)


def ln_product(x: str | Column) -> Column:
    """The log of a group's product, as a sum of logs."""
    return F.sum(F.log(x))


def ln_power(ln: Column, exponent: float) -> Column:
    """The log of a power of a number that is given by its log."""
    return ln * F.lit(exponent)
