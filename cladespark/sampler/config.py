"""Configuration: NEXUS blocks RUN, PARAMS, PRIORS and PROPOSALS as plain records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from ..functions import density
from ..functions.scalar import parse_flag


@dataclass
class Run:
    """Keys of the RUN block with their defaults, fixed values."""

    numGen: int = 1_000_000
    numRuns: int = 1
    numCoupledChains: int = 1
    samplingFreq: int = 500
    printFreq: int = 500
    diagFreq: int = 5000
    sdsfIgnoreFreq: float = 0.1
    sdsfConvergence: float = 0.05
    convergenceCriterion: str = "mean"
    burninGen: int = 0
    burninProportion: float = 0.25
    heatFactor: float = 0.1
    numSwapsPerGen: float = 1.0
    tuneHeat: bool = False
    tuneFreq: int = 100
    parsimonyStart: bool = True
    heatedChainsUseSame: bool = False
    checkPointInterval: int = 1000
    proposalSets: bool = True

    def verify(self) -> None:
        for name in ("sdsfIgnoreFreq", "burninProportion"):
            if not 0 <= getattr(self, name) < 1:
                raise ValueError(f"{name} must be in [0, 1)")
        if not 0 < self.sdsfConvergence <= 1:
            raise ValueError("sdsfConvergence must be in (0, 1]")
        if self.convergenceCriterion not in ("mean", "max", "none"):
            raise ValueError("convergenceCriterion is mean, max or none")
        if self.burninGen and self.burninProportion != Run.burninProportion:
            raise ValueError("give burninGen or burninProportion, not both")
        for name in ("numGen", "numRuns", "numCoupledChains", "samplingFreq", "diagFreq", "tuneFreq", "checkPointInterval"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


#: Default weights of the proposals, fixed values; None: not proposed unless asked for.
WEIGHTS: dict[str, tuple[str, float | None]] = {
    "stNNI": ("topology", 6), "eSPR": ("topology", 6), "eTBR": ("topology", None), "parsimonySPR": ("topology", 6), "likeSPR": ("topology", 2),
    "branchMulti": ("brlens", 7), "treeLengthMult": ("brlens", 1), "nodeSlider": ("brlens", None), "blDistGamma": ("brlens", 7), "blDistWeibull": ("brlens", None),
    "revMatSlider": ("revmat", 1), "revMatDirichlet": ("revmat", 1), "revMatRateDirich": ("revmat", None),
    "frequencySlider": ("statefreq", 0.5), "frequencyDirichlet": ("statefreq", 0.5),
    "rateHetMulti": ("ratehet", 1), "aaModelJump": ("aamodel", None), "divTimeSlider": ("divtimes", None), "divRateSlider": ("divrates", None),
}
#: Keywords that are known but that nothing stands behind.
UNAVAILABLE = ("revMatRateSlider", "rateHetSlider", "divTimeDirich")


@dataclass
class Proposals:
    """The PROPOSALS block: weights by keyword and knobs."""

    weights: dict[str, float] = field(default_factory=dict)
    esprStopProb: float = 0.5
    etbrStopProb: float = 0.5
    parsimonyWarp: float = 0.1
    parsSPRRadius: int = -1
    likeSprMaxRadius: int = -1
    likeSprWarp: float = 1.0
    moveOptMode: int = 0
    useMultiplier: bool = False

    def verify(self) -> None:
        for name in ("esprStopProb", "etbrStopProb"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        if not 0 <= self.moveOptMode <= 4:
            raise ValueError("moveOptMode is 0 to 4")
        if self.moveOptMode:
            raise NotImplementedError("moveOptMode other than 0 is not built")

    def mixture(self, available: set[str]) -> dict[str, float]:
        """Weights of the proposals of the available categories."""
        out = {k: (self.weights.get(k, w) or 0) for k, (cat, w) in WEIGHTS.items() if cat in available}
        return {k: w for k, w in out.items() if w > 0}


@dataclass
class Config:
    run: Run
    params: dict[str, list[list[int]]]
    priors: list[tuple[str, frozenset[int], object]]
    proposals: Proposals


CATEGORIES = {"statefreq": "stateFreq", "ratehet": "rateHet", "revmat": "revMat", "brlens": "brlens", "aamodel": "aaModel", "topology": "topology", "divtimes": "divTimes", "divrates": "divRates"}


def blocks(text: str) -> dict[str, list[str]]:
    """Commands of each block, by lower-case name; comments in brackets are dropped."""
    text = re.sub(r"\[[^\]]*\]", " ", text)
    out: dict[str, list[str]] = {}
    for name, body in re.findall(r"begin\s+(\w+)\s*;(.*?)end(?:block)?\s*;", text, re.IGNORECASE | re.DOTALL):
        parts = [p.strip() for p in re.split(r"[;\n]", body)]
        out.setdefault(name.lower(), []).extend(p for p in parts if p)
    return out


def _set(record, key: str, value: str) -> bool:
    for f in fields(record):
        if f.name.lower() == key.lower() and f.name != "weights":
            kind = type(getattr(record, f.name))
            setattr(record, f.name, parse_flag(value) if kind is bool else int(float(value)) if kind is int else float(value) if kind is float else value.lower())
            return True
    return False


def parse_linking(text: str, n: int) -> list[list[int]]:
    """Groups of partitions that share a parameter: ``(0:1,2)``. A comma parts groups, a plus joins members, a dash is
    a range in one group, a colon a range of single groups. Partitions that are not named stay single."""
    inside = re.sub(r"[()\s]", "", text)
    groups: list[list[int]] = []
    for part in filter(None, inside.split(",")):
        members: list[int] = []
        for item in part.split("+"):
            if m := re.fullmatch(r"(\d+)-(\d+)", item):
                members += range(int(m[1]), int(m[2]) + 1)
            elif m := re.fullmatch(r"(\d+):(\d+)", item):
                groups += [[k] for k in range(int(m[1]), int(m[2]) + 1)]
            else:
                members.append(int(item))
        if members:
            groups.append(members)
    used = [k for g in groups for k in g]
    if len(set(used)) != len(used):
        raise ValueError("a partition is named twice")
    if any(not 0 <= k < n for k in used):
        raise ValueError("a partition is out of range")
    return sorted(groups + [[k] for k in range(n) if k not in used])


def parse_prior(text: str):
    """uniform(a,b), exponential(rate), dirichlet(a,...), fixed(...), disc(name=w,..., remainder=w)."""
    m = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", text.strip(), re.DOTALL)
    kind, args = m[1].lower(), [a.strip() for a in (m[2] or "").split(",") if a.strip()]
    if kind == "uniform":
        return density.Uniform(*map(float, args)) if args else density.Uniform(0.0, 0.0)
    if kind == "exponential":
        return density.Exponential(float(args[0]))
    if kind == "dirichlet":
        return density.Dirichlet(tuple(map(float, args)))
    if kind == "fixed":
        return density.Fixed(args[0] if len(args) == 1 and not re.fullmatch(r"[-+.\deE]+", args[0]) else tuple(map(float, args)))
    if kind == "disc":
        return density.Discrete(tuple((k.strip(), float(v)) for k, v in (a.split("=") for a in args)))
    raise ValueError(f"unknown prior {kind}")


def parse(text: str, n_partitions: int = 1) -> Config:
    """A configuration file. Keys are matched in any case, unknown ones refused, and ranges verified."""
    run, proposals, params, priors = Run(), Proposals(), {}, []
    found = blocks(text)
    for line in found.get("run", []):
        key, value = line.replace("=", " ").split(None, 1)
        if not _set(run, key, value.strip()):
            raise ValueError(f"unknown key {key}")
    for line in found.get("params", []):
        key, value = re.split(r"[=\s]+", line, maxsplit=1)
        if key.lower() not in CATEGORIES:
            raise ValueError(f"unknown category {key}")
        if key.lower() in params:
            raise ValueError(f"{key} is linked twice")
        params[key.lower()] = parse_linking(value, n_partitions)
    for line in found.get("priors", []):
        m = re.match(r"(\w+?)(?:pr)?\s*(?:\{([\d,\s]*)\})?\s+(.*)$", line, re.IGNORECASE | re.DOTALL)
        priors.append((m[1].lower(), frozenset(int(x) for x in (m[2] or "").split(",") if x.strip()), parse_prior(m[3])))
    names = {k.lower(): k for k in WEIGHTS}
    for line in found.get("proposals", []):
        key, value = line.replace("=", " ").split(None, 1)
        if key.lower() in names:
            if names[key.lower()] in proposals.weights:
                raise ValueError(f"{key} is given twice")
            proposals.weights[names[key.lower()]] = float(value)
        elif key.lower() in {u.lower() for u in UNAVAILABLE}:
            if float(value) > 0:
                raise NotImplementedError(f"{key} has no implementation")
        elif not _set(proposals, key, value.strip()):
            raise ValueError(f"unknown key {key}")
    run.verify()
    proposals.verify()
    return Config(run, params, priors, proposals)


def prior_for(category: str, partitions: set[int], given: list[tuple[str, frozenset[int], object]], states: int = 4):
    """The prior of a parameter: one given for some of its partitions, else a general one, else the default."""
    own = [p for c, s, p in given if c == category and s & partitions]
    general = [p for c, s, p in given if c == category and not s]
    if own or general:
        return (own + general)[0]
    return {
        "topology": density.Uniform(0, 0), "brlens": density.Exponential(10.0), "ratehet": density.Uniform(1e-6, 200.0), "divtimes": density.Uniform(0, 10),
        "statefreq": density.Dirichlet((1.0,) * states), "revmat": density.Dirichlet((1.0,) * (states * (states - 1) // 2)),
    }[category]
