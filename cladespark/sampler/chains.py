"""Coupled chains on Spark: a table of chain states, advanced in batches by one task per chain.

Within a chain steps depend on each other, so Spark spreads (run, chain) over tasks and runs many generations in each.
Between batches the chains of a run meet and may swap heats. States are durable tables, so a lost executor costs a batch.
"""

from __future__ import annotations

import json
import tempfile
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.density import generator
from ..operators.likelihood import parsimony_tree
from ..operators.trees import parse_newick, random_tree
from .config import Config
from .proposals import REGISTRY, Data, State, tuned

SCHEMA = "run_id int, chain_id int, kind string, gen long, heat_ix int, lnl double, lnpr double, best double, body string"


@dataclass
class Chain:
    """A chain's state with its tuning and counters; everything survives as JSON."""

    state: State
    heat_ix: int = 0
    gen: int = 0
    lnl: float = 0.0
    lnpr: float = 0.0
    best: float = float("-inf")
    knobs: dict[str, float] = field(default_factory=dict)
    counts: dict[str, list[int]] = field(default_factory=dict)  # accepted, seen, accepted and seen in this batch, batches

    def dump(self) -> str:
        s = self.state
        tree = {"n": s.tree.n, "edges": [[a, b, s.tree.length((a, b))] for a, b in s.tree.edges()]}
        return json.dumps({"tree": tree, "alpha": s.alpha, "freqs": list(s.freqs), "rates": list(s.rates), "matrix": s.matrix, "ages": s.ages, "clock": list(s.clock), "knobs": self.knobs, "counts": self.counts})

    @classmethod
    def load(cls, row) -> Chain:
        from ..operators.trees import Tree

        d = json.loads(row.body)
        tree = Tree(d["tree"]["n"])
        for a, b, x in d["tree"]["edges"]:
            tree.link(a, b, x)
        state = State(tree, d["alpha"], np.array(d["freqs"]), np.array(d["rates"]), d["matrix"], {int(k): v for k, v in d["ages"].items()}, np.array(d["clock"]))
        return cls(state, int(row.heat_ix), int(row.gen), float(row.lnl), float(row.lnpr), float(row.best), d["knobs"], d["counts"])


def step(chain: Chain, data: Data, mixture: dict[str, float], config, rng: np.random.Generator, beta: float, tune: int) -> bool:
    """One generation: draw a proposal by weight, apply it to a copy, accept it by the heated posterior ratio."""
    names = sorted(mixture)
    cumulative = np.cumsum([mixture[n] for n in names])
    name = names[int(np.searchsorted(cumulative, rng.random() * cumulative[-1], side="right"))]
    f, first = REGISTRY[name]
    trial = chain.state.copy()
    hastings = f(trial, data, rng, chain.knobs.get(name, first), config)
    accepted = False
    u = rng.random()
    if hastings > float("-inf"):
        lnpr = data.ln_prior(trial)
        if lnpr > float("-inf"):
            lnl = data.ln_likelihood(trial)
            if np.log(u) < beta * ((lnl + lnpr) - (chain.lnl + chain.lnpr)) + hastings:
                chain.state, chain.lnl, chain.lnpr, accepted = trial, lnl, lnpr, True
                chain.best = max(chain.best, lnl)
    c = chain.counts.setdefault(name, [0, 0, 0, 0, 0])
    c[0] += accepted
    c[1] += 1
    c[2] += accepted
    c[3] += 1
    if tune and c[3] >= tune and first > 0:
        chain.knobs[name] = tuned(chain.knobs.get(name, first), c[4], c[2] / c[3], inverse=name.endswith("Dirichlet") or name.endswith("Dirich"))
        c[2] = c[3] = 0
        c[4] += 1
    chain.gen += 1
    return accepted


def is_sample(heat_ix, gen, every: int):
    """Whether a chain's state is a sample: that of the cold one, every so many generations. Takes numbers or columns."""
    return (heat_ix == 0) & (gen % every == 0)


def sample_body(chain: Chain) -> str:
    s = chain.state
    return json.dumps({"newick": s.tree.newick(), "TL": s.tree.total_length(), "alpha": s.alpha, "pi": list(s.freqs), "r": list(s.rates), "matrix": s.matrix})


def swaps(seed: int, run_id: int, gen: int, n: int, mean: float) -> list[tuple[int, int, float]]:
    """The swaps to try after a generation: two of ``n`` chains without replacement, and the logarithm of a uniform draw.
    Their number is binomial with that mean, of 2 * n * mean trials; all depends on seed, run and generation alone."""
    if n < 2 or mean <= 0:
        return []
    rng = generator(seed, run_id, 1 << 20, gen)
    trials = int(np.ceil(2 * n * mean))
    return [(*(int(k) for k in rng.choice(n, 2, replace=False)), float(np.log(rng.random()))) for _ in range(rng.binomial(trials, mean / trials))]


@dataclass
class Sampler:
    """A sampling job. ``data`` is the compressed alignment, small beside the work done on it, and goes with the closure."""

    spark: SparkSession
    data: Data
    config: Config
    n_taxa: int
    seed: int = 1
    available: frozenset = frozenset({"topology", "brlens", "ratehet", "statefreq", "revmat"})
    starts: tuple[str, ...] = ()

    def __post_init__(self):
        if self.spark.sparkContext.getCheckpointDir() is None:
            self.spark.sparkContext.setCheckpointDir(self.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="clade-ckpt-"))

    def initial(self) -> DataFrame:
        """Chains at generation 0, each from a given, parsimonious or random tree, and their samples."""
        rows = []
        for run in range(self.config.run.numRuns):
            for c in range(self.config.run.numCoupledChains):
                start = 0 if self.config.run.heatedChainsUseSame else c
                rng = generator(self.seed, run, start)
                k = run * self.config.run.numCoupledChains + c
                if k < len(self.starts):
                    tree = parse_newick(self.starts[k])
                elif self.config.run.parsimonyStart and self.data.masks is not None:
                    tree = parsimony_tree(self.data.masks, self.data.weights, rng)
                else:
                    tree = random_tree(self.n_taxa, rng)
                n = self.data.states
                state = State(tree, 1.0, np.full(n, 1 / n), np.full(n * (n - 1) // 2, 2 / (n * (n - 1))), min(self.data.matrices, default=""))
                chain = Chain(state, c)
                chain.lnl, chain.lnpr = self.data.ln_likelihood(state), self.data.ln_prior(state)
                chain.best = chain.lnl
                rows.append((run, c, "state", 0, c, chain.lnl, chain.lnpr, chain.best, chain.dump()))
                if c == 0:
                    rows.append((run, c, "sample", 0, 0, chain.lnl, chain.lnpr, chain.best, sample_body(chain)))
        return self.spark.createDataFrame(rows, SCHEMA)

    def advance(self, states: DataFrame, gens: int) -> DataFrame:
        """The chains of each run ``gens`` generations on: their new states, and a sample whenever the cold one is due.

        Coupled chains wait for each other at every generation that has a swap, one in most generations, so a run is
        one task. In each generation every chain steps and is sampled, then all drawn swaps are tried in turn.
        """
        data, config, seed = self.data, self.config, self.seed
        mixture = config.proposals.mixture(set(self.available))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            run_id = int(pdf.run_id.iloc[0])
            chains = {int(row.chain_id): Chain.load(row) for _, row in pdf.sort_values("chain_id").iterrows()}
            beta = lambda chain: 1 / (1 + config.run.heatFactor * chain.heat_ix)
            out = []
            for _ in range(gens):
                for k, chain in chains.items():
                    step(chain, data, mixture, config.proposals, generator(seed, run_id, k, chain.gen + 1), beta(chain), config.run.tuneFreq)
                    if is_sample(chain.heat_ix, chain.gen, config.run.samplingFreq):
                        out.append((run_id, k, "sample", chain.gen, 0, chain.lnl, chain.lnpr, chain.best, sample_body(chain)))
                for i, j, log_u in swaps(seed, run_id, chain.gen, len(chains), config.run.numSwapsPerGen):
                    a, b = chains[i], chains[j]
                    if log_u < (beta(a) - beta(b)) * (b.lnl + b.lnpr - a.lnl - a.lnpr):
                        a.heat_ix, b.heat_ix = b.heat_ix, a.heat_ix
            out += [(run_id, k, "state", c.gen, c.heat_ix, c.lnl, c.lnpr, c.best, c.dump()) for k, c in chains.items()]
            return pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

        return states.groupBy("run_id").applyInPandas(run, SCHEMA)

    def run(self, generations: int | None = None, batch: int = 200, path: str | None = None, resume: DataFrame | None = None) -> DataFrame:
        """All samples ``(run_id, gen, lnl, lnpr, body)``. With ``path`` samples are appended there as they come, for a
        monitor to read, and the run ends early once split frequencies agree."""
        goal = generations or self.config.run.numGen
        table = (resume or self.initial()).checkpoint()
        samples = table.filter("kind = 'sample'")
        done = table.filter("kind = 'state'").agg(F.min("gen")).first()[0]
        if path:
            self._put(samples, path, "append" if resume is not None else "errorifexists")
        since = 0
        while done < goal:
            gens = min(batch, goal - done)
            table = self.advance(table.filter("kind = 'state'"), gens).checkpoint()
            done += gens
            since += gens
            fresh = table.filter("kind = 'sample'")
            if path:
                self._put(fresh, path, "append")
            else:
                samples = samples.unionByName(fresh)
            if path and since >= self.config.run.diagFreq and self.config.run.convergenceCriterion != "none" and self.config.run.numRuns > 1:
                since = 0
                if self._settled(path):
                    break
        self.states = table.filter("kind = 'state'")
        return (self.spark.read.parquet(path) if path else samples).select("run_id", "gen", "lnl", "lnpr", "body")

    def save(self, path: str) -> None:
        """Keep the chains under a folder of their generation. A folder counts once its writer has marked it complete,
        so a write that was cut off never hides the one before."""
        gen = self.states.agg(F.min("gen")).first()[0]
        self.states.write.mode("overwrite").parquet(f"{path}/gen={gen:012d}")

    def load(self, path: str) -> DataFrame:
        """The latest complete chains, to go on from with ``run(resume=...)``."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not done:
            raise FileNotFoundError(f"no complete state in {path}")
        return self.spark.read.parquet(max(done)).select([f.split()[0] for f in SCHEMA.split(", ")])

    def _put(self, samples: DataFrame, path: str, mode: str) -> None:
        samples.select("gen", "lnl", "lnpr", "body", "run_id").write.mode(mode).partitionBy("run_id").parquet(path)

    def _settled(self, path: str) -> bool:
        from ..streaming.monitor import convergence

        r = convergence(self.spark.read.parquet(path), self.config.run).first()
        value = r.msdsf if self.config.run.convergenceCriterion == "max" else r.asdsf
        return value is not None and value < self.config.run.sdsfConvergence


def trace_of(samples: DataFrame, states: int = 4) -> DataFrame:
    """``(run_id, gen, param, value)`` of samples: TL, alpha, frequencies and rates as parameters."""
    body = F.from_json("body", "newick string, TL double, alpha double, pi array<double>, r array<double>, matrix string")
    s = samples.select("run_id", "gen", "lnl", "lnpr", body.alias("b"))
    one = lambda name, v: F.struct(F.lit(name).alias("param"), v.alias("value"))
    fields = [one("LnPr", F.col("lnpr")), one("LnL", F.col("lnl")), one("TL{0}", F.col("b.TL")), one("alpha{0}", F.col("b.alpha"))]
    fields += [one(f"pi{{0}}({k})", F.get("b.pi", F.lit(k))) for k in range(states)] + [one(f"r{{0}}({k})", F.get("b.r", F.lit(k))) for k in range(states * (states - 1) // 2)]
    return s.select("run_id", "gen", F.explode(F.array(*fields)).alias("x")).select("run_id", "gen", "x.*")


def trees_of(samples: DataFrame) -> DataFrame:
    """``(file_id, tree_id, newick)``: each run as a file."""
    return samples.select(F.col("run_id").alias("file_id"), F.col("gen").alias("tree_id"), F.get_json_object("body", "$.newick").alias("newick"))


def counters_of(states: DataFrame) -> DataFrame:
    """``(run_id, name, accepted, seen, ratio)`` over the chains of each run."""
    c = states.select("run_id", F.explode(F.from_json(F.get_json_object("body", "$.counts"), "map<string,array<long>>")).alias("name", "c"))
    return c.groupBy("run_id", "name").agg(F.sum(F.get("c", F.lit(0))).alias("accepted"), F.sum(F.get("c", F.lit(1))).alias("seen")).withColumn("ratio", F.col("accepted") / F.col("seen"))


def config_dict(config: Config) -> dict:
    return asdict(config.run)
