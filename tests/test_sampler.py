import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.functions import density
from cladespark.operators import likelihood as L
from cladespark.operators.trees import random_tree
from cladespark.sampler import chains, config, proposals

TEXT = """#NEXUS
begin run;
  numGen 1e3   [a note]
  numRuns 2
  NUMCOUPLEDCHAINS 2
  convergenceCriterion max
end;
begin params;
  stateFreq = (0+1,2)
  brlens = (0-2)
end;
begin priors;
  brlenpr exponential(5)
  stateFreqpr{1} fixed(0.25,0.25,0.25,0.25)
  stateFreqpr dirichlet(1,1,1,1)
end;
begin proposals;
  eTBR 2
  esprStopProb 0.3
end;
"""


def test_config():
    c = config.parse(TEXT, 3)
    assert (c.run.numGen, c.run.numRuns, c.run.numCoupledChains, c.run.convergenceCriterion) == (1000, 2, 2, "max")
    assert c.params == {"statefreq": [[0, 1], [2]], "brlens": [[0, 1, 2]]}
    assert c.proposals.esprStopProb == 0.3 and c.proposals.mixture({"topology"})["eTBR"] == 2
    assert isinstance(config.prior_for("statefreq", {1}, c.priors), density.Fixed)
    assert isinstance(config.prior_for("statefreq", {0}, c.priors), density.Dirichlet)
    assert config.prior_for("ratehet", {0}, c.priors) == density.Uniform(1e-6, 200.0)
    assert config.parse_linking("(0:1,2)", 3) == [[0], [1], [2]]


@pytest.mark.parametrize("text", ["begin run; what 3; end;", "begin run; burninProportion 1.5; end;", "begin params; brlens = (0+0); end;", "begin params; brlens = (0,7); end;", "begin proposals; stNNI 1; stnni 2; end;", "begin proposals; moveOptMode 9; end;"])
def test_refused(text):
    with pytest.raises(ValueError):
        config.parse(text, 2)
    with pytest.raises(NotImplementedError):
        config.parse("begin proposals; divTimeDirich 1; end;")


@pytest.mark.parametrize("mode", [1, 2, 3, 4])
def test_joint_branch_moves_are_refused(mode):
    assert config.parse("begin proposals; moveOptMode 0; end;", 2).proposals.moveOptMode == 0
    with pytest.raises(NotImplementedError):
        config.parse(f"begin proposals; moveOptMode {mode}; end;", 2)


def data(n=6, sites=30, seed=3):
    rng = density.generator(seed)
    return proposals.Data(rng.choice([1, 2, 4, 8], (sites, n)), np.ones(sites), 4, {"brlens": density.Exponential(10.0), "ratehet": density.Uniform(0.02, 100.0), "statefreq": density.Dirichlet((1.0,) * 4), "revmat": density.Dirichlet((1.0,) * 6)}, {"a": (np.full(6, 1 / 6), np.full(4, 0.25)), "b": (np.arange(1.0, 7.0), np.array([0.1, 0.2, 0.3, 0.4]))})


@pytest.mark.parametrize("name", sorted(proposals.REGISTRY))
def test_every_proposal_keeps_a_valid_state(name):
    d, rng = data(), density.generator(9)
    s = proposals.State(random_tree(6, rng), ages={7: 0.4, 8: 0.6}, clock=np.ones(3))
    f, knob = proposals.REGISTRY[name]
    moved = 0
    for _ in range(30):
        t = s.copy()
        h = f(t, d, rng, knob, config.Proposals())
        if h > float("-inf"):
            assert len(t.tree.edges()) == 9 and len(t.tree.splits()) == 3
            assert t.freqs.sum() == pytest.approx(1) and t.rates.sum() == pytest.approx(1)
            assert np.isfinite(h)
            moved += 1
            s = t
    assert moved


def test_branch_profile_agrees():
    d, rng = data(), density.generator(2)
    s = proposals.State(random_tree(6, rng))
    e = s.tree.inner_edges()[0]
    f = proposals.branch_profile(s, d, e)
    assert f(s.tree.length(e)) == pytest.approx(d.ln_likelihood(s))
    t, _ = proposals.branch_optimum(f)
    assert f(t) >= max(f(t * 1.3), f(t / 1.3)) - 1e-9


def test_state_survives_json():
    rng = density.generator(1)
    c = chains.Chain(proposals.State(random_tree(5, rng), ages={6: 0.5}), 1, 7, -3.0, 1.0)
    c.counts["x"] = [1, 2, 0, 1, 0]
    row = type("Row", (), {"body": c.dump(), "heat_ix": 1, "gen": 7, "lnl": -3.0, "lnpr": 1.0, "best": -3.0})
    again = chains.Chain.load(row)
    assert again.state.tree.adj == c.state.tree.adj and again.dump() == c.dump()


def test_prior_is_recovered():
    """Without data branch lengths follow their exponential prior: a mean of 0.1 each, 0.7 over seven."""
    d = proposals.Data(None, None, 4, {"brlens": density.Exponential(10.0)})
    c = config.parse("begin proposals; stNNI 2; eSPR 2; nodeSlider 2; end;")
    mix = {k: w for k, w in c.proposals.mixture({"topology", "brlens"}).items() if k in ("stNNI", "eSPR", "branchMulti", "treeLengthMult", "nodeSlider")}
    chain = chains.Chain(proposals.State(random_tree(5, density.generator(5))))
    chain.lnpr = d.ln_prior(chain.state)
    total = []
    for g in range(12_000):
        chains.step(chain, d, mix, c.proposals, density.generator(11, 0, 0, g), 1.0, 0)
        if g > 1000:
            total.append(chain.state.tree.total_length())
    assert np.mean(total) == pytest.approx(0.7, abs=0.07)
    assert np.var(total) == pytest.approx(0.07, abs=0.035)


def test_coupled_run(spark, tmp_path):
    d = data(5, 20)
    c = config.parse("begin run; numGen 40; numRuns 2; numCoupledChains 2; samplingFreq 5; diagFreq 20; sdsfConvergence 0.0001; end; begin proposals; likeSPR 0; parsimonySPR 0; blDistGamma 0; end;")
    s = chains.Sampler(spark, d, c, 5, seed=3)
    path = str(tmp_path / "samples")
    got = s.run(40, batch=20, path=path)
    rows = got.orderBy("run_id", "gen").collect()
    assert [(r.run_id, r.gen) for r in rows] == [(r, g) for r in range(2) for g in range(0, 41, 5)] or len(rows) == 18
    heats = s.states.groupBy("run_id").agg(F.sort_array(F.collect_list("heat_ix")).alias("h")).collect()
    assert all(r.h == [0, 1] for r in heats)
    again = chains.Sampler(spark, d, c, 5, seed=3).run(40, batch=20).orderBy("run_id", "gen").collect()
    assert [(r.run_id, r.gen, r.lnl, r.body) for r in again] == [(r.run_id, r.gen, r.lnl, r.body) for r in rows]
    assert chains.counters_of(s.states).agg(F.sum("seen")).first()[0] == 2 * 2 * 40
    assert chains.trace_of(got).filter("param = 'TL{0}'").count() == 18

    from cladespark.streaming import monitor

    q = monitor.watch(spark, path, c.run, str(tmp_path / "report"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    report = spark.read.parquet(str(tmp_path / "report")).collect()
    batch = monitor.convergence(spark.read.parquet(path), c.run).first()
    assert len(report) == 1 and report[0].trees == 18 and report[0].asdsf == pytest.approx(batch.asdsf)


def test_every_swap_is_tried_in_its_generation(spark):
    """With one swap a generation as many are drawn as there are generations, and batches change nothing."""
    for n, mean in ((2, 1.0), (4, 1.0), (3, 2.5), (2, 0.1)):
        drawn = [chains.swaps(3, 0, g, n, mean) for g in range(4000)]
        assert sum(map(len, drawn)) == pytest.approx(4000 * mean, rel=0.15)
        assert all(i != j and 0 <= min(i, j) and max(i, j) < n and u <= 0 for d in drawn for i, j, u in d)
    assert chains.swaps(3, 0, 1, 1, 1.0) == []
    d = proposals.Data(None, None, 4, {"brlens": density.Exponential(10.0)})
    c = config.parse("begin run; numRuns 2; numCoupledChains 3; samplingFreq 5; end; begin proposals; likeSPR 0; parsimonySPR 0; blDistGamma 0; end;")
    a, b = (chains.Sampler(spark, d, c, 5, seed=3, available=frozenset({"topology", "brlens"})).run(60, batch=k).orderBy("run_id", "gen").collect() for k in (60, 20))
    assert a == b and len(a) == 26


def test_fixed_matrix_model():
    d = data()
    s = proposals.State(random_tree(6, density.generator(8)), matrix="b")
    assert d.model(s).freqs == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert isinstance(d.model(s), L.Model)
