import numpy as np
import pytest
from pyspark.sql import functions as F

from cladespark.functions import density, scalar, stats
from cladespark.operators import splits


def one(spark, values, expr):
    return spark.createDataFrame([(float(v),) for v in values], "x double").agg(expr.alias("y")).first().y


def test_hand_checked(spark):
    assert one(spark, range(1, 101), stats.percentile("x", 0.5)) == 50
    assert one(spark, range(1, 101), stats.percentile("x", 0.5, True)) == 51
    assert one(spark, [5], stats.variance("x")) == 0
    assert scalar.percentile_of(range(1, 101), 0.5) == 50 and scalar.percentile_of(range(1, 101), 0.5, True) == 51
    x = np.random.default_rng(1).normal(size=50)
    d = x - x.mean()
    assert one(spark, x, stats.skewness("x")) == pytest.approx((d**3).mean() / ((d**2).sum() / 49) ** 1.5)


def test_ess():
    assert stats.ess_of(np.array([])) == 0 and stats.ess_of(np.array([3.0])) == 1
    rng = np.random.default_rng(2)
    white = rng.normal(size=1500)
    slow = np.convolve(rng.normal(size=1700), np.ones(200), "valid")
    assert stats.ess_of(white) > 1000 > 60 > stats.ess_of(slow)


def test_ess_forms_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(v)) for k in range(2) for i, v in enumerate(np.convolve(rng.normal(size=130), np.ones(4), "valid"))]
    df = spark.createDataFrame(rows, "k int, i long, v double")
    a = {r.k: r.ess for r in stats.ess(df, ["k"], "i", "v").collect()}
    b = {r.k: r.ess for r in stats.ess_sql_form(df, ["k"], "i", "v", 126).collect()}
    assert a == pytest.approx(b)


def test_ess_sql_form_over_blocks(spark, monkeypatch):
    """A trace that stays positive for longer than a block, and one that ends within its first; samples alone are shuffled."""
    monkeypatch.setattr(stats, "LAG_BLOCK", 64, raising=False)
    rng = np.random.default_rng(6)
    slow = np.convolve(rng.normal(size=2200), np.ones(200), "valid")
    traces = {0: slow, 1: rng.normal(size=50)}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in traces.items() for i, v in enumerate(vs)], "k int, i long, v double")
    before = shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.k: r.ess for r in stats.ess_sql_form(df, ["k"], "i", "v", 300).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == pytest.approx({k: stats.ess_of(vs, 300) for k, vs in traces.items()})
    assert shuffled_rows(spark) - before < 10 * 2051


def slow_products(values, lags):
    x = np.array([np.nan if v is None else v for v in values], float)
    d = x - np.nanmean(x)
    return {k: float(np.nanmean(d[: len(d) - k] * d[k:])) for k in range(min(lags, len(d) - 1) + 1)}


def test_lag_products_over_blocks(spark, monkeypatch):
    """Traces of less than a block, of whole blocks and of some, from any first position, with a null."""
    monkeypatch.setattr(stats, "LAG_BLOCK", 16)
    monkeypatch.setattr(stats, "UNROLLED", 3)
    rng = np.random.default_rng(4)
    traces = {k: [float(v) for v in rng.normal(size=n)] for k, n in enumerate((1, 2, 15, 16, 17, 32, 33, 100))}
    traces[7][40] = None
    df = spark.createDataFrame([(k, 5 * k + i, v) for k, vs in traces.items() for i, v in enumerate(vs)], "k int, i long, v double")
    for lags in (0, 7, 16, 40):
        got = {(r.k, r.lag): r.gamma for r in stats.lag_products(df, ["k"], "i", "v", lags).collect()}
        assert got == pytest.approx({(k, lag): g for k, vs in traces.items() for lag, g in slow_products(vs, lags).items()})


def shuffled_rows(spark):
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lag_products_shuffle_samples_not_pairs(spark):
    """Fails by disk otherwise: a trace has up to 2,001 pairs for each sample."""
    df = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.sin("id").alias("v"))
    before = shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for traces that are too large for it
    try:
        assert stats.lag_products(df, ["k"], "i", "v", 200).count() == 201
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < shuffled_rows(spark) - before < 3 * 10_000


def test_psrf(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("b", 0, 1.0), ("b", 0, 3.0), ("b", 1, 2.0), ("b", 1, 4.0)], "p string, r int, v double")
    got = {r.p: r.psrf for r in stats.psrf(df, ["p"], "r", "v").collect()}
    assert got["a"] == 1
    w, n, between = 2.0, 2.0, 2 * ((2 - 2.5) ** 2 + (3 - 2.5) ** 2)
    assert got["b"] == pytest.approx((((1 - 1 / n) * w + between / n) / w) ** 0.5)


def test_asdsf(spark):
    rows = [(f, t, 1) for f in (0, 1) for t in range(10) if f == 0 or t < 5] + [(f, t, 2) for f in (0, 1) for t in range(10)]
    obs = spark.createDataFrame(rows, "file_id int, tree_id long, split_id int")
    r = splits.asdsf(obs).first()
    assert r.msdsf == pytest.approx(0.353553, abs=1e-6) and r.asdsf == pytest.approx(0.353553 / 2, abs=1e-6)
    same = spark.createDataFrame([(f, t, s) for f in (0, 1) for t in range(4) for s in range(3)], "file_id int, tree_id long, split_id int")
    assert splits.asdsf(same).first().asdsf == 0
    assert splits.asdsf(obs.filter("false")).first().asdsf is None


def test_burnin_windows(spark):
    trees = spark.createDataFrame([(0, i, i) for i in range(20)], "file_id int, tree_id long, ordinal long")
    keep = lambda df: sorted(r.ordinal for r in df.collect())
    assert keep(splits.burnin_each(trees, constant=5)) == list(range(5, 20))
    assert keep(splits.burnin_each(trees, constant=5, compat=True)) == list(range(3, 18))
    assert keep(splits.burnin_each(trees, constant=1, compat=True)) == list(range(19))
    with pytest.raises(ValueError):
        splits.burnin_each(trees, 0.1, 3)
    with pytest.raises(ValueError):
        splits.burnin_each(trees, constant=30)
    assert splits.online_window(3, None, 1, 0.25) is None and splits.online_window(20, None, 1, 0.25) == (5, 20)


def test_credible_set(spark):
    rows = [(0, i, t) for i, t in enumerate("aaaaabbbcd")]
    t = spark.createDataFrame(rows, "file_id int, tree_id long, topology string")
    assert [r.topology for r in splits.credible_set(t, 0.5).orderBy(F.desc("n")).collect()] == ["a", "b"]
    assert {r.share: r.topologies for r in splits.credible_size(t).collect()} == {0.5: 1, 0.99: 4}


def test_scalars(spark):
    assert scalar.format_range([0, 1, 2, 4, 6]) == "0-2,4,6" and scalar.format_range([0, 1]) == "0,1"
    v = scalar.clamp_simplex([0.98, 0.019, 0.001], 0.01)
    assert v.min() == pytest.approx(0.01) and v.sum() == pytest.approx(1)
    assert scalar.triangle_indices(1, 4) == [0, 3, 4]
    r = spark.range(1).select(scalar.from_z(scalar.to_z(F.lit(0.3), 0.7), 0.7).alias("l"), scalar.some_rates(F.array(*map(F.lit, range(6))), [0, 3]).alias("s"), scalar.insert_rates(F.array(*map(F.lit, range(6))), [0, 3], F.array(F.lit(9), F.lit(8))).alias("i")).first()
    assert r.l == pytest.approx(0.3) and r.s == [0, 3] and r.i == [9, 1, 2, 8, 4, 5]
    assert scalar.clock(3725) == "1:02:05" and scalar.parse_flag("Yes") and not scalar.parse_flag("0")


def test_draws():
    assert density.generator(1, 2, 3, 4).random() == density.generator(1, 2, 3, 4).random() != density.generator(1, 2, 3, 5).random()
    rng = density.generator(5)
    d = np.array([density.draw_dirichlet(rng, [1, 2, 3]) for _ in range(4000)])
    assert d.mean(0) == pytest.approx([1 / 6, 2 / 6, 3 / 6], abs=0.02)
    assert all(0 <= density.draw_window(rng, 0.05, 0.5, 0, 1) <= 1 for _ in range(200))
    assert density.bisect(lambda x: x * x - 2, 0, 2) == pytest.approx(2**0.5)
    assert density.Discrete((("a", 1), ("b", 3))).ln("b") == pytest.approx(np.log(0.75))
    assert density.Uniform(0, 2).ln(3) == float("-inf") and density.Fixed((1.0,)).ln([1.0]) == 0
