import itertools

import numpy as np
import pytest

from cladespark.functions.density import generator
from cladespark.operators import alignment, likelihood as L
from cladespark.operators.trees import parse_newick, random_tree


def brute(tree, model, codes, n):
    """The likelihood of one column by summing over all states of inner nodes."""
    inner = [a for a in tree.adj if not tree.is_tip(a)]
    es = tree.edges()
    total = 0.0
    for k in range(len(model.rates)):
        p = {e: model.transition(np.array([tree.length(e)]))[0, k] for e in es}
        for states in itertools.product(range(n), repeat=len(inner)):
            at = dict(zip(inner, states, strict=True))
            for tips in itertools.product(*[[s for s in range(n) if codes[t] >> s & 1] for t in range(tree.n)]):
                full = at | {t + 1: s for t, s in enumerate(tips)}
                total += model.freqs[at[inner[0]]] * np.prod([p[a, b][full[a], full[b]] if b == b else 0 for a, b in directed(tree, inner[0], es)]) / len(model.rates)
    return np.log(total)


def directed(tree, root, es):
    """Reversibility lets transition matrices be read from either end only from the root down."""
    order = tree.post_order(root)
    return [tuple(e) if tuple(e) in es else e for e in ((min(a, p), max(a, p)) for a, p in order if p is not None)]


@pytest.mark.parametrize("alpha", [None, 0.7])
def test_against_all_states(alpha):
    n = 3
    model = L.reversible(np.array([0.5, 0.3, 0.2]), np.full(n, 1 / n), alpha)
    tree = parse_newick("((3:0.1,4:0.2):0.3,2:0.15,1:0.4);")
    rng = np.random.default_rng(0)
    masks = np.array([[1, 2, 4, 1], [1, 1, 1, 1], [7, 2, 2, 4], *rng.choice([1, 2, 4, 3], (3, 4)).tolist()])
    got = L.site_log_likelihoods(tree, model, L.mask_vectors(masks, n))
    assert got == pytest.approx([brute(tree, model, m, n) for m in masks])


def test_gtr():
    f = np.array([0.1, 0.2, 0.3, 0.4])
    m = L.reversible(np.arange(1.0, 7.0), f)
    p = m.transition(np.array([0.0, 0.3, 500.0]))[:, 0]
    assert p[0] == pytest.approx(np.eye(4), abs=1e-9) and p.sum(2) == pytest.approx(np.ones((3, 4))) and p[2][0] == pytest.approx(f)
    assert f[:, None] * p[1] == pytest.approx((f[:, None] * p[1]).T)
    jc = L.jukes_cantor().transition(np.array([0.3]))[0, 0]
    assert jc[0, 0] == pytest.approx(0.25 + 0.75 * np.exp(-0.4))


@pytest.mark.parametrize("alpha", [0.05, 0.5, 1.0, 20.0])
def test_gamma(alpha):
    r = L.gamma_rates(alpha)
    assert r.mean() == pytest.approx(1) and (np.diff(r) > 0).all()
    assert L.gamma_rates(alpha, median=True).mean() == pytest.approx(1)
    if alpha == 1.0:
        assert r[0] == pytest.approx(0.1369538, abs=1e-6)


def test_fitch_and_root_placement():
    rng = generator(3)
    tree = random_tree(7, rng)
    masks = rng.choice([1, 2, 4, 8], (20, 7))
    best = []
    inner = [a for a in tree.adj if a > 7]
    for m in masks:
        best.append(min(sum(full[a] != full[b] for a, b in tree.edges()) for s in itertools.product((1, 2, 4, 8), repeat=len(inner)) for full in [dict(zip(inner, s, strict=True)) | {t + 1: x for t, x in enumerate(m)}]))
    assert L.fitch_scores(tree, masks).tolist() == best


def test_underflow_and_plan():
    tree = random_tree(300, generator(4), 1.0)
    masks = generator(5).choice([1, 2, 4, 8], (3, 300))
    assert np.isfinite(L.site_log_likelihoods(tree, L.jukes_cantor(), L.mask_vectors(masks, 4))).all()
    plan = L.Traversal.of(tree)
    assert len(plan.stale({1})) < len(plan.order) and plan.level[plan.order[0][0]] == 0


def test_distributed_scores(spark):
    masks = generator(6).choice([1, 2, 4, 8], (40, 6))
    tree = random_tree(6, generator(7))
    df = spark.createDataFrame([(i % 2, row.tolist(), i + 1) for i, row in enumerate(masks)], "part_id int, pattern array<int>, weight int")
    want = L.fitch_scores(tree, masks) * np.arange(1, 41)
    assert {r.part_id: r.score for r in L.parsimony(df, tree).collect()} == {0: want[::2].sum(), 1: want[1::2].sum()}
    lnl = L.site_log_likelihoods(tree, L.jukes_cantor(), L.mask_vectors(masks, 4)) * np.arange(1, 41)
    assert {r.part_id: r.lnl for r in L.log_likelihood(df, tree, {}, L.jukes_cantor()).collect()} == pytest.approx({0: lnl[::2].sum(), 1: lnl[1::2].sum()})


def test_parsimony_tree():
    masks = np.array([[1, 1, 2, 2, 4, 4]] * 3 + [[1, 1, 2, 2, 2, 2]] * 2 + [[1, 1, 1, 1, 4, 4]] * 2)
    tree = L.parsimony_tree(masks, np.ones(len(masks)), generator(1))
    assert frozenset({5, 6}) in tree.splits() or frozenset({3, 4}) in tree.splits()


def test_alignment(spark):
    rows = [(t + 1, s + 1, x) for t, seq in enumerate([[1, 1, 4], [1, 1, 4], [2, 2, 8]]) for s, x in enumerate(seq)]
    aln = spark.createDataFrame(rows, "taxon_id int, site int, state int")
    assert {tuple(r.pattern): r.weight for r in alignment.patterns(aln).collect()} == {(1, 1, 2): 2, (4, 4, 8): 1}
    cols = {"AAGG": (True, True), "AGTT": (True, False), "AAAG": (True, False), "AGCT": (False, False)}
    code = {c: alignment.DNA_CODES[c] for c in "ACGT"}
    rows = [(t + 1, s + 1, code[c]) for s, col in enumerate(cols) for t, c in enumerate(col)]
    aln = spark.createDataFrame(rows, "taxon_id int, site int, state int")
    for strict in (False, True):
        got = {r.site: r.informative for r in alignment.informative(aln, [1, 2, 4, 8], strict).collect()}
        assert [got[i + 1] for i in range(4)] == [v[strict] for v in cols.values()]
    f = spark.createDataFrame([(1, 30), (2, 10), (3, 20)], "state int, n long")
    got = {r.bit: r.frequency for r in alignment.frequencies(f, 2).collect()}
    assert got[0] + got[1] == pytest.approx(1) and got[0] == pytest.approx(0.75, abs=1e-3)


def test_protein_characters_are_masks():
    """Characters as they are read, with ambiguous ones, against a sum over all states."""
    n = 20
    rng = np.random.default_rng(6)
    model = L.reversible(rng.uniform(0.2, 2, 190), np.full(n, 1 / n), None)
    tree = parse_newick("(2:0.2,3:0.3,1:0.1);")
    columns = ["AAA", "WWW", "ANB", "DZB", "XA-", "---", "QEZ", "VYK"]
    masks = np.array([[alignment.AA_CODES[c] for c in x] for x in columns])
    got = L.site_log_likelihoods(tree, model, L.mask_vectors(masks, n))
    assert got == pytest.approx([brute(tree, model, m, n) for m in masks]) and np.isfinite(got).all()
    assert got[5] == pytest.approx(0)
    assert L.fitch_scores(tree, masks).tolist() == [0, 0, 1, 1, 0, 0, 1, 2]


def test_places_of_all_rows(spark):
    from pyspark.sql import functions as F

    from cladespark.operators.ranking import numbered

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), (F.col("id") % 3).alias("y"))
    got = numbered(df, [F.col("y").desc(), F.col("x")], parts=7).collect()
    assert [r.place for r in sorted(got, key=lambda r: (-r.y, r.x))] == list(range(5000))
    assert numbered(df.filter("false"), [F.col("x")]).count() == 0
