import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladespark.functions.density import generator
from cladespark.operators import consensus
from cladespark.operators.trees import Tree, edges_of, members, newick_splits, parse_newick, random_tree, splits_table, ultrametric_ages


def test_five_taxa():
    t = parse_newick("((3:0.1,4:0.1):0.2,(2:0.3,5:0.1):0.4,1:0.3):0.0;")
    assert t.splits() == {frozenset({3, 4}): 0.2, frozenset({2, 5}): 0.4}
    assert len(t.splits(trivial=True)) == 7
    assert t.total_length() == pytest.approx(1.5)


@pytest.mark.parametrize("text", ["((1,2),3);", "((1,2,3),4,5);", "((1,2),3,4)", "((1,),3,4);", "(1,2,9);"])
def test_refused(text):
    for parse in (parse_newick, newick_splits):
        with pytest.raises((ValueError, IndexError)):
            parse(text)


def test_names_and_missing_lengths():
    t = parse_newick("((b,c),[a note]a,'d');", names={"a": 1, "b": 2, "c": 3, "d": 4})
    assert set(t.splits()) == {frozenset({2, 3})}
    assert all(np.isnan(x) for x in t.splits().values())


@settings(max_examples=40, deadline=None)
@given(st.integers(4, 24), st.integers(0, 10_000))
def test_invariants(n, seed):
    rng = generator(seed)
    t = random_tree(n, rng)
    assert len(t.edges()) == 2 * n - 3
    assert len(t.splits()) == n - 3
    assert len(t.splits(trivial=True)) == 2 * n - 3
    again = parse_newick(t.newick())
    assert set(again.splits(True)) == set(t.splits(True))
    for side, x in t.splits(True).items():
        assert again.splits(True)[side] == pytest.approx(x)
    for trivial in (False, True):
        fast = {frozenset(members(m)): x for m, x in newick_splits(t.newick(), trivial)}
        assert set(fast) == set(t.splits(trivial)) and all(fast[s] == pytest.approx(x) for s, x in t.splits(trivial).items())
    for a, b in itertools.combinations(t.splits(), 2):
        assert consensus.fits(a, b)


@settings(max_examples=30, deadline=None)
@given(st.integers(5, 12), st.integers(0, 1000))
def test_moves(n, seed):
    rng = generator(seed, 1)
    t = random_tree(n, rng)
    before, length = set(t.splits(True)), t.total_length()
    moved, at, onto = next(iter(t.all_sprs(3)))
    back = t.spr(moved, at, onto)
    assert len(t.edges()) == 2 * n - 3 and t.total_length() == pytest.approx(length)
    t.spr(moved, at, back)
    assert set(t.splits(True)) == before
    e = t.inner_edges()[0]
    t.nni(e, 1)
    assert len(set(t.splits()) ^ {s for s in before if 1 < len(s) < n - 1}) <= 2
    t.tbr(e, t.edges()[0], t.edges()[-1]) if not set(e) & {*t.edges()[0], *t.edges()[-1]} else None
    assert len(t.edges()) == 2 * n - 3


def test_paths():
    t = parse_newick("((3,4),(2,5),1);")
    assert len(t.path(3, 5)) == 4
    assert t.path(3, 3) == []
    e = t.inner_edges()[0]
    assert t.by_distance(e, 0) == {e: 0}
    assert len(t.by_distance(e, 5)) == 7
    assert {x[3] for x in edges_of(t)} == {True, False}
    assert max(ultrametric_ages(t, generator(1))[1].values()) <= 1


def test_greedy_order():
    a, b, c = frozenset({2, 3}), frozenset({3, 4}), frozenset({5, 6})
    assert set(consensus.greedy([(a, 5), (b, 4), (c, 1)], [], 6)) == {a, c}
    assert set(consensus.greedy([(a, 5), (b, 4), (c, 1)], [], 6, compat=True)) == {b, c}


def test_consensus(spark):
    texts = ["((2:1,3:1):1,(4:1,5:1):1,1:1);"] * 3 + ["((2:1,4:1):1,(3:1,5:1):1,1:1);"]
    trees = spark.createDataFrame([(0, i, x) for i, x in enumerate(texts)], "file_id int, tree_id long, newick string")
    obs = splits_table(trees, trivial=True).cache()
    major = parse_newick_splits(consensus.consensus(obs, 5, "MR"))
    assert major == {"2,3", "4,5"}
    assert parse_newick_splits(consensus.consensus(obs, 5, "STRICT")) == set()
    half = spark.createDataFrame([(0, i, x) for i, x in enumerate(texts[:1] + texts[-1:])], "file_id int, tree_id long, newick string")
    tied = splits_table(half, trivial=True)
    assert parse_newick_splits(consensus.consensus(tied, 5, "MR")) == set()
    with pytest.raises(ValueError):
        consensus.threshold_of("40")
    assert "[&prob=" in consensus.consensus(obs, 5, "MR", annotated=True)
    assert consensus.nexus_document("(1,2,3);", {1: "a", 2: "b", 3: "c"}, "t").startswith("#NEXUS")


def parse_newick_splits(text):
    """Inner groups of a multifurcating tree."""
    out, stack, label = set(), [], ""
    i = 0
    while text[i] != ";":
        c = text[i]
        if c == "(":
            stack.append(set())
        elif c in ",)":
            if label:
                stack[-1].add(int(label))
            label = ""
            if c == ")":
                inside = stack.pop()
                if stack:
                    out.add(",".join(map(str, sorted(inside))))
                    stack[-1] |= inside
                while text[i + 1] not in ",();":
                    i += 1
                i += 1
                continue
        elif c == ":":
            while text[i + 1] not in ",)":
                i += 1
        else:
            label += c
        i += 1
    return out


def test_tree_copy_is_free():
    t = parse_newick("((3:1,4:1):1,2:1,1:1);")
    c = t.copy()
    c.set_length((1, 5), 9.0)
    assert t.length((1, 5)) == 1.0 and isinstance(c, Tree)
