"""Trees: Newick text, edge lists, splits, moves and paths. A tree is a plain adjacency with a length per edge."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def edge(a: int, b: int) -> tuple[int, int]:
    """Edges have no direction."""
    return (a, b) if a < b else (b, a)


@dataclass
class Tree:
    """An unrooted tree; tips are 1 to ``n``, inner nodes follow. ``adj[a][b]`` is the length of the edge."""

    n: int
    adj: dict[int, dict[int, float]] = field(default_factory=dict)

    # Building.

    def link(self, a: int, b: int, length: float = float("nan")) -> None:
        self.adj.setdefault(a, {})[b] = length
        self.adj.setdefault(b, {})[a] = length

    def cut(self, a: int, b: int) -> float:
        self.adj[b].pop(a)
        return self.adj[a].pop(b)

    def copy(self) -> Tree:
        return Tree(self.n, {a: dict(x) for a, x in self.adj.items()})

    # Looking.

    def is_tip(self, a: int) -> bool:
        return a <= self.n

    def edges(self) -> list[tuple[int, int]]:
        return sorted({edge(a, b) for a, x in self.adj.items() for b in x})

    def inner_edges(self) -> list[tuple[int, int]]:
        return [e for e in self.edges() if not self.is_tip(e[0])]

    def length(self, e: tuple[int, int]) -> float:
        return self.adj[e[0]][e[1]]

    def set_length(self, e: tuple[int, int], value: float) -> None:
        self.adj[e[0]][e[1]] = self.adj[e[1]][e[0]] = value

    def has(self, e: tuple[int, int]) -> bool:
        return e[1] in self.adj.get(e[0], ())

    def around(self, node: int, but: int | None = None) -> list[int]:
        """Neighbours in order, without ``but``."""
        return [x for x in sorted(self.adj[node]) if x != but]

    def third(self, node: int, a: int, b: int) -> int:
        """The neighbour of an inner node besides two others."""
        (c,) = [x for x in self.adj[node] if x not in (a, b)]
        return c

    def total_length(self) -> float:
        return sum(map(self.length, self.edges()))

    def post_order(self, root: int, above: int | None = None) -> list[tuple[int, int | None]]:
        """``(node, parent)``, children before parents, away from ``above``."""
        out, stack = [], [(root, above)]
        while stack:
            a, p = stack.pop()
            out.append((a, p))
            stack += [(b, a) for b in self.around(a, p)]
        return out[::-1]

    def descendants(self, a: int, above: int) -> list[int]:
        """Nodes beyond ``a`` seen from ``above``, ``a`` included."""
        return [x for x, _ in self.post_order(a, above)]

    def tips_below(self, a: int, above: int) -> frozenset[int]:
        return frozenset(x for x in self.descendants(a, above) if self.is_tip(x))

    def depths(self, root: int) -> dict[int, int]:
        out = {root: 0}
        for a, p in reversed(self.post_order(root)):
            if p is not None:
                out[a] = out[p] + 1
        return out

    def longest_path(self, a: int, above: int) -> int:
        """Edges from ``a`` to its furthest tip."""
        far: dict[int, int] = {}
        for x, p in self.post_order(a, above):
            far[x] = max((far[y] + 1 for y in self.around(x, p)), default=0)
        return far[a]

    def path(self, a: int, b: int) -> list[tuple[int, int]]:
        """Edges from node ``a`` to node ``b``, in order."""
        up = dict(self.post_order(a))
        out = []
        while b != a:
            out.append(edge(b, up[b]))
            b = up[b]
        return out[::-1]

    def by_distance(self, e: tuple[int, int], most: int) -> dict[tuple[int, int], int]:
        """Edges within ``most`` steps of an edge."""
        out, front = {e: 0}, [e]
        for d in range(1, most + 1):
            front = list(dict.fromkeys(edge(a, b) for f in front for a in f for b in self.adj[a] if edge(a, b) not in out))
            out.update(dict.fromkeys(front, d))
        return out

    def splits(self, trivial: bool = False) -> dict[frozenset[int], float]:
        """Splits with their edge's length, each by the side without taxon 1; n-3, or 2n-3 with the trivial ones."""
        below: dict[int, frozenset[int]] = {}
        out: dict[frozenset[int], float] = {}
        for a, p in self.post_order(1):
            if p is None:
                continue
            below[a] = frozenset([a]) if self.is_tip(a) else frozenset().union(*(below[b] for b in self.around(a, p)))
            side, length = below[a], self.adj[a][p]
            if len(side) == self.n - 1:  # the edge of taxon 1 is the split of that taxon alone
                side = frozenset([1])
            if trivial or 1 < len(side) < self.n - 1:
                out[side] = length
        return out

    # Moves. Each gives a new state of the same tree; lengths go along with their edges.

    def prune(self, moved: int, at: int) -> tuple[int, int]:
        """Take the subtree of ``moved`` (with its node ``at``) out and join the two edges it hung on."""
        a, b = self.around(at, moved)
        self.link(a, b, self.cut(at, a) + self.cut(at, b))
        return edge(a, b)

    def graft(self, at: int, e: tuple[int, int], share: float = 0.5) -> None:
        """Put a pruned node back onto an edge."""
        length = self.cut(*e)
        self.link(at, e[0], length * share)
        self.link(at, e[1], length * (1 - share))

    def spr(self, moved: int, at: int, onto: tuple[int, int]) -> tuple[int, int]:
        """Prune and regraft; the edge to regraft onto for the way back."""
        back = self.prune(moved, at)
        self.graft(at, onto)
        return back

    def spr_targets(self, moved: int, at: int, depth: int) -> list[tuple[int, int]]:
        """Edges that the subtree can be regrafted onto within ``depth`` steps of where it hangs."""
        a, b = self.around(at, moved)
        out: list[tuple[int, int]] = []
        stack = [(a, at, 1), (b, at, 1)]
        while stack:
            x, before, d = stack.pop()
            for y in self.around(x, before):
                out.append(edge(x, y))
                if d < depth:
                    stack.append((y, x, d + 1))
        return sorted(set(out))

    def all_sprs(self, depth: int | None = None) -> Iterator[tuple[int, int, tuple[int, int]]]:
        """Every move ``(moved, at, onto)``."""
        for at in sorted(self.adj):
            if not self.is_tip(at):
                for moved in self.around(at):
                    for onto in self.spr_targets(moved, at, depth or len(self.adj)):
                        yield moved, at, onto

    def nni(self, e: tuple[int, int], which: int = 0) -> None:
        """Swap a neighbour of one end of an inner edge with one of the other."""
        a, b = e
        x, y = self.around(a, b)[0], self.around(b, a)[which]
        lx, ly = self.cut(a, x), self.cut(b, y)
        self.link(a, y, ly)
        self.link(b, x, lx)

    def tbr(self, e: tuple[int, int], onto_a: tuple[int, int], onto_b: tuple[int, int]) -> None:
        """Bisect at an inner edge and join an edge of each part: up to two regrafts at the edge's ends."""
        a, b = e
        for at, moved, onto in ((a, b, onto_a), (b, a, onto_b)):
            if at not in onto:
                self.spr(moved, at, onto)

    # Text.

    def newick(self, lengths: bool = True, names: dict[int, str] | None = None, root: int | None = None) -> str:
        """Written from an inner node, taxon 1's neighbour unless told, taxon 1 last."""
        root = root or next(iter(self.adj[1]))
        text: dict[int, str] = {}
        for a, p in self.post_order(root):
            own = (names or {}).get(a, str(a)) if self.is_tip(a) else "(" + ",".join(text[b] for b in sorted(self.around(a, p), key=lambda b: (b == 1, b))) + ")"
            text[a] = own + (f":{self.adj[a][p]:.10g}" if lengths and p is not None and self.adj[a][p] == self.adj[a][p] else "")
        return text[root] + (":0.0;" if lengths else ";")


def parse_newick(text: str, names: dict[str, int] | None = None, n: int | None = None) -> Tree:
    """A tree from Newick text without recursion.

    Labels are taxon numbers, or names looked up in ``names``. Every inner group must have two members, the outermost
    three; inner nodes are numbered from n+1 as they open. Missing lengths are nan; comments in brackets are skipped.
    """
    text = text.strip()
    tokens: list[str] = []
    at, size = 0, len(text)
    while at < size:
        c = text[at]
        if c == "[":
            at = text.index("]", at) + 1
        elif c in "(),:;":
            tokens.append(c)
            at += 1
        elif c.isspace():
            at += 1
        elif c == "'":
            end = text.index("'", at + 1)
            tokens.append(text[at + 1 : end])
            at = end + 1
        else:
            end = at
            while end < size and text[end] not in "(),:;[" and not text[end].isspace():
                end += 1
            tokens.append(text[at:end])
            at = end
    labels = [t for i, t in enumerate(tokens) if t not in "(),:;" and i and tokens[i - 1] in "(,"]
    n = n or len(labels)
    tree, opened, group = Tree(n), n, []
    members: list[list[tuple[int, float]]] = []
    node, length, done = None, float("nan"), False

    def label(t: str) -> int:
        got = names[t] if names is not None else int(t)
        if not 1 <= got <= n:
            raise ValueError(f"no taxon {t}")
        return got

    i = 0
    while i < len(tokens) and not done:
        t = tokens[i]
        if t == "(":
            opened += 1
            group.append(opened)
            members.append([])
        elif t in ",)":
            if node is None:
                raise ValueError("an empty member")
            members[-1].append((node, length))
            node, length = None, float("nan")
            if t == ")":
                own, inside = group.pop(), members.pop()
                want = 2 if group else 3
                if len(inside) != want:
                    raise ValueError(f"a group of {len(inside)} where {want} are expected")
                for child, x in inside:
                    tree.link(own, child, x)
                node = own
        elif t == ":":
            i += 1
            length = float(tokens[i])
        elif t == ";":
            done = True
        elif node is None:
            node = label(t)
        i += 1
    if group or not done:
        raise ValueError("the text ends within a tree")
    return tree


_PIECE = re.compile(r"[(),;]|:[^(),;]*|[^(),:;]+")
_NOTE = re.compile(r"\[[^\]]*\]|\s")


def newick_splits(text: str, trivial: bool = False) -> list[tuple[int, float]]:
    """Splits of a tree with numbered taxa as bit masks (taxon t is bit t - 1) with lengths, in one pass over the text
    and without building the tree. The sides and the demands on the text are those of ``parse_newick``."""
    found: list[tuple[int, float]] = []
    groups: list[list[int]] = []  # mask and number of members of the open groups
    mask, length, done = 0, math.nan, False
    for t in _PIECE.findall(_NOTE.sub("", text)):
        c = t[0]
        if c == "(":
            groups.append([0, 0])
        elif c == ":":
            length = float(t[1:])
        elif c in ",)":
            if not mask:
                raise ValueError("an empty member")
            found.append((mask, length))
            top = groups[-1]
            if top[0] & mask:
                raise ValueError("a taxon stands twice")
            top[0] |= mask
            top[1] += 1
            mask, length = 0, math.nan
            if c == ")":
                mask, members = groups.pop()
                if members != (2 if groups else 3):
                    raise ValueError(f"a group of {members}")
        elif c == ";":
            done = True
            break
        elif not mask:
            mask = 1 << (int(t) - 1)
    if groups or not done:
        raise ValueError("the text ends within a tree")
    n = mask.bit_count()
    full = (1 << n) - 1
    if mask != full:
        raise ValueError("taxa are not 1 to n")
    out = []
    for side, x in found:
        if side & 1 and side != 1:
            side ^= full
        elif side == full ^ 1:
            side = 1
        if trivial or 1 < side.bit_count() < n - 1:
            out.append((side, x))
    return out


def members(mask: int) -> list[int]:
    """Taxa of a mask, in order."""
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length())
        mask ^= low
    return out


def edges_of(tree: Tree, root: int | None = None) -> list[tuple[int, int, float, bool, int]]:
    """``(parent, child, length, is_tip, depth)`` from the outermost node down."""
    root = root or next(iter(tree.adj[1]))
    depth = tree.depths(root)
    return [(p, a, tree.adj[a][p], tree.is_tip(a), depth[a]) for a, p in reversed(tree.post_order(root)) if p is not None]


def splits_table(trees: DataFrame, newick: str = "newick", keys: tuple[str, ...] = ("file_id", "tree_id"), trivial: bool = False, with_length: bool = True) -> DataFrame:
    """``keys, split, length``: every split of every tree, in one pass of Arrow batches. Filter trees before this, as
    what is parsed cannot be skipped later; without ``with_length`` the column is left out."""
    kinds = ", ".join(f"`{k}` {trees.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            row, sides, lengths = [], [], []
            for i, text in enumerate(batch.column(newick).to_pylist()):
                for mask, x in newick_splits(text, trivial) if text else ():
                    if mask not in known:
                        if len(known) >= 100_000:
                            known.clear()
                        known[mask] = members(mask)
                    row.append(i)
                    sides.append(known[mask])
                    lengths.append(x)
            cols = [batch.column(k).take(pa.array(row, pa.int64())) for k in keys] + [pa.array(sides, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(lengths, pa.float64())] * with_length, names=[*keys, "split", *["length"] * with_length])

    return trees.select(*keys, newick).mapInArrow(run, f"{kinds}, split array<int>" + ", length double" * with_length)


def edges_table(trees: DataFrame, newick: str = "newick", keys: tuple[str, ...] = ("file_id", "tree_id")) -> DataFrame:
    """``keys, parent, child, length, is_tip, depth``."""
    kinds = ", ".join(f"`{k}` {trees.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*k, *e) for *k, text in pdf.itertuples(index=False) if text for e in edges_of(parse_newick(text))]
            yield pd.DataFrame(rows, columns=[*keys, "parent", "child", "length", "is_tip", "depth"])

    return trees.select(*keys, newick).mapInPandas(run, f"{kinds}, parent int, child int, length double, is_tip boolean, depth int")


# Random trees.


def random_tree(n: int, rng: np.random.Generator, mean: float = 0.1) -> Tree:
    """Stepwise insertion of taxa at uniformly drawn edges."""
    order = (rng.permutation(n) + 1).tolist()
    tree = Tree(n)
    centre = n + 1
    for a in order[:3]:
        tree.link(centre, a)
    for k, a in enumerate(order[3:]):
        es = tree.edges()
        e = es[int(rng.integers(len(es)))]
        at = n + 2 + k
        tree.cut(*e)
        tree.link(at, e[0])
        tree.link(at, e[1])
        tree.link(at, a)
    for e in tree.edges():
        tree.set_length(e, float(rng.exponential(mean)))
    return tree


def draw_edge(tree: Tree, rng: np.random.Generator, inner: bool = False) -> tuple[int, int]:
    es = tree.inner_edges() if inner else tree.edges()
    return es[int(rng.integers(len(es)))]


def draw_subtree(tree: Tree, rng: np.random.Generator) -> tuple[int, int]:
    """``(moved, at)``: a subtree hanging on an inner node, all equally likely."""
    at = tree.n + 1 + int(rng.integers(tree.n - 2))
    around = tree.around(at)
    return around[int(rng.integers(3))], at


def ultrametric_ages(tree: Tree, rng: np.random.Generator) -> tuple[tuple[int, int], dict[int, float]]:
    """A root edge drawn uniformly and node ages: tips 0, the root 1, inner nodes even steps in between by height."""
    e = draw_edge(tree, rng)
    a, b = e
    height = {x: tree.longest_path(x, p) for start, other in ((a, b), (b, a)) for x, p in [(y, q if q is not None else other) for y, q in tree.post_order(start, other)]}
    top = max(height.values()) + 1
    return e, {x: h / top for x, h in height.items()} | {0: 1.0}
