"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_pass, durable, field, grams, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, in BLOCKS blocks of 64.
BITS, BLOCKS = 256, 4
#: Bits that the fingerprints of a window and an item may differ in. Fingerprints are of (shingle, occurrence number),
#: whose sets have the Jaccard similarity of the bags, repeats counted. At 0.8 the bits differ independently with
#: probability acos(8/9)/pi = 0.15, so 256 bits differ in 38.8 on average (deviation 5.7), and over 66 do once in a
#: million windows. Two that differ in at most 66 differ in at most 16 bits in one of the four blocks; unlike texts, whose
#: bits differ by a coin's toss, are that close in one of the blocks in 0.02 % of all pairs.
RADIUS = 66
#: Bytes of benchmark text that one pass over the documents carries; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20


def _bits(h: np.ndarray) -> np.ndarray:
    """A row of BITS entries +1 or -1 per hash."""
    words = np.empty((len(h), BLOCKS), ">u8")
    with np.errstate(over="ignore"):
        for k in range(BLOCKS):
            x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
            for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
            words[:, k] = x ^ (x >> np.uint64(31))
    return np.unpackbits(words.view(np.uint8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)


def _fold(votes: np.ndarray) -> np.ndarray:
    """Fingerprint blocks, BLOCKS words for each row of votes."""
    return np.packbits(votes > 0, axis=1).view(np.uint64)


def _numbered(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of shingles with their occurrence numbers; the first occurrence has the shingle's own."""
    with np.errstate(over="ignore"):
        x = g + (n - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return np.where(n > 1, x ^ (x >> np.uint64(31)), g)


def window_votes(g: np.ndarray, wide: int) -> np.ndarray:
    """Votes of each window of ``wide`` shingles of ``g``, whose n-th occurrence of a shingle counts as an element of
    its own.

    A step takes out the last of the numbers that the leaving shingle had, and adds one above those that the entering
    shingle has, so sums of steps give every window.
    """
    m = len(g)
    kinds, kind = np.unique(g, return_inverse=True)
    if len(kinds) == m:
        total = np.zeros((m + 1, BITS), np.int32)
        np.cumsum(_bits(g), axis=0, dtype=np.int32, out=total[1:])
        return total[wide:] - total[:-wide]
    place = kind.astype(np.int64) * (m + 1) + np.arange(m)  # sorted by shingle, then position
    order = np.sort(place)
    upto = lambda k, p: np.searchsorted(order, k.astype(np.int64) * (m + 1) + p)
    at = np.arange(m)
    here = upto(kind, at)
    entering = here + 1 - upto(kind, np.maximum(at - wide + 1, 0))  # with itself, in the window that ends here
    last = m - wide
    leaving = upto(kind[:last], at[:last] + wide) - here[:last]
    out = np.empty((last + 1, BITS), np.int32)
    out[0] = _bits(_numbered(g[:wide], entering[:wide])).sum(0, dtype=np.int32)
    np.subtract(_bits(_numbered(g[wide:], entering[wide:])), _bits(_numbered(g[:last], leaving)), out=out[1:], dtype=np.int32)
    return np.cumsum(out, axis=0, out=out)


class Index:
    """The items of one pass: their shingles and fingerprints, the items of each size together.

    A window is a candidate for an item of its size if one of the blocks of their fingerprints differs in at most RADIUS //
    BLOCKS bits. Any within RADIUS bits in all are, by the pigeonhole rule. ``looked`` and ``met`` count the pairs of a window
    and an item that were compared, and those that became candidates.
    """

    def __init__(self, items: list[tuple[int, bytes]], words: int = WORDS):
        self.words = words
        kept = [(i, h) for i, t in items if len(h := word_hashes(t.lower()))]
        self.ids = [i for i, _ in kept]
        self.size = np.array([len(h) for _, h in kept], np.int64)
        shingles = [grams(h, words) for _, h in kept]
        self.bags = [np.unique(s, return_counts=True) for s in shingles]
        n = len(kept)
        fp = [_fold(window_votes(s, len(s))) for s in shingles]
        self.of_size = {int(n): np.flatnonzero(self.size == n) for n in set(self.size.tolist())}
        self.fp = {n: np.concatenate([fp[k] for k in ks]) for n, ks in self.of_size.items()}
        self.looked = self.met = 0
        self.keys = np.unique(np.concatenate([s for s, _ in self.bags])) if n else np.zeros(0, np.uint64)
        owner: dict[int, list[int]] = {}
        for k, (s, _) in enumerate(self.bags):
            for x in s.tolist():
                owner.setdefault(x, []).append(k)
        self.owner = owner
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.short = {int(self.size[k]) for k in range(n) if self.size[k] < words}

    def seeds(self, g: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item has."""
        at = np.flatnonzero(self.sieve[(g >> np.uint64(42)).astype(np.int64)])
        if len(at):
            place = np.searchsorted(self.keys, g[at])
            at = at[self.keys[np.minimum(place, len(self.keys) - 1)] == g[at]]
        return at

    def hits(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that a window of its size matches.

        Only windows that share a shingle with an item can resemble it, so windows are formed around those shingles.
        """
        h = word_hashes(text.lower())
        if not len(h) or not self.ids:
            return []
        best: dict[int, tuple[float, int, int]] = {}
        for n in sorted({self.words, *self.short}):  # items of fewer words than a shingle are one shingle of their own
            if len(h) < n:
                n = len(h)
                if n not in self.short:
                    continue
            g = grams(h, n)
            at = self.seeds(g)
            if not len(at):
                continue
            if n < self.words:
                for p in at.tolist():
                    for k in self.owner[int(g[p])]:
                        if self.size[k] == n:
                            best.setdefault(k, (1.0, p, n))
                continue
            wanted: dict[int, set[int]] = {}  # places of seeds by window size, in words
            for p in at.tolist():
                for k in self.owner[int(g[p])]:
                    if self.size[k] >= self.words:
                        wanted.setdefault(int(self.size[k]), set()).add(p)
            for size, places in wanted.items():
                self._windows(g, size, np.array(sorted(places)), best)
        return [(self.ids[k], p, n, s) for k, (s, p, n) in best.items()]

    def _windows(self, g: np.ndarray, size: int, places: np.ndarray, best: dict) -> None:
        wide = size - self.words + 1
        if len(g) < wide:  # the text is shorter than the item: one window, the whole text
            starts, wide = np.zeros(1, np.int64), len(g)
        else:
            mark = np.zeros(len(g) + 1, np.int64)
            np.add.at(mark, np.maximum(places - wide + 1, 0), 1)
            np.add.at(mark, places + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            starts = starts[starts <= len(g) - wide]
            starts = np.union1d(starts, [len(g) - wide]) if len(places) and places[-1] > len(g) - wide else starts
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > wide) + 1):
            for i in range(0, len(part), 1024):
                self._verify(g, size, wide, part[i : i + 1024], best)

    def _verify(self, g: np.ndarray, size: int, wide: int, starts: np.ndarray, best: dict) -> None:
        lo, hi = int(starts[0]), int(starts[-1]) + wide
        fp = _fold(window_votes(g[lo:hi], wide)[starts - lo])
        own, items = self.fp[size], self.of_size[size]
        for at in range(0, len(items), 256):  # 1,024 windows by 256 items at a time
            apart = np.bitwise_count(fp[:, None, :] ^ own[None, at : at + 256, :])
            w, k = np.nonzero((apart <= RADIUS // BLOCKS).any(2))
            self.looked += apart.shape[0] * apart.shape[1]
            self.met += len(w)
            close = apart[w, k].sum(1, dtype=np.int64) <= RADIUS
            for i, j in zip(w[close].tolist(), items[at + k[close]].tolist(), strict=True):
                s = int(starts[i])
                similar = self.similarity(g[s : s + wide], j)
                if similar >= SIMILARITY and similar > best.get(j, (0.0,))[0]:
                    best[j] = (similar, s, wide + self.words - 1)

    def similarity(self, window: np.ndarray, k: int) -> float:
        """Weighted Jaccard of the bags of shingles."""
        a, n = np.unique(window, return_counts=True)
        b, m = self.bags[k]
        _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        common = int(np.minimum(n[x], m[y]).sum())
        return common / (int(n.sum()) + int(m.sum()) - common)


class _Lazy:
    """Builds the index once in each worker, since word hashes belong to a process."""

    def __init__(self, shared):
        self.shared, self.index = shared, None

    def __getstate__(self):
        return self.shared, None

    def __setstate__(self, state):
        self.shared, self.index = state

    def get(self) -> Index:
        if self.index is None:
            self.index = Index(self.shared.value)
        return self.index


def _passes(benchmark: DataFrame, text: str, id_col: str) -> Iterator[tuple[_Lazy, bool]]:
    """The benchmark in parts of bounded size, each broadcast for one pass, and whether it is the only one. A part is
    read when it is asked for, and its broadcast goes when the next one is, so the driver holds one at a time."""
    items = benchmark.select(F.col(id_col).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = int(size // PASS_BYTES) + 1
    sc = benchmark.sparkSession.sparkContext
    for k in range(n):
        part = sc.broadcast([(r.i, r.t.encode()) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toLocalIterator()])
        yield _Lazy(part), n == 1
        if n > 1:
            part.unpersist()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(doc_id, item_id, start_word, window_words, similarity)``: a row per document row and benchmark item that a
    window of it resembles, with the best such window (the first of equals).

    A window has as many words as the item (or is the whole text, where that is shorter); words are lower-cased
    (A-Z) runs without ASCII white space; its five-word shingles, repeats counted, have a weighted Jaccard similarity of
    0.8 or more with the item's. Items of fewer than five words match where they stand word by word. Null texts are
    empty and never match, nor do items without words; repeated document rows repeat their rows. The benchmark is read
    to the driver in parts of at most PASS_BYTES by a hash of the item, and each part makes one pass without a shuffle.
    """
    kind = benchmark.schema[item_id].dataType
    fields = [field("hits", f"array<struct<item_id:{kind.simpleString()},start_word:int,window_words:int,similarity:double>>"), field("any", "boolean")]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for lazy, alone in _passes(benchmark, item_text, item_id):

        def run(texts, lazy=lazy):
            index = lazy.get()
            rows = [[dict(zip(("item_id", "start_word", "window_words", "similarity"), h, strict=True)) for h in index.hits(t)] for t in texts]
            return {"hits": _hit_array(rows, to_arrow_type(kind)), "any": [bool(r) for r in rows]}

        part = arrow_pass(source, ["doc_id"], "text", fields, run, only="any")
        part = part if alone else durable(part)
        out = part if out is None else out.union(part)
    return out.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def _hit_array(rows, kind):
    import pyarrow as pa

    return pa.array(rows, pa.list_(pa.struct([("item_id", kind), ("start_word", pa.int32()), ("window_words", pa.int32()), ("similarity", pa.float64())])))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold a window like a benchmark item; all columns pass through unchanged. Null and
    empty texts stay; repeated rows stay or go together; an empty benchmark drops nothing. A benchmark of several parts is
    one pass each, cut off by a checkpoint."""
    out = docs
    for lazy, alone in _passes(benchmark, item_text, item_id):
        out = arrow_pass(out, docs.columns, text, [field("__clean", "boolean")], lambda texts, lazy=lazy: {"__clean": [not lazy.get().hits(t) for t in texts]}, only="__clean")
        out = out if alone else durable(out)
    return out
