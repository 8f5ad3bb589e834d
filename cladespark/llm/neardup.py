"""Near-duplicates at a shingle similarity: SimHash blocks and then MinHash bands bring texts together, exact Jaccard of
five-word shingles links them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import PIECE_BYTES, arrow_pass, durable, field, grams, hot_join, pieces
from .graph import components, members

WORDS = 5
SIMILARITY = 0.8
#: Fingerprints of five-word shingles that differ in at most so many bits are candidates. Texts of similarity 0.8 differ in
#: more bits than blocks can find (9.7 on average); bands find the links beyond.
DISTANCE = 3
#: A text has BANDS keys of ROWS minima. Two texts of similarity s share none with probability (1 - s ** ROWS) ** BANDS:
#: 7 in a million at 0.8, less above.
BANDS, ROWS = 30, 5
#: Members of a bucket that one chunk of it holds.
CHUNK = 1024
_MULTIPLIERS = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)


def word_codes(text: bytes) -> np.ndarray:
    """The XXH64 of each lower-cased word (A-Z), the same in all processes."""
    import xxhash

    code = xxhash.xxh64_intdigest
    parts = [p.lower().split() for p in (pieces(text) if len(text) > PIECE_BYTES else (text,))]
    return np.concatenate([np.fromiter(map(code, ws), np.uint64, len(ws)) for ws in parts])


def shingles(codes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Distinct shingles in order; a text of fewer words is one shingle of its own."""
    return np.unique(grams(codes, words))


def bands(s: np.ndarray) -> list[int]:
    """The keys of a set of shingles."""
    import xxhash

    if not len(s):
        return []
    low = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    s = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 512):
        np.minimum(low, np.multiply.outer(s[i : i + 512], _MULTIPLIERS).min(0), out=low)
    return [xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]


def _node(codes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(codes.tobytes())


def _long(x) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _marks(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(doc_id, node, fp, keys)``: texts of the same words are one node, ``fp`` is the SimHash of its shingles."""

    def run(texts):
        codes = [word_codes(t) for t in texts]
        sets = [shingles(c) for c in codes]
        return {"node": _long([_node(c) for c in codes]), "fp": _long([simhash.of_hashes(s) for s in sets]), "keys": pa.array([_long(bands(s)) for s in sets], pa.list_(pa.int64()))}

    return arrow_pass(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", [field("node", "long"), field("fp", "long"), field("keys", "array<bigint>")], run)


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """``(node, set)``: the hashes of the distinct shingles."""

    def run(texts):
        codes = [word_codes(t) for t in texts]
        return {"node": _long([_node(c) for c in codes]), "set": pa.array([shingles(c).view(np.int64) for c in codes], pa.list_(pa.int64()))}

    return arrow_pass(docs.select(F.col(text).alias("text")), [], "text", [field("node", "long"), field("set", "array<bigint>")], run)


def similar(x: str, y: str, similarity: float) -> Column:
    """Whether two sets have a Jaccard similarity of at least so much. Sets of too different sizes are not looked into."""
    n, m = F.size(x), F.size(y)
    common = F.size(F.array_intersect(x, y))
    return F.when(F.least(n, m) >= F.greatest(n, m) * similarity, common / (n + m - common) >= similarity).otherwise(False)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingles are at least that similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.filter(similar("x", "y", similarity)).select("a", "b")


def _pair(x: str | Column, y: str | Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def close(marks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``(a, b)`` of nodes by SimHash. Nodes of one fingerprint are a class, and each is paired with the smallest of
    its class; classes whose fingerprints differ in at most ``distance`` bits, found by blocks and verified by Hamming
    distance, are paired by their smallest nodes."""
    nodes = durable(marks.select("node", "fp").distinct())
    classes = durable(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    copies = hot_join(nodes, classes, "fp", "n").filter("node <> least").select(*_pair("node", "least"))
    near = simhash.links(classes.select("fp"), distance)
    ends = [classes.select(F.col("fp").alias(e), F.col("least").alias(f"least_{e}")) for e in "ab"]
    return copies.union(near.join(ends[0], "a").join(ends[1], "b").select(*_pair("least_a", "least_b")))


def links(marks: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that join all nodes that are close by SimHash or meet in a bucket, and are similar, into
    their components.

    First the pairs close by SimHash are verified, and each member of a bucket is held against one centre, another in
    each bucket, which takes a linear number of pairs and joins most groups. Then the pairs of a bucket that are still in different components are held against
    each other, all of them: members outside the bucket's largest component meet its other members chunk by chunk.
    """
    rows = marks.groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("centre")).filter("n > 1")
    shared = durable(rows.join(sizes, "key"))
    near = durable(close(marks))
    met = shared.select("node").union(near.select("a")).union(near.select("b")).distinct()
    held = durable(sets.join(met, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))
    stars = durable(near.union(shared.filter("node <> centre").select(*_pair("node", "centre"))).distinct())
    first = durable(_verified(stars, held, similarity))
    of = components(first)
    placed = shared.join(of, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    parts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max_by("c", F.struct("m", "c")).alias("big")).filter("k > 1").select("key", "big")
    # Members bring their sets along, and pairs are verified within the join, so that it gives links and no candidates. A pair is
    # looked at in one of the buckets that it shares.
    keys = marks.groupBy("node").agg(F.first("keys").alias("keys"))
    whole = placed.join(mixed, "key").select("node", "c", F.struct("key", "n", "big").alias("in")).groupBy("node", "c").agg(F.collect_list("in").alias("in")).join(keys, "node").join(held, "node")
    left = durable(whole.select("node", "c", "keys", "set", F.explode("in").alias("in")).select("node", "c", "keys", "set", "in.*"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    x = left.filter("c <> big").select("key", "big", F.col("node").alias("p"), F.col("c").alias("pc"), F.col("keys").alias("pk"), F.col("set").alias("ps"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    y = left.select(F.col("key").alias("qkey"), F.col("node").alias("q"), F.col("c").alias("qc"), F.col("keys").alias("qk"), F.col("set").alias("qs"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("qchunk"))
    once = F.array_min(F.array_intersect("pk", "qk")) == F.col("key")
    meet = (F.col("key") == F.col("qkey")) & (F.col("chunk") == F.col("qchunk")) & F.expr("pc <> qc and (qc = big or p < q)") & once & similar("ps", "qs", similarity)
    second = x.join(y.hint("merge"), meet).select(*_pair("p", "q")).distinct()
    return first.union(durable(second))


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)`` for each row of ``docs``: rows are linked if the sets of their five-word shingles have
    a Jaccard similarity of ``similarity`` or more, and ``component_id`` is the smallest id that links reach.

    Words are lower-cased (A-Z) runs without ASCII white space. Null texts count as empty, and texts without words are
    copies of one another; texts of fewer than five words are linked to those of the same words alone. Different texts
    under one id are one document, whose links join; a row with a null id has its group's component, null if no id
    names it.
    """
    marks = durable(_marks(docs, text, id_col))
    found = links(marks, _sets(docs, text), similarity)
    return members(marks.select("doc_id", "node"), found).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows that repeat an id are
    one document and stay or go together; rows without an id, which no group can name, stay."""
    gone = groups(docs, text, id_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
