"""Near-duplicates by SimHash: pigeonhole blocks join fingerprints that may be close, Hamming distance verifies them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, arrow_pass, durable, field, pieces
from .graph import members

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, unsigned: a bit is set if it is set in over half of the shingles' XXH64."""
    import xxhash

    digest = xxhash.xxh64_digest
    votes, total, carry = np.zeros(64, np.int64), 0, []
    for part in pieces(text) if len(text) > PIECE_BYTES else (text,):
        ws = carry + part.lower().split()
        if len(ws) >= words:
            line = b" ".join(ws)
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
            spans = list(zip(starts, ends[words - 1 :], strict=False))
            for i in range(0, len(spans), CHUNK):
                d = b"".join([digest(line[s:e], seed) for s, e in spans[i : i + CHUNK]])
                votes += np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(spans)
        carry = ws[-(words - 1) :] if words > 1 else []
    if not total:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), seed)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def of_hashes(h: np.ndarray) -> int:
    """The 64-bit SimHash of 64-bit hashes, unsigned: a bit is set if it is set in over half of them."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        votes += np.unpackbits(h[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long. Null and wordless texts have fingerprint 0."""

    def run(texts):
        return {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    return arrow_pass(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", [field("fp", "long")], run)


def block_masks(distance: int, spare: int = 2, mask: int = 0) -> list[int]:
    """Masks of block keys, as signed longs; each holds the bits of ``mask`` and some more.

    The bits that ``mask`` leaves are dealt into ``distance + spare`` blocks, and a key takes ``spare`` of them. Two
    fingerprints that differ in at most ``distance`` bits, none in ``mask``, leave at least ``spare`` blocks untouched,
    so they agree on one key.
    """
    n = distance + spare
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * i / n) for i in range(n + 1)]
    parts = [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    masks = [mask & (1 << 64) - 1 | sum(c) for c in combinations(parts, spare)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fingerprints: DataFrame, distance: int = 2, spare: int = 2, bucket: int = 64) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of the distinct fingerprints ``fp`` that differ in at most ``distance`` bits.

    Fingerprints meet in the buckets of their block keys, and members of a bucket are verified pair by pair. A bucket
    of over ``bucket`` members is not paired but split: its members agree on the key's bits, so the other bits are
    dealt into blocks again by the same pigeonhole rule, and so on, until buckets are small or no bits are left to
    deal (a bucket with r bits left has at most 2^r members). Each level is one aggregation and two equi-joins.
    """
    rows = fingerprints.select("fp", F.explode(F.array(*[F.lit(m) for m in block_masks(distance, spare)])).alias("mask"))
    masks, found = block_masks(distance, spare), None
    while True:
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = durable(keyed.join(sizes, ["mask", "key"]))
        splits = 64 - (masks[0] & (1 << 64) - 1).bit_count() > distance + spare
        small = shared.filter(F.col("n") <= bucket) if splits else shared
        x, y = small.alias("x"), small.alias("y")
        near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
        pairs = x.join(y, (F.col("x.mask") == F.col("y.mask")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        found = pairs if found is None else found.union(pairs)
        large = shared.filter(F.col("n") > bucket)
        if not splits or large.isEmpty():
            return found.distinct()
        below = {m: block_masks(distance, spare, m) for m in masks}
        masks = sorted({c for cs in below.values() for c in cs})
        # One row for each mask and its parts: 36 at the first split, six times as many at each other.
        table = fingerprints.sparkSession.createDataFrame([(m, c) for m, cs in below.items() for c in cs], "mask long, child long")
        rows = large.join(F.broadcast(table), "mask").select("fp", F.col("child").alias("mask")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Rows with equal fingerprints form a class, so copies are never paired; classes within ``distance`` bits are linked,
    and ``component_id`` is the smallest id that links reach. Null texts count as empty; texts without words have
    fingerprint zero and are linked like any other; repeated rows repeat in the result; different texts
    under one id are one document, whose links join; a row with a null id links like any other and
    gets the component of its class, unless no id is there to name it (then null); an empty table gives
    an empty result; other columns are ignored. Ids may be of any type that has an order.
    """
    fps = durable(fingerprints(docs, text, id_col, words))
    of = members(fps.select("doc_id", F.col("fp").alias("node")), links(fps.select("fp").distinct(), distance))
    return of.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows that repeat an id are
    one document and stay or go together; rows without an id, which no group can name, stay."""
    gone = near_duplicates(docs, text, id_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
