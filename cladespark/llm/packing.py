"""Token ids in packed binary rows: best-fit-decreasing with a segment tree over free capacities."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, bound_batches, text_steps

#: The tokenizer's vocabulary file, a line of base64 bytes and rank for each token; a parameter everywhere. The driver
#: reads it and broadcasts its bytes, so workers need no copy.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary expects texts to be split, a fixed value of its public definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH = 2048
#: Bytes that a vocabulary file may have.
VOCABULARY_BYTES = 64 << 20
#: Tokens that a task holds before it packs them, by default; packing is best-fit-decreasing within such a window.
WINDOW_TOKENS = 1 << 21
#: A text is encoded in slices of about so many characters, cut where the pattern always cuts.
SLICE = 1 << 20


def vocabulary_bytes(path: str) -> bytes:
    """The vocabulary file, by a local path of the driver; refused beyond VOCABULARY_BYTES, as it is broadcast."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """The tokenizer, loaded once in each worker from a broadcast vocabulary file (or its bytes)."""

    _loaded: dict[int, object] = {}

    def __init__(self, vocabulary=None):
        self.vocabulary = vocabulary_bytes(VOCABULARY) if vocabulary is None else vocabulary

    def encoding(self):
        raw = self.vocabulary if isinstance(self.vocabulary, bytes) else self.vocabulary.value
        key = zlib.crc32(raw)
        if key not in self._loaded:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines())}
            self._loaded[key] = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self._loaded[key]

    def encode(self, text: str, e=None) -> np.ndarray:
        e = e or self.encoding()
        parts = [e.encode_ordinary(t) for t in slices(text)]
        return np.fromiter((x for p in parts for x in p), np.int32, sum(map(len, parts))) if len(parts) > 1 else np.array(parts[0], np.int32)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a long text that encode to the same ids as the whole.

    The pattern always starts a new piece at a single space between two letters, so cuts are made there alone; a text
    without such places stays whole.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Capacities:
    """Open rows by free capacity, with a segment tree for the least capacity that is large enough."""

    def __init__(self, length: int):
        self.length = length
        self.leaves = 1 << length.bit_length()
        self.tree = bytearray(2 * self.leaves)  # whether a subtree has an open row
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        i = self.leaves + free
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least capacity of at least ``need``, the latest of such; it leaves the tree."""
        i = self.leaves + need
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.leaves
        row = self.rows[free].pop()
        if not self.rows[free]:
            self.tree[i] = 0
            while i > 1 and not self.tree[i ^ 1]:
                i >>= 1
                self.tree[i] = 0
        return row, free


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices; each row's sizes sum to at most ``length``, and no size may exceed it."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = open_rows.take(sizes[i])
        if got is None:
            rows.append([i])
            row, free = len(rows) - 1, length - sizes[i]
        else:
            row, free = got[0], got[1] - sizes[i]
            rows[row].append(i)
        if free:
            open_rows.put(row, free)
    return rows


NAMES = ["row_doc", "row_part", "row_copy", "n_tokens", "doc_ids", "parts", "cu_seqlens", "ids", "position_ids"]
KINDS = ["long", "int", "int", "int", "array<long>", "array<int>", "array<int>", "binary", "binary"]


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END, pad: int = END, window: int = WINDOW_TOKENS) -> DataFrame:
    """Rows of packed token ids, ``length`` each.

    Every text becomes its ids and an end token. One that is longer than a row is split into full rows and a rest, in
    order, and loses nothing. Segments are packed best-fit-decreasing within windows of ``window`` tokens, as they follow
    each other in a partition, in a single pass without a shuffle; so which rows share a window follows the splits of the input. ``ids`` is a row of the matrix, little-endian int32, padded with ``pad``; ``cu_seqlens`` are the
    bounds of its segments (from 0 to ``n_tokens``); ``position_ids`` restart at 0 in each segment and in the padding;
    ``doc_ids`` and ``parts`` tell whose part each segment is. ``row_doc``, ``row_part`` and ``row_copy`` name a row by
    its first segment (``row_copy`` counts repeats of a document within a window). Null and empty texts are an end
    token alone; repeated rows are packed as often; a null id stays null; an empty table gives no rows; other columns
    are ignored, whatever their names. Ids may be of any type, which ``row_doc`` and ``doc_ids`` have.
    """
    bound_batches(docs.sparkSession, 200)
    encoder = Encoder(docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary)))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    id_type, id_kind = source.schema["doc_id"].dataType.simpleString(), to_arrow_type(source.schema["doc_id"].dataType)
    names, kinds = NAMES, [id_type, "int", "int", "int", f"array<{id_type}>", *KINDS[5:]]

    def rows(held: list[tuple[int | None, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        packed = best_fit_decreasing([len(x[3]) for x in held], length)
        for at in range(0, len(packed), 256):
            out = []
            for row in packed[at : at + 256]:
                own = [held[i] for i in row]
                ids, pos, cu = np.full(length, pad, "<i4"), np.zeros(length, "<i4"), [0]
                for _, _, _, x in own:
                    lo, hi = cu[-1], cu[-1] + len(x)
                    ids[lo:hi], pos[lo:hi] = x, np.arange(len(x))
                    cu.append(hi)
                pos[cu[-1] :] = np.arange(length - cu[-1])
                out.append((own[0][0], own[0][1], own[0][2], cu[-1], [o[0] for o in own], [o[1] for o in own], cu, ids.tobytes(), pos.tobytes()))
            kinds = [id_kind, pa.int32(), pa.int32(), pa.int32(), pa.list_(id_kind), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, copies, e = [], 0, {}, encoder.encoding()
        for batch in batches:
            for step in text_steps(batch, "text"):
                for doc, b in zip(step.column("doc_id").to_pylist(), as_bytes(step, "text"), strict=True):
                    ids = np.append(encoder.encode(b.decode(), e), np.int32(end))
                    copy = copies[doc] = copies.get(doc, -1) + 1
                    for part, lo in enumerate(range(0, len(ids), length)):
                        held.append((doc, part, copy, ids[lo : lo + length]))
                    n += len(ids)
                    if n >= window:
                        yield from rows(held)
                        held, n, copies = [], 0, {}
        if held:
            yield from rows(held)

    return source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows through Spark's own writer, so that any store that Spark reaches can hold them."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def matrices(packed_rows: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids and positions as matrices, and the cumulative lengths, of some collected rows."""
    ids = np.stack([np.frombuffer(r.ids, "<i4") for r in packed_rows])
    return ids, np.stack([np.frombuffer(r.position_ids, "<i4") for r in packed_rows]), [np.array(r.cu_seqlens) for r in packed_rows]
