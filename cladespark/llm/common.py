"""Helpers shared by the corpus operators: Arrow passes over texts, word hashing, durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these six ASCII characters; bytes.split() uses the same set.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = rb"\x20\x09-\x0D"
#: Bytes of text that one step of an Arrow pass holds at a time (a longer text makes a step of its own).
STEP_BYTES = 8 << 20
#: Texts above this are taken apart at white space while their words are hashed.
PIECE_BYTES = 4 << 20

MASK = (1 << 64) - 1
_GRAM = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder beside the checkpoints, in the folder that all machines share."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> None:
    """Have a checkpoint folder: the session's, or a temporary one where no other machine takes part, as in tests."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clade-ckpt-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process, as in
    tests, a local temporary folder is used. On a cluster a missing setting is an error. The shuffle files behind the
    checkpoint go once it is written.
    """
    _checkpoint_dir(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query made here, so that the setting is its own


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run in here remove their shuffle files when they end. Otherwise these stay until the
    driver happens to collect its garbage, and an operator of many steps has those of all of them on disk."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def first_row(df: DataFrame) -> Row | None:
    """``df.first()``, without leaving shuffle files behind."""
    with _shuffles_removed(df.sparkSession):
        return df.select("*").first()


#: A key with over one in so many rows is hot. There are fewer hot keys than this, however the rows are dealt.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has a row for each ``key`` and in ``weight`` the number of rows
    that ``left`` has of it.

    Keys with over a thousandth of all rows are fewer than a thousand, so these rows of ``right`` are broadcast; all other
    keys meet in a shuffle, where none is large. ``left`` is read twice and should be durable or cheap. The column
    ``weight`` does not come with the result, unless ``left`` has one of that name.
    """
    total = first_row(right.agg(F.sum(weight)))[0] or 0
    hot = right.filter(F.col(weight) * HOT_SHARE > total).drop(weight)
    cold = right.filter(F.col(weight) * HOT_SHARE <= total).drop(weight)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).select(rest.columns).union(rest)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def pieces(b: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in slices that end at white space, so that no word is cut."""
    at, n = 0, len(b)
    while n - at > size:
        cut = at + size
        while cut < n and b[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield b[at:cut]
        at = cut
    yield b[at:] if at else b


def word_hashes(b: bytes) -> np.ndarray:
    """A 64-bit hash per word, the same for equal words within one process."""
    if len(b) <= PIECE_BYTES:
        return _hashes(b.split())
    return np.concatenate([_hashes(p.split()) for p in pieces(b)])


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, repeats included; fewer words make one window, none make none."""
    if not len(h):
        return h
    k = max(1, len(h) - n + 1)
    out = np.zeros(k, np.uint64)
    mul = 1
    with np.errstate(over="ignore"):
        for i in range(min(n, len(h))):
            out += h[i : i + k] * np.uint64(mul)
            mul = mul * _GRAM & MASK | 1
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def text_steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most STEP_BYTES of text."""
    col = batch.column(text)
    sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), float))
    at, held = 0, 0.0
    for i, s in enumerate(sizes):
        if i > at and held + s > STEP_BYTES:
            yield batch.slice(at, i - at)
            at, held = i, 0.0
        held += s
    if at < batch.num_rows:
        yield batch.slice(at)


def as_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The texts in UTF-8; null counts as the empty text."""
    return [x or b"" for x in batch.column(text).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def arrow_pass(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField], fn: Callable, only: str | None = None) -> DataFrame:
    """One streaming Arrow pass without a shuffle.

    ``fn`` gets a list of texts in bytes and gives a dict of arrays, one for each of ``fields``. The result holds the
    columns ``keep`` and then ``fields``; with ``only``, just the rows where that boolean field is true, without it.
    """
    bound_batches(df.sparkSession)
    new = [f for f in fields if f.name != only]
    schema = T.StructType([df.schema[k] for k in keep] + new)
    source = df.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for step in text_steps(batch, text):
                got = fn(as_bytes(step, text))
                cols = [step.column(k) for k in keep] + [pa.array(got[f.name]) if not isinstance(got[f.name], pa.Array) else got[f.name] for f in new]
                cols = [c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, target, strict=True)]
                out = pa.RecordBatch.from_arrays(cols, names=target.names)
                yield out.filter(pa.array(got[only])) if only else out

    return source.mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def only_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns alone; a missing one is null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names])
