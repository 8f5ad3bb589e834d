"""Toxicity by class-conditional Kneser-Ney bigram models with shared backoff counts."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from dataclasses import field as attr
from itertools import repeat
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_BYTES, arrow_pass, as_bytes, bound_batches, durable, field, pieces, text_steps

#: At most about so many labelled documents of each class are learned from, chosen by a hash of the id.
SAMPLE = 8000
DISCOUNT = 0.75
#: Words in fewer contexts, and bigrams in fewer sampled documents, fall back to the shared counts.
LEAST = 5
#: Of the words and bigrams that are kept as telling, at most about this part are so by chance.
FALSE_RATE = 0.1
#: Log-ratios below this are taken for chance, as common words have so many contexts that any difference stands out.
LEAST_RATIO = 0.7
#: First characters of a word that it falls back to: rare forms of an expression share them.
STEM = 4
EDGE = b".,;:!?\"'()[]{}#*$%&|<>-_"


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words without punctuation at their ends; words of nothing else count as none."""
    return [w for x in text.lower().split() if (w := x.strip(EDGE))]


def stem_of(word: bytes) -> bytes:
    """The first STEM characters; no character is cut."""
    return word[:STEM] if word.isascii() else word.decode("utf-8", "replace")[:STEM].encode()


def sample(labels: DataFrame, id_col: str, label: str, bound: int) -> tuple[DataFrame, float]:
    """Labels ``(doc_id, y)`` to learn from: folds 1 to 4, about as many of either class, at most about ``bound`` of each;
    and how many ordinary labels there are for each toxic one.

    The draw is a threshold on a hash of the id, so it is the same on every run and needs no sort.
    """
    usable = usable_labels(labels, id_col, label)
    count = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = min(count.get(0, 0), count.get(1, 0), bound)
    share = F.when(F.col("y") == 1, F.lit(least / max(1, count.get(1, 1)))).otherwise(F.lit(least / max(1, count.get(0, 1))))
    return usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)), count.get(0, 0) / max(1, count.get(1, 0))


def usable_labels(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("y").alias("y"))


@dataclass
class Model:
    """Log-ratios of the two class models over the kept words and bigrams, and a logistic calibration.

    A word without a ratio of its own has that of its stem; any other has the same shared probability in both models,
    so its ratio is 0."""

    word: dict[bytes, float] = attr(default_factory=dict)
    bigram: dict[tuple[bytes, bytes], float] = attr(default_factory=dict)
    heads: frozenset = frozenset()
    stem: dict[bytes, float] = attr(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    def ratio(self, text: bytes) -> float:
        """Log-likelihood of the toxic model less that of the ordinary one, over the square root of the length.

        It has no bounds; the score takes its inverse hyperbolic sine, so that a line repeated hundreds of times weighs
        little more than plain evidence. The sum over n words strays from its mean in proportion to the square root of n, so this normalisation
        compares short and long texts alike; dividing by n would let one long clean passage hide an insult.
        """
        total, n, before = 0.0, 0, b""
        word, bigram, heads, stem = self.word.get, self.bigram.get, self.heads, self.stem.get
        for part in pieces(text) if len(text) > PIECE_BYTES else (text,):
            ws = words(part)
            n += len(ws)
            for w in ws:
                r = bigram((before, w)) if before in heads else None
                if r is None:
                    r = word(w)
                    if r is None:
                        r = stem(stem_of(w), 0.0)
                total += r
                before = w
        return total / n**0.5 if n else 0.0

    def score(self, text: bytes) -> float:
        z = self.slope * np.arcsinh(self.ratio(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _counts(docs: DataFrame, chosen: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(y, a, b, n, d)``: bigrams of the sampled documents with occurrences and documents, by class."""
    bound_batches(docs.sparkSession)
    # The sample is bounded by SAMPLE ids of each class, so its broadcast is as well.
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("y", "text")
    schema = T.StructType([field("y", "int"), field("a", "binary"), field("b", "binary"), field("n", "long"), field("d", "long")])

    def run(batches):
        for batch in batches:
            for step in text_steps(batch, "text"):
                n, d = Counter(), Counter()
                for y, t in zip(step.column("y").to_pylist(), as_bytes(step, "text"), strict=True):
                    own = Counter()
                    before = b""
                    for part in pieces(t):
                        for w in words(part):
                            own[y, before, w] += 1
                            before = w
                    n.update(own)
                    d.update(own.keys())
                if n:
                    ys, a, b = zip(*n, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([d[k] for k in n], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema).groupBy("y", "a", "b").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _shared(docs: DataFrame, text: str, vocabulary: list[bytes], stems: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """How often all documents have each word and each stem of the (bounded) lists, and how many words they have."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast((vocabulary, stems))
    bound_batches(docs.sparkSession)

    def run(batches):
        own, first = ({w: i for i, w in enumerate(x)} for x in known.value)
        count, total = np.zeros(len(own) + len(first) + 1, np.int64), 0
        word, stem, none = own.get, {w: len(own) + i for w, i in first.items()}.get, len(own) + len(first)
        for batch in batches:
            for step in text_steps(batch, "text"):
                for t in as_bytes(step, "text"):
                    for part in pieces(t):
                        ws = words(part)
                        total += len(ws)
                        found = [i for w in ws for i in (word(w, none), stem(stem_of(w), none))]
                        count += np.bincount(np.array(found, np.int64), minlength=none + 1)
        at = np.flatnonzero(count[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(count[at], total), pa.int64())], names=["i", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # a row for each entry of the lists at most
    out, total = np.zeros(len(vocabulary) + len(stems), np.int64), 0
    for r in rows:
        if r.i < 0:
            total = r.n
        else:
            out[r.i] = r.n
    return out[: len(vocabulary)], out[len(vocabulary) :], total


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Learn the model from a bounded labelled sample, and its shared backoff counts from all documents.

    Folds 2 to 4 (by crc32 of the id) give the counts, fold 1 the calibration; fold 0 is held out altogether. Without
    labels of both classes the model is empty and scores everything 0.5 less a hair, that is as ordinary.
    """
    chosen, prior = sample(labels, id_col, label, bound)
    chosen = durable(chosen)
    inner = chosen.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    counts = durable(_counts(docs, inner, text, id_col))
    sums = {r.y: (r.types, r.n) for r in counts.groupBy("y").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).collect()}
    if set(sums) != {0, 1}:
        return Model(shift=-1e-3)
    sizes = {r.y: r.n for r in inner.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sided = lambda c: [F.sum(F.when(F.col("y") == y, c).otherwise(0)).alias(f"d{y}") for y in (0, 1)]
    # A word's evidence is the number of different words before it, as its Kneser-Ney count is: a passage that many
    # documents share is one context, so groups of copies do not look like evidence.
    by_word = counts.groupBy("b").agg(*sided(F.lit(1))).withColumn("a", F.lit(None).cast("binary")).withColumn("d", F.col("d0") + F.col("d1")).filter(F.col("d") >= LEAST)
    share = sums[1][0] / (sums[0][0] + sums[1][0])
    known = told(by_word, share)
    vocabulary = sorted(bytes(r.b) for r in known)
    by_stem = counts.groupBy(F.substring(F.col("b").cast("string"), 1, STEM).cast("binary").alias("b")).agg(*sided(F.lit(1))).withColumn("a", F.lit(None).cast("binary")).withColumn("d", F.col("d0") + F.col("d1")).filter(F.col("d") >= LEAST)
    families = sorted(told(by_stem, share), key=lambda r: bytes(r.b))
    rank = {w: i for i, w in enumerate(vocabulary)}
    spark = counts.sparkSession
    listed = lambda ws: F.broadcast(spark.createDataFrame([(w,) for w in sorted(ws)], "w binary"))
    types = np.array([[r.d0, r.d1] for r in sorted(known, key=lambda r: bytes(r.b))], float).reshape(-1, 2).T
    by_gram = counts.join(listed(vocabulary), F.col("b") == F.col("w")).groupBy("a", "b").agg(*sided(F.col("d")), *[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)]).withColumn("d", F.col("d0") + F.col("d1")).filter(F.col("d") >= LEAST)
    pairs = [(bytes(r.a), bytes(r.b), r.n0, r.n1) for r in told(by_gram, sizes[1] / (sizes[0] + sizes[1]))]
    follow: list[dict[bytes, tuple[int, int]]] = [{}, {}]  # distinct and all bigrams after a history
    for r in counts.join(listed({a for a, *_ in pairs}), F.col("a") == F.col("w")).groupBy("y", "a").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect():
        follow[r.y][bytes(r.a)] = (r.k, r.n)

    shared, shared_stems, total = _shared(docs, text, vocabulary, [bytes(r.b) for r in families])

    def probabilities(kinds: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
        """Discounted continuation counts of either class, and what discounts and everything without evidence leave to
        the shared counts."""
        out = []
        for y in (0, 1):
            kept = np.maximum(kinds[y] - DISCOUNT, 0) / sums[y][0]
            out.append(kept + (1 - kept.sum()) * base)
        return out

    p = probabilities(types, (shared + 1) / (total + len(vocabulary) + 1))
    s = probabilities(np.array([[r.d0, r.d1] for r in families], float).reshape(-1, 2).T, (shared_stems + 1) / (total + len(families) + 1))
    large = lambda names, q: {w: float(x) for w, x in zip(names, np.log(q[1]) - np.log(q[0]), strict=True) if abs(x) >= LEAST_RATIO}
    model = Model(large(vocabulary, p), stem=large([bytes(r.b) for r in families], s))
    for a, b, *ns in pairs:
        q = []
        for y in (0, 1):
            k, n = follow[y].get(a, (0, 0))
            q.append((max(ns[y] - DISCOUNT, 0) + DISCOUNT * k * p[y][rank[b]]) / n if n else p[y][rank[b]])
        if abs(ratio := float(np.log(q[1]) - np.log(q[0]))) >= LEAST_RATIO:
            model.bigram[a, b] = ratio
    model.heads = frozenset(a for a, _ in model.bigram)
    outer = chosen.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    rows = scores(docs.select(id_col, text).join(F.broadcast(outer.select(F.col("doc_id").alias(id_col), "y")), id_col), model, text, ["y"], raw=True).collect()  # bounded by the sample
    x, y = np.arcsinh([r.score for r in rows]), np.array([r.y for r in rows], float)
    if 0 < y.sum() < len(y):
        # The sample holds the classes in equal numbers; weights bring back their real proportion.
        weight = np.where(y == 1, 1.0, prior / (y.size - y.sum()) * y.sum())
        model.slope, model.shift = calibrate(x, y, weight)
    return model


def told(rows: DataFrame, share: float, rate: float = FALSE_RATE) -> list:
    """The rows whose counts ``d0`` and ``d1`` lie in one class beyond chance: a sign test of each, and Benjamini and
    Hochberg's rule for all together. ``share`` is the toxic part of all counts.

    The test depends on the two counts alone, so the rule is worked out from how many rows have each pair of counts, and
    no other row than the telling ones comes to the driver. All are counts of the bounded sample.
    """
    pairs = [(r.d0, r.d1, r.k) for r in rows.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("k")).collect()]
    chosen = telling(pairs, share, rate)
    if not chosen:
        return []
    listed = rows.sparkSession.createDataFrame(sorted(chosen), "d0 long, d1 long")
    return rows.join(F.broadcast(listed), ["d0", "d1"]).collect()


def telling(pairs: list[tuple[int, int, int]], share: float, rate: float = FALSE_RATE) -> set[tuple[int, int]]:
    """Of pairs of counts, each with the number of rows that have it, those that Benjamini and Hochberg's rule takes."""

    def tail(k: int, n: int, q: float) -> float:
        """Chance of k or more of n."""
        if n > 2000:
            return 0.5 * erfc((k - 0.5 - n * q) / sqrt(2 * n * q * (1 - q)))
        return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(q) + (n - i) * log(1 - q)) for i in range(k, n + 1))

    ordered = sorted((min(tail(d1, d0 + d1, share), tail(d0, d0 + d1, 1 - share)), d0, d1, k) for d0, d1, k in pairs)
    total = sum(k for *_, k in ordered)
    upto, last = 0, -1
    for i, (p, _, _, k) in enumerate(ordered):
        upto += k
        if p <= rate * upto / total:
            last = i
    return {(d0, d1) for _, d0, d1, _ in ordered[: last + 1]}


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on one value, by Newton steps with a light ridge; slope and intercept."""
    mean, sd = float(x.mean()), float(x.std()) or 1.0
    m = np.stack([(x - mean) / sd, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve(m.T @ (m * (weight * q * (1 - q))[:, None]) + 1e-2 * np.eye(2), m.T @ (weight * (y - q)) - 1e-2 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0] / sd, 1e-6)
    return float(slope), float(w[1] - slope * mean)


def scores(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, raw: bool = False) -> DataFrame:
    """Columns ``keep`` and ``score``; with ``raw`` the normalised log-ratio instead of the probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # what the bounded sample tells apart

    def run(texts):
        f = shared.value.ratio if raw else shared.value.score
        return {"score": [f(t) for t in texts]}

    return arrow_pass(docs, keep or ["doc_id"], text, [field("score", "double")], run)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Null and wordless texts have a log-ratio of 0 and the score that the calibration gives it; null labels and labels
    other than 0 and 1 teach nothing; of several labels of an id the largest holds; other columns are ignored.
    """
    model = fit(docs, labels, text, id_col)
    out = scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), model, "text", ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic; all columns pass through unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, id_col))
    return arrow_pass(docs, docs.columns, text, [field("__clean", "boolean")], lambda texts: {"__clean": [shared.value.score(t) < 0.5 for t in texts]}, only="__clean")
