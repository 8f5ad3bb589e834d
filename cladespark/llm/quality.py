"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, field, grams, word_hashes

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
WINDOW = 8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """A rule fails a text where ``fails`` (SQL over the measurements) is true. Its place in the list is its bit."""

    name: str
    fails: str


#: Bits never change their meaning; new rules are appended.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words * 3"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
)

#: Versioned policies: the rules whose failure rejects a text.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting"),
}


def bits(names, rules=RULES) -> int:
    place = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << place[n] for n in set(names))


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of one whole text."""
    h = word_hashes(text)
    n = len(h)
    spaces = len(text) - len(text.translate(None, WHITE))
    chars = len(text.decode("utf-8", "replace")) - spaces
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    repeats = 0
    if n >= WINDOW:
        _, place, count = np.unique(grams(h, WINDOW), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[place] > 1)
        if len(twice):
            step = np.zeros(n + 1, np.int64)
            step[twice] += 1
            step[twice + WINDOW] -= 1
            repeats = int((np.cumsum(step[:n]) > 0).sum())
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, upper, len(lines)


def ledger(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, MEASURES (long) and ``failed`` (long), the bits of the rules that it fails.

    One Arrow pass measures the texts, and the rules are SQL over the measurements, so each rule runs once whatever
    policies come later. A null text counts as empty; words are runs of anything but ASCII white space; lines without
    a word don't count; repeated rows repeat; other columns are ignored; an empty table gives an empty ledger.
    """

    def run(texts):
        return dict(zip(MEASURES, np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES)).T, strict=True))

    kept = keep or [id_col]
    measured = arrow_pass(docs.select(*dict.fromkeys([*kept, text])), kept, text, [field(m, "long") for m in MEASURES], run)
    mask = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)), F.lit(0).cast("long"))
    return measured.withColumn("failed", mask)


def passes(policy: str, failed: Column | str = "failed", rules=RULES) -> Column:
    """Whether a policy keeps a text, from its failure bits alone."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(bits(POLICIES[policy], rules))) == 0


def ablations(marks: DataFrame, policy: str, rules=RULES) -> DataFrame:
    """For each rule of a policy: how many texts it fails, how many fail it alone, and how many the policy keeps without it.

    The ledger is first summed up by its distinct masks (at most 2^rules rows), so texts are never read again.
    """
    mask = bits(POLICIES[policy], rules)
    sums = marks.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    per = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1]))
    rows = sums.select("m", "n", per.alias("r")).select("m", "n", "r.*")
    has, rest = F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("m").bitwiseAND(F.bitwise_not("bit"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return rows.groupBy("rule").agg(count(has).alias("fails"), count(has & (rest == 0)).alias("fails_alone"), count(rest == 0).alias("kept_without"), count(F.col("m") == 0).alias("kept_with"))


def quality(docs: DataFrame, policy: str = "v1", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The ledger with the verdicts of the base policy and of ``policy``."""
    return ledger(docs, text, id_col).withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})
