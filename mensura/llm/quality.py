"""Quality rules as a ledger: every rule is evaluated once, policies and ablations are bit operations on the result.

``ledger`` reads each text once and stores its measurements and one integer of failure bits. A policy is a named, versioned
set of rules; applying one, changing one or asking what a rule costs never touches a text again.

Null and empty texts have no words: they fail ``few_words`` and no other rule. Rows are judged one by one, so repeated rows are judged
alike and ids, null or not, are not read. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.batches import each_piece

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 3
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    """A text fails where ``sql``, over the measurements, is true."""

    name: str
    sql: str


#: The order gives each rule its bit and is only ever appended to.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 7 * n_lines"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols"),
    "v2": tuple(r.name for r in RULES),
}


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags that are set in each stretch; a stretch ends where the next begins."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[np.concatenate([[0], ends])])


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """Words of each text that lie in a window of three words which that text holds twice or more."""
    counts = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if total < WINDOW:
        return np.zeros(len(texts), np.int64)
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, total)
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(ids) < 1 << 21:
        code = (words[:-2] << 42) | (words[1:-1] << 21) | words[2:]
    else:  # number the pairs first, so that a window still fits 64 bits
        pair = np.unique((words[:-1] << 32) | words[1:], return_inverse=True)[1]
        code = (pair[:-1] << 32) | words[2:]
    starts = np.flatnonzero(owner[:-2] == owner[2:])
    order = starts[np.argsort(code[starts], kind="stable")]  # stable: by window, then by text
    again = (code[order][1:] == code[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.concatenate([order[1:][again], order[:-1][again]])
    covered = np.zeros(total, bool)
    for step in range(WINDOW):
        covered[twice + step] = True
    return _sums(covered, ends)


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    texts = [t or b"" for t in texts]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    words = [t.split() for t in texts]
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    return {
        "n_words": np.array([len(w) for w in words], np.int64),
        "word_chars": _sums(((raw & 0xC0) != 0x80) & ~SPACE[raw], ends),
        "n_symbols": _sums(SYMBOL[raw], ends),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(words),
    }


def bits(names: Sequence[str]) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in names)


def ledger(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row``, the measurements and ``fail_bits`` (bit i: rule i failed) of every row."""
    measured = each_piece(df, measure, MEASURES, text, keep)
    failed = [F.when(F.expr(r.sql), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = failed[0]
    for one in failed[1:]:
        total = total.bitwiseOR(one)
    return measured.withColumn("fail_bits", total.cast("long"))


def passes(policy: str = "v2", fail_bits: str | Column = "fail_bits") -> Column:
    """Whether no rule of the policy failed."""
    found = F.col(fail_bits) if isinstance(fail_bits, str) else fail_bits
    return found.bitwiseAND(F.lit(bits(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """What each rule of a policy does, from a ledger: (rule, n_failed, n_alone: rows that it alone rejects, n_kept_without).

    The ledger is first counted by its bits, so that at most 2 ** rules rows meet the rules.
    """
    mask = bits(POLICIES[policy])
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("found")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bits([name])).cast("long").alias("bit")) for name in POLICIES[policy]])
    each = counts.select("found", "n", F.explode(rules).alias("r")).select("found", "n", "r.rule", "r.bit")
    has = F.col("found").bitwiseAND(F.col("bit")) != 0

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")

    return each.groupBy("rule").agg(
        total(has).alias("n_failed"),
        total(F.col("found") == F.col("bit")).alias("n_alone"),
        total(F.col("found").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def accepted(df: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with their own columns only."""
    return ledger(df, text).filter(passes(policy)).select("row.*")
