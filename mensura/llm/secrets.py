"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over the trigrams that any match must contain (case folded). The index
holds a posting (trigram, row key) for every trigram that some query names. Postings are intersected per key; only rows
that satisfy a rule's query are searched with its expression. A rule without a mandatory trigram searches every row.

A key hashes a row's id and text, so equal rows share postings, and a hash collision costs a needless search, never a match.
Null and empty texts hold no secrets. Repeated rows are scanned as often as they occur, and a null id is one id. Offsets are code points, ends
exclusive; matches at one place are listed in the order of the rules. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.batches import quoted
from mensura.session import cut

_SRE = re._parser
SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` (0: all) has ``least`` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Matches of [0-9a-f]+ are whole runs, so those of 24 or more are the matches of this.
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

# --- trigram queries ---------------------------------------------------------------------------
# A query is True (any text), a trigram, or ("and" | "or", queries).

MAX_STRINGS = 64  # alternatives that are followed exactly; beyond that a query only gets weaker, never wrong


def _join(kind: str, queries: Iterable) -> object:
    queries = list(dict.fromkeys(queries))
    if kind == "or" and True in queries:
        return True
    queries = [q for q in queries if q is not True]
    if not queries:
        return True
    return queries[0] if len(queries) == 1 else (kind, tuple(queries))


def _needs(strings: set[str]) -> object:
    """The query of a text that holds one of the strings; a string that holds another adds nothing."""
    strings = {s for s in strings if not any(t != s and t in s for t in strings)}
    return _join("or", (_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)))


def _strings(op, arg) -> set[str] | None:
    """All strings that a part of an expression matches, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        return None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        inner = _sequence_strings(body)
        if inner is None or int(high) > 4:
            return None
        out = {"".join(p) for n in range(low, int(high) + 1) for p in product(sorted(inner), repeat=n)}
        return out if len(out) <= MAX_STRINGS else None
    return {""} if name == "AT" else None


def _sequence_strings(parts) -> set[str] | None:
    out = {""}
    for op, arg in parts:
        each = _strings(op, arg)
        if each is None or len(out) * len(each) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in each}
    return out


def _query(parts) -> object:
    """Trigrams of the strings that stand next to each other, and of what is mandatory in the parts between."""
    needed, run = [], {""}
    for op, arg in parts:
        each = _strings(op, arg)
        if each is not None and len(run) * len(each) <= MAX_STRINGS:
            run = {a + b for a in run for b in each}
            continue
        needed.append(_needs(run))
        run = {""}
        name = str(op)
        if each is not None:
            run = each
        elif name == "SUBPATTERN":
            needed.append(_query(arg[-1]))
        elif name == "BRANCH":
            needed.append(_join("or", [_query(x) for x in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            needed.append(_query(arg[2]))
    return _join("and", [*needed, _needs(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean query of a regular expression; True if no trigram is mandatory."""
    return _query(_SRE.parse(pattern))


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def _holds(query: object, number: dict[str, int], found: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, number[query])
    parts = [_holds(q, number, found) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


# --- index and search --------------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, _text, _k1, _k2): the caller's columns as a struct, the text without null, and the row's key."""
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    name = F.col(quoted(key)).cast("string")
    return df.select(
        F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), whole.alias("_text"),
        F.xxhash64(F.lit(1), name, whole).alias("_k1"), F.xxhash64(whole, F.lit(2), name).alias("_k2"),
    )


def postings(rows: DataFrame, grams: Sequence[str]) -> DataFrame:
    """The inverted index: (gram, _k1, _k2) for the listed trigrams, by their place in the list."""
    listed = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(g).alias("g")) for i, g in enumerate(grams)])
    held = _let(F.lower("_text"), lambda low: F.filter(listed, lambda x: F.contains(low, x["g"])))
    return rows.select(F.explode(F.transform(held, lambda x: x["n"])).alias("gram"), "_k1", "_k2")


def candidates(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """(_k1, _k2, _maybe): for the rows that satisfy some rule's query, the places of those rules; None without queries."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    if not queries:
        return None
    grams = sorted(set().union(*(trigrams(q) for q in queries.values())))
    number = {g: i for i, g in enumerate(grams)}
    met = postings(rows, grams).groupBy("_k1", "_k2").agg(F.collect_set("gram").alias("_grams"))
    flags = F.array(*[F.when(_holds(q, number, F.col("_grams")), F.lit(i)) for i, q in queries.items()])
    return met.select("_k1", "_k2", F.array_compact(flags).alias("_maybe")).filter(F.size("_maybe") > 0)


def spans(text: Column, rule: Rule) -> Column:
    """Offsets of a rule's leftmost, non-overlapping matches, without those that are too short."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast(SPANS)

    def placed(found: Column, values: Column, gaps: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.char_length(gaps[i])
            end = start + F.char_length(found[i])
            span = F.array(F.struct(start.alias("start"), end.alias("end")))
            long_enough = F.char_length(values[i]) >= rule.least
            return F.struct(end.alias("at"), F.when(long_enough, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

        first = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda s: s["out"])

    def located(found: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
        whole = _let(values, lambda v: _let(F.split(text, rule.pattern, -1), lambda g: placed(found, v, g)))
        return F.when(F.size(found) == 0, none).otherwise(whole)

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), located)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``row`` and one array of spans for each rule, named ``found_<rule>``; every input row gives one row."""
    rows = keyed(df, key, text)
    maybe = candidates(rows, rules)
    if maybe is None:
        rows = rows.withColumn("_maybe", F.lit(None).cast("array<int>"))
    else:
        rows = rows.join(cut(maybe), ["_k1", "_k2"], "left")  # cut: a join of two exchanges, whose hot keys Spark can split
    held = F.coalesce("_maybe", F.array().cast("array<int>"))
    columns = []
    for i, rule in enumerate(rules):
        found = spans(F.col("_text"), rule)
        if trigram_query(rule.pattern) is not True:
            found = F.when(F.array_contains(held, i), found).otherwise(F.array().cast(SPANS))
        columns.append(found.alias(f"found_{rule.name}"))
    return rows.select("row", *columns)


def ordered(rules: Sequence[Rule] = RULES) -> Column:
    """All spans of some rules as text ``rule:start:end``, by start and then in the rules' order, joined by commas."""
    def named(i: int, name: str) -> Column:
        return F.transform(f"found_{name}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("rule"), s["end"].alias("end"), F.lit(name).alias("name")))

    each = [named(i, r.name) for i, r in enumerate(rules)]
    shown = F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"]))
    return F.array_join(shown, ",")


def any_found(rules: Sequence[Rule] = RULES) -> Column:
    return reduce(lambda a, b: a | b, [F.size(f"found_{r.name}") > 0 for r in rules])


def redacted(text: Column, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap are replaced as one."""
    every = F.array_sort(F.concat(*[F.col(f"found_{r.name}") for r in rules]))
    whole = F.coalesce(text, F.lit(""))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(whole, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        added = F.concat(state["out"], before, F.when(s["start"] >= state["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), added.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(every, start, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.char_length(whole))))
    return F.when(F.size(every) == 0, text).otherwise(done)


def redact_documents(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rows with their own columns; secrets are replaced in the text."""
    found = scan(df, key, text, rules)
    cleaned = redacted(F.col(f"row.{quoted(text)}"), rules)
    return found.select(*[(cleaned if c == text else F.col(f"row.{quoted(c)}")).alias(c) for c in df.columns])
