import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from awkward import AWKWARD, CLASHES, prose
from pyspark.sql import types as T

from mensura.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source", *CLASHES, "term", "chunk", "docs", "part", "rank")])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * (len(SCHEMA) - 3)) for r in rows], SCHEMA)


def brute(rows, least=10, top=10):
    docs = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))))
            for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        frequency = Counter(t for d in own for t in d[2])
        kept = [t for t, n in frequency.items() if n >= least]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, c in own:
            counts[s].update(c)
        total = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))

        p = {s: {t: share(c, t) for t in kept} for s, c in counts.items()}
        q = {t: share(total, t) for t in kept}
        for s, c in counts.items():
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in divergence.audit(df, **options).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("least, side", [(2, 256), (3, 4)])
def test_awkward_texts_match_brute_force(spark, least, side):
    rng = random.Random(7)
    rows = [(t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "🙂", "", "src9", None])) for _, t in AWKWARD * 3]
    rows += [("Word, word. WORD (word) wörd it's 1word2 x", "en", "a"), ("only here", "xx", "solo"), ("", "yy", "p"), (None, "yy", "q")]
    assert got(frame(spark, rows).repartition(3), least=least, side=side) == brute(rows, least)


def test_terms_spread_over_many_chunks_are_counted_by_document(spark):
    """`rare` has more than ten chunks in nine documents, `often` ten chunks in ten."""
    rows = [(f"rare{i}rare rare;{i} {i}rare filler", "en", f"s{i % 3}") for i in range(9)]
    rows += [(f"{i}often; {i}often", "en", f"s{i % 4}") for i in range(10)]
    rows += [(prose(i, 120), "en", f"s{i % 5}") for i in range(30)]
    want = brute(rows)
    assert any(r[3] == "often" for r in want) and not any(r[3] == "rare" for r in want)
    assert got(frame(spark, rows).repartition(7)) == want == got(frame(spark, rows).coalesce(1), side=2)


def test_a_task_may_hand_on_its_rows_in_parts(monkeypatch):
    rows = [("en", "a", "x y x"), ("en", "b", "x"), ("de", "a", "x z"), ("en", "a", ""), ("en", "b", "y")]
    monkeypatch.setattr(divergence, "SEGMENT", 2)
    counter, found = divergence.Counter(3, 2), []
    for lang, source, text in rows:
        counter.add((lang, source), text.encode())
    for batch in counter.rows():
        found += [tuple(r.values()) for r in batch.to_pylist()]
    first = 3 << 36
    assert sorted(found, key=repr) == sorted([
        ("de", b"x", ["a"], [1], [first + 2]), ("de", b"z", ["a"], [1], [first + 2]), ("en", b"x", ["a", "b"], [2, 1], None),
        ("en", b"y", ["a", "b"], [1, 1], None)], key=repr)
    assert list(counter.rows()) == [] and counter.next == first + 5


def test_empty_tables_and_lone_groups(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(None, None, None)])) == []
    assert got(frame(spark, [(None, "a", "x"), ("b", "a", "y")])) == [("a", "x", "pair", "y", 0, 1), ("a", "y", "pair", "x", 0, 1)]


def test_packed_rows_come_back_and_hold_two_values():
    rows = pa.RecordBatch.from_arrays([
        pa.array(["en", "", "de", "de"]), pa.array([b"x", b"y", b"y", b"z"], pa.binary()),
        pa.array([["a", "", "é🙂"], [""], ["b"], ["", "b"]], pa.list_(pa.string())), pa.array([[1, 2, 3], [4], [1 << 40], [5, 6]], pa.list_(pa.int64())),
        pa.array([None, [7], [8, 9 << 36], None], pa.list_(pa.int64()))], ["lang", "chunk", "sources", "counts", "docs"])
    for part in (rows, rows.slice(1, 2), rows.slice(3), rows.slice(2, 0)):
        made = divergence.packed(part)
        assert made.schema.names == ["lang", "chunk", "names", "numbers"]
        sources, counts, docs, unlisted = divergence.unpacked(made) if part.num_rows else ([],) * 4
        assert list(map(lambda x: x.as_py(), sources)) == part.column("sources").to_pylist()
        assert list(map(lambda x: x.as_py(), counts)) == part.column("counts").to_pylist()
        assert [None if no else x.as_py() for x, no in zip(docs, unlisted)] == part.column("docs").to_pylist()
