import random
import re

import numpy as np
import pytest
from awkward import AWKWARD, documents, prose, table

from mensura.llm import jaccard, joining
from mensura.llm.links import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, base_words, copies, changes):
    rng = random.Random(seed)
    base = prose(seed, base_words).split()
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def test_awkward_documents_match_brute_force(spark):
    got = table(jaccard.linked_documents(documents(spark).repartition(3)), "doc_id", "n_shingles", "component_id")
    assert got == brute(AWKWARD)


@pytest.mark.parametrize("block", [4, 512])
def test_groups_of_near_copies_match_brute_force(spark, block):
    texts = [prose(1000 + i, 40) for i in range(60)]
    for seed, words, copies, changes in ((1, 60, 50, 3), (2, 200, 40, 9), (3, 12, 30, 1), (4, 400, 25, 14), (5, 100, 40, 5)):
        texts += near_copies(seed, words, copies, changes)
    # A chain: neighbours are linked, its ends are not.
    words = prose(9, 300).split()
    for i in range(12):
        texts.append(" ".join(words[5 * i : 5 * i + 220]))
    rng = random.Random(0)
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    got = table(jaccard.linked_documents(documents(spark, rows).repartition(4), block=block), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows)


@pytest.mark.parametrize("ids", [
    [5 + (k << 24) for k in (3, 1, 0, 2)], [7 + (k << 33) for k in (2, 0, 1, 3)], [7 + (k << 48) for k in (2, 0, 1, 3)],
    [None, (1 << 24) - 1, None, (3 << 24) - 1], [-1, None, -1, None], [9, 9 + (1 << 24) + 1, 9 - (1 << 24), 9 - (1 << 24)]])
def test_copies_whose_ids_differ_in_high_bits_keep_their_links(spark, ids):
    base = prose(31, 60)
    rows = [*((i, base) for i in ids), (400, base + " tail"), (401, prose(32, 60))]
    got = table(jaccard.linked_documents(documents(spark, rows).coalesce(1)), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows)


def test_the_filter_of_ids_lets_all_wanted_sets_through(spark):
    rng = np.random.default_rng(4)
    texts = [prose(500 + i, 30) for i in range(200)]
    ids = [int(x) for x in rng.integers(-(2**63), 2**63, 199)] + [None]
    one, two = joining.identities(joining.shingle_sets([t.encode() for t in texts], 3))
    wanted = [(i, d, int(x), int(y)) for i, (d, x, y) in enumerate(zip(ids, one, two)) if i % 2]
    found = joining.full_sets(documents(spark, list(zip(ids, texts))), "doc_id", "text", spark.createDataFrame(wanted, "c long, head long, c1 long, c2 long"), 3)
    assert {r.c: r.n for r in found.collect()} == {i: len(shingles(texts[i])) for i, *_ in wanted}


def test_linked_sets_share_a_cell():
    rng, seen = np.random.default_rng(1), 0
    for _ in range(1500):
        n = int(np.exp(rng.uniform(np.log(9), np.log(2000))))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        most = jaccard.most_different(2 * n + n // 9)
        gone = int(rng.integers(0, most + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, int(rng.integers(0, most - gone + 1)), dtype=np.uint64)]))
        o = len(np.intersect1d(a, b))
        if len(a) == len(b) == o or not jaccard.may_link(o, len(a), len(b)):
            continue
        found, counts = jaccard.cells([a, b])
        assert set(found[: counts[0]].tolist()) & set(found[counts[0] :].tolist())
        assert jaccard.may_link(np.minimum(jaccard.point(a), jaccard.point(b)).sum(), len(a), len(b))
        seen += 1
    assert seen > 500


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    base = rng.poisson(2, (6, 32))
    points = np.concatenate([np.maximum(0, base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1)) for _ in range(40)]).astype(np.int32)
    sizes, labels = points.sum(1).astype(np.int64), rng.integers(0, 9, len(points))
    q, found = jaccard.CountTree(points, sizes, labels).search(points[:50], sizes[:50], labels[:50])
    want = {(i, j) for i in range(50) for j in range(len(points)) if labels[i] != labels[j]
            and 100 * (o := min(np.minimum(points[i], points[j]).sum(), sizes[i])) >= 90 * (sizes[i] + sizes[j] - o)}
    assert set(zip(q.tolist(), found.tolist())) == want and want


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(90)]
    got = {}
    for r in components(spark.createDataFrame(links, "a long, b long")).collect():
        got.setdefault(r.label, set()).add(r.c)
    groups = []
    for a, b in links:
        if a != b:
            hit = [g for g in groups if a in g or b in g]
            groups = [g for g in groups if g not in hit] + [set().union({a, b}, *hit)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_one_of_each_and_empty_table(spark):
    kept = jaccard.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    labels = brute(AWKWARD)
    worded = {c for _, n, c in labels if n}
    assert kept.filter("doc_id IS NOT NULL AND length(trim(text)) > 5").count() >= len(worded - {None}) - 2
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 6 not in ids and 12 not in ids and ids.count(5) == 2 and {2, 3, 4} <= set(ids) and ids.count(None) == 2
    assert jaccard.linked_documents(documents(spark).limit(0)).count() == 0
    assert jaccard.one_of_each(documents(spark).limit(0)).count() == 0
