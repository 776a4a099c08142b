import random

import numpy as np
import pyarrow as pa
import pytest
from awkward import AWKWARD, documents, prose, table
from pyspark.sql import functions as F
from test_jaccard import near_copies, shingles

from mensura.llm import jaccard, joining, sketches
from mensura.llm.blocks import RARITY_BITS, block_of, block_pairs, first_shingles, narrowed, open_cells, size_step
from mensura.llm.links import components, joined_components

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    out = [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=repr)


def test_awkward_documents_match_brute_force(spark):
    assert table(sketches.near_duplicates(documents(spark).repartition(3)), *COLUMNS) == brute(AWKWARD)
    assert sketches.near_duplicates(documents(spark).limit(0)).count() == 0
    assert table(sketches.near_duplicates(documents(spark, [(1, None), (None, None), (None, "a b")])), *COLUMNS) == [
        (1, 0, 1, True), (None, 0, None, True), (None, 1, None, True)]


@pytest.mark.parametrize("block", [4, 512])
def test_groups_of_near_copies_match_brute_force(spark, block):
    texts = [prose(2000 + i, 40) for i in range(40)]
    for seed, words, copies, changes in ((1, 60, 40, 4), (2, 200, 30, 12), (3, 12, 30, 1), (4, 900, 20, 50), (5, 100, 30, 7)):
        texts += near_copies(seed, words, copies, changes)
    words = prose(9, 300).split()
    texts += [" ".join(words[6 * i : 6 * i + 200]) for i in range(12)]  # a chain: neighbours are linked, its ends are not
    texts += ["all rights reserved " + prose(700 + i, 5) for i in range(30)]  # short texts that share one shingle
    ids = random.Random(0).sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    assert table(sketches.near_duplicates(documents(spark, rows).repartition(4), block=block), *COLUMNS) == brute(rows)


def pairs_of_sets(rng, count):
    """Linked pairs of sets of all sizes, as different as they may be."""
    while count:
        n = int(np.exp(rng.uniform(np.log(7), np.log(1500))))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(rng.integers(0, sketches.most_different(2 * n, 85) + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, int(rng.integers(0, 1 + sketches.most_different(2 * n, 85) - gone)), dtype=np.uint64)]))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 85 * (len(a) + len(b) - o) and o < max(len(a), len(b)):
            count -= 1
            yield a, b


def test_linked_sets_share_a_cell_and_pass_the_estimate():
    rng = np.random.default_rng(3)
    for a, b in pairs_of_sets(rng, 1500):
        regs, sizes = sketches.registers([a, b]), np.array([len(a), len(b)])
        found, counts = sketches.cells(regs, sizes)
        assert set(found[: counts[0]].tolist()) & set(found[counts[0] :].tolist())
        assert sketches.may_be_linked(regs[:1], regs[1:], sizes[:1], sizes[1:]).all()


def test_registers_keep_zeros_and_mantissa_of_the_smallest_hash():
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(0, 2**64, 700, dtype=np.uint64))
    want = np.zeros(sketches.REGISTERS, np.int64)
    for bucket in range(sketches.REGISTERS):
        rest = [int(h) & ((1 << 57) - 1) for h in hashes if int(h) >> 57 == bucket]
        if rest:
            bits = f"{min(rest):057b}"
            zeros = len(bits) - len(bits.lstrip("0"))
            want[bucket] = 1 + (zeros << 10) + int((bits[zeros + 1 :] + "0" * 20)[:10], 2)
    assert (sketches.registers([hashes, np.zeros(0, np.uint64)])[0] == want).all()
    assert not sketches.registers([np.zeros(0, np.uint64)]).any()


def test_the_estimate_takes_collisions_off(monkeypatch):
    monkeypatch.setattr(sketches, "MANTISSA", 0)  # zeros alone: many collisions
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64)) for _ in range(200)] for _ in range(2))
    equal, filled = sketches.agreement(sketches.registers(a), sketches.registers(b))
    sizes = np.full(200, 3000)
    assert abs(equal.mean() / sketches.expected_collisions(sizes, sizes).mean() - 1) < 0.1
    assert equal.mean() > 20 and sketches.estimated(equal, filled, sizes, sizes).mean() < 0.05


def test_joined_components_and_repeated_links(spark):
    def frame(links):
        return spark.createDataFrame(links, "a long, b long")

    labels = components(frame([(1, 2), (2, 1), (5, 6), (7, 7)]))
    got = {(r.c, r.label) for r in joined_components(labels, frame([(6, 2), (8, 9)])).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 1), (8, 8), (9, 8)}
    assert {tuple(r) for r in joined_components(labels, frame([])).collect()} == {(1, 1), (2, 1), (5, 5), (6, 5)}
    path = list(range(3000))
    random.Random(1).shuffle(path)
    assert {r.label for r in components(frame(list(zip(path, path[1:])))).collect()} == {0}


def test_blocks_hold_every_pair_of_labels_once(spark):
    rng = random.Random(6)
    rows = [(1, c, 0 if c < 90 else c, 3 + (c % 3 == 0)) for c in range(150)] + [(2, c, c % 4, 5) for c in range(40)]
    members = spark.createDataFrame(rng.sample(rows, len(rows)), "cell long, c long, label long, step int")
    tasks = {}
    for r in block_pairs(members, 16).collect():
        tasks.setdefault((r.task, r.cell), []).append(r)
    met = {}
    for (_, cell), part in tasks.items():
        assert len(part) <= 80
        for x in part:
            for y in part:
                if x.side <= 1 and y.side >= 1 and x.label != y.label:
                    met.setdefault((cell, min(x.c, y.c), max(x.c, y.c)), 0)
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and abs(a[3] - b[3]) <= 1}
    assert want <= set(met)


@pytest.mark.parametrize("operator, percent", [(jaccard, 90), (sketches, 85)])
def test_a_block_hands_on_fewer_links_than_it_has_sets(operator, percent):
    rng = np.random.default_rng(7)

    def copies(base, many, gone):
        return [np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)])) for _ in range(many)]

    one, two = (rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(2))
    sets = [*copies(one, 60, 4), *copies(two, 60, 30)]  # all of the first are linked; of the second none is, but many are nearly so
    n = [len(s) for s in sets]
    prints = [np.sort((s & np.uint64(0xFFFF)).astype("<u2")).tobytes() for s in sets]
    regs = [r.tobytes() for r in sketches.registers(sets, sketches.JUDGED_BITS).astype("<u2")]
    rows = pa.table({"c": range(120), "label": range(120), "side": [1] * 120, "n": n, "prints": prints, "sketch": regs})
    a, b = joining.spanning(rows, lambda block: operator._candidates(block, percent), percent)
    root = list(range(120))
    for x, y in zip(a.tolist(), b.tolist()):
        assert joining.may_link(len(np.intersect1d(sets[x], sets[y])), n[x], n[y], percent) and root[x] != root[y]
        root = [root[x] if r == root[y] else r for r in root]
    assert len(a) == 59 and len(set(root[:60])) == 1


def test_large_sets_make_smaller_blocks_and_equal_cells_are_searched_once(spark):
    sizes = spark.createDataFrame([(10,), (3000,), (300_000,), (10_000_000,)], "n long")
    got = [r[0] for r in sizes.select(block_of(size_step(F.col("n"), 85), 85)).collect()]
    assert got[:2] == [512, 512] and 1 < got[2] <= (1 << 21) / 300_000 and got[3] == 1
    cells = [(1, 5, 5), (1, 6, 6), (2, 6, 6), (2, 5, 5), (3, 5, 5), (3, 7, 7), (4, 8, 1), (4, 9, 1)]
    members = open_cells(spark.createDataFrame(cells, "cell long, c long, label long"))
    assert sorted((r.cell, r.c) for r in members.collect()) == [(1, 5), (1, 6), (3, 5), (3, 7)]


@pytest.mark.parametrize("operator, percent", [(jaccard, 90), (sketches, 85)])
def test_a_pair_that_only_looks_linked_hides_no_link(spark, operator, percent, monkeypatch):
    """With prints of one value every pair that the sketches let through looks linked."""
    whole = joining.printed
    monkeypatch.setattr(joining, "printed", lambda full: whole(full).withColumn("prints", F.expr("cast(repeat('aa', cast(n as int)) as binary)")))
    monkeypatch.setattr(operator, "_candidates", lambda block, percent: ((i, block.right) for i in block.left.tolist()))
    texts = [t for seed in range(4) for t in near_copies(50 + seed, 100, 25, 14)]
    rows = list(enumerate(texts))
    documents_, sets = operator.classes(documents(spark, rows).repartition(3))
    assert table(joining.by_document(documents_, sets), "doc_id", "n_shingles", "component_id") == [r[:3] for r in brute(rows, percent)]


@pytest.mark.parametrize("percent", [85, 90])
def test_linked_sets_share_a_rare_shingle_and_their_classes(percent):
    rng = np.random.default_rng(8)
    often = rng.integers(2, 5, 1 << RARITY_BITS)
    for a, b in pairs_of_sets(rng, 600):
        if joining.may_link(len(np.intersect1d(a, b)), len(a), len(b), percent):
            at, shingle, own, other = first_shingles([a, b], often, percent)
            one, two = (set(zip(shingle[at == i].tolist(), *(x[at == i].tolist() for x in order))) for i, order in ((0, (own, other)), (1, (other, own))))
            assert one & two


def test_copies_too_far_from_each_other_cost_rows_in_proportion(spark):
    """Every copy has 30 of 100 shingles of its own, every twentieth also a twin."""
    rng, placed = np.random.default_rng(9), []
    base = rng.integers(0, 2**64, 70, dtype=np.uint64)
    for many in (200, 800):
        sets = [np.unique(np.concatenate([base, rng.integers(0, 2**64, 30, dtype=np.uint64)])) for _ in range(many)]
        sets += [np.unique(np.concatenate([x[3:], rng.integers(0, 2**64, 5, dtype=np.uint64)])) for x in sets[::20]]
        full = spark.createDataFrame([(c, len(x), bytearray(x.tobytes())) for c, x in enumerate(sets)], "c long, n long, hashes binary")
        members = full.select(F.lit(1).cast("long").alias("cell"), "c", F.col("c").alias("label"), size_step(F.col("n"), 85).alias("step"))
        rows = block_pairs(narrowed(members.withColumn("size", F.lit(len(sets))), full, 85, 16), 16).collect()
        tasks = {}
        for r in rows:
            tasks.setdefault(r.task, []).append(r)
        met = {(min(x.c, y.c), max(x.c, y.c)) for part in tasks.values() for x in part for y in part if x.side <= 1 <= y.side and x.c != y.c}
        assert {(20 * i, many + i) for i in range(many // 20)} <= met
        placed.append(len(rows))
    assert placed[1] <= 6 * placed[0] and placed[1] < 800
