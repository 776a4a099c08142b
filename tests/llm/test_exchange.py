import numpy as np
import pytest
from awkward import AWKWARD, documents, table

from mensura.llm import exchange


def test_matrix_has_the_sums_of_both_sides():
    rows, cells = np.array([7, 0, 13, 100, 1]), np.array([40, 41, 0, 40])
    before = np.concatenate([[0], np.cumsum(rows)])
    matrix = np.array([exchange.matrix_row(before, i, cells, 3) for i in range(len(rows))])
    assert (matrix.sum(1) == rows).all() and (matrix.sum(0) == cells).all() and (matrix >= 0).all()


def test_matrix_is_hypergeometric():
    """Mean and variance of one entry, over many seeds, against the distribution's own."""
    rows, cells = np.array([30, 20, 50]), np.array([25, 75])
    before = np.concatenate([[0], np.cumsum(rows)])
    drawn = np.array([exchange.matrix_row(before, 1, cells, s)[0] for s in range(4000)])
    assert abs(drawn.mean() - 20 * 0.25) < 0.1 and abs(drawn.var() - 20 * 0.25 * 0.75 * 80 / 99) < 0.25


def test_draws_beyond_the_exact_range_stay_possible():
    rng = np.random.default_rng(0)
    cells = np.array([3_000_000_000, 1, 2_000_000_000])
    for taken in (0, 1, 4_999_999_999, 5_000_000_001, 2_500_000_000):
        got = exchange.drawn(rng, cells, taken)
        assert got.sum() == taken and (got >= 0).all() and (got <= cells).all()


@pytest.mark.parametrize("shards, per_cell", [(5, 2), (24, 16_384), (1, 3)])
def test_every_row_has_one_slot(spark, shards, per_cell):
    out = exchange.shuffled(documents(spark).repartition(4), shards, rows_per_cell=per_cell)
    assert table(out, "row.doc_id", "row.text") == sorted(AWKWARD, key=repr)
    slots = {}
    for r in out.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_order_is_uniform_and_repeatable(spark):
    rows = spark.range(0, 2000, 1, 7)
    out = {r.row.id: (r.shard, r.slot) for r in exchange.shuffled(rows, 4, rows_per_cell=50).collect()}
    assert out == {r.row.id: (r.shard, r.slot) for r in exchange.shuffled(rows, 4, rows_per_cell=50).collect()}
    assert out != {r.row.id: (r.shard, r.slot) for r in exchange.shuffled(rows, 4, seed=1, rows_per_cell=50).collect()}
    place = np.array([out[i][0] * 500 + out[i][1] for i in range(2000)])
    assert abs(np.corrcoef(np.arange(2000), place)[0, 1]) < 0.08
    halves = np.bincount([out[i][0] for i in range(1000)], minlength=4)
    assert (np.abs(halves - 250) < 60).all()


def test_draws_beyond_numpys_range_follow_the_law():
    rng = np.random.default_rng(6)
    for good, bad, taken in ((3, 1_500_000_000, 150_000_000), (1_500_000_000, 3, 1_350_000_003)):
        draws = np.array([exchange._one(rng, good, bad, taken) for _ in range(20_000)])
        rare = draws if good == 3 else 3 - (taken - draws)  # good ones taken, or bad ones left
        found = np.bincount(rare, minlength=4) / 20_000
        want = np.array([0.9**3, 3 * 0.1 * 0.9**2, 3 * 0.1**2 * 0.9, 0.1**3])
        assert np.abs(found - want).max() < 0.02
    wide = np.array([exchange._one(rng, 2_000_000_000, 3_000_000_000, 1_000_000_000) for _ in range(200)])
    spread = np.sqrt(1e9 * 0.4 * 0.6 * 0.8)
    assert abs(wide.mean() - 4e8) < 5 * spread / np.sqrt(200) and 0.75 < wide.std() / spread < 1.25


def test_empty_table(spark):
    assert exchange.shuffled(documents(spark).limit(0), 24).count() == 0
