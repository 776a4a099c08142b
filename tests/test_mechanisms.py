"""Balanced folds, p-values and tiled correlations against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.operators import evaluation as ev
from mensura.operators import features as ft
from mensura.operators import splits as sp


def lightest(sizes, k):
    """The rule, group by group."""
    loads, out = [0] * k, []
    for s in sizes:
        f = loads.index(min(loads))
        loads[f] += s
        out.append(f)
    return out


def test_whole_runs_of_equal_sizes_are_dealt_as_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        k = rng.randrange(1, 7)
        sizes = sorted((rng.choice([1, 2, 3, 7, 50, 200]) * rng.randrange(1, 4) for _ in range(rng.randrange(1, 90))), reverse=True)
        runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        phases, got = sp._phases(runs, k), []
        for size, groups in runs:
            mine = [(r, f) for s, r, f in phases if s == size]
            for j in range(groups):
                rank, turn = [p for p in mine if p[0] <= j][-1]
                got.append(turn[(j - rank) % len(turn)])
        assert got == lightest(sizes, k)
    assert len(sp._phases([(10**9, 2), (1, 10**12)], 3)) <= 6  # never a step for each group


def test_folds_follow_the_lightest_fold(spark):
    rng = random.Random(4)
    names = [f"g{i:03d}" for i in range(60)]
    rows = [(i, rng.choice(names[: rng.choice([3, 20, 60])])) for i in range(900)] + [(10_000, None)]
    got = {r["g"]: r["fold"] for r in sp.grouped_kfold(spark.createDataFrame(rows, "i int, g string"), "g", 4).collect()}
    sizes = {}
    for _, g in rows:
        sizes[g or "__NO_SCAFFOLD__"] = sizes.get(g or "__NO_SCAFFOLD__", 0) + 1
    order = sorted(sizes, key=lambda g: (-sizes[g], g))
    assert got == dict(zip(order, lightest([sizes[g] for g in order], 4)))


def tail(r, n):
    """The two-sided p-value by integrating Student's density, its angle as the variable."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    grid = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 400_001)
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    y = np.exp(log_norm + (df - 1) * np.log(np.maximum(np.cos(grid), 1e-300)))
    h = grid[1] - grid[0]
    return 2 * h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_p_values(spark):
    cases = [(r, n) for n in (3, 4, 5, 8, 30, 200, 5000) for r in (0.01, 0.1, -0.3, 0.55, 0.9, -0.99)]
    df = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long")
    got = [x["p"] for x in df.coalesce(1).select(ev.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    for (r, n), p in zip(cases, got):
        assert p == pytest.approx(tail(r, n), rel=1e-6, abs=1e-9), (r, n)
    odd = spark.createDataFrame([(None, 10), (0.5, 2), (1.0, 10), (-1.0, 3), (0.0, 10), (1e-5, 4_000_000_000)], "r double, n long")
    found = [x["p"] for x in odd.coalesce(1).select(ev.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert found[:5] == [None, None, 0.0, 0.0, 1.0] and found[5] == pytest.approx(math.erfc(1e-5 * math.sqrt(2e9)), rel=1e-4)


def test_p_values_of_groups_and_incomplete_pairs(spark):
    rng = np.random.default_rng(1)
    data = []
    for m, noise in (("a", 0.5), ("b", 3.0), (None, 1.0)):
        x = rng.normal(size=40)
        data += [(m, float(u), float(u + noise * v)) for u, v in zip(x, rng.normal(size=40))]
    df = spark.createDataFrame([*data, ("a", 1.0, None), ("b", float("nan"), 2.0)], "m string, actual double, predicted double")
    for r in ev.correlation_pvalue(df, by=["m"]).collect():
        pairs = np.array([(x, y) for m, x, y in data if m == r["m"]])
        c = np.corrcoef(pairs.T)[0, 1]
        ranks = np.corrcoef(pairs.argsort(0).argsort(0).T)[0, 1]
        assert (r["rows"], r["left_out"]) == (40, 0 if r["m"] is None else 1)
        assert r["pearson_p"] == pytest.approx(tail(c, 40), abs=1e-9) and r["spearman_p"] == pytest.approx(tail(ranks, 40), abs=1e-9)


@pytest.mark.parametrize("tile", [3, 128])
def test_tiles_give_what_pairs_of_columns_give(spark, tile):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) + 1e6
    x[:, 3] = x[:, 0] + 0.1 * rng.normal(size=300)
    x[:, 5] = 7.0
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(8)]
    rows = [(*(None if np.isnan(v) else float(v) for v in r), "train" if i % 5 else "test") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", split string")
    found = {r["feature"]: r for r in ft.correlation_filter(df.repartition(5), names, 0.9, tile=tile).collect()}
    train = x[[i % 5 > 0 for i in range(300)]]
    for j, c in enumerate(names):
        each = []
        for i in range(j):
            both = ~np.isnan(train[:, i]) & ~np.isnan(train[:, j])
            a, b = train[both, i], train[both, j]
            if a.std() > 0 and b.std() > 0:
                each.append(abs(np.corrcoef(a, b)[0, 1]))
        assert (found[c]["highest"] is None) == (not each)
        assert not each or found[c]["highest"] == pytest.approx(max(each), abs=1e-9)
        assert found[c]["kept"] == (not each or max(each) <= 0.9)
