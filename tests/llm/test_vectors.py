import hashlib

import numpy as np
from pyspark.sql import types as T

from mensura.llm import vectors

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
                      + [T.StructField(c, T.StringType()) for c in ("id", "x", "code", "near", "low", "error", "v", "_key", "label_error")])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * 9) for r in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % parts == 0 and all(x is not None and np.isfinite(x) for x in r[1])]
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].copy().transpose(1, 0, 2)
    for turn in range(rounds + 1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        code = np.stack([m.argmin(1) for m in d], 1)
        if turn < rounds:
            books = books.copy()
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    books[p, e] = [int(s) // int((code[:, p] == e).sum()) for s in x[code[:, p] == e, p].sum(0)]
    error = np.stack([m.min(1) for m in d], 1).sum(1)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    total = {}
    for r, e in zip(kept, error.tolist()):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{c:02x}" for c in code[i]), int(error[i]), total[r[2]], digest) for i, r in enumerate(kept)), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in vectors.codes(df, **options).collect()), key=repr)


def random_rows(seed, n, dims=32, step=None):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (9, dims))
    v = centres[rng.integers(0, 9, n)] + rng.normal(0, 0.1, (n, dims))
    if step:
        v = np.round(v / step) * step  # many ties
    ids = rng.permutation(10 * n)[:n]
    return [(int(i), [float(np.float32(x)) for x in row], int(rng.integers(0, 4))) for i, row in zip(ids, v)]


def test_vectors_match_brute_force_ties_and_nulls(spark):
    rows = random_rows(1, 700, step=0.125)
    v = rows[0][1]
    rows += [(None, v, None), (None, rows[1][1], None), (3, None, 1), (4, [], 1), (5, [None] + v[1:], 2), (6, [float("nan")] + v[1:], 2),
             (7, [float("-inf")] + v[1:], None), (rows[5][0], v, 2), rows[9], rows[9], (8, v[:16], 1), (9, v[:15], 1)]
    assert got(frame(spark, rows).repartition(5)) == brute(rows)


def test_few_vectors_and_empty_table(spark):
    for n in (1, 2, 9, 64, 65):
        rows = random_rows(n, n)
        assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == [] == got(frame(spark, [(1, None, 1)]))


def test_bounds_adapt_and_decide_most_parts_of_clustered_vectors(spark):
    rows, seen = random_rows(3, 3000), []
    coded, books = vectors.compress(frame(spark, rows), bounds=24, rounds=4, watch=lambda b, needed: seen.append((b, needed)))
    assert coded.count() == 3000 and books.shape == (16, 64, 2)
    bs = [b for b, _ in seen]
    assert bs[:2] == [24, 24] and bs == sorted(bs, reverse=True) and bs[-1] < 24
    first, later = seen[0][1], seen[-1][1]
    assert first[255] == 16 * 3000 and later[:255].sum() == 16 * 3000
    assert later[0] > later[bs[-1] + 1]  # more parts were decided without a distance than had to be measured against all
    assert got(frame(spark, rows), rounds=4, bounds=3) == brute(rows, rounds=4)


def test_again_equals_fresh_and_bounds_stay_below_the_distances():
    rng = np.random.default_rng(5)
    for seed in range(20):
        x = rng.integers(-20, 20, (300, 4))
        book = x[rng.choice(300, 40, False)]
        code, _, near, low = vectors.fresh(x, book, 6)
        for _ in range(3):
            new = book + rng.integers(-2, 3, book.shape) * (rng.random((40, 1)) < 0.5)
            moved = np.nextafter(np.sqrt(((new - book) ** 2).sum(1).astype(float)), np.inf)
            code, own, near, low, _ = vectors.again(x, new, moved, code, near, low)
            d = vectors.squared(x, new)
            assert (code == d.argmin(1)).all() and (own == d.min(1)).all()
            root = np.sqrt(d)
            assert (low[:, :-1] <= np.take_along_axis(root, near.astype(np.int64), 1)).all() and (np.diff(low) >= 0).all()
            rest = root.copy()
            np.put_along_axis(rest, near.astype(np.int64), np.inf, 1)
            np.put_along_axis(rest, code[:, None], np.inf, 1)
            assert (low[:, -1] <= rest.min(1)).all()
            book = new
