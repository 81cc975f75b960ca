import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tessera.llm import vector_codes as m

SCHEMA = "vec_id long, label int, embedding array<float>"


def naive(rows, rounds=m.ROUNDS):
    """(code, error) of each row in order, and the codebooks, by comparing all with all."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = [[math.floor(4096 * Fraction(float(np.float32(c)))) for c in r[2]] for r in rows]
    w = len(x[0]) // 8
    cut = [[v[p * w : p * w + w] for p in range(8)] for v in x]
    books = [[v[p] for v in cut[:16]] for p in range(8)]
    near = lambda y, p: min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(v[p], p)[1] for p in range(8)] for v in cut]
        for p in range(8):
            for e in range(len(books[p])):
                if mine := [v[p] for v, o in zip(cut, own, strict=True) if o[p] == e]:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = [(r[0], "".join(f"{near(v[p], p)[1]:02x}" for p in range(8)), sum(near(v[p], p)[0] for p in range(8))) for r, v in zip(rows, cut, strict=True)]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def check(spark, rows, dropped=()):
    got = m.compress(spark.createDataFrame(rows + list(dropped), SCHEMA).repartition(3))
    want, digest = naive(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.code, r.error) for r in got.rows.collect()), key=key) == sorted(((i, c, e if e < 1 << 63 else None) for i, c, e in want), key=key)
    assert got.digest == digest
    return got


def clustered(n, seed, spread=0.05, dims=24):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(30)]
    return [(i * 3, rnd.randrange(4), [c + rnd.gauss(0, spread) for c in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "first"), [(0.05, 4), (0.6, 2), (0.01, 8)])
def test_equals_comparing_all(spark, monkeypatch, spread, first):
    monkeypatch.setattr(m, "FIRST", first)
    monkeypatch.setattr(m, "HELD", 1 << 13)
    check(spark, clustered(300, int(100 * spread), spread))


def test_bounds_hold_and_spare_comparisons():
    rng = np.random.default_rng(5)
    part = np.tile(np.arange(8), 400)
    x = rng.integers(-3000, 3000, (3200, 4))
    books = rng.integers(-3000, 3000, (8, 16, 4))
    state, spared = m.compare_all(x, part, books, 4), 0
    for turn, b in enumerate([4, 2, 6, 6, 3, 15]):
        new = books + rng.integers(-60, 60, books.shape)
        state = state.moved(part, np.sqrt(((new - books) ** 2).sum(axis=2)) * (1 + 1e-9), b)
        books = new
        asked = m.reassign(x, part, books, state)
        d = ((x[:, None] - books[part]) ** 2).sum(axis=2)
        assert (state.code == d.argmin(axis=1)).all(), turn
        root = np.sqrt(d)
        assert (state.upper >= root[np.arange(3200), state.code]).all()
        filler = np.stack([(state.near[:, z] == state.code) | (state.near[:, :z] == state.near[:, [z]]).any(axis=1) for z in range(b)], axis=1)
        reach = np.where(filler, np.inf, np.take_along_axis(root, state.near, 1))
        for z in range(b):
            assert (state.lower[:, z] <= reach[:, z:].min(axis=1)).all()
        assert (np.diff(state.lower, axis=1) >= 0).all()
        listed = np.zeros_like(root, bool)
        np.put_along_axis(listed, state.near, True, 1)
        listed[np.arange(3200), state.code] = True
        assert (state.outer <= np.where(listed, np.inf, root).min(axis=1)).all()
        spared += (asked == 0).sum()
    assert spared > 1000


def test_lists_adapt():
    assert m._listed(4, 16, [900, 60, 0, 0, 0] + [0] * 11 + [40]) == 4
    assert m._listed(4, 16, [990, 10, 0, 0, 0] + [0] * 12) == 2
    assert m._listed(4, 16, [500] + [0] * 15 + [500]) == 8
    assert m._listed(8, 9, [500] + [0] * 15 + [500]) == 8


def test_ties_repeats_nulls_and_few_vectors(spark):
    rows = [(1, 1, [0.5] * 16), (1, None, [0.5] * 16), (2, None, [-0.5, 0.25] * 8), (None, 1, [0.1] * 16), (7, 2, [0.0] * 16)]
    dropped = [(0, 1, None), (0, 1, [None] * 16), (-5, 2, [float("nan")] * 16), (-5, 2, [float("inf")] + [0.0] * 15), (3, 1, [1.0] * 8), (4, 1, []), (4, 1, [1.0] * 9)]
    check(spark, rows, dropped)
    check(spark, rows * 8, dropped)
    assert m.compress(spark.createDataFrame(dropped[:2], SCHEMA)).rows.count() == 0
    assert m.compress(spark.createDataFrame([(1, 1, [1.0] * 9)], SCHEMA)).rows.count() == 0


def test_components_of_any_size(spark):
    rnd = random.Random(3)
    rows = [(i, 0, [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-6, top) for _ in range(16)]) for i in range(40) for top in [30 if i % 3 else 3]]
    assert None in {r.error for r in check(spark, rows).rows.collect()}


def test_clashing_columns(spark, tmp_path):
    rows = [(*r, 7, "x") for r in clustered(40, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", v int, sums string").withColumnRenamed("label", "code")
    got = m.compress(df, label_col="code").rows
    assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 40


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    cur = duckdb.sql(m.ORACLES["op12_vector_codes"])
    want = sorted(tuple(r) for r in cur.fetchall())
    got = m.op12_vector_codes(spark, folder)
    assert got.columns == cur.columns
    assert sorted(tuple(r) for r in got.collect()) == want
