import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard_join as j
from tessera.llm.shared import small_batches

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, sig string, component string"


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute(rows, m):
    """doc_id to (set size, component), by all pairs."""
    sets = {i: shingle_set(t, m.words) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and m.q * len(sets[a] & sets[b]) >= m.p * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rnd, words, k, new):
    words = list(words)
    for _ in range(k):
        at, how = rnd.randrange(len(words)), rnd.random()
        if how < 0.5:
            words[at] = new()
        elif how < 0.75:
            words.insert(at, new())
        elif len(words) > 5:
            del words[at]
    return words


@pytest.mark.parametrize(("seed", "m", "chance"), [(0, j.OP9, 0.02), (1, j.NEAR, 0.5), (2, j.Measure(1, 3, 4), 0.9)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, m, chance):
    monkeypatch.setattr(j, "RELATED", 1.0)
    monkeypatch.setattr(j, "CHANCE", chance)  # high chances of agreement make doubled segments pay
    for name, value in zip(("MEMBERS", "FEW", "LIGHT", "ELEMENTS"), [(4096, 32, 256, 1 << 22), (2, 1, 1 << 20, 50), (3, 2, 9, 200)][seed], strict=True):
        monkeypatch.setattr(j, name, value)
    rnd = random.Random(seed)
    new = lambda: f"W{rnd.randrange(400)}"
    rows, texts = [], []
    for _ in range(10):
        base = [new() for _ in range(rnd.choice([3, 8, 12, 20, 40, 90, 200]))]
        for _ in range(rnd.choice([1, 3, 25])):  # chains: each copy edits any earlier one
            texts.append(base)
            base = edited(rnd, rnd.choice(texts[-6:]), rnd.randrange(0, 3), new)
    shared = [new() for _ in range(30)]
    for _ in range(25):  # many texts around one passage
        texts.append(shared + [new() for _ in range(rnd.randrange(1, 6))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, "w1"), (903, "W1")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = {r.id: (r.n, r.component) for r in j.grouped(j.join(docs, m)).collect()}
    assert got == brute(rows, m)


def test_a_link_beside_the_centre_is_found(spark):
    # x and z link with each other, z links with c, and x doesn't link with c.
    words = [f"w{i}" for i in range(200)]
    docs = [words]
    for i in range(40):
        for k in (2, 3, 4):
            docs.append(docs[-1 if k > 2 else 0][: 5 * i + k] + [f"e{i}{k}"] + docs[-1 if k > 2 else 0][5 * i + k + 1 :])
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    m = j.Measure(3, 97, 100)
    found = j.join(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA), m)
    assert {r.id: (r.n, r.component) for r in j.grouped(found).collect()} == brute(rows, m)


def just_apart(n, seed):
    """Texts of 120 words, each with two words changed: most pairs differ a little too much."""
    rnd = random.Random(seed)
    base, out = [f"b{i}" for i in range(120)], []
    for _ in range(n):
        words = list(base)
        for at in rnd.sample(range(120), 2):
            words[at] = f"n{rnd.randrange(50)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("members", "light"), [(4096, 256), (100, 256), (100, 1)])
def test_work_grows_with_a_family_of_near_copies(spark, monkeypatch, members, light):
    monkeypatch.setattr(j, "MEMBERS", members)
    monkeypatch.setattr(j, "LIGHT", light)
    sent, verify = [], j._stars
    monkeypatch.setattr(j, "_stars", lambda groups, s: (sent.append((out := verify(groups, s))[0].count()), out)[1])
    compared = {}
    for n in (150, 600):
        texts = just_apart(n, 3)
        found = j.join(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), j.OP9)
        compared[n] = sum(sent)
        sent.clear()
        if n == 150:
            assert {r.id: (r.n, r.component) for r in j.grouped(found).collect()} == brute(list(enumerate(texts)), j.OP9)
    if light > 1:
        assert compared[600] <= 6 * compared[150]


@pytest.mark.parametrize("seed", range(4))
def test_a_family_is_settled_as_by_all_pairs(seed):
    rnd, m = random.Random(seed), j.Measure(1, 80, 100)
    centre = set(range(40))
    sets = []
    for _ in range(60):
        base = rnd.choice(sets)[:] if sets and rnd.random() < 0.7 else sorted(centre)
        sets.append(sorted(set(base) - set(rnd.sample(range(40), 3)) | set(rnd.sample(range(40, 60), rnd.randrange(4)))))
    jac = lambda a, b: m.q * len(a & b) >= m.p * len(a | b)
    diffs = [sorted(set(s) ^ centre) for s in sets]
    linked = np.array([jac(set(s), centre) for s in sets])
    label = j.settled(m, np.array([len(s) for s in sets]), np.array([len(x) for x in diffs]), linked, np.array(sum(diffs, []), np.int64), np.concatenate([[0], np.cumsum([len(x) for x in diffs])]))
    up = list(range(61))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for k in [0] * int(linked[i]) + [k + 1 for k, t in enumerate(sets) if jac(set(s), set(t))]:
            up[max(top(i + 1), top(k))] = min(top(i + 1), top(k))
    assert label.tolist() == [top(i + 1) for i in range(60)]


def test_sketches_lose_no_link():
    rng = np.random.default_rng(2)
    for m in (j.NEAR, j.OP9):
        sets = []
        for n in (3, 60, 64, 65, 70, 500, 520, 600):
            base = rng.integers(0, 1 << 62, n).astype(np.uint64)
            sets += [base] + [np.unique(np.concatenate([base[: n - k], rng.integers(0, 1 << 62, k).astype(np.uint64)])) for k in (1, n // 12, n // 3)]
        want = [any(m.links(len(np.intersect1d(a, b)), len(a), len(b)) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
        got = j.plausible(m, np.array([len(x) for x in sets]), [j.sketch(x) for x in sets])
        assert all(got[np.array(want)]) and any(want) and not all(got)


def test_layout_covers_every_difference():
    for m in (j.OP9, j.NEAR):
        layout = j.Layout(m, {b: 10**5 for b in range(30)})
        for b in range(25):
            x = layout[b]
            assert 2 * x.doubled + (x.segments - x.doubled) >= int(m.differences(np.int64(int(1.5 ** (b + 1))))) + 1


def test_shingles_are_sets_of_whole_texts():
    texts = ["a B c a b C a b", "a", "", "a b", " \n", "é É"]
    key, of = j.shingles(j.OP9, pa.array(texts))
    sizes, sig = j._signature(key, of, len(texts))
    assert sizes.tolist() == [len(shingle_set(t, 3)) for t in texts]
    assert len(set(sig.tolist())) == 5


def test_query_and_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.op9_jaccard_join(spark, SF).collect()}
    assert got == brute(rows, j.OP9)
    groups = defaultdict(list)
    for i, (n, c) in brute(rows, j.NEAR).items():
        groups[c].append(i)
    kept = j.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_nulls_repeats_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, long, "a", None), (1, long, "a", None), (2, long + " x", None, "b"), (None, long, None, None), (3, None, None, None), (4, "", None, None), (1, "other text of this id", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.id or 0), r.n > 0, r.component or 0) for r in j.grouped(j.join(docs, j.OP9)).collect())
    assert got == [(0, True, 0), (1, True, 1), (1, True, 1), (1, True, 1), (2, True, 1), (3, False, 3), (4, False, 4)]
    kept = j.without_near_duplicates(docs, j.OP9)
    assert sorted((r.doc_id or 0) for r in kept.collect()).count(1) <= 2 and kept.filter("doc_id = 2").count() == 0
    assert j.grouped(j.join(docs.limit(0), j.OP9)).count() == 0 and j.without_near_duplicates(docs.limit(0)).count() == 0


def test_index_takes_little_memory_and_is_the_same_in_any_slices(monkeypatch):
    rnd = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rnd.integers(0, 5000, 500)]) for _ in range(1600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    bands = j.Layout(j.NEAR, {j.band_of(np.array([498])).item(): 1600})
    tracemalloc.start()
    try:
        for _ in j._index(j.NEAR, bands)(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(" ".join(texts)) > 4 << 20 and peak < 80 << 20
    found = []
    for most in (1, 1 << 14, 4 << 20):
        monkeypatch.setattr(j, "SLICE_BYTES", most)
        found.append({tuple(r.values()) for b in j._index(j.NEAR, bands)(iter([batch.slice(0, 60)])) for r in b.to_pylist()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 60


def test_texts_reach_tasks_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, seen, profile = spark.conf.get(name), [], j._profile

    def watched(m):
        seen.append(spark.conf.get(name))
        return profile(m)

    monkeypatch.setattr(j, "_profile", watched)
    docs = spark.createDataFrame([(i, f"a b c {i % 2}", None, None) for i in range(4)], SCHEMA)
    assert j.grouped(j.join(docs, j.NEAR)).count() == 4
    assert seen == ["1000"] and spark.conf.get(name) == was
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) == 1000
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == was
