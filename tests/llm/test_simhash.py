import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as m

SF = "/root/testdata/sf0.001"


def naive(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)].append(d)
    return [min(least[top(i)], default=None) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [naive(d.text) for d in docs]
    want = {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, classes(fps, [d.doc_id for d in docs]), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in m.op11_simhash(spark, SF).collect()} == want


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 7919} é{i % 13}" for i in range(120_000))
    texts = [None, "", " \t", "Two words", "two  WORDS", "one", long, long + " end", "a b c", "a b c", None]
    ids = [5, 3, 9, 8, 2, None, 20, 19, 4, 4, None]
    df = spark.createDataFrame(list(zip(ids, texts, ids, ids, strict=True)), "doc_id long, text string, fp long, key long")
    got = m.near_duplicates(df).collect()
    fps = [naive(t) for t in texts]
    want = sorted((str(i), f, str(c)) for i, f, c in zip(ids, fps, classes(fps, ids), strict=True))
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component)) for r in got) == want
    assert m.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bit_sliced_pairs_equal_all_pairs(monkeypatch, seed):
    monkeypatch.setattr(m, "PAIRS", 50)
    rnd = random.Random(seed)
    sizes, fp = [1, 2, 70, 1, 200, 3], []
    for n in sizes:
        base, some = rnd.getrandbits(64), set()
        while len(some) < n:
            some.add(base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) % (1 << 64))
        fp += some
    end = np.cumsum(sizes)
    start = end - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    got = [(int(a), int(b)) for x, y in m.near_pairs(np.array(fp, np.uint64).view(np.int64), start[group], end[group]) for a, b in zip(x, y, strict=True)]
    want = [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and (fp[i] ^ fp[j]).bit_count() <= 2]
    assert sorted(got) == want and len(want) > 100


@pytest.mark.parametrize("most", [1 << 12, 20])
def test_split_groups_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(m, "GROUP", most)
    rnd = random.Random(7)
    base = rnd.getrandbits(64)
    fps = {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(40)) for _ in range(500)} | {rnd.getrandbits(64) for _ in range(200)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = m.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all((r.a % (1 << 64) ^ r.b % (1 << 64)).bit_count() > 0 for r in found)
    up = {f: f for f in fps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in found:
        up[top(r.a)] = top(r.b)
    want = classes([f % (1 << 64) for f in fps], fps)
    ours = defaultdict(set)
    for f, c in zip(fps, want, strict=True):
        ours[top(f)].add(c)
    assert all(len(s) == 1 for s in ours.values()) and len(ours) == len(set(want))


def test_masks_cover_every_pair():
    for a in range(64):
        for b in range(a):
            differ = 1 << a | 1 << b
            for level in (m.masks(), m.split(0), m.split(m.masks()[0] % (1 << 64))):
                free = [x for x in level if not x % (1 << 64) & differ]
                assert free or (level is not m.masks() and any(m.masks()[0] % (1 << 64) & d for d in (1 << a, 1 << b)))
    assert all(64 - (c % (1 << 64)).bit_count() <= 12 for x in m.masks() for y in m.split(x) for c in m.split(y))
