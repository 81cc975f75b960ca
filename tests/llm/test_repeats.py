import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, n_units string"


def brute(texts, window, split):
    """(units, kept units, spans) of each text."""
    docs = [split(t or "") for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((len(d), [x for x, g in zip(d, gone, strict=False) if not g], int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(d) else 0))
    return out


def corpus(seed, n, unit):
    """Texts with copied stretches of all lengths, edits, periods and repeats."""
    rnd = random.Random(seed)
    new = lambda k: [rnd.choice(unit) for _ in range(k)]
    pool = [new(rnd.randrange(5, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = new(rnd.randrange(0, 30))
        for _ in range(rnd.randrange(0, 4)):
            p = list(rnd.choice(pool))
            if rnd.random() < 0.5 and p:
                p[rnd.randrange(len(p))] = rnd.choice(unit)
            t += p[rnd.randrange(0, 5) :] + new(rnd.randrange(0, 12))
        if rnd.random() < 0.15:
            t += new(rnd.randrange(1, 4)) * rnd.randrange(1, 15)
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_words_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "COMPARED", [48, 2, 1][seed])
    texts = [" ".join(t) for t in corpus(seed, 150, [f"w{i}" for i in range(12)])]
    texts += [None, "", texts[3], texts[3], "é " * 40]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.id: r for r in substring_dedup.without_repeats(docs, substring_dedup.units(8, 3), "doc_id", "text", bytes).collect()}
    for i, (n, kept, spans) in enumerate(brute(texts, 8, str.split)):
        assert (got[i].n_units, got[i].n_removed, bytes(got[i].kept).decode(), got[i].n_spans) == (n, n - len(kept), " ".join(kept), spans), i


@pytest.mark.parametrize("seed", range(3))
def test_bytes_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "COMPARED", [48, 2, 1][seed])
    texts = ["".join(t) for t in corpus(10 + seed, 200, "abé")]
    texts += [None, "", texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.id: r for r in suffix_dedup.remove_strings(docs, window=16, anchor=5).collect()}
    for i, (n, kept, spans) in enumerate(brute(texts, 16, lambda t: list(t.encode()))):
        assert (got[i].n_units, bytes(got[i].kept), got[i].n_spans) == (n, bytes(kept), spans), i


def test_rows_that_share_an_id_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "x y", None, None), (None, None, None, None)], SCHEMA)
    got = sorted(((r.n_units, r.n_removed) for r in substring_dedup.remove_passages(docs, window=3).collect()))
    assert got == [(0, 0), (2, 0), (6, 6), (6, 6)]
    assert substring_dedup.remove_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["words", "bytes"])
def test_queries_on_the_small_tables(spark, name):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = [r.text for r in rows]
    if name == "words":
        got = {r.doc_id: (r.n_words, r.kept_sha256) for r in substring_dedup.op7_substring_dedup(spark, SF).collect()}
        want = {r.doc_id: (n, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for r, (n, kept, _) in zip(rows, brute(texts, 35, str.split), strict=True)}
    else:
        got = {r.doc_id: (r.n_bytes, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10_suffix_dedup(spark, SF).collect()}
        want = {r.doc_id: (n, s, hashlib.sha256(bytes(kept)).hexdigest()) for r, (n, kept, s) in zip(rows, brute(texts, 200, lambda t: list(t.encode())), strict=True)}
    assert got == want


def test_blocks_cover_every_window_once():
    rng = np.random.default_rng(0)
    units = rng.integers(1, 5, 500).astype(np.uint64)
    offsets = np.array([0, 3, 3, 200, 207, 500])
    _, _, of, start, n, off = repeats.blocks(units, offsets, 8, 3)
    got = sorted((t, s + i) for t, s, k in zip(of, start, n, strict=True) for i in range(k))
    assert got == [(t, i) for t in range(5) for i in range(offsets[t + 1] - offsets[t] - 7)]
    assert (off >= n - 1).all() and (off < 6 + n).all()


def test_many_equal_rows_without_ids(spark):
    from tessera.llm import substring_dedup

    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w200 ", "other ")
    docs = spark.createDataFrame([(None, text)] * 3000 + [(1, near), (2, "short")], "doc_id long, text string")
    got = substring_dedup.remove_passages(docs).groupBy("n_units", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(400, 400, 3000), (400, 399, 1), (1, 0, 1)}
