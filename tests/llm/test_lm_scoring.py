import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm_scoring as m

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, n_known string"


def tree_of(texts, depths, least):
    """A tree from brute-force counts, and those counts."""
    counts = defaultdict(Counter)
    for t in texts:
        s = [m.BEFORE] * m.DEPTH + list(t.encode()) + [m.END]
        for i in range(m.DEPTH, len(s)):
            for d in depths:
                counts[tuple(s[i - d : i])][s[i]] += 1
    counts = {c: n for c, n in counts.items() if not c or sum(n.values()) >= least}
    pack = lambda c: sum(x << m.BITS * i for i, x in enumerate(reversed(c)))
    rows = [(len(c), pack(c), x, k) for c, n in counts.items() for x, k in n.items()]
    return m.SuffixTree.build(*(np.array(x, np.int64) for x in zip(*rows, strict=True))), counts


def naive(text, counts):
    def p(context, symbol):
        known = [d for d in range(len(context) + 1) if context[len(context) - d :] in counts]
        value = None
        for d in known:
            n = counts[context[len(context) - d :]]
            total = sum(n.values())
            value = (n[symbol] + 0.5) / (total + 0.5 * 257) if value is None else (n[symbol] + m.SMOOTHING * value) / (total + m.SMOOTHING)
        return value

    s = (m.BEFORE,) * m.DEPTH + tuple(text.encode()) + (m.END,)
    return sum(math.log10(p(s[i - m.DEPTH : i], s[i])) for i in range(m.DEPTH, len(s)))


@pytest.mark.parametrize("depths", [range(6), (0, 2, 5), (0,)])
def test_automaton_equals_longest_suffix_lookup(depths):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["an", "th", "é", "x", " "]) for _ in range(rnd.randrange(1, 30)))
    train = [word() for _ in range(80)]
    tree, counts = tree_of(train, depths, 4)
    tests = ["", train[0], "".join(word() for _ in range(90)), "never seen: 09", "é" * 300]
    got = tree.score(pa.array(tests, pa.string()))
    assert got == pytest.approx([naive(t, counts) for t in tests], rel=1e-5)


def test_probabilities_sum_to_one():
    tree, _ = tree_of(["abab", "abc", "b"], range(4), 1)
    p, seen = 10 ** tree.log10.astype(float), tree.log10.shape[1] - 3
    assert p[:, :seen].sum(1) + p[:, seen] * (257 - seen) == pytest.approx(np.ones(len(p)), rel=1e-5)


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_query_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(m, "HEAD", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {d.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), d.text)) for d in docs}
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    count = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in m.op4_lm_scoring(spark, SF).collect()}
    assert len(got) == len(docs) and 0 < sum(held.values()) < len(docs)
    for i, ws in words.items():
        r, tokens = got[i], [*ws, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0


def test_learnt_text_scores_above_noise(spark):
    docs = spark.createDataFrame([(i, "the station and the nation are in motion " * 5, None, None) for i in range(60)] + [(99, None, None, None), (None, "", None, None)], SCHEMA)
    model, words = m.fit(docs)
    tests = spark.createDataFrame([(1, "the nation and the station", None, None), (2, "eht noitan dna eht noitats", None, None), (3, None, None, None), (3, None, None, None)], SCHEMA)
    got = sorted((r.id, r.n_tokens, r.n_known, r.score) for r in m.score(tests, model, words).collect())
    assert got[0][3] > got[1][3] + 10 and [g[:3] for g in got] == [(1, 6, 6), (2, 6, 1), (3, 1, 1), (3, 1, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    model, words = m.fit(none)
    assert m.score(none, model, words).count() == 0
    one = m.score(spark.createDataFrame([(1, "ab", None, None)], SCHEMA), model, words).first()
    assert one.score == pytest.approx(3 * math.log10(1 / 257), rel=1e-5) and one.base_score == pytest.approx(0.0) and one.n_known == 0


def test_capitals_count_as_small_letters(spark):
    train = spark.createDataFrame([(1, "The THE the É", None, None), (2, "AND and", None, None)], SCHEMA)
    model, words = m.fit(train)
    assert (model.tokens, model.distinct) == (8, 4)  # the x 3, É, and x 2, the end x 2
    tests = spark.createDataFrame([(1, "the and É", None, None), (2, "tHe AND É", None, None), (3, "the and é", None, None)], SCHEMA)
    got = {r.id: r for r in m.score(tests, model, words).collect()}
    assert got[1].n_known == got[2].n_known == 4 and got[3].n_known == 3  # É is not in A-Z
    assert got[1].base_score == got[2].base_score == pytest.approx(sum(math.log10((c + 1) / 13) for c in (3, 2, 1, 2)))
    assert got[1].score == got[2].score


def test_contexts_count_absolutely(spark):
    train = spark.createDataFrame([(1, "ab" * 2_000_000, None, None), (2, "qz" * 15, None, None)], SCHEMA)
    model, words = m.fit(train)
    one = m.score(spark.createDataFrame([(1, "qz" * 5, None, None)], SCHEMA), model, words).first()
    assert one.score > -15  # q and z follow each other, though they are under 1e-5 of all symbols


@pytest.mark.parametrize("head", [1 << 19, 300])
def test_joined_scores_equal_the_automaton(spark, monkeypatch, head):
    monkeypatch.setattr(m, "HEAD_GRAMS", head)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).cache()
    model, words = m.fit(docs.filter(~m.is_held_out()))
    table = m.contexts(model).toArrow()
    tree = m.SuffixTree.build(*(table[x].to_numpy().astype(np.int64) for x in ("depth", "context", "next", "n")))
    tests = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "\u65e5\u672c never seen"), (-3, "\u65e5\u672c never seen")], "doc_id long, text string"))
    text = {r.doc_id: (r.text or "") for r in tests.collect()}
    got = m.score(tests, model, words).collect()
    want = tree.score(m.ta.lowered(pa.array([text[r.id] for r in got], pa.string())))
    assert len(got) == len(text) + 1 and [r.score for r in got] == pytest.approx(want.tolist(), rel=1e-4)


@pytest.mark.parametrize("taken", [m.TAKEN, 1])
def test_retained_contexts_and_scores_equal_brute_force(spark, monkeypatch, taken):
    monkeypatch.setattr(m, "TAKEN", taken)
    monkeypatch.setattr(m, "HEAD_GRAMS", 200)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(25).collect()]
    docs += [(-1, None), (-2, ""), (-3, "ab" * 400), (-3, "ab" * 400)]
    low = lambda t: re.sub("[A-Z]", lambda c: c[0].lower(), t or "")
    counts = defaultdict(Counter)
    for _, t in docs:
        s = [m.BEFORE] * m.DEPTH + list(low(t).encode()) + [m.END]
        for i in range(m.DEPTH, len(s)):
            for d in range(m.DEPTH + 1):
                counts[tuple(s[i - d : i])][s[i]] += 1

    def gain(c):
        own, up = counts[c], counts[c[1:]]
        return sum(n * math.log(n / own.total() * up.total() / up[x]) for x, n in own.items())

    kept = {c: n for c, n in counts.items() if not c or n.total() >= m.MIN_COUNT and gain(c) > m.MIN_GAIN}
    assert {len(c) for c in kept} == set(range(m.DEPTH + 1))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model, words = m.fit(df)
    pack = lambda c: sum(x << m.BITS * i for i, x in enumerate(reversed(c)))
    got = Counter(tuple(r) for r in m.contexts(model).collect())
    assert got == Counter((len(c), pack(c), x, k) for c, n in kept.items() for x, k in n.items())
    tests = [*docs, (-5, "Zq \u65e5\u672c never seen 09"), (-6, "e" * 300)]
    text = {i: low(t) for i, t in tests}
    rows = m.score(spark.createDataFrame(tests, "doc_id long, text string"), model, words).collect()
    assert len(rows) == len(tests)
    for r in rows:
        assert r.score == pytest.approx(naive(text[r.id], kept), rel=1e-9)


def test_very_long_text(spark):
    long = "the nation and the station " * 60_000
    docs = spark.createDataFrame([(1, long), (2, "the nation")], "doc_id long, text string")
    model, words = m.fit(docs)
    got = {r.id: r for r in m.score(docs, model, words).collect()}
    assert got[1].n_tokens == got[1].n_known == 300_001
    table = m.contexts(model).toArrow()
    tree = m.SuffixTree.build(*(table[x].to_numpy().astype(np.int64) for x in ("depth", "context", "next", "n")))
    assert [got[1].score, got[2].score] == pytest.approx(tree.score(pa.array([long, "the nation"])).tolist(), rel=1e-3)


def test_sums_merge_within_three_times_what_they_hold():
    rnd = np.random.default_rng(3)
    rows, run = 1 << 20, 1 << 15
    sums, want = m._Sums(), 0
    tracemalloc.start()
    try:
        for _ in range(rows // run):
            keys = np.sort(rnd.integers(0, 1 << 62, run))
            want ^= int(np.bitwise_xor.reduce(keys))
            sums.add(keys, np.ones(run, np.int64))
        del keys
        tracemalloc.reset_peak()
        keys, n = sums.merge()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(keys) == n.sum() == rows and int(np.bitwise_xor.reduce(keys)) == want
    assert peak < 3 * 16 * rows


def test_sums_equal_a_counter(monkeypatch):
    monkeypatch.setattr(m, "HELD", 60)
    rnd, want, sums = np.random.default_rng(4), Counter(), m._Sums()
    assert [len(x) for x in sums.merge()] == [0, 0]
    for _ in range(50):
        keys, n = np.unique(rnd.integers(-20, 20, 30), return_counts=True)
        sums.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        assert sums.held <= 90
    keys, n = sums.merge()
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()
