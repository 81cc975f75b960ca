import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import best_fit_packing as b

SCHEMA = "doc_id long, text string, piece string, salt int, rank int"


def one_by_one(lengths, opens):
    """Best-fit decreasing, a piece at a time: the multiset of bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [x for x in bins if x[0] >= n]
        if fitting:
            x = min(fitting, key=lambda x: x[0])
        else:
            x = [opens(n), []]
            bins.append(x)
        x[0] -= n
        x[1].append(n)
    return sorted(sorted(x[1]) for x in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([8, 16, 32]))
def test_histogram_steps_equal_piecewise_best_fit(lengths, least):
    opens = lambda n: min(c for c in (8, 16, 32) if c >= max(n, least))
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    placed, bins = b.best_fit(list(counts.items()), opens)
    held = defaultdict(list)
    for length, a, z, per, first, at in placed:
        for rank in range(a, z):
            held[first + (rank - a) // per].append((at + (rank - a) % per * length, length))
    for pieces in held.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
    got = sorted(sorted(n for _, n in x) for x in held.values())
    assert sorted(map(sum, got)) == sorted(used for _, number, used in bins for _ in range(number))
    assert sum(map(len, got)) == len(lengths)
    want = one_by_one(lengths, opens)
    if least == 32:  # with one capacity, ties between bins don't matter
        assert len(got) == len(want) and sorted(map(sum, got)) == sorted(map(sum, want))


def test_pack_loses_nothing(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.choice([0, 1, 3, 9, 10, 11, 25, 64, 130])), "x", 1, 2) for i in range(300)]
    rows += [(None, "a b", None, None, None), (5, None, None, None, None), (5, None, None, None, None), (6, "", None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = b.pack(docs, b.word_count(), capacities=(16, 32, 64), overhead=2).collect()
    want = sorted(len((t or "").split()) for _, t, *_ in rows)
    by_doc, by_bin = defaultdict(int), defaultdict(list)
    for r in got:
        by_doc[r.doc_id] += r.n_tokens
        if r.n_tokens:
            by_bin[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    assert sum(by_doc.values()) == sum(want) and by_doc[7] == len(rows[7][1].split())
    assert len([r for r in got if not r.n_tokens]) == want.count(0)
    for pieces in by_bin.values():
        used = sum(p.n_tokens for p in pieces)
        assert {p.bin_used for p in pieces} == {used} and {p.bin_capacity for p in pieces} == {min(c for c in (16, 32, 64) if c >= used)}
        end = 0
        for p in sorted(pieces, key=lambda p: p.bin_offset):
            assert p.bin_offset == end
            end += p.n_tokens


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert b.pack(docs, F.length("text")).count() == 0


def test_joint_plan_is_no_dearer_than_any_policy():
    histogram = [(n, 100 - n) for n in range(1, 65)]
    _, cost = b.plan(histogram, (16, 32, 64), 2)
    for least in (16, 32, 64):
        _, bins = b.best_fit(histogram, lambda n, least=least: min(c for c in (16, 32, 64) if c >= max(n, least)))
        assert cost <= sum(k * (b.downsized(used, (16, 32, 64)) + 2) for _, k, used in bins)
