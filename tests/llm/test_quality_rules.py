import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality_rules as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept string, n_words string"


def brute(text):
    words = WORD.findall(text)
    triples, inside = Counter(zip(words, words[1:], words[2:])), set()
    for k in range(len(words) - 2):
        if triples[tuple(words[k : k + 3])] > 1:
            inside |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n\t\x0b\x1c #<"), max_size=40), max_size=6))
def test_counts_equal_brute_force(texts):
    counts, ratios = q.statistics(pa.array(texts, pa.string()))
    got = list(zip(*(counts[c].tolist() for c in q.COUNTS), strict=True))
    assert got == [brute(t) for t in texts]
    assert ratios.shape == (len(texts), len(q.RATIOS)) and np.isfinite(ratios).all()


def test_forest_finds_rare_rows():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 0.05, (2000, 3)), rng.normal(3, 0.1, (60, 3))])
    good = np.arange(2060) < 2000
    forest = q.IsolationForest.fit(rows)
    forest.threshold = q.calibrated(forest, rows, good)
    odd = forest.score(rows) > forest.threshold
    assert odd[good].mean() <= q.MAX_GOOD_LOSS and odd[~good].mean() > 0.95


def test_query_on_the_small_tables(spark):
    got = {r.doc_id: r for r in q.op1_quality_rules(spark, SF).collect()}
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").collect(), spark.read.parquet(f"{SF}/labels.parquet").collect()
    for d in docs:
        assert tuple(got[d.doc_id][c] for c in q.COUNTS) == brute(d.text)
        n, *_, rep = brute(d.text)
        assert got[d.doc_id].base_failed == (n < 50 or 100 * rep > 50 * n)
    own = [x for x in labels if not got[x.doc_id].base_failed]
    good, bad = ([got[x.doc_id].kept for x in own if x.quality == v] for v in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_nulls_empty_clashes_and_repeats(spark):
    long = "word " * 10_000
    docs = spark.createDataFrame([(1, None, "x", "y"), (None, "a b", None, None), (2, "", "x", "y"), (3, long, "x", "y"), (3, long, "x", "y")], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = q.assess(docs, q.fit(docs, labels)).collect()
    assert sorted((r.n_words, r.base_failed) for r in got) == [(0, True), (0, True), (2, True), (10_000, True), (10_000, True)]
    assert q.assess(docs.limit(0), q.fit(docs.limit(0), labels.limit(0))).count() == 0
