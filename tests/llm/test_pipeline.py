from collections import defaultdict

import corpus_pipeline as p
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard_join import brute as groups

from tessera.llm import jaccard_join
from tessera.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    by_stage = {}
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, SF))
        by_stage[name] = docs
    start = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r.doc_id: r for r in by_stage["quality"].collect()}
    good = [i for i, x in labels.items() if x.quality and len(start[i].text.split()) >= 50]
    bad = [i for i, x in labels.items() if not x.quality]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.5 * len(bad)

    want = defaultdict(set)
    for i, (_, c) in groups([(i, r.text) for i, r in kept.items()], jaccard_join.NEAR).items():
        want[c].add(i)
    unique = {r.doc_id: r for r in by_stage["near_duplicates"].collect()}
    assert set(unique) == set(want)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {i for i, _ in leaks([(i, r.text) for i, r in unique.items()], items)}
    clean = {r.doc_id: r for r in by_stage["decontamination"].collect()}
    assert found and set(clean) == set(unique) - found

    safe = {r.doc_id: r for r in by_stage["secrets"].collect()}
    assert set(safe) == set(clean) and all(r.n_chars == len(r.text) for r in safe.values())
    assert any("[SECRET]" in r.text for r in safe.values()) and by_stage["secrets"].columns == by_stage["quality"].columns

    tokens = defaultdict(int)
    for r in by_stage["packing"].collect():
        tokens[r.doc_id] += r.n_tokens
        assert r.bin_used <= r.bin_capacity
    assert tokens == {i: len(r.text.split()) for i, r in safe.items()}
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, by_stage["packing"].collect()))


def test_stages_pass_columns_nulls_and_repeats_through(spark):
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    schema = "doc_id long, text string, kept string, anomaly string, n_words string, _row string, row string, found string, n string, key string"
    extra = ("k", None, "w", "r", "q", "f", "n", None)
    rows = [(r.doc_id, r.text, *extra) for r in docs]
    rows += [rows[0], rows[0], (None, rows[1][1], *extra), (None, None, *extra), (7_000_001, None, *extra), (7_000_002, "", *extra)]
    start = spark.createDataFrame(rows, schema)
    assert labels
    for empty in (False, True):
        at = start.limit(0) if empty else start
        for _, stage in p.STAGES[:-1]:
            at = written(stage(spark, at, SF))
            assert at.columns == start.columns
        left = at.collect()
        assert all((r.kept, r.anomaly, r.n_words, r._row, r.row, r.found, r.n, r.key) == extra for r in left)
        ids = [r.doc_id for r in left if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and not {7_000_001, 7_000_002} & set(ids) and bool(left) != empty
        packed = p.STAGES[-1][1](spark, at, SF)
        assert (packed.count() == 0) == empty
