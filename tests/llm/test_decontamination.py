import itertools
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination as d

SF = "/root/testdata/sf0.001"


def toks(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+", (text or "").lower())


def brute(docs, items):
    """(doc, item) to (windows, most equal, first place), by trying every window of each pair."""
    out = {}
    for i, t in docs:
        x = toks(t)
        own = set(x)
        for k, u in items:
            y = toks(u)
            starts = {}
            if len(y) >= d.WINDOW and sum(w in own for w in y) >= d.WINDOW - d.SUBSTITUTIONS:
                for a in range(len(x) - d.WINDOW + 1):
                    for b in range(len(y) - d.WINDOW + 1):
                        n = sum(p == q for p, q in zip(x[a : a + d.WINDOW], y[b : b + d.WINDOW], strict=True))
                        if n >= d.WINDOW - d.SUBSTITUTIONS:
                            starts[a] = max(starts.get(a, 0), n)
            elif 0 < len(y) < d.WINDOW:
                same = {a: sum(p == q for p, q in zip(x[a:], y, strict=False)) for a in range(len(x) - len(y) + 1)}
                starts = {a: n for a, n in same.items() if n >= len(y) - (len(y) >= 7)}
            for a, n in starts.items():
                out.setdefault((i, k), {}).setdefault(a + 1, 0)
                out[i, k][a + 1] = max(out[i, k][a + 1], n)
    return {pair: (len(starts), max(starts.values()), min(starts)) for pair, starts in out.items()}


def test_masks_meet_every_window_with_two_substitutions():
    for bad in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        assert any(not {s + k for k in mask} & set(bad) for mask in d.MASKS for s in range(d.WINDOW - max(mask)))


def test_masks_of_short_items_meet_one_substitution():
    for n in range(1, d.WINDOW):
        assert d.substitutions(n) == (n >= 7)
        for bad in range(n if d.substitutions(n) else 0):
            assert any(bad not in mask for mask in d.short_masks(n))


@pytest.mark.parametrize("seed, lengths", [(2, [13, 14, 20, 30, 12, 7, 5, 3, 0]), (3, [*range(1, 13), 15])])
def test_pairs_equal_brute_force(spark, seed, lengths):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate(lengths)] + [(50, None)]
    docs = [(0, None), (1, ""), (None, items[-2][1]), (None, "clean text"), (7, "clean text of a repeated id")]
    for i in range(2, 120):
        words = [word() for _ in range(rnd.randrange(0, 20))]
        if rnd.random() < 0.7:
            y = toks(rnd.choice(items)[1])
            a = rnd.randrange(max(1, len(y) - 12))
            y = y[a : a + rnd.randrange(8, 31)]
            for _ in range(rnd.randrange(0, 4 if len(y) > 12 else 3)):
                if y:
                    y[rnd.randrange(len(y))] = word()
            words += y + [word() for _ in range(rnd.randrange(0, 6))]
        docs.append((i, ", ".join(words).title()))
    docs.append(docs[5])
    a = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, item_id string, seed string")
    b = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    got = {(r.id, r.item): (r.n_windows, r.most_equal, r.first_token) for r in d.contaminated(a, b).collect()}
    want = brute(docs, items)
    assert len(want) > 20 and got == want
    stays = d.without_contaminated(a, b)
    assert stays.columns == a.columns and sorted((str(r.doc_id), str(r.text)) for r in stays.collect()) == sorted((str(i), str(t)) for i, t in docs if not brute([(0, t)], items))


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, d.contaminated(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_SEEDS", 500)
    assert one and sorted(map(tuple, d.contaminated(docs, items).collect())) == one


def test_empty_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert d.contaminated(docs.limit(0), items).count() == 0 and d.contaminated(docs, items.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    d.contaminated(docs.filter(F.lit(True)), items).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(d.ORACLES["op5_decontamination"])
    names = [c[0] for c in rel.description]
    got = d.op5_decontamination(spark, SF)
    want = rel.fetchall()
    assert got.columns == names and want and sorted(map(tuple, got.collect())) == sorted(want)


def test_very_long_text_is_searched_whole(spark):
    rnd = random.Random(4)
    item = [f"b{k}" for k in range(20)]
    words = [f"w{rnd.randrange(5000)}" for _ in range(200_000)]
    words[-20:] = item
    words[-15] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-20]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in d.contaminated(docs, items).collect()] == [(1, 1, 8, 13, 199_981)]


@pytest.mark.parametrize("stretch", [1, 4, 17])
def test_stretches_change_nothing(spark, monkeypatch, stretch):
    rnd = random.Random(5)
    items = [(k, " ".join(f"w{rnd.randrange(40)}" for _ in range(n))) for k, n in enumerate([13, 14, 22, 12, 7, 3, 1])]
    docs = []
    for i in range(30):
        words = [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 50))]
        y = toks(rnd.choice(items)[1])
        y[rnd.randrange(len(y))] = "other"
        docs.append((i, " ".join(words + y + words[:i])))
    monkeypatch.setattr(d, "STRETCH", stretch)
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert len(want) > 20 and {(r.id, r.item): (r.n_windows, r.most_equal, r.first_token) for r in found.collect()} == want


def test_long_text_full_of_hits_fits_memory(spark):
    item = [f"b{k}" for k in range(20)]
    docs = spark.createDataFrame([(1, " ".join(item * 2000))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "b4 b5 b6")], "item_id long, text string")
    assert sorted(map(tuple, d.contaminated(docs, items).collect())) == [(1, 1, 16_000, 13, 1), (1, 2, 2000, 3, 5)]


def test_large_row_groups_are_not_held_outside_the_heap(spark, tmp_path):
    rnd = random.Random(6)
    item = " ".join(f"b{k}" for k in range(20))
    texts = [rnd.randbytes(100_000).hex() for _ in range(400)] + [item]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    pq.write_table(pa.table({"item_id": [7], "text": [item]}), tmp_path / "benchmark.parquet")
    kind = spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
    held = lambda: sum(x.getTotalCapacity() for x in spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind) if x.getName() == "direct") / 1e6
    before = held()
    assert [tuple(r) for r in d.op5_decontamination(spark, str(tmp_path)).collect()] == [(400, 7, 8, 13, 1)]
    assert held() - before < 40
