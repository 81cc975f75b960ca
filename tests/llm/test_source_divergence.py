import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from tessera.llm import source_divergence as m

SCHEMA = "doc_id long, text string, lang string, source string"


def words(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def naive(rows, least, top=m.TOP):
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        docs[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
    out = []
    for lang, its in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept} if kept else {}  # noqa: E731, B023
        p = {s: share(counts[lang, s]) for s in its}
        q = share(sum((counts[lang, s] for s in its), Counter()))
        for s in its:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in its if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("tile", [48, 2])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(m, "TILE", tile)
    monkeypatch.setattr(m, "SLICE", 500)
    monkeypatch.setattr(m, "HELD", 300)
    rnd = random.Random(4)
    stock = ["a", "an", "and", "ande", "Anderson", "über", "übergang", "日本語の文", "x" * 70, "x" * 69 + "y", "it's", "co-op", "é", "zoo", "sand", "Sandstone"]
    rows = [(i, " ".join(rnd.choices(stock, [len(stock) - k for k in range(len(stock))], k=rnd.randrange(12))) + f" r{i}q", rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", "é", None])) for i in range(200)]
    rows += [(None, None, "fr", "s1"), (1, "", "fr", "s2"), (1, None, "it", "alone"), (7, "same text " * 3, "xx", "s"), (7, "same text " * 3, "xx", "s"), (8, "and\x00and", "en", "s1")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least in (2, 12):
        got = m.divergence(df, least, 4)
        assert sorted(tuple(r) for r in got.collect()) == naive(rows, least, 4)
    assert got.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]


def test_long_texts_many_sources_and_clashing_columns(spark):
    long = " ".join(f"w{'abcdefghij'[i % 10] * (i % 37)}" for i in range(100_000))
    rows = [(i, long if i < 3 else f"abc term{'xyz'[i % 3]} {'q' * 5000}", "en", f"s{i % 130}") for i in range(260)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", level int, prefix int")
    assert sorted(tuple(r) for r in m.divergence(df, 3, 5).collect()) == naive(rows, 3, 5)
    assert m.divergence(df.limit(0)).count() == 0


def test_new_levels_count_documents_once():
    texts = ["sand sandstone sands", "san andes and", "sandstone", ""]
    distinct, of, term, new, count = m.terms(pa.array(texts))
    names = [x + m.END for x in distinct.to_pylist()]
    assert names == sorted(names) and count.sum() == 7
    for n in range(6):
        got = Counter(names[t][: m.level(n)] for t, lv in zip(term, new, strict=True) if lv <= n)
        want = Counter(p for t in texts for p in {(w.encode() + m.END)[: m.level(n)] for w in words(t)})
        assert got == want


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    cur = duckdb.sql(m.ORACLES["op13_source_divergence"])
    want = sorted(tuple(r) for r in cur.fetchall())
    got = m.op13_source_divergence(spark, folder)
    assert got.columns == cur.columns
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 2000
