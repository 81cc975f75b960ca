import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import secret_scans as s

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(out)


def base_of(texts):
    found, data, ends = s.find(pa.array(texts, pa.string()))
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = [[] for _ in texts]
    for t, k, a, z in found.spans.tolist():
        out[t].append((int(point[a] - point[ends[t]]), k, int(point[z] - point[ends[t]])))
    return [sorted(x) for x in out]


parts = st.sampled_from(["token", "PassWord", "api_key", "apikey", "secret", "ſecret", " = ", "=", ": '", '"', "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "Zz9+/", "é", " ", "\n", "AKI", "Kelvin"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(parts, max_size=14).map("".join), max_size=5))
def test_base_spans_equal_brute_force(texts):
    assert base_of(texts) == [brute(t) for t in texts]


def test_held_out_strings_are_told_apart():
    rnd = random.Random(5)
    syllables = ["an", "the", "ion", "re", "ting", "ment", "ou", "st", "er", "al", "_", "-"]
    name = lambda: "".join(rnd.choice(syllables) for _ in range(9)).ljust(16, "e")
    key = lambda: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    train = [f"token = {key()} {name()} {name()} {name()}" for _ in range(400)]
    counts = np.zeros((2, 128 * 128), np.int64)
    for b in s._count(iter([pa.RecordBatch.from_arrays([pa.array(train)], names=["text"])])):
        for k, p, n in zip(*(c.to_pylist() for c in b), strict=True):
            counts[k, p] = n
    model = s.SecretModel.fit(counts)
    tests = [(key(), True) for _ in range(300)] + [(name(), False) for _ in range(300)]
    spans, _, _ = s._scanned(pa.array([f"see {x} here" for x, _ in tests]), model)
    hit = np.array([any(k == 3 for *_, k in own) for own in spans])
    truth = np.array([v for _, v in tests])
    assert hit[truth].mean() > 0.97 and hit[~truth].mean() < 0.01


def test_random_strings_are_found_by_models_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = s.fit(docs)
    rnd = random.Random(9)
    key = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    words = sorted({w.lower() for r in docs.filter("doc_id % 9 = 0").collect() for w in re.findall("[A-Za-z]{3,}", r.text or "")})
    name = lambda: "_".join(rnd.choice(words) for _ in range(4)).ljust(16, "e")
    tests = [(key(rnd.randrange(20, 41)), True) for _ in range(1000)] + [(name(), False) for _ in range(1000)]
    spans, _, _ = s._scanned(pa.array([f"see {x} here" for x, _ in tests]), model)
    hit, truth = np.array([any(k == 3 for *_, k in own) for own in spans]), np.array([v for _, v in tests])
    assert hit[truth].mean() > 0.95 and hit[~truth].mean() < 0.01


def test_what_is_left_beside_a_base_span_is_judged():
    model = s.SecretModel(np.ones(128 * 128), 0.0)
    spans, _, _ = s._scanned(pa.array(["x KqZr7TbXw9LmPv2QsYt8HdGf0123456789abcdef y"]), model)
    assert [(a, z, s.KINDS[k]) for a, z, k in spans[0]] == [(2, 25, "model"), (25, 42, "hex")]


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in s.op2_secret_scans(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, r = brute(d.text), got[d.doc_id]
        line = ",".join(f"{s.KINDS[k]}:{a}:{z}" for a, k, z in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_redaction_and_edge_cases(spark):
    rows = [(1, "é token = abcdefghijkl0 end", "x"), (2, None, "x"), (3, "", None), (None, "plain", "x"), (1, "é token = abcdefghijkl0 end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = s.fit(docs)
    assert sorted((r.doc_id or 0, len(r.spans)) for r in s.scan(docs, model).collect()) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 0)]
    assert [r.text for r in s.redact(docs, model).collect()] == ["é [SECRET] end", None, "", "plain", "é [SECRET] end"]
    assert s.scan(docs.limit(0), s.fit(docs.limit(0))).count() == 0
