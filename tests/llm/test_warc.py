import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, capture_ts string, digest string"


def round_trip(spark, rows):
    path = shared_folder(spark)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, ts=F.col("capture_ts"))
    return warc.merge_index(warc.read_archives(spark, path)).collect()


def test_revisits_small_null_and_repeated(spark):
    body = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(7, "http://b.org/x", body, "t", "d"), (3, "https://www.a.org/", body, "t", "d"), (9, None, body, None, None),
            (4, "u", "short", None, None), (5, "u", "short", None, None), (6, None, None, None, None), (8, "u\r\nX: y", "", None, None), (8, "u", "", None, None)]
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in round_trip(spark, rows)}
    want = set()
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        first = min(x[0] for x in rows if (x[2] or "") == (html or ""))
        again = len(data) >= 100 and first != i
        want.add((i, "revisit" if again else "response", first if again else None, len(data), hashlib.sha256(data).hexdigest()))
    assert got == want
    assert len(round_trip(spark, rows)) == len(rows)


def test_empty_table(spark):
    assert round_trip(spark, []) == []


@pytest.mark.parametrize("block, records", [(256, 2000), (3, 17), (1, 5)])
def test_index_is_globally_ordered(spark, monkeypatch, block, records):
    monkeypatch.setattr(warc, "BLOCK_ROWS", block)
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", records)
    rnd = random.Random(7)
    # A third of all captures are of one URL, a third of those at one time.
    url = lambda i: "http://hot.org/é" if i % 3 else f"http://{rnd.choice('abc')}.org/{rnd.randrange(11)}"
    rows = [(i, url(i), "x" * i, f"2024-01-{rnd.randrange(1, 29):02}T00:00:00Z" if i % 9 else None, None) for i in range(300)]
    got = round_trip(spark, rows)
    order = [(r.url_key, r.capture_ts, r.archive, r.position) for r in got]
    assert order == sorted(order)
    stamp = {i: t or warc.EPOCH for i, _, _, t, _ in rows}
    assert sorted((r.page_id, r.capture_ts, r.payload_bytes) for r in got) == sorted((i, stamp[i], i) for i in stamp)


def test_merge_holds_one_block_of_each_run():
    rnd = random.Random(3)
    runs = [sorted(rnd.sample(range(100_000), 1000)) for _ in range(7)]
    blocks = sorted([(x, r) for x in run[a : a + 10]] for r, run in enumerate(runs) for a in range(0, 1000, 10))
    open_rows, most, got = 0, 0, []

    def read():
        nonlocal open_rows
        for block in blocks:
            open_rows += len(block)
            yield block

    for x in warc.merge_blocks(read()):
        most, open_rows = max(most, open_rows), open_rows - 1
        got.append(x)
    assert got == sorted((x, r) for r, run in enumerate(runs) for x in run) and most <= 10 * (len(runs) + 1)


def test_very_long_payload(spark):
    body = "äb\r\n\r\n" * 2_000_000
    got = round_trip(spark, [(2, "http://a.org", body, None, None), (1, "http://b.org", body, None, None), (3, "http://c.org/" + "p" * 100_000, "", None, None)])
    size, digest = len(body.encode()), hashlib.sha256(body.encode()).hexdigest()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in got) == [(1, "response", size), (2, "revisit", size), (3, "response", 0)]
    assert {r.payload_digest for r in got if r.page_id < 3} == {digest}


def test_loser_tree_equals_sort():
    rnd = random.Random(1)
    for k in range(8):
        runs = [sorted((rnd.randrange(9), rnd.randrange(9)) for _ in range(rnd.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
