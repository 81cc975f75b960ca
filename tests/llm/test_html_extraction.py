import html
import random
import re

import numpy as np
import pytest

from tessera.llm import html_extraction as h

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, text string, id string"


@pytest.fixture(scope="module")
def trained():
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{SF}/pages.parquet").slice(0, 180)
    x, y = [], []
    for i, page in zip(pages["page_id"].to_pylist(), pages["html"].to_pylist(), strict=True):
        rnd = random.Random(str(i))
        short = h.shortened(page, rnd)
        for k, one in enumerate((page, short, *(h.dressed(page, rnd) for _ in range(3)), h.dressed(short, rnd))):
            nodes, _ = h.parse(one)
            x.append(h.features(nodes))
            y.append(h.labels(nodes, k > 1))
    return h.BoostedTrees.fit(np.vstack(x), np.concatenate(y).astype(float))


def article(page):
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", found))).split())


def test_query_equals_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = h.op3_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != article(pages[r.page_id].html)]
    assert not wrong and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_held_out_dressings(trained):
    import pyarrow.parquet as pq

    exact = n = 0
    for page in pq.read_table(f"{SF}/pages.parquet").slice(180, 60)["html"].to_pylist():
        rnd = random.Random(page[:200])
        one = h.dressed(page, rnd)
        nodes, pieces = h.parse(one)
        y = h.labels(nodes, True)
        want = " ".join(t for k, t in pieces if y[k]).split()
        exact += h.main_text(one, trained).split() == want
        n += 1
    assert exact / n > 0.9


def test_a_page_cannot_label_itself():
    nodes, _ = h.parse('<body><div data-y="1">x</div><article><p>text</p></article></body>')
    assert [n.tag for n, y in zip(nodes, h.labels(nodes), strict=True) if y] == ["article", "p"]


def test_decoding_is_hierarchical(trained):
    rnd = random.Random(4)
    for _ in range(50):
        page = "".join(rnd.choice(["<div>", "<p>", "x y ", "</div>", "<nav>", "</nav>", "<ul><li>", "<article>", "</article>", "&amp;", "<"]) for _ in range(60))
        nodes, _ = h.parse(page)
        odds = np.array([rnd.uniform(-1, 1) for _ in nodes])
        keep = h.decode(nodes, odds)
        assert all(keep[n.parent] for k, n in enumerate(nodes) if k and keep[k])


def test_markup_of_every_kind(trained):
    page = """<html><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One<b>two</b>
      three<br>four &lt;five&gt;<!-- no --><script>var a = "</p>";</script><p>six &eacute;&#8364; seven<p title="a>b">eight</article><footer>&copy; us</footer>"""
    assert h.main_text(page, trained) == "A & B Onetwo three four <five> six é€ seven eight"
    assert h.main_text("", trained) == "" and h.main_text("<div", trained) in ("", "<div")


def test_nulls_empty_repeats_and_clashes(spark, trained):
    body = "<body><article><p>" + "long text " * 20_000 + "</p></article></body>"
    rows = [(1, None, None, "x", "y"), (None, "u", "", None, None), (2, "u", body, None, None), (2, "u", body, None, None)]
    got = h.extract(spark.createDataFrame(rows, SCHEMA), trained).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 199_999), (2, 199_999)]
    none = spark.createDataFrame([], SCHEMA)
    assert h.extract(none, h.fit(none)).count() == 0


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<datalist><option value=x></datalist>", ""),
        ("<datalist><option value=x>drop<option value=y>drop</datalist>", "<select><option>drop</option></select>"),
        ("<select><option>drop</option><option>drop</select>", ""),
        ("<datalist><option>drop <b>drop</b></option></datalist>", ""),
        ("<object data=x>", ""),
    ],
)
def test_skipped_elements_without_end_tag_keep_the_page(before, after):
    _, pieces = h.parse(f"<body>{before}<article><p>kept text</p></article>{after}</body>")
    assert "".join(t for _, t in pieces).split() == ["kept", "text"]


def test_raw_text_without_end_tag_takes_the_rest():
    _, pieces = h.parse("<body><p>kept</p><script>var x = 1; <p>code</p></body>")
    assert "".join(t for _, t in pieces).split() == ["kept"]
