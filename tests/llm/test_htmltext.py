"""HTML extraction: gradients, the pages table, and layouts never trained on."""

import html
import re

import numpy as np
import pytest

from riskweave.llm import htmltext, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages():
    import pyarrow.parquet as pq
    return pq.read_table(f"{SF}/pages.parquet").to_pylist()


@pytest.fixture(scope="module")
def model(pages):
    return htmltext.fit_pages([p["html"] for p in pages[:150]])


def article(page):
    """The article element's text, blocks split at the tags that end a block."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1|article)>|<br>", body)
    return " ".join(t for t in (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts) if t)


def text_of(model, page):
    blocks = htmltext.Parser().blocks(page)
    return " ".join(b[0] for b, m in zip(blocks, model.label([blocks])[0]) if m)


def test_gradients_match_differences():
    lab, rng = htmltext.Labeller(), np.random.default_rng(0)
    pages = [[("some text here", [3, 9], [4, 5, 6], 2, [])] * 3, [("other", [3], [8], 0, [])] * 5]
    data, lengths = htmltext.inputs(pages), np.array([3, 5])
    y = rng.random(8) < 0.5
    _, grad = lab.gradients(data, lengths, y)
    for name in lab.p:
        flat, g = lab.p[name].reshape(-1), grad[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = lab.gradients(data, lengths, y)[0]
            flat[i] = old - e
            down = lab.gradients(data, lengths, y)[0]
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 1e-6


def test_pages_table(spark, pages):
    got = {r["page_id"]: r for r in queries.op8(spark, SF).collect()}
    assert len(got) == len(pages)
    right = sum(got[p["page_id"]]["text"] == article(p["html"]) for p in pages)
    assert right == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_layouts(model, pages):
    rng = np.random.default_rng(99)
    blocks = [b[0] for p in pages[150:] for b in htmltext.Parser().blocks(p["html"])]
    prose, bits = [b for b in blocks if len(b) > 60], [b for b in blocks if len(b) <= 60]
    hit = total = 0
    for _ in range(100):
        b = htmltext.Parser().blocks(htmltext.generated(rng, prose, bits))
        y = np.array([htmltext.MARK in x[0] for x in b])
        hit += int((model.label([b])[0] == y).sum())
        total += len(y)
    assert hit / total >= 0.97


def test_broken_markup_and_edges(spark, model):
    p = htmltext.Parser()
    assert p.blocks(None) == [] and p.blocks("") == [] and p.blocks("<p> </p>&nbsp;") == []
    assert [b[0] for b in p.blocks("a<b>b</b>c<br>d<p>e &amp; f<p>g</i></div>h<!-- x")] == ["abc d", "e & f", "g", "h"]
    assert [b[0] for b in p.blocks("<script>x</p></script>y<style>z")] == ["y"]
    assert [b[0] for b in p.blocks("<p title='a>b'>t</p><p class=\"x>u</p>")][0] == "t"
    assert text_of(model, "<html><body><nav><a>m</a></nav><article><p>one  two</p><p>three</p></article>") == "one two three"
    long = "<article>" + "<p>many words in this long paragraph, and more.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", long), (3, "u", "<article><p>x &lt;tag&gt; &eacute;</p></article>"), (None, None, "<")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' as text", "5 as n_chars")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in htmltext.extract(df, model).collect())
    assert len(got) == 5 and (1, 0) in got and (2, 0) in got and (3, 20_000 * 45 - 1) in got and (3, 9) in got
    assert htmltext.extract(df.limit(0), model).collect() == []
    assert htmltext.fit(df.limit(0)) is not None


@pytest.mark.parametrize("tag", ["svg", "math", "object", "noscript", "template", "iframe"])
@pytest.mark.parametrize("end", [True, False])
def test_only_scripts_and_styles_are_dropped(tag, end):
    page = f"<article><p>before</p><{tag}>inside{f'</{tag}>' if end else ''}<p>after</p><style>x</style><script>y</article>"
    assert " ".join(b[0] for b in htmltext.Parser().blocks(page)) == "before inside after"


def test_formulas_stay_in_their_block():
    page = "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>"
    assert [b[0] for b in htmltext.Parser().blocks(page)] == ["so x=1 holds"]
