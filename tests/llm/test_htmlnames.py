"""Hand-written pages of other makes: opaque names, tables, sections that only their place tells apart."""

import pytest

from riskweave.llm import htmltext

LONG = ["The council met on Tuesday evening to talk about the new bridge, which has been closed since the flood in spring.",
        "Several members said that the repair would take longer than planned, because the old piers have to be replaced as well.",
        "A decision is expected in autumn. Until then, a ferry takes people across the river every twenty minutes.",
        "Shop owners on the far side report that they lose about a third of their customers, and some think of moving.",
        "The engineers will present two designs, one of steel and one of wood, and both cost about the same."]
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Sport</a></li><li><a href='/d'>Contact</a></li></ul>"
M = "\u0001"                                          # begins every block of the main text


def body(tag="p", n=5):
    return "".join(f"<{tag}>{M}{t}</{tag}>" for t in LONG[:n])


def page(top, main, after=""):
    return f"<html><head><title>Bridge</title></head><body>{top}{main}{after}</body></html>"


PAGES = {
    "opaque classes": page(f"<div class=c1>{MENU}</div>", f"<div class=c2><h1>{M}The bridge</h1>{body()}</div>", "<div class=c3><p>Copyright 2020</p></div>"),
    "no names": page(f"<div>{MENU}</div>", f"<div><h1>{M}The bridge</h1>{body()}</div>", "<div>All rights reserved</div>"),
    "long hashed classes": page(f"<div class='x9f3a'>{MENU}</div>", f"<div class='q81kd'><div class='zz1'><h2>{M}The bridge</h2>{body()}</div></div>",
                                "<div class='x77'><a href='/p'>Privacy</a> <a href='/t'>Terms</a></div>"),
    "table": page(f"<table><tr><td>{MENU}</td></tr></table>", f"<table><tr><td><h1>{M}The bridge</h1>{body()}</td></tr></table>",
                  "<table><tr><td><a href='/x'>Imprint</a></td></tr></table>"),
    "table of two": page(f"<div>{MENU}</div>", f"<table><tr><td>{M}{LONG[0]}</td></tr><tr><td>{M}{LONG[1]}</td></tr></table>"),
    "header in article": page(f"<nav>{MENU}</nav>", f"<article><header><h1>{M}The bridge</h1></header>{body()}</article>", "<footer>Copyright</footer>"),
    "subscription inside": page(f"<nav>{MENU}</nav>", f"<article><h1>{M}The bridge</h1>{body(n=3)}<div class='popup-subscribe'><form><label>Your mail</label>"
                                f"<button>Subscribe</button></form></div><p>{M}{LONG[3]}</p></article>", "<footer>Copyright</footer>"),
    "main and aside": page(f"<nav>{MENU}</nav>", f"<main><h1>{M}The bridge</h1>{body()}</main>", f"<aside><h3>More</h3>{MENU}</aside><footer>Imprint</footer>"),
    "other language": page(f"<div id=k>{MENU}</div>", "<div id=m>" + "".join(
        f"<p>{M}{t}</p>" for t in ["Der Rat hat am Dienstag lange über die neue Brücke beraten, die seit dem Frühjahr gesperrt ist.",
                                   "Viele Händler klagen, dass ihnen ein Drittel der Kunden fehlt, und denken an einen Umzug.",
                                   "Im Herbst soll entschieden werden. Bis dahin fährt alle zwanzig Minuten eine Fähre."]) + "</div>"),
    "sections": page(f"<section>{MENU}</section>", f"<section><h1>{M}The bridge</h1>{body()}</section>", f"<section><h3>See also</h3>{MENU}</section>"),
    "nested": page(f"<div><div><div>{MENU}</div></div></div>", f"<div><div><div><h1>{M}The bridge</h1><div>{body()}</div></div></div></div>"),
    "quote and list": page(f"<div class=a>{MENU}</div>", f"<div class=b><h1>{M}The bridge</h1>{body(n=2)}<blockquote>{M}{LONG[2]}</blockquote>"
                           f"<ul><li>{M}{LONG[3]}</li><li>{M}{LONG[4]}</li></ul></div>", "<div class=c>Copyright</div>"),
    "links in text": page(f"<div class=n1>{MENU}</div>", "<div class=n2>" + "".join(
        f"<p>{M}{t[:40]}<a href='/z'>{t[40:55]}</a>{t[55:]}</p>" for t in LONG) + "</div>", f"<div class=n3>{MENU}</div>"),
    "search form": page("<form><input name=q><button>Search</button></form>", f"<div class=w1><h1>{M}The bridge</h1>{body()}</div>", "<div class=w2>Copyright</div>"),
    "two menus": page(f"<div class=u>{MENU}</div><div class=v>{MENU}</div>", f"<div class=w>{body()}</div>", f"<div class=x>{MENU}</div>"),
    "line breaks": page(f"<div class=r1>{MENU}</div>", f"<div class=r2><p>{M}{'<br><br>'.join(LONG)}</p></div>", "<div class=r3>Copyright</div>"),
    "late article": page("".join(f"<div class=t{i}><a href='/{i}'>Topic {i}</a></div>" for i in range(12)), f"<div class=tt><h1>{M}The bridge</h1>{body()}</div>"),
}


@pytest.fixture(scope="module")
def model():
    import pyarrow.parquet as pq
    return htmltext.fit_pages(pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()[:150])


def judged(model, html):
    """(right blocks, all blocks, wrong texts)."""
    marked = [M in b[0] for b in htmltext.Parser().blocks(html)]
    blocks = htmltext.Parser().blocks(html.replace(M, ""))
    got = model.label([blocks])[0]
    assert len(blocks) == len(marked)
    wrong = [(b[0][:30], bool(g)) for b, g, y in zip(blocks, got, marked) if g != y]
    return len(blocks) - len(wrong), len(blocks), wrong


def test_hand_written_pages(model):
    right = total = 0
    for html in PAGES.values():
        r, n, _ = judged(model, html)
        right, total = right + r, total + n
    assert len(PAGES) == 17 and right / total >= 0.95


@pytest.mark.parametrize("name", ["opaque classes", "no names", "table of two", "header in article", "subscription inside"])
def test_no_paragraph_is_lost(model, name):
    _, _, wrong = judged(model, PAGES[name])
    assert not [w for w in wrong if any(t.startswith(w[0]) for t in LONG)]


def test_disguise_keeps_texts():
    import numpy as np
    for html in PAGES.values():
        for seed in range(6):
            hidden = htmltext.disguise(np.random.default_rng(seed), html)
            assert [b[0] for b in htmltext.Parser().blocks(hidden)] == [b[0] for b in htmltext.Parser().blocks(html)]
            assert "subscribe" not in hidden
