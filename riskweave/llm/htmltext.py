"""Main-text extraction from HTML with a recurrent block labeller.

A page becomes the sequence of its text blocks (leaves in page order). Each
block is read through three kinds of input: a mean of learned vectors of its
tag path (hashed tag names and the words of class, id and role attributes), a
mean of learned vectors of its hashed words, and a few numbers (length, share
of linked text, punctuation). A bidirectional LSTM written in numpy reads the
whole sequence, so each block is judged in the light of the entire page, and a
logistic output marks the blocks of the main text.

Training data: a bounded sample of pages (``sample`` of them, by a hash of the
id). Their own blocks are labelled by the meaning of HTML elements (``article`` or
``main``, without ``nav``, ``aside``, ``footer``, forms and the like), never by class
names or the page's url. Their texts are also laid out anew in many generated page
layouts (menus, headers, sidebars, notices, adverts, forms, comments), where the label
is known by construction. Most training pages are shown once more in disguise: every
class, id and role is renamed at random or dropped, alike within a page, and on some
the elements with a meaning become plain ``div``. So names and elements help where
they are known, and the labeller has to do without them where they are not: from the
page's shape, how much of its text has the same path, link shares and order.

Defined cases: null or empty html gives an empty text. Markup may be broken:
unclosed elements are closed by what follows, stray end tags are ignored, an
unclosed comment, script or style runs to the end; all other elements are read. Every row gives one row.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import sampling
from riskweave.llm import textbits as tb

PATH_DIM, WORD_DIM, VEC, HIDDEN, NUMBERS = 512, 512, 8, 16, 9
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+|[^<>]*+)>|<[!?][^>]*+>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[A-Za-z]+")
# Fixed values of HTML: elements without an end tag, elements whose content is no text, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup "
                   "msubsup munder mover munderover mstyle mspace mpadded semantics annotation".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "footer", "aside", "form", "title", "head", "button", "select", "textarea"}
SECTIONS = "article|main|section|nav|header|footer|aside"


def _slot(kind: str, value: str, dim: int) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % dim


class Parser:
    """Blocks of a page: (text, path feature ids, word ids, linked characters, open elements); an
    element is (tag, path feature ids, name words, number in the page)."""

    def __init__(self):
        self.tags: dict = {}
        self.words: dict = {}

    def _element(self, tag: str, attrs: str):
        key = (tag, attrs if "=" in attrs and NAMED.search(attrs) else "")
        got = self.tags.get(key)
        if got is None:
            words = [w.lower() for m in NAMED.finditer(key[1]) for w in WORD.findall(m.group(1))]
            got = (tag, [_slot("t", tag, PATH_DIM)] + [_slot("c", w, PATH_DIM) for w in words], words)
            if len(self.tags) < 50_000:
                self.tags[key] = got
        return got

    def _word(self, w: str) -> int:
        got = self.words.get(w)
        if got is None:
            got = _slot("w", w.lower(), WORD_DIM)
            if len(self.words) < 200_000:
                self.words[w] = got
        return got

    def blocks(self, page: str | None) -> list[tuple]:
        out: list[tuple] = []
        stack: list[tuple] = []
        parts: list[str] = []
        linked = at = opened = 0
        page = page or ""

        def flush():
            nonlocal linked
            if parts:
                raw = "".join(parts)
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                if text:
                    word = self._word
                    out.append((text, [s for e in stack for s in e[1]] or [0], [word(w) for w in text.split(" ")], linked, stack[:]))
                parts.clear()
            linked = 0

        n = len(page)
        while at <= n:
            m = TOKEN.search(page, at)
            text = page[at:m.start()] if m else page[at:]
            if text:
                parts.append(text)
                if any(e[0] == "a" for e in stack):
                    linked += len(text)
            if not m:
                break
            at = m.end()
            tag = m.group(2)
            if tag is None:                               # a comment or declaration
                continue
            tag = tag.lower()
            if m.group(1):
                if tag not in INLINE:
                    flush()
                if any(e[0] == tag for e in stack):
                    while stack.pop()[0] != tag:
                        pass
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
                shut = CLOSES.get(tag) or ({"p"} if tag not in VOID else ())
                while stack and (stack[-1][0] in shut or (stack[-1][0] in INLINE and any(e[0] in shut for e in stack))):
                    stack.pop()
            if tag in RAW and not m.group(3).endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n + 1
                continue
            if tag not in VOID and not m.group(3).endswith("/"):
                opened += 1
                stack.append((*self._element(tag, m.group(3)), opened))
        flush()
        return out


def meaning(stack: list[tuple]) -> bool:
    """Main text by the meaning of the elements around it."""
    tags = [e[0] for e in stack]
    inside = next((i for i, t in enumerate(tags) if t in MAIN_TAGS), None)
    # a header is page furniture unless it belongs to the article
    return inside is not None and not SIDE_TAGS & set(tags) and "header" not in tags[:inside]


def disguise(rng: np.random.Generator, page: str) -> str:
    """The page with its class, id and role values renamed at random or dropped, alike all over the page;
    in half of the cases its sectioning elements become ``div``."""
    drop, names = rng.random() < 0.4, {}

    def name(m):
        value = names.setdefault(m.group(2).strip("\"'"), "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(1, 6)))))
        return " " if drop else f'{m.group(1)}="{value}"'

    out = re.sub(r"<[a-zA-Z][^<>]*>", lambda m: re.sub(r"(\s(?:class|id|role))\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", name, m.group(0)), page)
    if rng.random() < 0.5:
        out = re.sub(rf"<(/?)(?:{SECTIONS})(?=[\s>])", r"<\1div", out, flags=re.I)
    return out


MARK = ""                                           # marks main blocks in generated pages


def generated(rng: np.random.Generator, prose: list[str], bits: list[str]) -> str:
    """A page layout drawn at random around given texts; main blocks begin with MARK."""
    def pick(*c):
        return c[rng.integers(len(c))]

    def some(lo, hi):
        return range(int(rng.integers(lo, hi + 1)))

    def line():
        return html.escape(bits[rng.integers(len(bits))][:80])

    def para():
        return html.escape(prose[rng.integers(len(prose))])

    def links(lo, hi):
        return "".join(f"<li><a href='/x'>{line()}</a></li>" for _ in some(lo, hi))

    def menu():
        o, c = pick(("<nav>", "</nav>"), ("<div class='menu'>", "</div>"), ("<div id=navigation>", "</div>"),
                    ("<ul class='nav-links'>", "</ul>"), ("<div class='breadcrumb'>", "</div>"), ("<div role=navigation>", "</div>"))
        return f"{o}<ul>{links(2, 8)}</ul>{c}"

    def notice():
        o = pick("cookie-notice", "banner", "alert notice", "consent", "newsletter")
        return f"<div class='{o}'><p>{pick(line(), para())}</p><button>{line()}</button></div>"

    def advert():
        return pick(f"<div class='{pick('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot')}'>{pick(line(), para())}</div>",
                    f"<aside class='ad'><p>{para()}</p></aside>")

    def form():
        return f"<form><label>{line()}</label><input name=q><button>{line()}</button></form>"

    def side():
        o, c = pick(("<aside>", "</aside>"), ("<div class='sidebar'>", "</div>"), ("<div id='related'>", "</div>"),
                    ("<div class='widget'>", "</div>"))
        return f"{o}<h3>{line()}</h3>{pick('<ul>' + links(2, 6) + '</ul>', '<p>' + para() + '</p>')}{c}"

    def comments():
        o, c = pick(("<section class='comments'>", "</section>"), ("<div id='comments'>", "</div>"), ("<ol class='commentlist'>", "</ol>"))
        one = pick("<div class='comment'><b>{}</b><p>{}</p></div>", "<li class='comment'><p>{1}</p></li>", "<article class='comment'><p>{1}</p></article>")
        return o + f"<h3>{line()}</h3>" + "".join(one.format(line(), para()) for _ in some(1, 5)) + c

    def body():
        tops = []
        if rng.random() < 0.8:
            o, c = pick(("", ""), ("", ""), ("<header>", "</header>"), ("<div class='title'>", "</div>"))
            size = pick(1, 2)
            tops = [f"{o}<h{size}>{MARK}{line()}</h{size}>{pick('', f'<p>{MARK}{line()}</p>')}{c}"]
        in_table = rng.random() < 0.1
        rest = []
        for _ in some(1, 12):
            if in_table:
                rest.append(f"<tr><td>{MARK}{para()}</td></tr>")
                continue
            rest.append(pick(f"<p>{MARK}{para()}</p>", f"<p>{MARK}{para()}</p>", f"<p><b>{MARK}{para()}<br>", f"<blockquote>{MARK}{para()}</blockquote>",
                             f"<h3>{MARK}{line()}</h3>", f"<ul><li>{MARK}{line()}</li><li>{MARK}{para()}</li></ul>", f"<div>{MARK}{para()}</div>"))
            if rng.random() < 0.1:
                rest.append(pick(advert, side, form, notice, lambda: f"<div class='share'><a>{line()}</a><a>{line()}</a></div>")())
        o, c = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                    ("<div class='content'>", "</div>"), ("<div class='post-body entry'>", "</div>"), ("<div id='main-content'>", "</div>"),
                    ("<section class='story'>", "</section>"), ("<article class='post'><div class='entry-content'>", "</div></article>"))
        inner = "".join(rest)
        if in_table:
            inner = f"<table>{inner}</table>"
        return o + "".join(tops) + inner + (comments() if rng.random() < 0.1 else "") + c

    top = [menu] * int(rng.integers(0, 3)) + [notice] * int(rng.integers(0, 2)) + [advert] * int(rng.integers(0, 2))
    if rng.random() < 0.5:
        top.append(lambda: f"<header><h1>{line()}</h1><p>{line()}</p></header>")
    after = [side] * int(rng.integers(0, 2)) + [comments] * int(rng.integers(0, 2)) + [form] * int(rng.integers(0, 2)) + [advert] * int(rng.integers(0, 2))
    rng.shuffle(top)
    rng.shuffle(after)
    foot = pick(f"<footer>{line()} {line()}</footer>", f"<div class='footer'><p>{para()}</p></div>", "", f"<footer><p>{para()}</p></footer>")
    return (f"<html><head><title>{line()}</title></head><body>" + "".join(f() for f in top) + body() + "".join(f() for f in after) + foot)


def inputs(pages: list[list[tuple]]):
    """Flat feature ids with their block starts, and the numbers, for the blocks of many pages."""
    blocks = [b for p in pages for b in p]
    path = np.array([s for b in blocks for s in b[1]], dtype=np.int64)
    word = np.array([s for b in blocks for s in b[2]], dtype=np.int64)
    n_path, n_word = (np.array([len(b[k]) for b in blocks], dtype=np.int64) for k in (1, 2))
    chars = np.array([len(b[0]) for b in blocks], dtype=np.float64)
    linked = np.array([b[3] for b in blocks]) / np.maximum(chars, 1)
    numbers = np.stack([np.log1p(chars) / 6, linked,
                        np.array([b[0].count(".") + b[0].count(",") for b in blocks]) / np.maximum(n_word, 1),
                        np.ones(len(blocks)), *shape(pages, chars * np.maximum(1 - linked, 0))], axis=1)
    return path, n_path, word, n_word, np.minimum(numbers, 3.0)


def shape(pages: list[list[tuple]], plain: np.ndarray) -> list[np.ndarray]:
    """What names cannot hide, per block: the share of the page's unlinked text (``plain``) under the block's
    container and under that container's parent, whether the container holds the most, place in the page, depth."""
    out, lo = np.zeros((5, len(plain))), 0
    for p in pages:
        if not p:
            continue
        hi = lo + len(p)
        total = max(plain[lo:hi].sum(), 1.0)
        for row, up in ((0, 2), (1, 3)):                   # an element's number stands for all around it
            at = np.array([b[4][-up][3] if len(b[4]) >= up else 0 for b in p])
            held = np.bincount(at, weights=plain[lo:hi])
            out[row, lo:hi] = held[at] / total
            if not row:
                out[2, lo:hi] = held[at] >= held.max()
        out[3, lo:hi] = np.arange(hi - lo) / (hi - lo)
        out[4, lo:hi] = [len(b[4]) / 8 for b in p]
        lo = hi
    return list(out)


def _mean(table, ids, n):
    return np.add.reduceat(table[ids], np.r_[0, np.cumsum(n)[:-1]], axis=0) / n[:, None]


class Labeller:
    """Bidirectional LSTM over block inputs; ``p``: its parameters by name."""

    def __init__(self, seed: int = 2):
        r = np.random.default_rng(seed)
        d = 2 * VEC + NUMBERS
        self.p = {"path": r.normal(0, 0.3, (PATH_DIM, VEC)), "word": r.normal(0, 0.1, (WORD_DIM, VEC)),
                  "out": r.normal(0, 0.3, (2 * HIDDEN + d, 1)), "bias": np.zeros(1)}
        for s in "fb":
            self.p["x" + s] = r.normal(0, 0.3, (d, 4 * HIDDEN))
            self.p["h" + s] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))

    def vectors(self, data):
        path, n_path, word, n_word, numbers = data
        return np.concatenate([_mean(self.p["path"], path, n_path), _mean(self.p["word"], word, n_word), numbers], axis=1)

    def scan(self, x, mask, side, keep=None):
        """x: (steps, pages, inputs), mask: (steps, pages). Hidden states per step; ``keep`` stores what the way back needs."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        pre = x @ self.p["x" + side]
        out = np.zeros((steps, pages, HIDDEN))
        for t in (range(steps) if side == "f" else range(steps - 1, -1, -1)):
            z = pre[t] + h @ self.p["h" + side]
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * HIDDEN], -30, 30)))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, on))
            h, c = np.where(on, o * tc, h), np.where(on, c2, c)
            out[t] = h
        return out

    def logits(self, x, mask, keep_f=None, keep_b=None):
        hidden = np.concatenate([self.scan(x, mask, "f", keep_f), self.scan(x, mask, "b", keep_b), x], axis=2)
        return hidden, (hidden @ self.p["out"])[..., 0] + self.p["bias"][0]

    @staticmethod
    def padded(v, lengths):
        steps = int(lengths.max())
        page = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(v)) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        x = np.zeros((steps, len(lengths), v.shape[1]))
        x[step, page] = v
        mask = np.zeros((steps, len(lengths)), dtype=bool)
        mask[step, page] = True
        return x, mask, step, page

    def label(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of similar length go together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and (hi - lo + 1) * len(pages[order[hi]]) <= 20_000:
                hi += 1
            group = [pages[i] for i in order[lo:hi]]
            lengths = np.array([len(g) for g in group])
            x, mask, step, page = self.padded(self.vectors(inputs(group)), lengths)
            main = self.logits(x, mask)[1][step, page] >= 0
            for i, part in zip(order[lo:hi], np.split(main, np.cumsum(lengths)[:-1])):
                out[i] = part
            lo = hi
        return out

    def gradients(self, data, lengths, y):
        """Mean logistic loss of a batch and its gradients by back-propagation through both directions."""
        p, grad = self.p, {}
        v = self.vectors(data)
        x, mask, step, page = self.padded(v, lengths)
        keep = {"f": [], "b": []}
        hidden, z = self.logits(x, mask, keep["f"], keep["b"])
        z = z[step, page]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(np.mean(np.logaddexp(0, np.where(y, -z, z))))
        dz = (prob - y) / len(y)
        grad["out"] = (hidden[step, page] * dz[:, None]).sum(axis=0)[:, None]
        grad["bias"] = np.array([dz.sum()])
        dh_all = np.zeros(hidden.shape)
        dh_all[step, page] = dz[:, None] * p["out"][:, 0]
        dx = dh_all[..., 2 * HIDDEN:].copy()
        for k, s in enumerate("fb"):
            dh_out = dh_all[..., k * HIDDEN:(k + 1) * HIDDEN]
            dh, dc = np.zeros(dh_out.shape[1:]), np.zeros(dh_out.shape[1:])
            grad["h" + s] = np.zeros_like(p["h" + s])
            dpre = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN))
            for t, h0, c0, i, f, o, g, tc, on in reversed(keep[s]):
                dh_t = dh + dh_out[t]
                live = np.where(on, dh_t, 0.0)
                dct = np.where(on, dc, 0.0) + live * o * (1 - tc * tc)
                d = np.concatenate([dct * g * i * (1 - i), dct * c0 * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
                dpre[t] = d
                grad["h" + s] += h0.T @ d
                dh = d @ p["h" + s].T + np.where(on, 0.0, dh_t)
                dc = dct * f + np.where(on, 0.0, dc)
            grad["x" + s] = np.tensordot(x, dpre, axes=([0, 1], [0, 1]))
            dx += dpre @ p["x" + s].T
        dv = dx[step, page]
        path, n_path, word, n_word, _ = data
        for name, ids, n, part in (("path", path, n_path, dv[:, :VEC]), ("word", word, n_word, dv[:, VEC:2 * VEC])):
            grad[name] = np.zeros_like(p[name])
            np.add.at(grad[name], ids, np.repeat(part / n[:, None], n, axis=0))
        return loss, grad

    def train(self, pages: list[list[tuple]], labels: list[np.ndarray], epochs: int = 8, batch: int = 24, rate: float = 0.02):
        rng = np.random.default_rng(6)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * (len(pages) // batch + 1)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                rows = [i for i in order[lo:lo + batch] if pages[i]]
                if not rows:
                    continue
                step += 1
                group = [pages[i] for i in rows]
                _, grad = self.gradients(inputs(group), np.array([len(g) for g in group]), np.concatenate([labels[i] for i in rows]))
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (1 - step / (total + 1)) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)
        return self


def fit_pages(pages: list[str], layouts: int = 400, longest: int = 120, disguised: float = 0.7) -> Labeller:
    """Trains on the given pages, on ``layouts`` generated ones that reuse their texts, and on a share
    ``disguised`` of both under other names. Training pages of more than ``longest`` blocks are left out;
    labelling knows no such bound."""
    parser, rng = Parser(), np.random.default_rng(8)
    data, labels, prose, bits, shown = [], [], [], [], []
    for page in pages:
        blocks = parser.blocks(page)
        for text, *_ in blocks:
            (prose if len(text) > 60 else bits).append(text)
        y = np.array([meaning(b[4]) for b in blocks], dtype=bool)
        if y.any() and len(blocks) <= longest:
            data.append(blocks)
            labels.append(y)
            shown.append(page)
    for i, page in enumerate(shown):
        if rng.random() < disguised:
            hidden = parser.blocks(disguise(rng, page))
            if [b[0] for b in hidden] == [b[0] for b in data[i]]:
                data.append(hidden)
                labels.append(labels[i])
    prose, bits = prose or ["Some words of a text that goes on for a while, and then ends."], bits or ["a few words"]
    for _ in range(layouts):
        page = generated(rng, prose, bits)
        for version in [page] + [disguise(rng, page)] * (rng.random() < disguised):
            blocks = parser.blocks(version)
            labels.append(np.array([MARK in b[0] for b in blocks], dtype=bool))
            texts = [b[0].replace(MARK, "") for b in blocks]
            data.append([(t, b[1], [parser._word(w) for w in t.split(" ")], b[3], b[4]) for t, b in zip(texts, blocks)])
    return Labeller().train(data, labels)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 300) -> Labeller:
    """Fits on about ``sample`` pages, chosen by a hash of the id, and on layouts generated from their texts."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("h"), F.lit(1).alias("one")).filter(F.col("h").isNotNull())
    chosen, _ = sampling.sample_per_class(rows, "id", "one", sample)
    return fit_pages([r["h"] for r in chosen.select("h", F.col("id").cast("string").alias("id")).orderBy("id", "h").collect()])


def extract(pages: DataFrame, labeller: Labeller, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, the main text and its number of code points; one row per row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names, k = schema.fieldNames(), len(keep)

    def run(batches):
        model, parser = shared.value, Parser()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                blocks = [parser.blocks(h) for h in part.column(k).to_pylist()]
                texts = [" ".join(x[0] for x, main in zip(p, y) if main) for p, y in zip(blocks, model.label(blocks))]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(k)] + [pa.array(texts, pa.string()),
                                                 pa.array([len(t) for t in texts], pa.int64())], names=names)

    src = tb.bound_batches(pages).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(html_col).alias("h"))
    return src.mapInArrow(run, schema)
