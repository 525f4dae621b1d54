"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of inline text between block-level tags.
Each block has features from its ancestors (tag names, words of class, id and
role), from its text (length, links, punctuation, capitals, place) and from the
shape of its neighbours and of the page; a CRF
with the labels `other` and `main` scores them and their neighbours, and Viterbi
decoding picks the main blocks.  The CRF is fitted by gradient ascent on the
likelihood of labelled pages, which `labelled_pages` makes from templates with
a fixed seed: their blocks' labels are known by construction.  Half of the pages
have names that say nothing, mislead, or none, and lie in forms, tables or grids.

Null, empty and text-free pages have no text.  Scripts, styles, comments and
markup are never text; unclosed and misnested tags are accepted.  Every row is
returned, repeated ones too; an empty table gives none.  Columns named in `keep`
are passed on, others, of any names, are not read.  Ties between labels go to
`other`.

Reading a page takes time in proportion to its length, whatever its markup: what
was looked for in vain is not looked for again, and a block's ancestors count up
to the `NEAR` nearest, with up to `NAMES` words of an attribute each.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Element kinds of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
RAW_TAGS = ("script", "style", "textarea", "noscript", "template", "svg", "iframe", "head", "select", "button")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}

_OPEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_QUOTE = re.compile(r"[\"'>]")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
HASH = 1 << 15
#: Ancestors of a block, and words of an attribute, that give features.
NEAR, NAMES = 64, 16
#: Marks of the nearest ancestors that count once more.
CLOSE = 3
#: Characters in which the end of a tag is looked for at once.
SHORT = 256


@dataclass
class Block:
    text: str
    marks: tuple[str, ...]
    linked: int  # characters inside links


class TagEnds:
    """Finds the `>` that ends a tag, outside of quotes, in steps that are few in sum.

    A quoted value may hold `>`; a tag with an unclosed quote ends at its first `>`.
    """

    def __init__(self, page: str):
        self.page = page
        self.signs: list[tuple[int, str]] | None = None

    def __call__(self, at: int) -> tuple[int, bool]:
        """(place of `>` or -1, whether the quotes before it are closed) for a tag read up to `at`."""
        if m := _TAG_END.match(self.page, at, at + SHORT):
            return m.end() - 1, True
        plain = self.page.find(">", at)
        if plain < 0:
            return -1, False
        if self.page.find('"', at, plain) < 0 and self.page.find("'", at, plain) < 0:
            return plain, True
        if self.signs is None:
            self.signs = [(m.start(), m[0]) for m in _QUOTE.finditer(self.page)]
            self.places = [p for p, _ in self.signs]
            self.same, seen = [-1] * len(self.signs), {}
            for k in range(len(self.signs) - 1, -1, -1):
                self.same[k] = seen.get(self.signs[k][1], -1)  # the next sign of the same kind
                seen[self.signs[k][1]] = k
            self.dead = bytearray(len(self.signs) + 1)  # signs from which no end was found
        k, tried = bisect_left(self.places, at), []
        while k < len(self.signs) and not self.dead[k]:
            place, sign = self.signs[k]
            if sign == ">":
                return place, True
            tried.append(k)
            if self.same[k] < 0:
                break
            k = self.same[k] + 1
        for k in tried:
            self.dead[k] = 1
        return plain, False


class OpenTags:
    """The open elements, with counts and places, so that no search passes over elements that stay."""

    def __init__(self):
        self.tags: list[tuple[str, tuple[str, ...]]] = []
        self.count: dict[str, int] = {}
        self.blocks: list[int] = []  # places of block elements
        self.lists: list[int] = []  # places of lists and their items

    def push(self, tag: str, marks: tuple[str, ...]) -> None:
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.tags))
        if tag in ("li", "ul", "ol"):
            self.lists.append(len(self.tags))
        self.tags.append((tag, marks))
        self.count[tag] = self.count.get(tag, 0) + 1

    def close_to(self, place: int) -> None:
        for tag, _ in self.tags[place:]:
            self.count[tag] -= 1
        del self.tags[place:]
        for places in (self.blocks, self.lists):
            while places and places[-1] >= place:
                places.pop()

    def close(self, tag: str) -> None:
        if self.count.get(tag):
            k = len(self.tags) - 1
            while self.tags[k][0] != tag:
                k -= 1
            self.close_to(k)

    def last(self, places: list[int], tag: str) -> None:
        """Closes the last of these elements if it is a `tag`."""
        if places and self.tags[places[-1]][0] == tag:
            self.close_to(places[-1])

    def marks(self) -> tuple[str, ...]:
        return tuple(m for _, ms in self.tags[-NEAR:] for m in ms)


def _marks(tag: str, attrs: str) -> tuple[str, ...]:
    marks = [tag] if tag in BLOCK_TAGS or tag == "a" else []
    for a in _ATTR.finditer(attrs):
        names = islice(_WORD.finditer((a[2] or a[3] or a[4] or "").lower()), NAMES)
        marks += [w[0] if a[1].lower() == "role" else f".{w[0]}" for w in names]
    return tuple(marks)


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks, in order."""
    out: list[Block] = []
    stack, tag_end, endless = OpenTags(), TagEnds(page), set()
    text: list[str] = []
    linked = at = 0

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack.marks(), linked))
            text.clear()
            linked = 0

    def say(piece: str):
        nonlocal linked
        if piece:
            text.append(piece)
            if stack.count.get("a"):
                linked += len(piece)

    size = len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = _OPEN.match(page, begin)
        if not m:
            end = page.find(">", begin) if page[begin + 1 : begin + 2] in ("!", "?", "/") and ">" not in endless else -1
            if end >= 0:
                at = end + 1
            else:
                if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                    endless.add(">")
                say("<")
                at = begin + 1
            continue
        end, closed = (-1, False) if ">" in endless else tag_end(m.end())
        if end < 0:  # no tag ends from here on
            endless.add(">")
            say("<")
            at = begin + 1
            continue
        at = end + 1
        tag, attrs = m[2].lower(), page[m.end() : end] if closed else ""
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            stack.close(tag)
            continue
        if tag in _RAW_END:
            over = None if tag in endless else _RAW_END[tag].search(page, at)
            if tag in BLOCK_TAGS:
                flush()
            if over:
                at = over.end()
            else:
                endless.add(tag)
                at = size if tag in ("script", "style", "textarea") else at
            continue
        if tag in ("br", "wbr"):
            say(" " if tag == "br" else "")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P:
                stack.last(stack.blocks, "p")
            if tag == "li":
                stack.last(stack.lists, "li")
        if tag not in VOID_TAGS:
            stack.push(tag, _marks(tag, attrs))
    flush()
    return out


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % HASH


_slots: dict[str, int] = {}


def _shape(b: Block) -> tuple[int, int, int]:
    """Buckets of a block's length, share of links and sentence ends."""
    n = len(b.text)
    ends = b.text.count(".") + b.text.count("!") + b.text.count("?")
    return _bucket(n, (15, 40, 80, 160, 400)), _bucket(b.linked / n, (0.05, 0.3, 0.7)), _bucket(ends / n * 100, (0.2, 0.8, 2))


def block_features(bs: list[Block]) -> list[list[int]]:
    """Hashed features of each block: all ancestors, the `CLOSE` nearest, its text, and its neighbours' and the page's shape.

    A page without known names is told by the text features and their conjunctions,
    which do not depend on any one ancestor.
    """
    out = []
    shapes = [_shape(b) for b in bs]
    most = max((len(b.text) for b in bs), default=1)
    prose = sum(s[0] >= 3 and s[1] == 0 for s in shapes)
    for k, (b, (size, link, ends)) in enumerate(zip(bs, shapes, strict=True)):
        n = len(b.text)
        leaf = next((m for m in reversed(b.marks) if not m.startswith(".")), "-")
        before, after = shapes[k - 1] if k else "-", shapes[k + 1] if k + 1 < len(bs) else "-"
        names = ["bias", *(f"in {m}" for m in set(b.marks)), *(f"near {m}" for m in set(b.marks[-CLOSE:])), f"leaf {leaf}"]
        names += [
            f"len {size}", f"link {link}", f"stops {ends}", f"end {b.text[-1] in '.!?:;'}", f"caps {_bucket(sum(map(str.isupper, b.text)) / n, (0.03, 0.15, 0.5))}", f"digits {_bucket(sum(map(str.isdigit, b.text)) / n, (0.02, 0.15))}",
            f"sign {'©' in b.text or '»' in b.text}", f"place {_bucket(k / len(bs), (0.05, 0.2, 0.8, 0.95))}",
            f"shape {size} {link} {ends}", f"leaf {leaf} {b.marks[-1:] == (leaf,)} {size} {link}", f"before {before} {size}", f"after {after} {size}", f"share {_bucket(n / most, (0.05, 0.2, 0.5))} {link}", f"prose {min(prose, 4)} {size} {link}",
        ]
        row = []
        for x in names:
            if (s := _slots.get(x)) is None:
                s = _slots[x] = _slot(x)
                if len(_slots) > 100_000:
                    _slots.clear()
            row.append(s)
        out.append(row)
    return out


class Crf:
    """Two labels; node weights by hashed feature, edge weights by label pair."""

    def __init__(self):
        self.node, self.edge = np.zeros((HASH, 2)), np.zeros((2, 2))

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        size = [len(f) for f in feats]
        flat = self.node[np.concatenate([np.array(f) for f in feats])]
        return np.add.reduceat(flat, np.cumsum([0, *size[:-1]]), axis=0)

    def step(self, feats: list[list[int]], gold: list[int], rate: float, decay: float) -> None:
        """Gradient of the log likelihood of one page, by forward and backward sums."""
        s, n = self.scores(feats), len(feats)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = s[0]
        for k in range(1, n):
            a[k] = s[k] + np.logaddexp(a[k - 1, 0] + self.edge[0], a[k - 1, 1] + self.edge[1])
        for k in range(n - 2, -1, -1):
            v = self.edge + s[k + 1] + b[k + 1]
            b[k] = np.logaddexp(v[:, 0], v[:, 1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        p = np.exp(a + b - z)
        for k, f in enumerate(feats):
            g = -p[k]
            g[gold[k]] += 1
            self.node[f] += rate * (g - decay * self.node[f])
        for k in range(n - 1):
            self.edge -= rate * np.exp(a[k][:, None] + self.edge + s[k + 1] + b[k + 1] - z)
            self.edge[gold[k], gold[k + 1]] += rate

    def decode(self, feats: list[list[int]]) -> list[int]:
        """The most likely labels (Viterbi); ties go to `other`."""
        s = self.scores(feats).tolist()
        (e00, e01), (e10, e11) = self.edge.tolist()
        v0, v1 = s[0]
        back = []
        for x0, x1 in s[1:]:
            f0, f1 = v1 + e10 > v0 + e00, v1 + e11 > v0 + e01
            back.append((f0, f1))
            v0, v1 = (v1 + e10 if f0 else v0 + e00) + x0, (v1 + e11 if f1 else v0 + e01) + x1
        y = [int(v1 > v0)]
        for pair in reversed(back):
            y.append(int(pair[y[-1]]))
        return y[::-1]


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(html, main blocks) of pages built from templates: the labelled data."""
    r = random.Random(seed)
    syllables = "an be ci do en fo ga hu in ka lo mi na or pe qui ra so ti un ve wo ya the and of".split()

    def word():
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(k=None):
        return (" ".join(word() for _ in range(k or r.randint(4, 18)))).capitalize() + r.choice(("." * 1, ".", ".", "!", "?"))

    def para(k=None):
        return " ".join(sentence() for _ in range(k or r.randint(1, 7)))

    def links(k):
        return "".join(f'<li><a href="/{word()}">{r.choice((word(), word().capitalize(), word() + " " + word()))}</a></li>' for _ in range(k))

    def junk() -> str:
        kind = r.randrange(14)
        name = lambda *xs: r.choice(xs)
        if kind == 0:
            return f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>"
        if kind == 1:
            return f'<div class="{name("menu", "navbar", "nav main", "breadcrumb", "topbar")}"><ul>{links(r.randint(2, 8))}</ul></div>'
        if kind == 2:
            return f"<header><h1>{word()}</h1><p>{sentence(4)}</p></header>"
        if kind == 3:
            return f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>"
        if kind == 4:
            return f'<div class="{name("ad", "ads", "advert", "sponsored", "promo", "banner ad")}">{name(sentence(), para(2))}</div>'
        if kind == 5:
            return f"<aside><h3>{word()}</h3><p>{para(r.randint(1, 3))}</p><ul>{links(3)}</ul></aside>"
        if kind == 6:
            return f'<div class="{name("sidebar", "widget", "related", "side", "recommended")}"><h2>{sentence(3)}</h2><ul>{links(4)}</ul></div>'
        if kind == 7:
            return f'<div id="{name("cookie", "cookies", "consent", "notice", "gdpr banner")}"><p>{para(r.randint(1, 3))}</p><a href="#">OK</a></div>'
        if kind == 8:
            return f'<form class="{name("search", "newsletter", "subscribe", "login")}"><label>{sentence(3)}</label><p>{sentence()}</p><input type="text"></form>'
        if kind == 9:
            return f'<section class="{name("comments", "comment list", "discussion", "replies")}"><h3>{sentence(2)}</h3>' + "".join(f'<div class="{name("comment", "reply", "comment body")}"><p>{para(r.randint(1, 3))}</p></div>' for _ in range(r.randint(1, 4))) + "</section>"
        if kind == 10:
            return f'<div class="{name("share", "social", "tags", "meta", "byline", "pager", "pagination")}">{" ".join(f"<a href=#>{word()}</a>" for _ in range(4))}</div>'
        if kind == 11:
            return f'<div id="{name("footer", "header", "masthead", "copyright", "legal")}"><p>&copy; {sentence()}</p></div>'
        if kind == 12:
            return f'<div role="{name("navigation", "banner", "complementary", "contentinfo", "search", "alert")}"><p>{sentence()}</p></div>'
        return f'<div class="{name("popup", "modal", "overlay", "disclaimer", "alert")}">{para(r.randint(1, 2))}</div>'

    def plain_junk() -> str:
        """Boilerplate that is told by its text alone, in elements without names."""
        kind = r.randrange(6)
        if kind == 0:
            return f"<div><ul>{links(r.randint(3, 8))}</ul></div>"
        if kind == 1:
            return "<div>" + r.choice((" | ", " ", " &middot; ")).join(f"<a href=#>{word()}</a>" for _ in range(r.randint(3, 7))) + "</div>"
        if kind == 2:
            return f"<div><p>&copy; {r.randint(1995, 2030)} {word()} {word()}</p></div>"
        if kind == 3:
            return f"<table><tr>{''.join(f'<td><a href=#>{word()}</a></td>' for _ in range(r.randint(3, 6)))}</tr></table>"
        if kind == 4:
            return f"<p><a href=#>{sentence(r.randint(2, 5))}</a></p>"
        return f"<div>{word()} {r.randint(1, 31)}, {r.randint(1995, 2030)}</div>"

    inner_names = ("post-body", "body text", "message", "content", "entry", "entry-content")  # of articles and of comments

    def comments() -> str:
        outer = r.choice(('id="disqus_thread"', 'id="comments"', 'class="comment-list"', 'class="fb-comments"', 'id="respond"', 'class="reviews"', 'class="discussion thread"', 'id="reader-comments"'))
        inner = r.choice((*inner_names, "comment-content", "review-text", "reply"))
        each = "".join(f'<div class="{inner}"><p>{para(r.randint(1, 3))}</p></div>' for _ in range(r.randint(1, 5)))
        return f"<div {outer}>{r.choice(('', f'<h3>{r.randint(2, 40)} comments</h3>'))}{each}</div>"

    out = []
    for number in range(n):
        title, main = sentence(), []
        body = []
        style = (0, 0, 1, 2, 3, 3)[number % 6]  # 0 and 1: the templates; 2: names that say nothing or mislead; 3: no names
        one_cell = style > 1 and r.random() < 0.2  # paragraphs apart by <br>, which make one block
        in_divs = style > 1 and r.random() < 0.4
        if r.random() < (0.9 if style < 2 else 0.6):
            main.append(title)
            body.append(f"<h1>{title}</h1>")
        if one_cell:
            ts = [para() for _ in range(r.randint(1, 6))]
            main.append(" ".join(ts))
            body.append("<br><br>".join(ts))
        for _ in range(0 if one_cell else r.randint(1, 9)):
            kind = r.random()
            if kind < 0.75:
                t = para() if r.random() < 0.93 or style > 1 else sentence(r.randint(1, 2))
                main.append(t)
                body.append(f"<div>{t}</div>" if in_divs else f"<p>{t}{r.choice(('</p>', '</p>', '<br>'))}")
            elif kind < 0.83:
                t = sentence(r.randint(2, 5))[:-1]
                main.append(t)
                body.append(f"<h2>{t}</h2>")
            elif kind < 0.9:
                ts = [sentence(r.randint(2, 9)) for _ in range(r.randint(2, 4))]
                main += ts
                body.append("<ul>" + "".join(f"<li>{t}</li>" for t in ts) + "</ul>")
            elif kind < 0.95:
                t = para(2)
                main.append(t)
                body.append(f"<blockquote>{t}</blockquote>")
            elif style < 2:
                body.append(junk() if r.random() < 0.3 else "")
        if style < 2:
            wrap = r.choice(("<article>|</article>", "<article>|</article>", "<main>|</main>", '<div class="content">|</div>', '<div id="main content">|</div>', '<div class="post body">|</div>', '<div class="article text">|</div>', "<main><article>|</article></main>", '<section class="entry">|</section>'))
            if style == 1:
                wrap = r.choice((wrap, f'<div id="content" role="main"><div class="{r.choice(inner_names)}">|</div></div>', f'<article><div class="{r.choice(inner_names)}">|</div></article>'))
        elif style == 2:
            names = (*inner_names, "col-md-8", "row", "container", "wrapper", "inner", "column left", f"css-{word()}", f"{word()}-{word()}", "notice-board article", "header-story content", "menu-page text", "side-a main", "comment-piece article", "promo-free body", "box", "grid")
            wrap = f'<div class="{r.choice(names)}">|</div>'
            for _ in range(r.randint(0, 2)):
                wrap = f'<div class="{r.choice(names)}">{wrap}</div>'
        else:
            wrap = r.choice(("<div>|</div>", "|", "<table><tr><td>|</td></tr></table>", "<div><div>|</div></div>", "<center>|</center>"))
        a, b = wrap.split("|")
        some = junk if style < 2 else plain_junk if style == 3 else lambda: r.choice((junk, plain_junk))()
        before, after = "".join(some() for _ in range(r.randint(0, 4))), "".join(some() for _ in range(r.randint(0, 4)))
        if style < 3 and r.random() < 0.3:
            after = comments() + after
        page = f"{before}{a}{''.join(body)}{b}{after}"
        if style > 1:
            outer = r.choice(("|", "|", '<form id="aspnetForm" method="post">|</form>', '<form name="form1">|</form>', "<form>|</form>", '<div class="container"><div class="row">|</div></div>', "<table><tbody><tr><td>|</td></tr></tbody></table>", '<div id="page">|</div>'))
            page = outer.replace("|", page)
        out.append((f"<html><head><title>{title}</title></head><body>{page}</body></html>", main))
    return out


def train(pages: list[tuple[str, list[str]]] | None = None, epochs: int = 8) -> Crf:
    """A CRF fitted to labelled pages (html, texts of the main blocks)."""
    crf, data = Crf(), []
    for page, main in pages if pages is not None else labelled_pages(1200):
        bs, left = blocks(page), list(main)
        gold = []
        for b in bs:
            gold.append(int(b.text in left))
            if gold[-1]:
                left.remove(b.text)
        if bs:
            data.append((block_features(bs), gold))
    for epoch in range(epochs):
        for feats, gold in data:
            crf.step(feats, gold, 0.1 / (1 + epoch), 1e-3)
    return crf


def main_text(page: str, crf: Crf) -> str:
    bs = blocks(page)
    if not bs:
        return ""
    return "\n".join(b.text for b, y in zip(bs, crf.decode(block_features(bs)), strict=True) if y)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), crf: Crf | None = None) -> DataFrame:
    """`keep`, id and main text of every whole page."""
    model = df.sparkSession.sparkContext.broadcast(crf or train())

    def make():
        m = model.value
        return lambda ids, texts: {id_col: ids, "text": [main_text(t, m) for t in texts]}

    return map_texts(df, id_col, html_col, make, f"`{id_col}` {dict(df.dtypes)[id_col]}, text string", keep)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
