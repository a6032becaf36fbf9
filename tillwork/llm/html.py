"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of block elements with its text blocks as leaves. Every node is content or not. Node potentials
come from tag, class and id words, text and link features, place and depth; parent-child potentials depend on whether the
child carries a cue of its own. One upward and one downward pass of sum-product messages give each block's exact marginal,
for all pages of a batch at once, level by level. Weights are trained on labelled pages by the gradient of the exact
likelihood (the same two passes). Labelled pages come from a bounded sample (``sample`` pages by a hash of the id): pages that mark
their article, as they are, and their texts set anew in layouts with menus, notices, adverts, forms, sidebars and comments.

Blocks above one half are joined in page order by two line feeds. Character references are decoded, runs of white
space inside a block become one space. Scripts, styles, comments and other raw elements are never text.

Cases: null and empty html give an empty text with 0 characters. Markup that is cut off or never closed ends with the page; a
raw element that is never closed swallows the rest. Pages without elements are one block of text, and judged like any other.
Repeated rows and ids are extracted each. Null ids and urls stay null. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.samples import smallest_hashes

SAMPLE = 240
LAYOUTS = 3  # rendered pages for each labelled one
STEPS = 200

_BLOCKS = {
    "p": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "li": "li", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "menu": "nav",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "caption": "cell", "article": "article", "main": "article",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "section": "section", "div": "div", "center": "div", "body": "body", "html": "body",
    "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "address": "footer", "form": "form", "fieldset": "form", "legend": "form", "label": "form",
    "button": "form", "option": "form", "optgroup": "form", "select": "form", "details": "section", "summary": "h", "dialog": "notice", "hgroup": "section",
}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noframes"}
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}
_INSIDE_P = {"label", "button", "option", "optgroup", "legend"}
# Comments, other declarations, tags. A quote opens a value only right behind "="; one that is never closed is part of a
# value without quotes.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>]*+))?+)*+)(?:>|\Z)""",
    re.S)
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

_CUES = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner outbrain taboola dfp", "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "footer": "footer foot copyright colophon legal", "header": "header masthead topbar logo branding", "sidebar": "sidebar side aside widget related recommended recommendation trending popular more rail complementary",
    "comment": "comment comments reply replies respond discussion disqus thread reader feedback", "notice": "cookie cookies notice consent gdpr alert modal popup overlay warning dialog announcement paywall",
    "form": "form subscribe newsletter login signup search register contact input", "share": "share sharing social follow like tweet", "meta": "meta byline author date time tags tag category categories",
    "content": "content article post entry story main text body articlebody prose blog page",
}
_CUE_OF = {word: i for i, words in enumerate(_CUES.values()) for word in words.split()}
_KINDS = sorted(set(_BLOCKS.values()))
_KIND_OF = {tag: _KINDS.index(kind) for tag, kind in _BLOCKS.items()}
_LEAF = len(_KINDS)
_LENGTHS, _DENSITY = [1, 3, 8, 20, 50, 120], [0.01, 0.2, 0.5, 0.9]
_SIZES = (len(_KINDS) + 1, len(_CUES) + 1, len(_LENGTHS) + 1, len(_DENSITY) + 1, 3, 2, 4, 3, len(_KINDS) + 1, 3)
_AT = np.cumsum((0, *_SIZES))
N_FEATURES = int(_AT[-1])
_NOT_CONTENT = {_KINDS.index(k) for k in ("nav", "footer", "aside", "form", "notice")}
_BAD_CUES = sum(1 << i for i, name in enumerate(_CUES) if name not in ("content", "meta", "header"))
_GOOD_CUES = 1 << list(_CUES).index("content")
_OWN_CUE = {_KINDS.index(k) for k in ("article", "nav", "header", "footer", "aside", "form", "notice", "body")}


class Page:
    """Nodes in page order (parents before children) and the texts of the leaves."""

    __slots__ = ("parent", "depth", "kind", "cues", "words", "links", "stops", "marks", "texts", "leaf")

    def __init__(self):
        self.parent, self.depth, self.kind, self.cues = [-1], [0], [_KIND_OF["body"]], [0]
        self.words, self.links, self.stops, self.marks = [0], [0], [0], [0]
        self.texts, self.leaf = [], []

    def add(self, parent: int, kind: int, cues: int, words: int = 0, links: int = 0, stops: int = 0, marks: int = 0) -> int:
        self.parent.append(parent), self.depth.append(self.depth[parent] + 1), self.kind.append(kind), self.cues.append(cues)
        self.words.append(words), self.links.append(links), self.stops.append(stops), self.marks.append(marks)
        return len(self.parent) - 1


def _cues(attributes: str) -> int:
    found = 0
    for m in _NAMES.finditer(attributes):
        for word in _PART.findall(m[1] or m[2] or m[3] or ""):
            cue = _CUE_OF.get(word.lower())
            if cue is not None:
                found |= 1 << cue
    return found


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False
    at = 0

    def flush() -> None:
        nonlocal in_link
        if pieces:
            words = "".join(pieces).split()
            if words:
                text = " ".join(words)
                n_links = len("".join(linked).split()) if linked else 0
                stops = text.count(". ") + text.count("? ") + text.count("! ") + (text[-1] in ".!?…:")
                marks = ("©" in text) + ("|" in text or "·" in text)
                page.leaf.append(page.add(stack[-1][1], _LEAF, 0, len(words), n_links, stops, marks))
                page.texts.append(text)
            pieces.clear(), linked.clear()

    def say(text: str) -> None:
        text = unescape(text) if "&" in text else text
        pieces.append(text)
        if in_link:
            linked.append(text)

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _RAW and not m[1]:
            if not _SELF_CLOSED.search(m[3]):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|</{re.escape(name)}\Z", re.I).search(html, at)
                at = end.end() if end else n
            pieces.append(" ")
        elif name in _BLOCKS:
            flush()
            in_link = False
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                continue
            if name in ("html", "body"):
                page.cues[0] |= _cues(m[3])
                continue
            if name in _ENDED_BY:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _ENDED_BY[name]:
                        del stack[k:]
                    elif stack[k][0] in _SCOPE[name]:
                        break
            elif name not in _INSIDE_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in _INSIDE_P:
                        break
            if name[0] == "h" and stack[-1][0][0] == "h" and name != "header" and _BLOCKS[name] == "h" == _BLOCKS.get(stack[-1][0]):
                del stack[-1]
            node = page.add(stack[-1][1], _KIND_OF[name], _cues(m[3]) if m[3] else 0)
            if not _SELF_CLOSED.search(m[3]):
                stack.append((name, node))
        elif name in ("br", "hr", "img", "input", "wbr"):
            if name == "hr":
                flush()
            elif name != "wbr":
                pieces.append(" ")
        elif name == "a":
            in_link = not m[1]
    flush()
    return page


class Batch:
    """Nodes of many pages in one set of arrays."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        join = lambda name: np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages]) if pages else np.empty(0, np.int64)
        parent, self.depth, kind, cues = join("parent"), join("depth"), join("kind"), join("cues")
        self.parent = np.where(parent < 0, -1, parent + base)
        self.root = parent < 0
        words, links, stops, marks = join("words"), join("links"), join("stops"), join("marks")
        order = np.argsort(self.depth, kind="stable")
        cut = np.searchsorted(self.depth[order], np.arange(int(self.depth.max(initial=0)) + 2))
        self.levels = [order[a:z] for a, z in zip(cut[:-1], cut[1:])]
        # Nodes of a level stand in page order, so siblings stand together.
        self.sibling_starts = [np.flatnonzero(np.append(True, self.parent[level][1:] != self.parent[level][:-1])) for level in self.levels]
        total, total_links = words.astype(np.float64), links.astype(np.float64)
        for level, starts in zip(reversed(self.levels[1:]), reversed(self.sibling_starts[1:])):
            above = self.parent[level][starts]
            total[above] += np.add.reduceat(total[level], starts)
            total_links[above] += np.add.reduceat(total_links[level], starts)
        size = np.repeat(sizes, sizes)
        place = (np.arange(len(parent)) - base) / np.maximum(size, 1)
        density = total_links / np.maximum(total, 1)
        leaf = kind == _LEAF
        parent_kind = np.where(self.root, _LEAF, kind[self.parent])
        self.x = np.zeros((len(parent), N_FEATURES), np.float32)
        rows = np.arange(len(parent))
        at = lambda group, value: self.x.__setitem__((rows, _AT[group] + value), 1.0)
        at(0, kind)
        for i in range(len(_CUES)):
            self.x[(cues >> i) & 1 == 1, _AT[1] + i] = 1.0
        self.x[cues == 0, _AT[1] + len(_CUES)] = 1.0
        at(2, np.digitize(total, _LENGTHS)), at(3, np.digitize(density, _DENSITY))
        at(4, np.where(leaf, np.minimum(stops, 2), 0)), at(5, (marks > 0).astype(int)), at(6, np.minimum((place * 4).astype(int), 3)), at(7, np.digitize(self.depth, [3, 6]))
        at(8, np.where(leaf, parent_kind, _LEAF))
        # The nearest marked ancestor, or the node itself: none, an article, or something else than an article.
        mark = np.where(np.isin(kind, list(_NOT_CONTENT)) | (cues & _BAD_CUES > 0), 2, np.where((kind == _KINDS.index("article")) | (cues & _GOOD_CUES > 0), 1, 0))
        mark[self.root] = 0
        for level in self.levels[1:]:
            mark[level] = np.where(mark[level] > 0, mark[level], mark[self.parent[level]])
        at(9, mark)
        # A child with a cue of its own is less bound to its parent.
        self.bound = np.where(leaf, 0, np.where((cues > 0) | np.isin(kind, list(_OWN_CUE)), 2, 1))

    def beliefs(self, weights: np.ndarray, pair: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Marginals of content; for each child those of (parent, child) labels. Messages are log-odds of content.

        ``pair`` is (3, 2, 2): binding class of the child, label of the parent, label of the child.
        """
        inside = (self.x @ weights.astype(np.float32)).astype(np.float64)
        psi = pair[self.bound]
        n00, n01, n10, n11 = psi[:, 0, 0], psi[:, 0, 1], psi[:, 1, 0], psi[:, 1, 1]
        up = np.zeros(len(inside))  # to the parent
        for level, starts in zip(reversed(self.levels[1:]), reversed(self.sibling_starts[1:])):
            d = inside[level]
            up[level] = np.logaddexp(n10[level], n11[level] + d) - np.logaddexp(n00[level], n01[level] + d)
            inside[self.parent[level][starts]] += np.add.reduceat(up[level], starts)
        down = np.zeros(len(inside))  # from the parent
        for level in self.levels[1:]:
            above = inside[self.parent[level]] + down[self.parent[level]] - up[level]
            down[level] = np.logaddexp(n01[level], n11[level] + above) - np.logaddexp(n00[level], n10[level] + above)
        marginal = 1 / (1 + np.exp(-np.clip(inside + down, -500, 500)))
        if not with_pairs:
            return marginal, None
        child = ~self.root
        joint = psi.copy()
        joint[child, 1, :] += (inside + down)[self.parent[child]][:, None] - up[child][:, None]
        joint[child, :, 1] += inside[child][:, None]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return marginal, joint / joint.sum(axis=(1, 2), keepdims=True)


def train(pages: list[Page], labels: list[list[int]], steps: int = STEPS, rate: float = 0.15, keep: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Node and parent-child weights that make labelled trees likely (gradient ascent with Adam). Labels are one per node."""
    weights, pair = np.zeros(N_FEATURES), np.zeros((3, 2, 2))
    if not pages:
        return weights, pair
    batch = Batch(pages)
    y = np.concatenate([np.asarray(x) for x in labels])
    child = ~batch.root
    n = max(1, len(pages))
    seen_pair = np.zeros((3, 2, 2))
    np.add.at(seen_pair, (batch.bound[child], y[batch.parent[child]], y[child]), 1)
    moments = [np.zeros(N_FEATURES + 12), np.zeros(N_FEATURES + 12)]
    theta = np.zeros(N_FEATURES + 12)
    for step in range(1, steps + 1):
        marginal, pairs = batch.beliefs(theta[:N_FEATURES], theta[N_FEATURES:].reshape(3, 2, 2), with_pairs=True)
        expected = np.stack([pairs[child & (batch.bound == b)].sum(axis=0) for b in range(3)])
        gradient = np.concatenate([(batch.x.T @ (y - marginal).astype(np.float32)) / n, ((seen_pair - expected) / n).ravel()]) - keep * theta
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient ** 2
        theta = theta + rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-8) * min(1.0, 2 * (1 - step / steps) + 0.02)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(3, 2, 2)


# Labelled pages -----------------------------------------------------------------------------------------------------

def marked_labels(page: Page) -> list[int] | None:
    """Labels of a page that marks its article: nodes inside it, outside of menus, forms, comments and the like."""
    article = _KINDS.index("article")
    label = [0] * len(page.parent)
    found = False
    for i in range(1, len(label)):
        kind, up = page.kind[i], page.parent[i]
        if kind == article:
            label[i] = int(page.cues[i] & _BAD_CUES == 0)
            found = True
        elif kind in _NOT_CONTENT or page.cues[i] & _BAD_CUES:
            label[i] = 0
        else:
            label[i] = label[up]
    return label if found and any(label) else None


def _rendered(rng: np.random.Generator, blocks: list[str], words: list[str]) -> str:
    """A labelled page in another layout: content nodes carry the attribute y."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    some = lambda a, z: esc(" ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(a, z)))))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    line = lambda: some(3, 12).capitalize() + "."
    links = lambda n, tag="li": "".join(f"<{tag}><a href='/{i}'>{some(1, 4)}</a></{tag}>" for i in range(n))
    paragraph = lambda n: " ".join(line() for _ in range(int(rng.integers(1, n))))
    menu = pick(lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f"<div class='{pick('menu', 'navbar', 'main-nav')}'><ul>{links(5)}</ul></div>", lambda: f"<ul id='menu'>{links(7)}</ul>")
    head = pick(lambda: "", lambda: f"<header><div class='logo'>{some(1, 3)}</div>{menu()}</header>", lambda: f"<div id='header'><h2>{some(1, 4)}</h2></div>")
    ad = lambda: pick(f"<div class='{pick('ad', 'advert', 'sponsored', 'promo', 'ad-banner')}'>{pick(line(), '<p>' + paragraph(4) + '</p>')}</div>", "")
    notice = lambda: pick(f"<div class='{pick('cookie-notice', 'consent', 'notice', 'alert')}'><p>{paragraph(4)}</p><button>{some(1, 3)}</button></div>", "")
    side = lambda: pick(f"<aside><h3>{some(1, 4)}</h3><ul>{links(5)}</ul></aside>", f"<div class='{pick('sidebar', 'widget', 'related')}'><h4>{some(1, 4)}</h4><p>{paragraph(3)}</p>{links(3, 'p')}</div>", "")
    form = lambda: pick(f"<form><label>{some(1, 4)}</label><input name='q'><button>{some(1, 2)}</button></form>", f"<div class='newsletter'><p>{line()}</p><form><p>{some(2, 6)}</p></form></div>", "")
    comments = lambda: pick("", f"<{(s := pick('section', 'div'))} {pick('class', 'id')}='{pick('comments', 'comment-list', 'reader-comments')}'><h3>{some(1, 3)}</h3>" + "".join(
        f"<div class='comment'><p>{some(1, 2)}</p><p>{paragraph(5)}</p></div>" for _ in range(int(rng.integers(1, 5)))) + f"</{s}>")
    foot = lambda: pick(f"<footer>{pick('&copy; ', '')}{line()}</footer>", f"<div class='footer'><p>&copy; {some(2, 8)}</p><ul>{links(4)}</ul></div>", f"<div id='footer'>{links(3, 'span')}</div>")
    body, title = [], True
    plain = rng.random()
    if plain > 0.85:  # articles of many short lines
        blocks = [blocks[0], *(" ".join(blocks[int(rng.integers(len(blocks)))].split(" ")[:int(rng.integers(1, 6))]) for _ in range(int(rng.integers(5, 60))))]
    for text in blocks:
        if plain < 0.15:  # articles without sentences: no punctuation, or the same words again and again
            text = re.sub(r"[.,;:!?]", "", text) or text
        elif plain < 0.3:
            text = " ".join([text.split(" ")[0]] * (text.count(" ") + 1))
        tag = "h1" if title else pick("p", "p", "p", "p", "h2", "blockquote", "li") if len(text) < 120 else pick("p", "p", "p", "div")
        inner = esc(text)
        if rng.random() < 0.2 and " " in text:
            a, _, b = text.partition(" ")
            inner = f"{esc(a)} <a href='/x'>{esc(b.split(' ')[0])}</a> {esc(' '.join(b.split(' ')[1:]))}"
        body.append(f"<ul y=1><li y=1>{inner}</li></ul>" if tag == "li" else f"<{tag} y=1>{inner}</{tag}>")
        title = False
        if rng.random() < 0.06:
            body.append(ad())
    inside = "".join(body)
    style = pick("<article y=1>{}</article>", "<main y=1>{}</main>", "<div class='content' y=1>{}</div>", "<div id='article-body' y=1>{}</div>", "<div class='post' y=1><div class='entry' y=1>{}</div></div>", "<div y=1>{}</div>", "<article y=1>{}")
    if rng.random() < 0.25:
        inside += comments() + side()
        middle = style.format(inside)
    else:
        middle = style.format(inside) + comments()
    wrap = pick("{}", "<div class='container'>{}</div>", "<div id='wrapper'>{}</div>", "<div>{}</div>")
    return f"<html><body>{notice()}{head()}{menu()}{ad()}" + wrap.format(pick(side() + form() + middle, middle + side(), middle + ad() + form())) + f"{ad()}{form()}{foot()}</body></html>"


_Y = re.compile(r"\sy=1")


def labelled_layout(html: str) -> tuple[Page, list[int]]:
    """Parse a rendered page; nodes opened by a tag with y are content, and so are leaves below them."""
    page = parse(html)
    flags = []
    for m in _TAG.finditer(html):
        if m[2] and not m[1] and m[2].lower() in _BLOCKS and m[2].lower() not in ("html", "body"):
            flags.append(int(bool(_Y.search(m[3]))))
    label, k = [0] * len(page.parent), 0
    for i in range(1, len(label)):
        if page.kind[i] == _LEAF:
            label[i] = label[page.parent[i]]
        else:
            label[i] = flags[k]
            k += 1
    return page, label


def labelled_pages(htmls: list[str], layouts: int = LAYOUTS, seed: int = 3) -> tuple[list[Page], list[list[int]]]:
    rng = np.random.default_rng(seed)
    pages, labels = [], []
    words = sorted({w for h in htmls for t in parse(h).texts for w in t.split()[:40] if w.isalpha()})[:20000] or ["word", "other", "some", "text"]
    for html in htmls:
        page = parse(html)
        label = marked_labels(page)
        if label is None:
            continue
        pages.append(page), labels.append(label)
        content = [t for t, leaf in zip(page.texts, page.leaf) if label[leaf]]
        for _ in range(layouts):
            p, y = labelled_layout(_rendered(rng, content, words))
            pages.append(p), labels.append(y)
    if not pages:
        for _ in range(100):
            p, y = labelled_layout(_rendered(rng, [" ".join(rng.choice(words, int(rng.integers(3, 60)))) + "." for _ in range(int(rng.integers(2, 12)))], words))
            pages.append(p), labels.append(y)
    return pages, labels


# On Spark -----------------------------------------------------------------------------------------------------------


def fit_extractor(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of fixed size, fitted in one task from at most ``sample`` pages (the smallest hashes of their ids)."""
    rows = pages.where(F.col(html).isNotNull()).select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    some = smallest_hashes(rows, F.col("page_id"), sample, "html").select("html").repartition(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        htmls = sorted(h for b in batches for h in b.column("html").to_pylist())
        if not htmls:
            return
        weights, pair = train(*labelled_pages(htmls))
        yield pa.RecordBatch.from_pydict({"theta": pa.array([np.concatenate([weights, pair.ravel()])], pa.list_(pa.float64()))})

    row = some.mapInArrow(fit, "theta array<double>").first()
    if row is None:
        return train(*labelled_pages([]))
    theta = np.array(row["theta"])
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(3, 2, 2)


def extract_pages(htmls: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [parse(h or "") for h in htmls]
    batch = Batch(pages)
    content = batch.beliefs(*model)[0] >= 0.5 if len(batch.root) else np.empty(0, bool)
    out, base = [], 0
    for page in pages:
        out.append("\n\n".join(t for t, leaf in zip(page.texts, page.leaf) if content[base + leaf]))
        base += len(page.parent)
    return out


def extract_main_text(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), at_once: int = 500) -> DataFrame:
    """The columns ``keep``, text and n_chars, for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(*keep, F.col(html).alias("_html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                texts = extract_pages(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", text string, n_chars long"
    return rows.mapInArrow(extract, schema)
