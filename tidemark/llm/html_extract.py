"""Main-text extraction by a tree-structured graphical model over the DOM.

Nodes are block elements and blocks of text; each is content or not. A node's own evidence is linear in
features of its tag, class and id words, text and links; an edge has a learned potential for each pair
of states of parent and child. One upward and one downward sum-product pass give exact marginals, and
blocks of text that are likelier content than not are kept, in page order. Weights maximise the
conditional likelihood of labelled pages; ``labelled_pages`` makes a set of them from page layouts.
"""

from __future__ import annotations

import bisect
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import lean, slices

#: Fixed values of the HTML standard: elements without content, with raw text, and inline elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math select object audio video canvas noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start closes an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements that an implied end does not cross.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
BLOCK_IN_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())

TAGS = "html body main article section div p nav header footer aside form fieldset ul ol li dl dt dd table tr td th figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 button address details summary menu dialog center".split()
WORDS = "nav menu side sidebar ad ads advert advertisement sponsor sponsored promo banner cookie consent gdpr notice alert popup modal comment comments reply respond discussion disqus share social related recommend footer foot header head top bottom breadcrumb breadcrumbs login signup subscribe newsletter widget toolbar pagination pager tags meta author byline copyright legal rail content article post entry main story body text page container wrapper row col pull quote pullquote note footnote free".split()
ROLES = "navigation banner contentinfo complementary search form main article dialog alert".split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
WORD_AT = {w: len(TAGS) + i for i, w in enumerate(WORDS)}
ROLE_AT = {r: len(TAGS) + len(WORDS) + i for i, r in enumerate(ROLES)}
BASE = len(TAGS) + len(WORDS) + len(ROLES)
LEAF, OTHER, HIDDEN, NUMBERS = BASE, BASE + 1, BASE + 2, BASE + 3
N_FEATURES = NUMBERS + 10

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTES = re.compile("[>\"']")
#: Quoted values of one tag at most; a tag with more, or with an open quote, ends at its first ``>``.
QUOTED = 256
#: Levels of the block tree; what is nested deeper belongs to its ancestor on the last one.
DEPTH = 200
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


def tag_end(source: str, at: int) -> int:
    """Past the ``>`` that ends a tag whose attributes begin at ``at``; quoted values may hold one."""
    first = source.find(">", at)
    if first < 0:
        return -1
    for _ in range(QUOTED):
        found = QUOTES.search(source, at)
        if not found:
            break
        if found[0] == ">":
            return found.end()
        at = source.find(found[0], found.end()) + 1
        if not at:
            break
    return first + 1


def tokens(source: str):
    """``(text, tag, ending, attributes, raw)``: text up to a tag, and the tag (none at the end). Comments,
    declarations and the bodies of raw elements are left out; time is linear in the page."""
    at, text, last = 0, [], source.rfind(">")
    while True:
        start = source.find("<", at)
        if start < 0 or start > last:
            # no tag can end any more; an open comment hides the rest
            comment = source.find("<!--", at)
            text.append(source[at:] if comment < 0 else source[at:comment])
            yield "".join(text), "", False, "", False
            return
        text.append(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(source)
            continue
        if source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
            continue
        ending = source.startswith("</", start)
        name = TAG_NAME.match(source, start + 1 + ending)
        end = tag_end(source, name.end()) if name else -1
        if end < 0:  # a bare "<", or "</>", which browsers drop
            at = start + 1
            if source.startswith("</>", start):
                at = start + 3
            else:
                text.append("<")
            continue
        tag, attrs = name[0].lower(), source[name.end() : end - 1]
        raw = not ending and tag in RAW and not (attrs.endswith("/") and tag in ("svg", "math"))
        at = end
        if raw:
            close = RAW_END[tag].search(source, at)
            at = close.end() if close else len(source)
        yield "".join(text), tag, ending, attrs, raw
        text = []


class Page:
    """A page's block tree: parents, depths, active features and, of leaves, text."""

    def __init__(self, source: str | None):
        self.parent, self.depth, self.on, self.texts, self.links, self.chars, self.linked = [], [], [], [], [], [], []
        self.marks: list[str] = []
        self._parse(source or "")

    def _node(self, parent: int, on: list[int]) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.on.append(on)
        self.texts.append(None)
        self.links.append(0)
        self.chars.append(0)
        self.linked.append(0)
        self.marks.append("")
        return len(self.parent) - 1

    def _parse(self, source: str):
        root = self._node(-1, [OTHER])
        stack: list[tuple[str, int]] = [("", root)]  # open elements; inline ones keep their block's node
        opened: dict[str, list[int]] = {}  # by tag: places in the stack
        blocks, hard = [0], [0]  # places of open block elements; of those that are no paragraph
        pieces: list[str] = []
        linked, in_link, count = 0, 0, 0

        def flush():
            nonlocal pieces, linked, count
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    node = self._node(stack[-1][1], [LEAF])
                    self.texts[node], self.links[node], self.chars[node], self.linked[node] = text, count, len(text), min(linked, len(text))
            pieces, linked, count = [], 0, 0

        def push(tag: str, node: int):
            opened.setdefault(tag, []).append(len(stack))
            if tag not in INLINE and node != stack[-1][1]:
                blocks.append(len(stack))
                if tag != "p":
                    hard.append(len(stack))
            stack.append((tag, node))

        def close(k: int):
            nonlocal in_link
            if blocks[-1] >= k:
                flush()
            for tag, _ in stack[k:]:
                opened[tag].pop()
                in_link -= tag == "a"
            while blocks[-1] >= k:
                blocks.pop()
            while hard[-1] >= k:
                hard.pop()
            del stack[k:]

        latest = lambda tags: max((opened[t][-1] for t in tags if opened.get(t)), default=0)
        for text, tag, ending, attrs, raw in tokens(source):
            if text:
                pieces.append(text)
                if in_link:
                    linked += len(text.strip())
            if not tag:
                continue
            if ending:
                k = latest((tag,))
                inline = tag in INLINE or (k and k not in blocks)
                if k and (not inline or hard[-1] < k):
                    close(k)
                elif not k and tag in ("p", "br"):
                    flush()
            elif raw:
                pieces.append(" ")
            elif tag == "br":
                pieces.append("\n")
            elif tag == "hr":
                flush()
            elif tag in VOID:
                if tag == "img":
                    pieces.append(" ")
            elif tag in INLINE or (tag == "button" and "".join(pieces).strip()):  # a button within a sentence
                push(tag, stack[-1][1])
                if tag == "a":
                    in_link += 1
                    count += 1
            else:
                if tag in BLOCK_IN_P and stack[blocks[-1]][0] == "p":
                    close(blocks[-1])
                if tag in CLOSES:
                    scope = latest(SCOPE[tag])
                    inside = [own[bisect.bisect_right(own, scope)] for t in CLOSES[tag] if (own := opened.get(t)) and own[-1] > scope]
                    if inside:
                        close(min(inside))
                flush()
                over = stack[-1][1]
                if self.depth[over] < DEPTH:
                    over = self._node(over, self._features(tag, attrs))
                    if attrs:
                        self.marks[-1] = attrs
                push(tag, over)
        flush()

    @staticmethod
    def _features(tag: str, attrs: str) -> list[int]:
        on = [TAG_AT.get(tag, OTHER)]
        if attrs.strip():
            for name, a, b, c in ATTR.findall(attrs):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    on += [WORD_AT[w] for w in {p.lower() for p in PARTS.findall(value)} if w in WORD_AT]
                elif name == "role":
                    on += [ROLE_AT[r] for r in value.lower().split() if r in ROLE_AT]
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                    on.append(HIDDEN)
        return on


class Forest:
    """Several pages' nodes as arrays, for features and message passing."""

    def __init__(self, pages: list[Page]):
        base, parents = 0, []
        self.page, self.texts = [], []
        for n, p in enumerate(pages):
            parents += [x + base if x >= 0 else -1 for x in p.parent]
            base += len(p.parent)
            self.page += [n] * len(p.parent)
            self.texts += p.texts
        self.parent = np.array(parents, np.int64)
        self.depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.empty(0, int)
        n = len(self.parent)
        chars, linked, links, leaves = (np.concatenate([np.array(getattr(p, k), float) for p in pages]) for k in ("chars", "linked", "links", "chars"))
        leaves = (leaves > 0).astype(float)
        self.levels = np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1])[1:] if n else []
        own = chars.copy()
        for level in self.levels[::-1]:
            for x in (chars, linked, links, leaves):
                np.add.at(x, self.parent[level], x[level])
        self.leaf = np.array([t is not None for t in self.texts], bool)
        f = np.zeros((n, N_FEATURES))
        rows = np.repeat(np.arange(n), [len(o) for p in pages for o in p.on])
        f[rows, [c for p in pages for o in p.on for c in o]] = 1.0
        marks = np.array([0.0 if t is None else sum(map(t.count, ".,;!?")) for t in self.texts])
        f[:, NUMBERS] = 1.0
        f[:, NUMBERS + 1] = np.log1p(chars) / 8
        f[:, NUMBERS + 2] = linked / np.maximum(chars, 1)
        f[:, NUMBERS + 3] = np.log1p(links) / 4
        f[:, NUMBERS + 4] = np.log1p(leaves) / 4
        f[:, NUMBERS + 5] = self.leaf * np.log1p(own) / 8
        f[:, NUMBERS + 6] = self.leaf * (linked > 0.6 * np.maximum(chars, 1))
        f[:, NUMBERS + 7] = self.leaf * np.minimum(1, marks / 4)
        f[:, NUMBERS + 8] = self.leaf * (own < 30)
        root = np.flatnonzero(self.parent < 0)
        f[:, NUMBERS + 9] = chars / np.maximum(chars[root], 1)[np.array(self.page, np.int64)]
        self.features = f

    def passes(self, weights: np.ndarray, edges: np.ndarray):
        """Exact marginals of content, and of (parent, child) states for nodes below a root."""
        n = len(self.parent)
        local = np.zeros((n, 2))
        local[:, 1] = self.features @ weights
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        kind = self.leaf.astype(int)
        for level in self.levels[::-1]:
            joint = edges[kind[level]] + local[level][:, None, :]  # (node, parent state, own state)
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(local, self.parent[level], up[level])
        pair = np.zeros((n, 2, 2))
        for level in self.levels:
            p = self.parent[level]
            rest = local[p] + down[p] - up[level]
            joint = edges[kind[level]] + rest[:, :, None]
            down[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            full = joint + local[level][:, None, :]
            full -= full.max((1, 2), keepdims=True)
            full = np.exp(full)
            pair[level] = full / full.sum((1, 2), keepdims=True)
        total = local + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60))), pair


def labelled_pages(count: int = 300, seed: int = 13) -> list[tuple[str, set[str]]]:
    """Pages of varied layouts with the texts of their content blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    serial = 0
    letters, sizes = rng.choice(list("abcdefghijklmnoprstuvéä"), 20_000), rng.integers(1, 9, 4000)
    ends = np.cumsum(sizes)
    vocabulary = ["".join(letters[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def words(lo, hi):
        nonlocal serial
        serial += 1
        text = " ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), int(rng.integers(lo, hi))).tolist())
        if rng.random() < 0.15:
            text = text.upper()
        return f"{text}{pick('.', '', '!', ' ***')} k{serial}"

    def items(n, link=True):
        return "".join(f"<li><a href='/{i}'>{words(1, 4)}</a></li>" if link else f"<li>{words(1, 4)}</li>" for i in range(n))

    out = []
    for _ in range(count):
        good: set[str] = set()

        def text(lo, hi, good=good):
            t = words(lo, hi)
            good.add(t)
            return t

        junk = {
            "top": lambda: pick(f"<header>{pick('', '<div class=logo>' + words(1, 3) + '</div>')}<nav><ul>{items(rng.integers(3, 9))}</ul></nav></header>", f"<nav><ul>{items(rng.integers(3, 9))}</ul></nav>", f"<div class='{pick('menu', 'top-menu', 'navbar nav', 'header')}'>{items(rng.integers(2, 7)).replace('li>', 'span>').replace('<li', '<span')}</div>", f"<header class='site-header'><p>{words(2, 8)}</p></header>"),
            "ad": lambda: pick(f"<div class='{pick('ad', 'ads', 'advert', 'sponsored', 'promo banner', 'ad-slot')}'>{words(4, 40)}</div>", f"<div class=ad><p>{words(4, 30)}</p><a href=x>{words(1, 4)}</a></div>"),
            "notice": lambda: f"<div {pick('class', 'id')}='{pick('cookie-banner', 'cookie-notice', 'consent', 'gdpr-notice', 'notice', 'alert notice')}'><p>{words(6, 40)}</p><button>{words(1, 2)}</button></div>",
            "side": lambda: pick(f"<div {pick('class', 'id')}='{pick('sidebar', 'side', 'related', 'widget')}'><p>{words(4, 30)}</p></div>", f"<aside>{pick('<h3>' + words(1, 4) + '</h3>', '')}<ul>{items(rng.integers(3, 8))}</ul></aside>", f"<aside><p>{words(5, 60)}</p></aside>", f"<div class='{pick('sidebar', 'side-rail', 'widget', 'related')}'><h3>{words(1, 4)}</h3><p>{words(5, 30)}</p><ul>{items(rng.integers(2, 6))}</ul></div>"),
            "form": lambda: f"<form action=x><p>{words(3, 10)}</p><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>",
            "comments": lambda: f"<{pick('section', 'div')} {pick('class', 'id')}='{pick('comments', 'comment-list', 'disqus', 'discussion', 'reader-comments')}'><h3>{words(1, 4)}</h3>" + "".join(f"<{pick('div', 'article', 'li')} class='{pick('comment', 'reply')}'><p>{words(5, 60)}</p></div>" for _ in range(int(rng.integers(1, 5)))) + "</div>",
            "share": lambda: f"<div class='{pick('share', 'social', 'tags', 'newsletter subscribe')}'>{items(rng.integers(2, 5))}</div>",
            "foot": lambda: pick(f"<footer>{words(4, 30)}</footer>", f"<footer><p>{words(4, 20)}</p><ul>{items(rng.integers(2, 6))}</ul></footer>", f"<div class='{pick('footer', 'copyright legal')}'><p>{words(4, 20)}</p></div>"),
        }

        def aside_of_article():
            """Parts of an article whose tags or places alone would speak against them."""
            name = pick("pullquote", "pull-quote", "quote")
            return pick(
                lambda: "<dl>" + "".join(f"<dt>{text(1, 5)}{pick('</dt>', '')}<dd>{text(2, 20)}{pick('</dd>', '')}" for _ in range(int(rng.integers(1, 5)))) + "</dl>",
                lambda: f"<aside class='{name}'><p>{text(3, 20)}</p></aside>",
                lambda: f"<aside class='{name}'>{text(3, 20)}</aside>",
                lambda: f"<details><summary>{text(1, 8)}</summary><p>{text(3, 40)}</p></details>",
                lambda: f"<pre>{text(2, 20)}</pre>",
            )()

        def body():
            parts = []
            if rng.random() < 0.85:
                h = f"<{(t := pick('h1', 'h1', 'h2'))}>{text(1, 14)}</{t}>"
                parts.append(f"<header>{h}</header>" if rng.random() < 0.1 else h)
            for _ in range(int(rng.integers(1, 12))):
                r = rng.random()
                if r < 0.68:
                    link = f" <a href=x>{words(1, 3)}</a>" if rng.random() < 0.15 else ""
                    t = text(1, pick(4, 30, 90))
                    if link:
                        good.discard(t)
                        shown = " ".join((t + re.sub("<[^>]*>", "", link)).split())
                        good.add(shown)
                    odd = f" class='{pick('comment-free', 'header-note', 'side-note', 'share-price', 'menu-item-text', 'footnote', 'ad-free', 'lead', 'intro')}'" if rng.random() < 0.08 else ""
                    parts.append(f"<p{odd}>{pick('', '<b>')}{t}{link}{pick('</p>', '</p>', '<br>')}")
                elif r < 0.76:
                    parts.append(f"<h2>{text(1, 8)}</h2>")
                elif r < 0.79:  # lists and paragraphs of links belong to an article too
                    tag = pick("ul", "ul", "ol")
                    parts.append(f"<{tag}>" + "".join(f"<li><a href='/{i}'>{text(1, 12)}</a></li>" for i in range(int(rng.integers(1, 6)))) + f"</{tag}>")
                elif r < 0.80:
                    parts.append(f"<p><a href=x>{text(2, 14)}</a></p>")
                elif r < 0.84:
                    parts.append("<ul>" + "".join(f"<li>{text(2, 20)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
                elif r < 0.86:
                    parts.append(f"<blockquote><p>{text(4, 40)}</p></blockquote>")
                elif r < 0.88:
                    parts.append(aside_of_article())
                elif r < 0.91:
                    parts.append(f"<table><tr><td>{text(1, 5)}</td><td>{text(1, 5)}</td></tr></table>")
                elif r < 0.93:
                    parts.append(f"<figure><figcaption>{text(2, 12)}</figcaption></figure>")
                elif r < 0.97:
                    parts.append(junk[pick("ad", "side", "share", "form")]())
                else:
                    parts.append(f"<div>{text(3, 40)}</div>")
            return "".join(parts)

        content = body()
        end = junk["comments"]() if rng.random() < 0.35 else ""
        inside = rng.random() < 0.3
        frame = pick("article", "article", "main", "div", "section")
        name = f" {pick('class', 'id')}='{pick('content', 'article-body', 'post', 'entry-content', 'main', 'story')}'" if frame in ("div", "section") or rng.random() < 0.3 else ""
        core = f"<{frame}{name}>{content}{end if inside else ''}</{frame}>{'' if inside else end}"
        if rng.random() < 0.3:
            core = f"<{pick('main', 'div class=wrapper', 'div id=page', 'div class=container')}>{core}{pick('', junk['side']())}</div>"
        if rng.random() < 0.3:  # a page that is little more than its article, or than its text
            if rng.random() < 0.6:
                good.clear()
                lone = pick("p", "p", "div", "h1", "")
                parts = [text(1, pick(3, 8, 25)) for _ in range(1 if not lone else int(rng.integers(1, 4)))]
                content = "".join(f"<{lone}>{x}</{lone}>" if lone else x for x in parts)
                core = f"<{frame}{name}>{content}</{frame}>"
            out.append((pick(core, core, content, f"<body>{content}</body>", f"<html><head><title>{words(2, 6)}</title></head><body>{core}</body></html>", f"{core}{junk['foot']()}"), good))
            continue
        if rng.random() < 0.07:  # laid out by a table
            row = "".join(f"<td><a href='/{i}'>{words(1, 3)}</a></td>" for i in range(int(rng.integers(2, 7))))
            core = pick(f"<table><tr>{row}</tr></table>{core}", f"<table><tr><td><ul>{items(rng.integers(3, 8))}</ul></td><td>{core}</td></tr></table>", f"<table><tr>{row}</tr><tr><td colspan=4>{core}</td></tr></table>")
        before = [junk["top"]()] + [junk[k]() for k in ("ad", "notice", "side") if rng.random() < 0.4]
        after = [junk[k]() for k in ("side", "form", "ad", "share", "notice") if rng.random() < 0.25] + [junk["foot"]()]
        end_tags = pick("</body></html>", "")
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{core}{''.join(after)}{end_tags}", good))
    return out


def fit(pages: list[tuple[str, set[str]]] | None = None, rounds: int = 120, rate: float = 0.1, decay: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials (text or element, parent state, own state) by Adam on the exact
    conditional likelihood. A node above a content block is content."""
    pages = labelled_pages() if pages is None else pages
    parsed = [Page(source) for source, _ in pages]
    forest = Forest(parsed)
    truth = np.array([t is not None and t in pages[forest.page[i]][1] for i, t in enumerate(forest.texts)], float)
    for level in forest.levels[::-1]:
        np.maximum.at(truth, forest.parent[level], truth[level])
    y = truth.astype(int)
    weights, edges = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    kind, below = forest.leaf.astype(int), forest.parent >= 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[below], y[forest.parent[below]], y[below]), 1)
    params, n = [weights, edges], len(pages)
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, rounds + 1):
        p, pair = forest.passes(*params)
        expected = np.zeros((2, 2, 2))
        for k in (0, 1):
            expected[k] = pair[below & (kind == k)].sum(0)
        grads = [(forest.features.T @ (truth - p) - decay * params[0]) / n, (seen - expected - decay * params[1]) / n]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return params[0], params[1]


def extract_texts(sources: list[str | None], model) -> list[str]:
    forest = Forest([Page(s) for s in sources])
    p, _ = forest.passes(*model)
    out: list[list[str]] = [[] for _ in sources]
    for i in np.flatnonzero(forest.leaf & (p >= 0.5)).tolist():
        out[forest.page[i]].append(forest.texts[i])
    return ["\n\n".join(x) for x in out]


def _extract(model, step: int = 200):
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2), most=step):
                part = batch.slice(i, j - i)
                texts = extract_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return lean(run)


def html_extract(pages: DataFrame, model=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page: its content blocks joined by a blank line.

    Null and empty pages, and pages without a content block, give an empty text; repeated rows repeat;
    an empty table gives an empty result; other columns are ignored. Without a model, one is trained on
    ``labelled_pages``.
    """
    model = fit() if model is None else model
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
