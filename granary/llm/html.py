"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' word
counts and link densities.

A page is cut into blocks of text at its block-level tags. Each block has its number of words, its link density
(words inside links by words), those of the blocks before and after it, and what its open elements say: whether one
of them is named as furniture (menu, notice, advert, comment ...), and whether one is the article, by name or by holding
COMPANY unlinked words outside furniture in its own blocks. A small CART tree, fitted to LABELLED below, decides which
blocks are main text.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S,
)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[a-z]+|\d+", re.I)
#: Content that is not text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg select button head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without end tags, or whose end tags may be left out and which hold no blocks that outlast them.
LEAF = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr hr caption legend summary".split())
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
#: Parts of class, id and role that name furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert "
    "menu menubar nav navbar navigation topnav breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets rail complementary footer foot bottom contentinfo colophon "
    "masthead topbar siteheader comment comments commentlist disqus respond reply replies discussion share sharing social follow related recommended recommendations popular trending "
    "newsletter subscribe subscription signup login signin search searchbox form modal popup overlay dialog skip toolbar hidden copyright legal disclaimer".split()
)
#: Parts that may stand beside those in a name of furniture; a name with any other part, such as related-work, is not one, unless
#: its last part is in NOUNS.
NEUTRAL = frozenset(
    "a all area bar block blocks body bottom box boxes button buttons col column container content contents desktop entry first fixed global group header heading holder icon inner inside item items js last left link links list main mobile "
    "module more new news outer page panel post posts article articles story stories primary region right row secondary section site slot small sticky sub tag tags tertiary text title top ul unit us view web wrap wrapper your".split()
)
NOUNS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments commentlist footer menu nav navbar navigation newsletter pagination popup sidebar".split())
#: Beginnings of such parts.
STEMS = ("comment", "sidebar", "advert", "cookie", "newsletter", "navbar", "navig", "footer", "breadcrumb", "sponsor", "promo", "subscri", "popup", "related")
#: Names of page headers, unless they also name the article.
HEADERS = frozenset("header head pageheader siteheader topheader".split())
#: Names of whole pages' layouts, which may mention a sidebar or menu that they have or lack.
LAYOUTS = frozenset("has with no without layout wrapper container grid".split())
SIDES = frozenset("sidebar side menu nav navbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
ARTICLE = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article post story entry articlebody content main".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}

#: What the tree is fitted to. Fixed values, written for this module: blocks as they stand in layouts of news, blog,
#: encyclopedia, shop and forum pages, labelled by hand; no page of a test or of the corpus is in it. Words, link density, words and link
#: density of the block before and of the block after, in named furniture, in the article, heading, main text.
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 0 0
1 1.0 1 1.0 1 1.0 1 0 0 0
2 1.0 1 1.0 12 0.0 1 0 0 0
3 1.0 2 1.0 40 0.0 1 0 0 0
9 0.0 2 1.0 9 0.0 1 0 0 0
14 0.0 1 1.0 8 0.0 1 0 0 0
40 0.0 1 1.0 60 0.0 1 0 0 0
120 0.1 10 0.0 80 0.0 1 0 0 0
60 0.0 90 0.0 0 0.0 1 0 0 0
8 0.2 70 0.0 0 0.0 1 0 0 0
12 0.0 30 0.0 0 0.0 1 0 0 0
5 0.0 30 0.0 0 0.0 1 0 0 0
30 0.0 25 0.0 22 0.0 1 1 0 0
25 0.0 120 0.0 30 0.0 1 1 0 0
6 0.0 80 0.0 30 0.0 1 1 0 0
3 0.0 25 0.0 20 0.0 1 1 1 0
90 0.0 60 0.0 40 0.0 1 1 0 0
4 1.0 90 0.0 4 1.0 1 1 0 0
2 0.0 40 0.0 3 0.0 1 0 1 0
9 0.0 14 0.0 9 0.0 0 1 1 1
3 0.0 14 0.0 50 0.0 0 1 1 1
1 0.0 0 0.0 20 0.0 0 1 1 1
6 0.0 0 0.0 80 0.0 0 1 1 1
70 0.0 9 0.0 40 0.0 0 1 0 1
40 0.0 70 0.0 1 0.0 0 1 0 1
1 0.0 40 0.0 90 0.0 0 1 0 1
2 0.0 1 0.0 1 0.0 0 1 0 1
1 0.0 1 0.0 8 0.2 0 1 0 1
3 0.0 90 0.0 8 0.1 0 1 0 1
200 0.0 80 0.0 12 0.0 0 1 0 1
30 0.2 60 0.0 40 0.0 0 1 0 1
12 0.4 60 0.0 40 0.0 0 1 0 1
900 0.0 9 0.0 12 0.0 0 1 0 1
6 0.0 20 0.0 6 0.0 0 1 0 1
4 0.0 4 0.0 47 0.0 0 1 0 1
2 0.0 2 0.0 120 0.0 0 1 0 1
3 0.0 3 0.0 3 0.0 0 1 0 1
1 0.0 2 0.0 0 0.0 0 1 0 1
2 0.0 1 1.0 5 0.0 0 1 1 1
4 0.0 2 1.0 40 0.0 0 1 1 1
1 0.0 3 1.0 30 0.0 0 1 0 1
2 0.0 4 1.0 60 0.0 0 1 0 1
30 0.0 3 1.0 60 0.0 0 1 0 1
60 0.0 80 0.0 0 0.0 0 1 0 1
12 0.0 40 0.0 0 0.0 0 1 0 1
40 0.0 5 0.0 0 0.0 0 1 0 1
3 0.0 40 0.0 0 0.0 0 1 0 1
6 0.0 40 0.0 2 1.0 0 1 0 1
12 0.0 60 0.0 3 1.0 0 1 0 1
3 0.0 30 0.0 1 1.0 0 1 0 1
150 0.0 60 0.0 4 1.0 0 1 0 1
40 0.0 2 1.0 3 1.0 0 1 0 1
3 0.0 2 1.0 2 1.0 0 1 1 1
8 0.6 40 0.0 60 0.0 0 1 0 1
5 0.3 30 0.0 5 0.0 0 1 0 1
2 1.0 60 0.0 2 1.0 0 1 0 1
3 1.0 2 1.0 3 1.0 0 1 0 1
4 1.0 3 1.0 0 0.0 0 1 0 1
5 0.9 50 0.0 6 1.0 0 1 0 1
1 1.0 0 0.0 1 1.0 0 0 0 0
2 1.0 1 1.0 2 1.0 0 0 0 0
2 1.0 2 1.0 30 0.0 0 0 0 0
6 0.8 3 1.0 5 1.0 0 0 0 0
20 0.8 5 1.0 20 0.9 0 0 0 0
30 0.6 10 1.0 5 1.0 0 0 0 0
5 0.0 2 1.0 3 1.0 0 0 0 0
8 0.0 3 1.0 2 1.0 0 0 0 0
4 0.0 0 0.0 3 1.0 0 0 0 0
7 0.0 4 0.5 0 0.0 0 0 0 0
6 0.0 5 0.0 0 0.0 0 0 0 0
6 0.0 40 0.0 0 0.0 0 0 0 0
3 0.0 3 1.0 4 0.0 0 0 0 0
9 0.5 60 0.0 3 1.0 0 0 0 0
40 0.0 6 0.0 60 0.0 0 0 0 1
60 0.0 40 0.0 30 0.0 0 0 0 1
90 0.1 60 0.0 50 0.0 0 0 0 1
30 0.0 90 0.0 6 0.0 0 0 0 1
25 0.0 60 0.0 3 1.0 0 0 0 1
25 0.1 3 1.0 60 0.0 0 0 0 1
12 0.0 60 0.0 50 0.0 0 0 0 1
6 0.0 70 0.0 80 0.0 0 0 0 1
150 0.0 0 0.0 0 0.0 0 0 0 1
200 0.0 2 1.0 6 0.0 0 0 0 1
45 0.2 50 0.0 40 0.1 0 0 0 1
4 0.0 4 0.0 47 0.0 0 0 0 1
2 0.0 50 0.0 60 0.0 0 0 0 1
1 0.0 80 0.0 40 0.0 0 0 0 1
3 0.0 9 0.0 80 0.0 0 0 0 1
60 0.0 90 0.0 2 1.0 0 0 0 1
45 0.1 30 0.0 1 1.0 0 0 0 1
90 0.0 2 1.0 2 1.0 0 0 0 1
90 0.0 60 0.0 0 0.0 0 0 0 1
30 0.0 40 0.0 0 0.0 0 0 0 1
40 0.0 2 1.0 3 0.0 0 0 0 1
2 0.0 2 1.0 40 0.0 0 0 1 1
3 0.0 1 1.0 4 0.0 0 0 1 1
1 0.0 2 1.0 25 0.0 0 0 1 1
5 0.0 3 1.0 50 0.0 0 0 1 1
7 0.0 0 0.0 60 0.0 0 0 1 1
4 0.0 60 0.0 70 0.0 0 0 1 1
2 0.0 40 0.0 30 0.0 0 0 1 1
3 0.0 30 0.0 2 1.0 0 0 1 0
2 0.0 2 1.0 2 1.0 0 0 1 0
4 0.5 3 1.0 5 1.0 0 0 1 0
"""
NAMES_OF_FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "heading"]


#: Unlinked words in one element's own blocks that make it an article without a name.
COMPANY = 40


class Tree:
    """A CART decision tree by Gini impurity, grown until its leaves are pure or depth or size stop it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.nodes: list[tuple[int, float, int, int, float]] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at, p = len(self.nodes), float(y.mean())
        self.nodes.append((-1, 0.0, 0, 0, p))
        best = (2 * p * (1 - p) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]) if depth and 0 < p < 1 else ():
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least)
            pl, pr = c[:-1] / n, (c[-1] - c[:-1]) / (len(v) - n)
            gini = np.where(ok, (n * 2 * pl * (1 - pl) + (len(v) - n) * 2 * pr * (1 - pr)) / len(v), 9)
            if len(gini) and gini.min() < best[0]:
                k = int(gini.argmin())
                best = (float(gini[k]), f, float(v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            a, b = self._grow(x[left], y[left], depth - 1, least), self._grow(x[~left], y[~left], depth - 1, least)
            self.nodes[at] = (best[1], best[2], a, b, p)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        feature, cut, left, right, p = (np.array(c) for c in zip(*self.nodes))
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            n = at[i]
            at[i] = np.where(x[i, feature[n]] <= cut[n], left[n], right[n])
        return p[at] >= 0.5


def trained() -> Tree:
    t = np.array([line.split() for line in LABELLED.split("\n") if line], dtype=float)
    return Tree(t[:, :-1], t[:, -1])


def _furniture(part: str) -> bool:
    return part in NAMES or part.startswith(STEMS)


def _named(attrs: str) -> tuple[bool, bool, bool]:
    """Whether the attributes name furniture, whether they name the article, and whether they name a header."""
    furniture = article = header = False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), CAMEL.sub("-", (m[2] or "").strip("\"'")).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            furniture = True
        elif key == "style":
            furniture |= bool(HIDDEN.search(value))
        elif key in ("class", "id", "role"):
            layout = not LAYOUTS.isdisjoint(NAME.findall(value))
            for name in value.split():
                parts = NAME.findall(name)
                good = not ARTICLE_NAMES.isdisjoint(parts)
                article |= good
                header |= not good and not HEADERS.isdisjoint(parts)
                if layout:
                    parts = [p for p in parts if p not in SIDES]
                others = [p for p in parts if not _furniture(p) and p not in NEUTRAL and p not in LAYOUTS and not p.isdigit()]
                furniture |= any(map(_furniture, parts)) and (not others or parts[-1] in NOUNS)
    return furniture, article and not furniture, header


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Text blocks in page order: text, words, words in links, in furniture, in the article, heading."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open containers: tag, furniture, article, both inherited; number
    holders: list[int] = []
    unlinked: dict[int, int] = {}
    depth: dict[str, int] = {}  # open containers of each tag
    unended: set[str] = set()  # tags with raw content whose end does not come any more
    opened = 0
    parts: list[str] = []
    linked: list[str] = []
    leaf = ("", False)  # the open paragraph, heading or item, and whether it is named as furniture
    in_link = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            if words := entities.unescape("".join(parts)).split():
                _, furniture, article, holder = stack[-1] if stack else ("", False, False, 0)
                n = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                holders.append(holder)
                if not furniture and not leaf[1]:
                    unlinked[holder] = unlinked.get(holder, 0) + max(0, len(words) - n)
                out.append((" ".join(words), len(words), min(n, len(words)), furniture or leaf[1], article, leaf[0][:1] == "h" and leaf[0] != "hr"))
            parts, linked = [], []

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                parts.append(page[m.start() + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
            continue
        ends = bool(m["end"] or m["end2"])
        if tag in RAW:
            if not ends and not (m["attrs"] or m["attrs2"] or "").endswith("/"):
                stop = None if tag in unended else RAW_END[tag].search(page, at)
                if not stop:
                    unended.add(tag)
                at = stop.end() if stop else at if tag == "head" else end
            parts.append(" ")
        elif tag == "a":
            in_link = not ends
        elif tag in ("br", "wbr", "img", "input"):
            parts.append(" " if tag != "wbr" else "")
        elif tag in BLOCK:
            close()
            if ends:
                in_link = False
            if tag in LEAF:
                leaf = ("", False) if ends else (tag, _named(m["attrs"] or m["attrs2"] or "")[0])
            elif ends:
                leaf = ("", False)
                while depth.get(tag):  # an end tag without its start closes nothing; others close what is open inside
                    last = stack.pop()[0]
                    depth[last] -= 1
                    if last == tag:
                        break
            else:
                leaf = ("", False)
                _, furniture, article, _ = stack[-1] if stack else ("", False, False, 0)
                opened += 1
                named, good, header = _named(m["attrs"] or m["attrs2"] or "")
                if tag in ("body", "html"):
                    named = good = header = False
                if tag == "main":
                    furniture = False
                furniture |= named or tag in FURNITURE or (header or tag == "header") and not article
                depth[tag] = depth.get(tag, 0) + 1
                stack.append((tag, furniture, article or (good or tag in ARTICLE) and not furniture, opened))
    close()
    return [b if b[4] or b[3] or unlinked.get(h, 0) < COMPANY else (*b[:4], True, b[5]) for b, h in zip(out, holders)]


def features(found: list[tuple[str, int, int, bool, bool, bool]]) -> np.ndarray:
    """One row a block, by NAMES_OF_FEATURES."""
    if not found:
        return np.zeros((0, len(NAMES_OF_FEATURES)))
    words = np.array([b[1] for b in found], dtype=float)
    links = np.array([b[2] for b in found], dtype=float) / words
    before = lambda v: np.concatenate([[0.0], v[:-1]])
    after = lambda v: np.concatenate([v[1:], [0.0]])
    marks = np.array([b[3:6] for b in found], dtype=float)
    return np.column_stack([words, links, before(words), before(links), after(words), after(links), marks])


def main_text(page: str, tree: Tree) -> tuple[str, int, int]:
    """The main text, and how many blocks there were and stayed."""
    found = blocks(page)
    keep = tree.predict(features(found))
    kept = [b[0] for b, k in zip(found, keep) if k]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars, n_blocks and n_main for every row of pages.

    Null html is an empty page; repeated rows give repeated rows; an empty table an empty result; a very long page is read whole, in
    linear time; a block for which a leaf of the tree has as many examples for as against is kept; columns beside page_id, url
    and html are not read. Each row is read alone, so there is no shuffle.
    """
    tree = trained()

    def run(batches):
        for b in batches:
            got = [main_text(h or "", tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
            )

    src = pages.select("page_id", "url", F.col("html"))
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_main long")
