"""Main text of web pages by tag-path ratios.

A page is parsed into text nodes, each with its root-to-leaf tag path. Text length and punctuation are summed per path
and divided by the path's nodes; both ratios are fused on a log scale, lowered by the path's share of links, and smoothed
along the page. The mean of a path decides for all its nodes, so a short paragraph stays with the long ones. The smallest
element around nearly all text of the paths above the threshold, or the article that this is part of, is the text's own
region: what stands outside isn't text, whatever its ratio. Inside, an article is taken whole, anything else from the
first such text to the last, with headings just before it.

What markup says only weighs: an element that is a menu, an advert or a comment by its tag, role or class has paths of
its own, whose ratios are halved, and inside the region it isn't added with the rest. Where such an element is a wrapper
of nearly all of the page's text, what it says is not believed. Time is linear in the page's length, at any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

_words = lambda text: frozenset(text.split())
BLOCKS = _words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Elements whose characters aren't shown as text.
NO_TEXT = _words("head title script style noscript template iframe object svg canvas select option textarea button audio video datalist")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: Elements, roles and words of a class or an id that say: this is not the article.
ASIDE = _words("nav footer aside form dialog menu")
ROLES = _words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
HINTS = _words(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup sidebar sidenav widget widgets related recommended recommendations comment comments commentlist disqus reply replies respond menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar pagination pager login hidden"
)
#: Words that say so of a bar or a box, but that also name what an article is about.
WEAK_HINTS = _words("notice notices notification alert share sharing social search skip")
#: After these a hint says something about another element, or about an article.
NEGATED = _words("with has no without not hide editor editors editorial author")
#: A name of two of these or more says: this is the article.
OWN = _words("article body content entry post story text main page blog news")
#: What a hint and a weak one multiply a path's ratio by.
HINTED, WEAKLY = 0.5, 0.8
#: A start tag closes these, up to the nearest of the second set.
IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
IMPLIED = {k: (_words(a), _words(b)) for k, (a, b) in IMPLIED.items()}
P_SCOPE = _words("div section article td th body li blockquote main aside header footer nav form button fieldset figure")
_P = frozenset(("p",))
#: A path is content if its smoothed ratio, a logarithm, is this part of the highest; smoothing raises it to this times its
#: own at most. Outside the region only what nothing speaks against and has this part of the highest ratio is content.
LEVEL, RAISED, ALONE = 0.6, 1.2, 0.95
#: Regions that are the whole page, and elements that are a piece of text and no region.
WHOLE = ("", "html", "body")
PIECES = HEADINGS | _words("p li dt dd pre td th tr blockquote figcaption caption summary hgroup header")
#: The region holds this part of the selected text. Hints on an element that holds the second part of all text aren't believed,
#: if it holds one of these elements, too, or the page has none.
MOST, REGION, MARKS = 0.65, 0.8, _words("h1 h2 article main")
_PUNCTUATION = re.compile(r"[,.;:!?。、，；：！？…]")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _hint(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> float:
    """What the element's markup multiplies its paths' ratios by."""
    names = [[w.lower() for w in _NAME.findall(part)] for name, value in attrs if name in ("class", "id") and value for part in value.split()]
    own = any(len(words) > 1 and OWN.issuperset(words) for words in names)
    if tag in ASIDE or tag == "header" and not in_article and not any(OWN & {*words} for words in names):
        return HINTED
    weight = 1.0
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return HINTED
        if name == "style" and value and _UNSEEN.search(value):
            return HINTED
    for words in [] if own else names:
        for i, w in enumerate(words):
            if (w in HINTS or w in WEAK_HINTS) and not NEGATED & {*words[:i]} and words[i : i + 2] != ["ad", "hoc"]:
                if w in HINTS:
                    return HINTED
                weight = WEAKLY
    return weight


class _Page(HTMLParser):
    """Text blocks in page order, and the elements they stand in; element 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.path, self.hint = [-1], [""], [0], [1.0]
        self.shown, self.article, self.block_of, self.at_article, self.linked = [True], [False], [0], [0], [False]
        self.paths: dict[tuple[int, str, float], int] = {}
        self.open, self.closed = [0], [False]  # a closed element below open ones waits for them
        self.places: dict[str, list[int]] = {}  # of each tag, where open elements of it are in `open`
        self.blocks: list[tuple[int, list[str]]] = []  # element, pieces of text
        self.nodes: list[tuple[int, int, int, int]] = []  # element, block, characters, punctuation
        self.fresh = True

    def _push(self, tag: str, attrs: list) -> None:
        up, e = self.open[-1], len(self.tag)
        article = tag in ("article", "main")
        hint = _hint(tag, attrs, self.article[up] or article)
        if self.tag[up] == "header" and self.article[up] and tag not in HEADINGS and tag != "hgroup":
            hint = HINTED
        self.parent.append(up)
        self.tag.append(tag)
        self.hint.append(hint)
        self.path.append(self.paths.setdefault((self.path[up], tag, hint), len(self.paths) + 1))
        self.shown.append(self.shown[up] and tag not in NO_TEXT)
        self.article.append(self.article[up] or article)
        self.at_article.append(e if article else self.at_article[up])
        self.linked.append(self.linked[up] or tag == "a")
        self.block_of.append(e if tag in BLOCKS else self.block_of[up])
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(e)
        self.closed.append(False)

    def _pop(self, to: int) -> None:
        """Close all from place `to` on, and what waited just below."""
        while len(self.open) > max(to, 1) or self.closed[-1]:
            if not self.closed.pop():
                self.places[self.tag[self.open[-1]]].pop()
            self.open.pop()

    def _last(self, tags: frozenset) -> int:
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=-1)

    def _close(self, tags: frozenset, scope: frozenset) -> None:
        at = self._last(tags)
        if at > self._last(scope):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.fresh = True
            if self.places.get("head"):
                self._pop(self.places["head"][-1])
            if self.places.get("p"):
                self._close(_P, P_SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag == "br":
            self.handle_data(" ")
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self.fresh = True
        places = self.places.get(tag)
        if not places:
            return
        if block or tag in NO_TEXT:
            if block and tag not in P_SCOPE and tag != "table" and self._last(_words("table body")) > places[-1]:
                return
            self._pop(places[-1])
        else:  # blocks that were opened inside stay open
            self.closed[places.pop()] = True
            self._pop(len(self.open))

    def handle_data(self, data: str) -> None:
        e = self.open[-1]
        if not self.shown[e]:
            return
        if self.fresh:
            if not data.strip():
                return
            self.blocks.append((self.block_of[e], []))
            self.fresh = False
        self.blocks[-1][1].append(data)
        if n := len("".join(data.split())):
            self.nodes.append((e, len(self.blocks) - 1, n, len(_PUNCTUATION.findall(data))))


def ratios(path: np.ndarray, chars: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Of each node its path's fused ratio: characters a node, times one and the marks of punctuation a node."""
    count = np.maximum(np.bincount(path), 1)
    return ((np.bincount(path, chars) / count) * (1 + np.bincount(path, marks) / count))[path]


def selected(path: np.ndarray, fused: np.ndarray) -> np.ndarray:
    """The nodes whose paths are text: by the mean over the path of the ratio smoothed along the page, a little above its
    own ratio at most."""
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = np.convolve(np.pad(fused, 2, mode="edge"), kernel / kernel.sum(), "valid")
    mean = (np.bincount(path, np.minimum(smooth, RAISED * fused)) / np.maximum(np.bincount(path), 1))[path]
    return mean >= LEVEL * mean.max()


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds; empty if there are none.

    A null or empty page, or one of markup only, gives an empty text. Unclosed elements end as browsers end them.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    if not page.nodes:
        return ""
    element, block, chars, marks = (np.array(x) for x in zip(*page.nodes, strict=True))
    size, tag = len(page.tag), page.tag
    held, marked = np.bincount(element, chars, size).tolist(), [t in MARKS for t in tag]
    for e in range(size - 1, 0, -1):
        held[page.parent[e]] += held[e]
        marked[page.parent[e]] |= marked[e]
    # what of the hints is believed, all the way down; how many elements above and at each one say such a thing
    weight, said = [1.0] * size, [0] * size
    for e in range(1, size):
        up = page.parent[e]
        believed = page.hint[e] < 1 and (held[e] < REGION * held[0] or marked[0] and not marked[e])
        weight[e], said[e] = weight[up] * (page.hint[e] if believed else 1.0), said[up] + believed
    path = np.array(page.path)[element]
    held_by = np.bincount(path, chars)
    plain = 1 - (np.bincount(path, chars * np.array(page.linked)[element]) / np.maximum(held_by, 1))[path]
    fused = np.log1p(ratios(path, chars, marks) * plain) * np.array(weight)[element]
    keep = selected(path, fused)
    # a few words of an article beside much that isn't: the article's
    hinted, inner = np.array(said)[element] > 0, np.array(page.at_article)[element] > 0
    if not (keep & ~hinted).any() and (inner & ~hinted).any():
        keep = inner & ~hinted
    doubtful = not (keep & ~hinted).any()

    # a path counts by all it holds: a paragraph among many more than one long footer
    inside = np.bincount(element, chars * keep * held_by[path] * np.array(weight)[element] ** 2, size).tolist()
    for e in range(size - 1, 0, -1):
        inside[page.parent[e]] += inside[e]
    region = max((e for e in range(size) if inside[e] >= MOST * inside[0] and (tag[e] in BLOCKS - PIECES and (doubtful or not said[e]) or e == 0)), default=0)
    lifted = page.at_article[region] or region
    own = {lifted} | {page.at_article[e] for e in element[keep].tolist()} - {0}
    # the text's own element around each one: the region, or an article that holds selected nodes
    around = [0 if 0 in own else -1] * size
    for e in range(1, size):
        around[e] = e if e in own else around[page.parent[e]]
    # inside the region all that nothing speaks against; if that is the whole page, from the first block of text to the last
    text, alone = {*block[keep].tolist()}, {*block[keep & (fused >= ALONE * fused.max())].tolist()}
    ends: dict[int, tuple[int, int]] = {}
    for k in sorted(text):
        a = around[page.blocks[k][0]]
        ends[a] = (ends.get(a, (k, k))[0], k)
    kept = []
    for k, (e, _) in enumerate(page.blocks):
        a = around[e]
        fits = a >= 0 and (tag[a] not in WHOLE or k in text or a in ends and ends[a][0] <= k <= ends[a][1])
        fits |= a < 0 and k in alone and not said[e]
        kept.append(fits and (said[e] == (said[a] if a >= 0 else 0) or k in text and (doubtful or tag[a] not in WHOLE)))
    for k in range(len(kept) - 2, -1, -1):
        e = page.blocks[k][0]
        kept[k] = kept[k] or kept[k + 1] and tag[e] in HEADINGS and said[e] <= said[page.blocks[k + 1][0]]
    texts = (" ".join("".join(pieces).split()) for (_, pieces), k in zip(page.blocks, kept, strict=True) if k)
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): page_id, url, text, n_chars. Further columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
