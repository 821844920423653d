"""Main text of web pages from the standard library's streaming parser.

Parser events build lines (blocks of text) with the count of tags met in each. The text-to-tag
ratios along the page are smoothed with a Gaussian and split in two clusters by a threshold; the lines of the upper one are content,
and regions are chosen by how much content they hold.

What the markup says of itself is evidence only. An element that calls itself a menu, header, footer, sidebar, notice, advert, form or comment is
left out, unless nearly all content lies in it: those are taken back in, the fullest first, as long as one holds nine times what is kept beside it. So a page whose
text lies in such an element as a whole keeps it, however short it is. Inside an article, names that articles use too (a menu, what one shares) leave sentences alone.
Of what is left, the article elements that hold content are the region; without any, it is the
innermost container of nearly all content, and beside it headings, paragraphs and further lines of content, but for a last line of copyright.

Time and memory grow with the page, however deep its elements are nested: elements know their parent, and what they hold is a range of blocks.
"""

from __future__ import annotations

import heapq
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from . import textcore as T

# HTML elements by role.
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Hold no text of the page.
_CODE = frozenset("applet audio canvas datalist frameset annotation annotation-xml head iframe map noembed noframes noscript object optgroup option script select style svg template textarea title video".split())
#: Say that they aren't main text.
_OTHER = frozenset("aside button dialog footer form header menu nav search".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Not containers: an end tag that is missing ends with the next block.
_LOOSE = frozenset("p li dt dd tr td th tbody thead tfoot option optgroup h1 h2 h3 h4 h5 h6 caption legend summary figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | frozenset("p blockquote pre figcaption".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promoted promotion recommended recommendations related replies reply respond responses share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser toc toolbar topbar widget widgets".split()
)
#: Names that articles use for parts of their own.
_SHY = frozenset("menu menus share sharing social toc".split())
#: Words that add nothing to a name: "share-buttons" is a name of its kind, "share-price" isn't.
_PLAIN = frozenset("area articles bar block body bottom box btn button buttons center col column container content desktop fixed form global group icon icons inner item items layout left level links list main menu message mobile module notice outer page panel post posts primary right secondary section site slot sticky sub template text thread title top unit wrap wrapper".split())
#: Readers' texts and pointers to other pages: long ones don't make them the main text beside another.
_FOREIGN = re.compile(r"comment|repl(?:y|ies)|respon|discuss|disqus|related|recommend|promo|teaser|sponsor|advert")
#: Parts of names that are enough where words are written together.
_JOINED = re.compile(r"^(?:\w*(?:cookie|advert|sidebar|newsletter|breadcrumb|sponsor|popup|navbar|disqus)\w*|comments?\w{4,}(?<!ary)(?<!aries)|\w+(?:nav|menu|footer|header))$")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COPYRIGHT = re.compile(r"(?:©|\(c\)\s|copyright\b).{0,80}\b(?:19|20)\d\d\b", re.I)
#: Five words or more, and an end.
_SENTENCE = re.compile(r"(?:\S+\s+){4}.*[.!?…][\"'”’»)\]]*$")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names_other(name: str) -> bool:
    """Whether one class or id names a part that isn't main text: some word does, and the others add nothing."""
    words = [x for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if x]
    said = [x in _NAMES or bool(_JOINED.match(x)) for x in words]
    return any(said) and all(ok or x in _PLAIN or len(x) == 1 for ok, x in zip(said, words, strict=True))


def _is_other(tag: str, attrs: dict) -> bool:
    """Whether an element says that it isn't main text."""
    if tag in _OTHER or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or (attrs.get("role") or "").lower() in _ROLES:
        return True
    if _HIDDEN.search(attrs.get("style") or ""):
        return True
    return any(_names_other(x) for k in ("class", "id") for x in (attrs.get(k) or "").split())


def _is_shy(tag: str, attrs: dict) -> bool:
    """Whether only a name that articles use too says that an element isn't main text."""
    if tag in _OTHER or (attrs.get("role") or "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") or attrs.get("style"):
        return False
    said = [x for k in ("class", "id") for x in (attrs.get(k) or "").split() if _names_other(x)]
    return bool(said) and all(w in _SHY or w in _PLAIN or len(w) < 2 for x in said for w in _SPLIT.split(_CAMEL.sub("-", x).lower()))


class Container:
    """An element: what it says of itself, the nearest one around it that says it is something else, and the range of blocks that it holds."""

    __slots__ = ("article", "barred", "first", "foreign", "in_article", "last", "other", "shy", "tagged", "up")

    def __init__(self, tag: str, attrs: dict, first: int, number: int, up: int, around: Container | None):
        self.first, self.last, self.up = first, -1, up
        self.in_article = around is not None and (around.article or around.in_article)
        self.other = _is_other(tag, attrs) and not (tag == "header" and self.in_article)  # of an article: its own title
        self.shy = self.other and self.in_article and _is_shy(tag, attrs)
        self.tagged = tag in _OTHER and tag != "form"
        self.foreign = self.other and bool(_FOREIGN.search(f"{attrs.get('class')} {attrs.get('id')}".lower()))
        self.article = not self.other and (tag in ("article", "main") or (attrs.get("role") or "").lower() == "main" or (attrs.get("itemprop") or "") == "articleBody")
        # The innermost element around a block, or this one, that says it isn't main text; -1: none.
        self.barred = number if self.other else around.barred if around is not None else -1


class Blocks(HTMLParser):
    """Collects blocks as (text, tags, container, share of link text, tag); code is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag, container (-1: code)
        self.named: dict[str, int] = {}  # how many are open
        self.at = -1
        self.code = 0
        self.tags = 0
        self.links = self.linked = 0
        self.within = ""
        self.parts: list[str] = []
        self.blocks: list[tuple[str, int, int, float, str]] = []
        self.containers: list[Container] = []

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.tags, self.at, self.linked / len(text), self.within))
            self.parts = []
            self.tags = self.linked = 0
        self.within = ""

    def _open(self, tag: str, container: int) -> None:
        self.open.append((tag, container))
        self.named[tag] = self.named.get(tag, 0) + 1

    def _pop(self) -> None:
        tag, container = self.open.pop()
        self.named[tag] -= 1
        if container < 0:
            self.code -= 1
        else:
            self.end_block()
            self.containers[container].last = len(self.blocks)
            self.at = self.containers[container].up

    def _push(self, tag: str, attrs: dict) -> None:
        self.end_block()
        number = len(self.containers)
        self.containers.append(Container(tag, attrs, len(self.blocks), number, self.at, self.containers[self.at] if self.at >= 0 else None))
        self._open(tag, number)
        self.at = number

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            if not self.code:
                self.parts.append("\n")
            return
        if self.open and self.open[-1][0] == "head" and tag not in _IN_HEAD:
            self._pop()
        if tag in _BLOCK:
            self.end_block()
        if tag in _VOID:
            return
        if tag == "a":
            self.links = 1  # links don't nest
        if tag in _CODE:
            self._open(tag, -1)
            self.code += 1
            return
        given = dict(attrs)
        if tag in _LOOSE:
            # Of these, only parts that say they are something else are followed, until their own end or that of what holds them.
            while self.open and self.open[-1][0] == tag:
                self._pop()
            if _is_other(tag, given):
                self._push(tag, given)
        elif tag in _BLOCK or _is_other(tag, given):
            self._push(tag, given)
        if tag in _PROSE:
            self.within = tag

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # A slash at the end of a start tag has no meaning but for elements that are void anyway.
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag in _BLOCK:
            self.end_block()
        if self.named.get(tag):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.code:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.end_block()
        while self.open:
            self._pop()


def smoothed_ratios(sizes: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Text-to-tag ratios of successive lines, smoothed with a Gaussian of `sigma` lines."""
    ratio = sizes / np.maximum(tags, 1)
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratio, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_threshold(ratios: np.ndarray) -> float:
    """Splits lines in two clusters, by Otsu's threshold on the logarithm of their ratios: those above it are content. Equal ratios are one cluster, of content."""
    s = np.sort(np.log1p(ratios))
    if s[0] == s[-1]:
        return -1.0
    n = np.arange(1, len(s))
    left = np.cumsum(s)[:-1]
    between = n * (len(s) - n) * (left / n - (s.sum() - left) / (len(s) - n)) ** 2
    between[s[1:] == s[:-1]] = -1
    return float(np.expm1(s[int(np.argmax(between))]))


def _content(blocks: list) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are content by the clusters of their smoothed ratios, and which by their own ratio alone; a line that is all links isn't."""
    sizes, tags, links = (np.array([b[k] if k else len(b[0]) for b in blocks]) for k in (0, 1, 3))
    ratios = smoothed_ratios(sizes, tags)
    cut = content_threshold(ratios)
    # A little room, since the threshold is one of the values.
    return (ratios > cut * (1 + 1e-9)) & (links < 0.9), (sizes / np.maximum(tags, 1) > cut) & (links < 0.9)


def _kept(blocks: list, containers: list[Container]) -> np.ndarray:
    """Which blocks stay when elements that say they are something else go, but for those that hold nearly all content."""
    barred = np.array([containers[c].barred if c >= 0 else -1 for _, _, c, _, _ in blocks])
    if (barred < 0).all():
        return barred < 0
    content = _content(blocks)[0]
    sizes = np.array([len(t) for t, *_ in blocks])
    links = np.array([b[3] for b in blocks])
    heads = np.array([b[4] in _HEADINGS for b in blocks])
    # Inside an article a sentence is the article's, if only a shy name speaks against it.
    for k in np.flatnonzero((links < 0.5) & (barred >= 0)).tolist():
        c = containers[barred[k]]
        if c.shy and _SENTENCE.search(blocks[k][0]):
            barred[k] = containers[c.up].barred if c.up >= 0 else -1
    # Lists of links take nothing back in, nor do bare words of an element that is a menu or the like by its tag.
    bare = np.array([b >= 0 and containers[b].tagged and blocks[k][4] not in _PROSE for k, b in enumerate(barred.tolist())])
    size = sizes * content * (links < 0.5) * ~bare
    # What stands beside an element: any text but links and headings.
    beside = sizes * (links < 0.9) * ~heads
    in_article = np.array([c >= 0 and (containers[c].article or containers[c].in_article) for _, _, c, _, _ in blocks])
    # With articles, only what they hold counts.
    if (beside * in_article).any():
        size, beside, heads = size * in_article, beside * in_article, heads & in_article
    total = np.append(0, np.cumsum(size))
    free = barred < 0
    outside, titles = int(beside[free].sum()), int(sizes[free & heads].sum())
    direct = np.bincount(barred[~free], beside[~free], minlength=len(containers)).astype(int)  # by the innermost element that bars it
    inner: dict[int, list[int]] = {}
    for i, c in enumerate(containers):
        if c.other:
            inner.setdefault(containers[c.up].barred if c.up >= 0 else -1, []).append(i)
    # The fullest first; readers' texts and pointers to other pages last.
    waiting: list[tuple[bool, int, int]] = []
    forgiven = np.zeros(len(containers), bool)

    def consider(those: list[int]) -> None:
        for i in those:
            heapq.heappush(waiting, (containers[i].foreign, -int(total[containers[i].last] - total[containers[i].first]), i))

    consider(inner.get(-1, []))
    while waiting:
        foreign, inside, i = heapq.heappop(waiting)
        if -inside <= max(9 * outside, titles) or (foreign and outside):
            continue
        forgiven[i] = True
        outside += int(direct[i])
        consider(inner.get(i, []))
    return free | forgiven[barred]


def extract_text(html: str | None) -> str:
    """The blocks of the content region, in page order, joined by an empty line."""
    if not html:
        return ""
    p = Blocks()
    try:
        p.feed(html)
        p.close()
    except AssertionError:  # the parser's way to give up on broken declarations: read on without them
        p = Blocks()
        p.feed(html.replace("<![", "&lt;!["))
        p.close()
    if not p.blocks:
        return ""
    kept = _kept(p.blocks, p.containers)
    if not kept.any():
        return ""
    at = np.flatnonzero(kept)
    blocks = [p.blocks[k] for k in at.tolist()]
    sizes = np.array([len(t) for t, *_ in blocks])
    links, prose = np.array([b[3] for b in blocks]), np.array([b[4] in _PROSE for b in blocks])
    content, alone = _content(blocks)
    # Of each container: its range among these blocks, and how much content lies there.
    first, last = (np.searchsorted(at, [getattr(c, end) for c in p.containers]) for end in ("first", "last"))
    total = np.append(0, np.cumsum(sizes * content))
    weight = total[last] - total[first]
    # All articles of a text in parts that hold content, or all there are if none does.
    articles = np.flatnonzero([c.article for c in p.containers])
    articles = articles[last[articles] > first[articles]]
    articles = articles[weight[articles] > 0] if (weight[articles] > 0).any() else articles
    if len(articles):
        cover = np.zeros(len(blocks) + 1, int)
        np.add.at(cover, first[articles], 1)
        np.add.at(cover, last[articles], -1)
        return "\n\n".join(blocks[k][0] for k in np.flatnonzero(np.cumsum(cover)[:-1]).tolist())
    if not content.any():
        return "\n\n".join(b[0] for b in blocks if b[3] < 0.9)
    # Inside the innermost container of nearly all content only menus that don't say so are left out. Beside it stand headings and leads,
    # but also lines of menus, notices and footers, which have no name here: their low ratio tells them, without what smoothing adds to it.
    tight = np.flatnonzero(weight >= 0.95 * total[-1])  # containers are numbered as they open: the largest is innermost
    inside = np.ones(len(blocks), bool)
    if len(tight):
        inside = (np.arange(len(blocks)) >= first[tight[-1]]) & (np.arange(len(blocks)) < last[tight[-1]])
    chosen = np.flatnonzero((links < 0.9) & (inside | alone | prose)).tolist()
    while len(chosen) > 1 and _COPYRIGHT.match(blocks[chosen[-1]][0]):
        chosen.pop()
    return "\n\n".join(blocks[k][0] for k in chosen)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Adds `text`, the main text, to `pages`; a column of that name in the input gives way.

    Character references are decoded; inside a block white space becomes one space, at its ends none;
    blocks are joined in page order by two line feeds. A null or empty page, or one without main text, gives an
    empty text. Each page is read on its own, so repeated rows and null keys do no harm.
    """
    pages = pages.drop("text")
    schema = S.StructType([*pages.schema.fields, S.StructField("text", S.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            html = batch.column(batch.schema.get_field_index("html"))
            size = T.column_bytes(html)
            for at, end in T.slices(size, 4 << 20):
                part = batch.slice(at, end - at)
                made = [extract_text(x).encode("utf-8", "replace") for x in html.slice(at, end - at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(T.as_type(c, f.type) for c, f in zip(part.columns, arrow, strict=False)), pa.array(made, pa.binary()).cast(pa.string())], schema=arrow)

    return pages.mapInArrow(run, schema)
