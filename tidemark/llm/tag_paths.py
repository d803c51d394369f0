"""Main text of web pages by tag-path ratios.

Every block of text hangs on a root-to-leaf path of tags. Per path, the length of text and the punctuation are
set against the number of blocks on it; both ratios are fused, smoothed over the blocks in page order, and
thresholded. The paths above the threshold select the content node: the article or main element around most of what
they hold, or else the container around all of it. What the contract names as no part of an article (menus,
headers, footers, sidebars, notices, adverts, forms, comments) is known by its tags, roles and whole words of its
names, and neither counts for the node nor comes with it.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACES = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

#: What these hold is no text of the page.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr map area".split())
#: A start tag of the key ends open elements of the values, up to the nearest container.
_P = {"p"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
CONTAINERS = set("body div section article main td center blockquote html".split())
#: A quotation is a part of an article, never the whole.
REGIONS = CONTAINERS - {"blockquote"}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
BOILER_TAGS = set("nav footer aside form button select dialog template svg canvas object menu head fieldset".split())
#: Tags of furniture that can stand around a whole page; the others never hold its text.
WRAPPERS = {"aside", "form", "object", "fieldset"}
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# Words of names that say that an element is no part of an article. MARKS do in any name that holds
# them; SIGNS only where the whole name is made of MARKS, SIGNS and FILLERS ("share-buttons", not "share-of-votes").
MARKS = set("nav navbar navigation sidebar footer masthead breadcrumb breadcrumbs advert adverts advertisement advertisements advertising adslot adbox sponsored comments cookie cookies gdpr newsletter pagination pager disqus taboola outbrain paywall".split())
SIGNS = set("ad ads banner menu side foot header modal overlay popup share sharing social login signin signup register subscribe search toolbar widget skip copyright comment reply replies respond consent privacy notice alert toast promo promoted sponsor related recommended recommendations discussion".split())
FILLERS = set("area bar block body bottom box button buttons col column container content form global group head holder icon icons id inner input items left link links list main module msg more news outer page panel policy posts primary right row secondary section site slot stories strip title to top tools unit wrap wrapper articles thread".split())
#: Words that say that an element stands around others of the name ("has-sidebar").
AROUND = set("has with no without".split())


class Element:
    """An open or closed element: its tag, parent, path, and whether its tag or names say that it is page furniture.

    Elements are numbered as they open, so those within one are the numbers from its own to its last.
    """

    __slots__ = ("tag", "parent", "flag", "never", "article", "at", "last", "path", "home", "weight")

    def __init__(self, tag: str, parent: Element | None, attributes: str, at: int, path: int):
        self.tag, self.parent, self.at, self.last, self.path = tag, parent, at, at, path
        self.weight = 0.0
        self.home: Element | None = self if tag in REGIONS else parent.home if parent else None
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        self.never = bool(parent and parent.never) or tag in BOILER_TAGS - WRAPPERS
        self.flag = tag in WRAPPERS or tag == "header" and not self.article
        if attributes and tag not in ("body", "html", "article", "main"):
            self.never = self.never or unseen(attributes)
            self.flag = self.flag or furniture(attributes, self.article)


def unseen(attributes: str) -> bool:
    """Whether attributes hide an element."""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "hidden" and attributes[m.start() - 1 : m.start()] in (" ", "\t", "\n") and attributes[m.end() : m.end() + 1] in ("", " ", "/"):
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def furniture(attributes: str, in_article: bool) -> bool:
    """Whether the names or the role of an element say that it is no part of an article."""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "role" and value.lower() in BOILER_ROLES:
            return True
        if key in ("class", "id") and any(_named(name, in_article) for name in value.split()):
            return True
    return False


def _named(name: str, in_article: bool) -> bool:
    """Whether one name says so, by its whole words."""
    parts = {w.lower() for w in _NAME.findall(name) if not w.isdigit()}
    if parts & AROUND:
        return False
    signs = parts & SIGNS - ({"header"} if in_article else set())
    return bool(parts & MARKS) or bool(signs) and parts <= MARKS | SIGNS | FILLERS


class Block:
    """A run of text that no block-level tag breaks."""

    __slots__ = ("at", "text", "linked", "path")

    def __init__(self, at: Element, text: str, linked: int, path: int):
        self.at, self.text, self.linked, self.path = at, text, linked, path


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of text of a page in page order, with references decoded and white space folded, and its elements."""
    out: list[Block] = []
    paths: dict[tuple[int, str], int] = {}  # a path is its parent's path and a tag
    root = Element("html", None, "", 0, 0)
    elements, stack = [root], [root]
    opened: dict[str, int] = {"html": 1}
    parts: list[str] = []
    linked, deepest = 0, root
    links = 0

    def flush() -> None:
        nonlocal parts, linked, deepest
        if parts:
            joined = "".join(parts)
            text = _SPACES.sub(" ", html.unescape(joined) if "&" in joined else joined).strip()
            if text:
                holder = deepest
                while holder.tag in INLINE and holder.parent:
                    holder = holder.parent
                out.append(Block(holder, text, linked, deepest.path))
        parts, linked, deepest = [], 0, stack[-1]

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            opened[e.tag] -= 1
            links -= e.tag == "a"
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            if not parts or deepest is root:
                deepest = stack[-1]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            if tag not in INLINE:
                deepest = stack[-1]
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        ended, scope = ENDS.get(tag, _P if tag in ENDS_P else None), SCOPES.get(tag, CONTAINERS)
        if ended and any(opened.get(t) for t in ended):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    close(k)
                    break
                if stack[k].tag in scope:
                    break
        if tag in VOID or attributes and attributes.rstrip().endswith("/") and tag not in CONTAINERS:
            continue
        path = paths.setdefault((stack[-1].path, tag), len(paths) + 1)
        stack.append(Element(tag, stack[-1], attributes, len(elements), path))
        elements.append(stack[-1])
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        if not parts:
            deepest = stack[-1]
    flush()
    for e in reversed(elements):
        if e.parent:
            e.parent.last = max(e.parent.last, e.last)
    return out, elements


def ratios(found: list[Block]) -> list[float]:
    """For each block, its path's fused ratio of text and punctuation to blocks, smoothed in page order."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in found:
        length[b.path] = length.get(b.path, 0) + len(b.text) - min(len(b.text), b.linked)
        marks[b.path] = marks.get(b.path, 0) + len(_PUNCTUATION.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
    fused = {p: length[p] / count[p] * math.log2(2 + marks[p] / count[p]) for p in count}
    raw = [fused[b.path] for b in found]
    kernel = (0.25, 0.5, 0.25)
    padded = [raw[0], *raw, raw[-1]] if raw else []
    return [sum(k * padded[i + j] for j, k in enumerate(kernel)) for i in range(len(raw))]


def _up(e: Element | None) -> Iterator[Element]:
    while e:
        yield e
        e = e.parent


def _weigh(elements: list[Element], weights: list[tuple[Block, float]]) -> float:
    """Set each element's weight to that of the blocks within it; their sum."""
    for e in elements:
        e.weight = 0.0
    for b, w in weights:
        b.at.weight += w
    for e in reversed(elements):
        if e.parent:
            e.parent.weight += e.weight
    return elements[0].weight


def candidates(seen: list[Block], elements: list[Element]) -> set[Block]:
    """The blocks that no furniture holds.

    The name of a wrapper doesn't count where it holds the page's article or main elements, or most of the text of the
    page or of the article around it; and no name does where they would leave nothing.
    """
    total = _weigh(elements, [(b, len(b.text) - min(len(b.text), b.linked)) for b in seen])
    flags = [0] * len(elements)
    for e in elements:
        flags[e.at] = e.flag + (flags[e.parent.at] if e.parent else 0)
    articles = {e: flags[e.at] for e in elements if e.tag in ("article", "main") and e.weight}
    fewest = min(articles.values(), default=0)
    least = {e for e, n in articles.items() if n == fewest}
    told = bool(least) and 10 * sum(e.weight for e in least) >= total  # by more than a comment or a teaser
    lifted = [False] * len(elements)
    if told:
        for e in least:
            lifted[e.at] = True
        for e in reversed(elements):
            if e.parent and lifted[e.at]:
                lifted[e.parent.at] = True
    around: list[Element | None] = [None] * len(elements)
    held = [False] * len(elements)
    for e in elements:
        around[e.at] = e if told and e in least else around[e.parent.at] if e.parent else None
        if e.flag and e.weight and not lifted[e.at]:
            home = around[e.at]
            lifted[e.at] = bool(home or not told) and 2 * e.weight > (home.weight if home else total)
        held[e.at] = e.flag and not lifted[e.at] or bool(e.parent) and held[e.parent.at]
    return {b for b in seen if not held[b.at.at]} or set(seen)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by an empty line; empty where there is none.

    Ratios and threshold come from all blocks that are shown. The paths above the threshold choose the content node,
    the container that holds what they select; blocks of furniture, by the tags and names of the contract's list, never
    count for it nor come with it. Short blocks of the content node (headings, list items) come with it.
    """
    found, elements = blocks(page or "")
    seen = [b for b in found if not b.at.never]
    if not seen:
        return ""
    values = ratios(seen)
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    least = max(0.0, min(mean, max(values) - spread / 2))
    fine = candidates(seen, elements)
    chosen = {b for b, v in zip(seen, values, strict=True) if v >= least and b in fine}
    if not chosen:  # only furniture passes: the best of the rest do
        best = max(v for b, v in zip(seen, values, strict=True) if b in fine)
        chosen = {b for b, v in zip(seen, values, strict=True) if b in fine and 2 * v >= best}
    found = [b for b in seen if b in fine]
    total = _weigh(elements, [(b, len(b.text) - min(len(b.text), b.linked) + 1) for b in chosen])
    depth = [0] * len(elements)
    for e in elements[1:]:
        depth[e.at] = depth[e.parent.at] + 1
    deepest = lambda among: max(among, key=lambda e: (depth[e.at], -e.at), default=None)
    core = region = deepest(e for e in elements if e.weight >= 0.6 * total and e.tag in REGIONS)
    for e in _up(region):  # an article or main element around it is the whole article
        if e.tag in ("article", "main"):
            region = e
            if e.tag == "article":
                break
    if region and region.tag not in ("article", "main"):
        core = region
        region = deepest(e for e in elements if e.tag in REGIONS and e.weight >= total - 1e-9)
        beside = _beside(region, found)
        if region and region.tag not in ("body", "html"):
            region = _with_heading(region, found)
    else:
        core, beside = region, set()
    passing = [i for i, b in enumerate(found) if b in chosen]
    inner = core is not None and core.tag not in ("body", "html")
    out = []
    for i, b in enumerate(found):
        if region is None or _within(b.at, region) or b in beside:
            article = _within(b.at, core) if inner else passing[0] <= i <= passing[-1]
            if article or not _link_list(b):
                out.append(b.text)
    return "\n\n".join(out)


def _beside(region: Element | None, found: list[Block]) -> set[Block]:
    """The paragraphs and headings that stand beside the region in the container around it, and are no links."""
    around = next((e for e in _up(region.parent) if e.tag in CONTAINERS), None) if region else None
    return {b for b in found if around and b.at.tag in PROSE and 2 * b.linked < len(b.text) and b.at.home is around}


def _within(e: Element, region: Element) -> bool:
    return region.at <= e.at <= region.last


def _with_heading(region: Element, found: list[Block]) -> Element:
    """The nearest container that adds nothing but headings to the region, or the region."""
    others = sorted(b.at.at for b in found if b.at.tag not in ("h1", "h2", "h3") and not _within(b.at, region))
    up = region.parent
    while up and up.tag in CONTAINERS and up.tag not in ("body", "html"):
        at = bisect_left(others, up.at)
        if at < len(others) and others[at] <= up.last:
            break
        region, up = up, up.parent
    return region


def _link_list(b: Block) -> bool:
    """Whether a block is a link in a list rather than text."""
    return b.at.tag in ("li", "ul", "ol") and b.linked >= 0.8 * len(b.text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id and url columns, text and n_chars (code points) for each row of pages.

    A null or empty page, and one without an article, has an empty text. Very long and very deep pages are taken
    whole, in time that grows with their length. Repeated rows are extracted each; an empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):  # texts pass in small pieces
                part = b.slice(at, 64)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    picked = pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    return picked.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
