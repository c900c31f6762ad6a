"""Main-text extraction from HTML by tag-path ratios (operator 2).

A page is read into elements and text nodes (tolerant of unclosed tags). Every text node has a
root-to-leaf tag path (tags with their first class). Per path the text length, the punctuation and the
linked characters are summed over its nodes; the path ratio is text per node x punctuation per node x
unlinked share. The ratios are laid over the nodes in page order, smoothed with a Gaussian, fused with
the raw ratio, and thresholded by their standard deviation: nodes above are content nodes. The main
region is the deepest container that holds most of the content nodes' text, up to an article or main
element; outside these the parts beside it that hold content nodes belong to it too. Its blocks, without
boilerplate subtrees (navigation, forms, adverts, comments, ...) and link lists outside an article, are
the main text.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by a blank line. Nothing else is dropped or capped. Each page is handled by itself, so neither
hot hosts nor copies matter.

Edge cases: NULL or empty html, pages without text and pages of boilerplate only give "" and 0; text
without any tag is one block; very long pages take linear time; repeated rows give repeated results;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
#: Elements that never hold article text.
DROPPED = RAW | frozenset("""head nav footer aside form button select svg canvas object applet audio video
menu dialog input label fieldset map datalist math search""".split())
#: Roles of boilerplate regions.
ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu menubar
toolbar form note""".split())
#: Parts of class and id names that mark boilerplate.
CUES = frozenset("""ad ads adv advert advertisement advertising adbox adslot sponsor sponsored promo promotion
banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget comment comments commentlist
reply replies respond discussion disqus footer header masthead cookie cookies consent gdpr notice notices
notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing
related recommended recommendations toc pager pagination paging skip tags taglist byline hidden""".split())
#: Start tags that end an open element of the same family.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
         "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
           "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt address figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Page:
    """Elements (parent, tag, name, dropped) and text nodes (element, text, block number) of one page."""

    def __init__(self, html: str):
        self.parent = [-1]
        self.tag = ["#root"]
        self.name = ["#root"]
        self.cue = [False]
        self.texts: list[tuple[int, str, int]] = []
        self._read(html)

    def _open(self, stack: list[int], tag: str, attributes: str) -> int:
        at = len(self.tag)
        first, cue = "", False
        if attributes.strip(" /\t\r\n"):
            for m in _ATTRIBUTE.finditer(attributes):
                key = (m[1] or m[5]).lower()
                value = m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    parts = {p for w in value.split() for p in _NAME_PARTS.split(w.lower()) if p}
                    cue |= not CUES.isdisjoint(parts)
                    if key == "class" and value.split():
                        first = "." + value.split()[0]
                elif key == "role":
                    cue |= value.lower() in ROLES
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    cue = True
                elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    cue = True
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.name.append(tag + first)
        self.cue.append(cue and tag not in ("html", "body", "main", "article"))
        return at

    def _read(self, html: str) -> None:
        stack, block, pos, n = [0], 0, 0, len(html)
        tag_of, texts = self.tag, self.texts
        lowered: str | None = None
        while pos < n:
            m = _TOKEN.search(html, pos)
            if m is None:
                texts.append((stack[-1], html[pos:], block))
                break
            if m.start() > pos:
                texts.append((stack[-1], html[pos:m.start()], block))
            pos = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCKS:
                    block += 1
                for k in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[k]] == tag:
                        del stack[k:]
                        break
                    # an inline end tag does not close blocks around it
                    if tag not in BLOCKS and tag_of[stack[k]] in BLOCKS:
                        break
                continue
            if tag in BLOCKS:
                block += 1
                if tag not in ("td", "th", "tr", "option"):
                    for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                        if tag_of[stack[k]] == "p":
                            del stack[k:]
                            break
                        if tag_of[stack[k]] in BLOCKS:
                            break
                ends = _ENDS.get(tag)
                if ends:
                    for k in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[k]] in _SCOPES[tag]:
                            break
                        if tag_of[stack[k]] in ends:
                            del stack[k:]
            if tag == "br":
                texts.append((stack[-1], " ", block))
            if tag in VOID:
                continue
            attributes = m[3] or ""
            at = self._open(stack, tag, attributes)
            if tag in RAW:
                if lowered is None:
                    lowered = html.lower() if len(html.lower()) == n else html
                end = lowered.find("</" + tag, pos)
                if end < 0:
                    break
                close = html.find(">", end)
                pos = n if close < 0 else close + 1
                continue
            if not attributes.endswith("/") or tag in BLOCKS:
                stack.append(at)


def _smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    padded = np.concatenate([np.zeros(2), values, np.zeros(2)])
    weight = np.convolve(np.concatenate([np.zeros(2), np.ones(len(values)), np.zeros(2)]), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    parent, tag, n = page.parent, page.tag, len(page.tag)
    # which elements hold a heading of the article: cues do not drop those that hold the article itself
    holds = [t in ("article", "main") for t in tag]
    for e in range(n - 1, 0, -1):
        if holds[e]:
            holds[parent[e]] = True
    dropped, linked, inside = [False] * n, [False] * n, [False] * n
    path = [""] * n
    for e in range(1, n):
        p, t = parent[e], tag[e]
        inside[e] = inside[p] or t in ("article", "main")
        mark = t in DROPPED or page.cue[e] or t == "header"
        if mark and holds[e] and t not in ("head", "form"):
            mark = False
        if t == "header" and inside[p] and not page.cue[e]:
            mark = False  # the article's own header: its headings count
        if t in _HEADINGS and tag[p] == "hgroup":
            mark = False
        dropped[e] = dropped[p] or mark
        linked[e] = linked[p] or t == "a"
        path[e] = path[p] + "/" + page.name[e]
        if t not in _HEADINGS and tag[p] == "header" and inside[p]:
            dropped[e] = True
    nodes = [(e, text, block) for e, text, block in page.texts if not dropped[e] and text and not text.isspace()]
    if not nodes:
        return ""
    length = np.array([len(text) for _, text, _ in nodes], float)
    marks = np.array([len(_PUNCTUATION.findall(text)) for _, text, _ in nodes], float)
    link = np.array([linked[e] for e, _, _ in nodes], float) * length
    names: dict[str, int] = {}
    of = np.array([names.setdefault(path[e], len(names)) for e, _, _ in nodes])
    count = np.bincount(of)
    total = np.bincount(of, length)
    ratio = (total / count) * (np.bincount(of, marks) / count + 0.1) * (1 - np.bincount(of, link) / total)
    raw = ratio[of]
    fused = np.sqrt(raw * _smooth(raw))
    content = fused >= min(fused.std(), fused.max())
    weight = np.zeros(n)
    np.add.at(weight, [e for e, _, _ in nodes], length * content)
    children: list[list[int]] = [[] for _ in range(n)]
    for e in range(n - 1, 0, -1):
        weight[parent[e]] += weight[e]
        children[parent[e]].append(e)
    blocky = [False] * n
    for e in range(n - 1, 0, -1):
        if tag[e] in BLOCKS:
            blocky[parent[e]] = True
        elif blocky[e]:
            blocky[parent[e]] = True
    region, above = 0, [False] * n
    while tag[region] not in ("article", "main"):
        best = max(children[region], key=lambda e: (weight[e], -e), default=None)
        if best is None or weight[best] < 0.7 * weight[region] or tag[best] in _LEAVES or not blocky[best]:
            break
        above[region] = True
        region = best
    within = [False] * n
    whole = tag[region] in ("article", "main")
    for e in range(n):
        within[e] = e == region or (e > 0 and within[parent[e]])
        # a part beside the region's way down that holds content nodes
        within[e] |= not whole and e > 0 and above[parent[e]] and not above[e] and weight[e] > 0
    loose = set() if whole else {(e, block) for (e, _, block), c in zip(nodes, content) if c and above[e]}
    anchor = [0] * n
    for e in range(1, n):
        anchor[e] = e if tag[e] == "a" else anchor[parent[e]]
    # blocks of the region, in page order
    out: list[str] = []
    parts: list[str] = []
    chars = links = 0
    last = None
    held: list[str] = []  # link blocks in a row outside an article
    anchors: set[int] = set()

    def release() -> None:
        # several links only, in one block or in blocks in a row, are a link list; a single one is not
        if listed < 2:
            out.extend(held)
        held.clear()

    def close() -> None:
        nonlocal listed
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if not text:
            return
        if links > 0.9 * chars and chars and not heading and not article:
            held.append(text)
            listed += len(anchors)
        else:
            release()
            listed = 0
            out.append(text)

    heading = article = False
    listed = 0
    for e, text, block in page.texts:
        if dropped[e] or not within[e] and (e, block) not in loose:
            continue
        if block != last:
            if parts:
                close()
            parts, chars, links, last, heading, article, anchors = [], 0, 0, block, False, inside[e], set()
        parts.append(text)
        size = len(text.strip())
        chars += size
        links += size if linked[e] else 0
        if size and linked[e]:
            anchors.add(anchor[e])
        up = e
        while up > 0 and tag[up] not in BLOCKS:
            up = parent[up]
        heading |= tag[up] in _HEADINGS
    if parts:
        close()
    release()
    return "\n\n".join(out)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row."""
    ready(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                        ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            html = batch.column(2)
            text = [main_text(h.as_py()) for h in html]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], schema=schema)

    return pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"),
                        pages["html"].cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
