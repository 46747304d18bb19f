"""HTML extraction (operator 2): composite text density.

Every page becomes a DOM. Each node has its characters per tag, adjusted for
the share of link characters and link tags below it; the density sum of a
node adds up its children. The node with the largest density sum leads the
main text; the smallest density on its path to the body is the threshold at
or above which other nodes count as main text too. The result is the smallest
subtree that holds the lead and all of them, so that headings and short lines
between dense blocks stay; blocks in it that are mostly links and below the
threshold are left out.

Elements that are never main text (menus, footers, side bars, forms, adverts,
notices, reader comments, hidden and script-like elements) are cut from the
tree before any density is computed, but not where they hold the page: an
article or main that no other outweighs, or nearly all text outside links (a
page in one form). Where a page has ``article`` or ``main`` elements, the
lead is sought in them and the subtree ends at the one that holds it.

Pages are rows: nothing is shuffled or gathered, and a lost task costs its
own pages only. Defined results: null or empty pages and pages without main
text give an empty text; repeated rows are returned as often; truncated
markup is read as far as it goes; other columns are not read.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>|[^>]*>)", re.S)
UNENDED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
#: An open element of the first kind ends where one of the second kind starts.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
SCOPE = frozenset("html body article main section div ul ol dl table td th blockquote aside nav header footer form".split())
CUT_TAGS = frozenset("head nav footer aside form button select option input label dialog menu object canvas audio video".split()) | RAW
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail masthead footer "
    "comment comments commentlist respond disqus replies reply share sharing social related recommended "
    "pagination pager toolbar widget widgets outbrain taboola skip".split())
#: Elements of the head; any other one ends it.
HEAD = frozenset("base link meta title style script noscript template head html".split())
#: ``has-sidebar`` and the like name a state of the page, not a side bar.
STATES = frozenset("has have no not with without is hide show enable disable".split())
#: Builders' names for any block: cut words only at the start of a name.
BUILDER = frozenset("widget widgets".split())
READERS = frozenset("comment comments commentlist respond disqus replies reply".split())
ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _cut_word(value: str) -> str:
    """The first class name or id with a cut word as its name or a part of it."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        for k, x in enumerate(parts):
            if x in STATES:
                break
            if x in CUT_WORDS and not (k and x in BUILDER):
                return x
    return ""


def _cut(tag: str, attrs: str, inside: bool) -> str:
    """Why an element is never main text, or nothing; ``inside``: within article or main."""
    if tag in CUT_TAGS or tag == "header" and not inside:
        return "tag"
    if not attrs.strip() or tag in ("html", "body"):
        return ""
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        if name == "role" and value in CUT_ROLES:
            return "role"
        if name in ("class", "id") and tag not in ("article", "main") and (word := _cut_word(value)):
            return "readers" if word in READERS else "word"
        if name in ("class", "id") and tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(re.split(r"[^a-z]+", value)):
            return "readers"
    return ""


class Dom:
    """Nodes in page order: tag, parent, items (child number or text)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.items = ["html"], [-1], [[]]
        html = UNENDED.sub("", html)
        stack, at, body = [0], 0, False
        cut: dict[int, str] = {}
        for m in iter(lambda: TOKEN.search(html, at), None):
            if m.start() > at:
                stack = self._text(html[at:m.start()], stack)
            at = m.end()
            end, start = m[1], m[2]
            if start:
                start, attrs = start.lower(), m[3][:-1]
                if self.tag[stack[-1]] == "head" and start not in HEAD:
                    stack = [0]
                if start in RAW and not attrs.endswith("/"):
                    stop = re.compile(rf"</{start}\b[^>]*>", re.I).search(html, at)
                    at = stop.end() if stop else len(html)
                    continue
                stack = self._imply(start, stack)
                if start in VOID or attrs.endswith("/"):
                    if start in ("br", "hr", "wbr", "img"):
                        self.items[stack[-1]].append(self._add(start, stack[-1]))
                    continue
                if start in ("html", "body"):
                    if start == "body" and (not body or cut.keys().isdisjoint(stack)):
                        stack, body = [0], True
                    continue
                inside = any(self.tag[s] in ("article", "main") for s in stack)
                n = self._add(start, stack[-1])
                if why := _cut(start, attrs, inside):
                    cut[n] = why
                self.items[stack[-1]].append(n)
                stack.append(n)
            elif end:
                end = end.lower()
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == end:
                        del stack[k:]
                        break
                    if end not in BLOCK and self.tag[stack[k]] in BLOCK:
                        break
        if at < len(html):
            self._text(html[at:], stack)
        if cut:
            self._restore(cut)
            for n in {self.parent[n] for n in cut}:
                self.items[n] = [x for x in self.items[n] if isinstance(x, str) or x not in cut]

    def _text(self, text: str, stack: list[int]) -> list[int]:
        if self.tag[stack[-1]] == "head" and text.strip():
            stack = [0]
        self.items[stack[-1]].append(text)
        return stack

    def _restore(self, cut: dict[int, str]) -> None:
        """Take elements that hold the page out of ``cut``."""
        c, _, lc, _ = self.measure()
        plain = [x - y for x, y in zip(c, lc)]

        def left():
            """Per node: plain characters outside cut elements, and whether it is cut itself."""
            out, gone = plain.copy(), [False] * len(plain)
            for n in range(len(plain) - 1, -1, -1):
                out[n] -= sum(plain[x] - (0 if x in cut else out[x]) for x in self.items[n] if not isinstance(x, str))
            for n in range(1, len(plain)):
                gone[n] = n in cut or gone[self.parent[n]]
            return out, gone

        homes = [n for n in range(len(plain)) if self.tag[n] in ("article", "main") and n not in cut and plain[n]]
        out, gone = left()
        if any(out[n] and not gone[n] for n in homes):
            return

        def above(n):
            while n:
                n = self.parent[n]
                yield n

        homes = [n for n in homes if not any(cut.get(x) in ("hidden", "readers") for x in above(n))]
        home = max(homes, key=lambda n: plain[n], default=0)
        if home and plain[home] > out[0]:
            for n in above(home):
                cut.pop(n, None)
            out, gone = left()
        while not any(out[n] and not gone[n] for n in homes):
            held = [n for n, why in cut.items() if (why == "word" or self.tag[n] == "form") and not gone[self.parent[n]]]
            most = max(held, key=lambda n: plain[n], default=0)
            if not most or plain[most] <= 10 * out[0] or 2 * plain[most] <= plain[0]:
                break
            del cut[most]
            out, gone = left()

    def _add(self, tag: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.items.append([])
        return len(self.tag) - 1

    def _imply(self, start: str, stack: list[int]) -> list[int]:
        """The stack without the elements that end where ``start`` begins."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == "p" and start in CLOSES_P or start in ENDS.get(tag, ()):
                return stack[:k]
            if tag in SCOPE:
                break
        return stack

    def measure(self):
        """Per node: characters, tags, link characters, link tags below it."""
        size = len(self.tag)
        c, t, lc, lt = [0] * size, [0] * size, [0] * size, [0] * size
        for n in range(size - 1, -1, -1):  # children come after their parents
            for x in self.items[n]:
                if isinstance(x, str):
                    c[n] += len("".join(x.split()))
                else:
                    c[n] += c[x]
                    t[n] += t[x] + 1
                    lc[n] += lc[x]
                    lt[n] += lt[x] + (self.tag[x] == "a")
            if self.tag[n] == "a":
                lc[n], lt[n] = c[n], t[n]
        return c, t, lc, lt

    def densities(self, root: int):
        """Composite density and density sum of every node under ``root``."""
        c, t, lc, lt = self.measure()
        ratio = lc[root] / max(1, c[root])
        density, total = [0.0] * len(self.tag), [0.0] * len(self.tag)
        for n in range(len(self.tag)):
            if c[n]:
                plain = max(1, c[n] - lc[n])
                base = math.log(c[n] / plain * lc[n] + ratio * c[n] + math.e)
                adjust = c[n] / max(1, lc[n]) * max(1, t[n]) / max(1, lt[n])
                density[n] = c[n] / max(1, t[n]) * max(0.0, math.log(adjust) / math.log(base) if base > 1 else math.log(adjust))
        for n in range(len(self.tag)):
            for x in self.items[n]:
                # a node's own text is a child of one tag
                total[n] += len("".join(x.split())) if isinstance(x, str) else density[x]
        return density, total, c, lc

    def below(self, n: int) -> list[int]:
        """The node and all nodes under it, in page order."""
        out, stack = [], [n]
        while stack:
            at = stack.pop()
            out.append(at)
            stack.extend(x for x in reversed(self.items[at]) if not isinstance(x, str))
        return out

    def blocks(self, keep: set[int], root: int, drop: set[int]) -> list[str]:
        """Texts of the blocks under ``root`` that lie in a kept subtree."""
        out: list[str] = []
        line: list[str] = []

        def close():
            if line:
                text = " ".join("".join(line).split())
                if text:
                    out.append(text)
                line.clear()

        stack: list = [(root, 0, root in keep)]
        while stack:
            n, k, on = stack.pop()
            block = self.tag[n] in BLOCK
            if k == 0 and block:
                close()
            items = self.items[n]
            while k < len(items):
                x = items[k]
                k += 1
                if isinstance(x, str):
                    if on:
                        line.append(unescape(x))
                elif self.tag[x] == "br":
                    line.append(" ")
                elif x not in drop:
                    stack.append((n, k, on))
                    stack.append((x, 0, on or x in keep))
                    break
            else:
                if block:
                    close()
        close()
        return out


def main_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    dom = Dom(html)
    density, total, c, lc = dom.densities(0)
    nodes = dom.below(0)
    if not c[0]:
        return ""
    home = {n: n if dom.tag[n] in ("article", "main") else 0 for n in nodes}  # outermost article or main
    for n in nodes:
        home[n] = n and home[dom.parent[n]] or home[n]
    lead = max(nodes, key=lambda n: (bool(home[n] and c[n]), total[n], -n))
    path = [lead]
    while path[-1] and dom.parent[path[-1]]:
        path.append(dom.parent[path[-1]])
    threshold = min(density[n] for n in path)
    order = {n: i for i, n in enumerate(nodes)}
    end = order.copy()  # place of the last node of each subtree
    links = [0] * len(dom.tag)
    for n in reversed(nodes):
        links[n] += dom.tag[n] == "a"
        if n:
            end[dom.parent[n]] = max(end[dom.parent[n]], end[n])
            links[dom.parent[n]] += links[n]
    top = home[lead]
    if not top:
        top = lead
        places = [order[n] for n in nodes if n and density[n] >= threshold] or [order[lead]]
        while top and not (order[top] <= min(places) and max(places) <= end[top]):
            top = dom.parent[top]
    # blocks that are mostly links and below the threshold are lists of links
    drop = {n for n in nodes if order[top] < order[n] <= end[top] and dom.tag[n] in BLOCK and 2 * lc[n] > c[n]
            and density[n] < threshold and links[n] > 1}
    return "\n".join(dom.blocks({top}, top, drop))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text per row of ``pages``."""
    ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])

    kinds = [pages.schema[x].dataType.simpleString() for x in (id_col, url_col)]
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
            .mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string"))


def op2_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
