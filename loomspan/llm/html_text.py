"""Operator 3, HTML extraction: parser events to lines, text-to-tag ratios, smoothing, threshold clusters, regions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from math import exp, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, lean, output, quoted, restored

#: Elements whose content is no text of the page; those of the second set end where a block begins, as their ends are often missing.
_SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button", "option", "datalist", "audio", "video", "map"}
_LOOSE = {"head", "title", "select", "button", "option", "datalist"}
#: Elements for text beside the article; a form may be around the whole page.
_BESIDE = {"nav", "footer", "aside", "menu", "dialog"}
_AROUND = {"form", "fieldset", "header"}
_SECTIONS = {"article", "main", "section", "nav", "footer", "aside", "header", "form", "menu", "dialog"}
_CONTAINERS = {"html", "body", "main", "article", "section", "div", "header", "table", "tbody", "tr", "td", "ul", "ol", "dl", "figure", "details", "center", "blockquote"} | _BESIDE | _AROUND
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "th", "thead", "tfoot", "caption", "figcaption", "summary", "address", "pre", "hr", "hgroup", "legend", "search"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_CLOSED_BY = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, **{h: {"p"} | _HEADINGS for h in _HEADINGS}}
#: Words by which a class or id tells that its element is something beside the article, and words that say nothing about it.
_MARKS = {"ad", "ads", "adbox", "adsense", "adslot", "adunit", "advert", "adverts", "advertisement", "nav", "navbar", "navigation", "navigationbar", "topnav", "subnav", "menu", "submenu", "breadcrumb", "breadcrumbs", "header", "footer", "masthead", "topbar", "toolbar", "sidebar", "aside", "banner", "notice", "notices", "notification", "alert", "consent", "gdpr", "popup", "modal", "overlay", "dialog", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "login", "signin", "signup", "register", "search", "searchbox", "searchform", "pagination", "pager", "copyright", "legal", "disclaimer", "contentinfo", "complementary", "tags", "toc", "teaser", "promo", "promoted", "promotion", "hidden", "announcement", "paywall", "sitemap"}
_MARK_STARTS = ("advert", "sponsor", "newsletter", "subscri", "cookie")
_COMMENTS = {"comment", "comments", "commentlist", "commentform", "respond", "reply", "replies", "discussion", "discuss", "disqus"}
_PLAIN = {"box", "wrap", "wrapper", "container", "area", "block", "list", "section", "inner", "outer", "top", "bottom", "left", "right", "main", "site", "page", "bar", "group", "item", "items", "link", "links", "button", "buttons", "btn", "icon", "icons", "panel", "content", "text", "row", "col", "column", "holder", "module", "component", "global", "primary", "secondary", "fixed", "sticky", "floating", "mobile", "desktop", "small", "large", "article", "post", "posts", "entry", "entries", "blog", "story", "news", "form", "field", "policy", "message", "slot", "unit", "card", "cards", "grid", "thread", "zone", "region", "count", "body", "user", "reader", "readers"}
#: A header with one of these words in its class is the article's own.
_OWN_HEADER = {"article", "entry", "post", "story", "content", "chapter", "section"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar"}
_SPLIT, _CAMEL, _HIDDEN = re.compile(r"[^a-z0-9]+"), re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"display\s*:\s*none")
_RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\s+(?:©|\(c\)|\d{4}))", re.IGNORECASE)
#: Inside an article an id of these words alone names a section on that topic, and a class that ends in one of the second set a part of it.
_TOPICS = {"legal", "social", "search", "copyright", "disclaimer", "register", "navigation", "promotion", "announcement", "sitemap", "header", "footer"}
_PARTS = {"story", "article", "chapter", "paragraph"}
_NOT_PARTS = ("related", "recommend", "promo", "sponsor", "advert")
_VERBATIM, _END, _UNFINISHED = re.compile(r"<(script|style)\b.*?</\1\b", re.IGNORECASE | re.ASCII | re.DOTALL), "-->", re.compile(r"<[a-zA-Z/!?]")
#: What the ratio of a line is lowered to whose element is, or says that it is, beside the article; and the least share of the mean that a
#: threshold is.
LOW, FLOOR = 1e-6, 1e-3
#: What is beside the article whatever it holds; what isn't, if it holds the article; and that for readers' comments.
FIXED, MARKED, COMMENTS = 1, 2, 3


def _marked(attrs: list[tuple[str, str | None]], inside: bool = False) -> int:
    """Whether an element says that it is something beside the article: a class or id counts if all its words are known.
    ``inside`` an article, words that are as well topics or parts of one don't."""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value)):
            return MARKED
        if name == "role" and value in _ROLES:
            return MARKED
        if name in ("class", "id") and value:
            for token in value.split():
                words = [w for w in _SPLIT.split(_CAMEL.sub("-", token).lower()) if w and not w.isdigit()]
                if not all(w in _MARKS or w in _COMMENTS or w in _PLAIN or w.startswith(_MARK_STARTS) for w in words):
                    continue
                if any(w in _COMMENTS for w in words):
                    return COMMENTS
                telling = [w for w in words if w not in _PLAIN]
                if inside and telling and ((name == "id" and _TOPICS.issuperset(telling)) or (words[-1] in _PARTS and not any(w.startswith(_NOT_PARTS) for w in words))):
                    continue
                if telling and not (telling == ["header"] and _OWN_HEADER.intersection(words)):
                    return MARKED
    return 0


class _Page(HTMLParser):
    """Turns parser events into lines, one a block: (text, tags inside, characters in links, innermost element, in a heading).
    Elements are numbered as they open, so a parent has a smaller number than what is in it."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lines, self.text = html, [], []
        self.tags = self.links = self.in_link = self.heading = self.at = 0
        self.parent, self.own, self.article, self.section, self.header = [0], [0], [False], [True], [False]
        self.node, self.stack, self.open = 0, [], Counter()
        self.silent, self.depth, self.skip, self.last = "", 0, [], {}

    def run(self) -> _Page:
        self.feed(self.html)
        self.close()
        self.flush()
        return self

    def parse_starttag(self, i: int) -> int:
        self.at = len(self.html) - len(self.rawdata) + i
        return super().parse_starttag(i)

    def ends_later(self, tag: str) -> bool:
        if tag not in self.last:
            ends = [m.start() for m in re.finditer(rf"</{tag}\b", self.html, re.IGNORECASE | re.ASCII)]
            self.last[tag] = ends[-1] if ends else -1
        return self.last[tag] > self.at

    def inside(self) -> bool:
        return self.open["article"] > 0 or self.open["main"] > 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.links, self.node, self.heading > 0))
        self.text, self.tags, self.links = [], 0, 0
        self.skip.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag == self.silent:
                self.depth += 1
            elif tag in _BLOCKS and self.silent in _LOOSE:
                self.silent = ""
            if self.silent:
                return
        if tag in _SILENT:
            if self.ends_later(tag) or tag == "head":
                self.silent, self.depth = tag, 1
            return
        if tag not in _BLOCKS:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
            elif tag not in _VOID and (self.skip or (attrs and _marked(attrs, self.inside()))):
                self.skip.append(tag)
            elif tag == "a":
                self.in_link += 1
            return
        self.flush()
        self.tags = 1
        if tag in _CLOSED_BY:  # the next one closes it
            self.leave(_CLOSED_BY[tag], _CONTAINERS)
        if tag in ("article", "main"):  # a menu that is open and doesn't end later has lost its end
            for t in ("nav", "menu", "form", "header", "aside"):
                if self.open[t] and not self.ends_later(t):
                    self.leave({t})
        if tag in _VOID:
            return
        own = FIXED if tag in _BESIDE else 0 if tag in ("html", "body", "main") else _marked(attrs, self.inside()) or (MARKED if tag in ("form", "fieldset") else 0)
        node = self.node
        if tag in _CONTAINERS or own:
            self.parent.append(self.node)
            self.own.append(own)
            self.article.append(tag in ("article", "main") and not own)
            self.section.append(tag in _SECTIONS)
            self.header.append(tag == "header")
            self.node = len(self.parent) - 1
        self.heading += tag in _HEADINGS
        self.stack.append((tag, node))
        self.open[tag] += 1

    def leave(self, wanted: set[str], stop: set[str] = frozenset()) -> None:
        """Ends the innermost wanted element and all that is open in it, if it is open below any of ``stop``."""
        if not any(self.open[t] for t in wanted):
            return
        k = len(self.stack) - 1
        while k >= 0 and self.stack[k][0] not in wanted:
            if self.stack[k][0] in stop:
                return
            k -= 1
        if k < 0:
            return
        for tag, _ in self.stack[k:]:
            self.open[tag] -= 1
            self.heading -= tag in _HEADINGS
        self.node = self.stack[k][1]
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent:
                self.depth -= 1
                if not self.depth:
                    self.silent = ""
            return
        if tag in _SILENT:
            return
        self.tags += 1
        if tag in _BLOCKS:
            self.flush()
            self.leave({tag})
        elif self.skip:
            if self.skip[-1] == tag:
                self.skip.pop()
        elif tag == "a" and self.in_link:
            self.in_link -= 1

    def handle_data(self, data: str) -> None:
        if self.silent or self.skip:
            return
        self.text.append(data)
        if self.in_link:
            self.links += len(data.strip())


def _finished(html: str) -> str:
    """A page without what never ends: a comment that is open at the end, or a tag. Both run to the page's end and hold no text,
    and the parser would look for the end of each again and again."""
    at = html.find("<!--", html.rfind(_END) + len(_END) if _END in html else 0)
    if at >= 0:
        verbatim = [m.span() for m in _VERBATIM.finditer(html)]
        k = 0
        while at >= 0:
            while k < len(verbatim) and verbatim[k][1] <= at:
                k += 1
            if k == len(verbatim) or at < verbatim[k][0]:
                html = html[:at]
                break
            at = html.find("<!--", verbatim[k][1])
    tail = _UNFINISHED.search(html, html.rfind(">") + 1)
    return html[: tail.start()] if tail else html


def _parse(html: str) -> _Page:
    html = _finished(html)
    try:
        return _Page(html).run()
    except AssertionError:  # the standard parser stops at some malformed declarations
        return _Page(html.replace("<![", "<!-- [")).run()


def smoothed(ratios: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian means over the lines within two ``sigma``."""
    r = max(1, round(2 * sigma))
    kernel = [exp(-0.5 * (d / sigma) ** 2) for d in range(r + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for j in range(max(0, i - r), min(len(ratios), i + r + 1)):
            k = kernel[abs(i - j)]
            total += k * ratios[j]
            weight += k
        out.append(total / weight)
    return out


def clusters(smooth: list[float], share: float = 0.5) -> list[bool]:
    """The lines at or above the threshold, a share of the ratios' standard deviation, and not next to nothing beside the mean."""
    mean = sum(smooth) / len(smooth)
    threshold = min(max(smooth), max(FLOOR * mean, share * sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))))
    return [0 < x >= threshold for x in smooth]


def _furniture(page: _Page, chars: list[int]) -> list[bool]:
    """Of each element, whether it is beside the article or in such an element. Marks of one that holds most of the articles'
    text, or without articles nearly all text, are void: it is around the article."""
    m = len(page.parent)
    inside, articles = [0] * m, [0] * m
    for (_, _, _, node, _), n in zip(page.lines, chars, strict=True):
        inside[node] += n
    for k in range(m - 1, 0, -1):
        articles[k] = max(articles[k], inside[k]) if page.article[k] else articles[k]
        inside[page.parent[k]] += inside[k]
        articles[page.parent[k]] += articles[k]
    beside = [0] * m
    for k in range(1, m):
        p, own = page.parent[k], page.own[k]
        around = own in (MARKED, COMMENTS) and 2 * articles[k] > articles[0] > 0
        beside[k] = beside[p] or (0 if around else own) or (MARKED if page.header[k] and not _in_article(page, p) else 0)
    if not articles[0]:
        rest = sum(n for (_, _, _, node, _), n in zip(page.lines, chars, strict=True) if not beside[node])
        for k in range(1, m):
            p = page.parent[k]
            if beside[k] == MARKED and not beside[p] and inside[k] > 20 * rest:
                page.own[k] = 0
                page.header[k] = False
        for k in range(1, m):
            beside[k] = beside[page.parent[k]] or page.own[k] or (MARKED if page.header[k] else 0)
    return [bool(x) for x in beside]


def _in_article(page: _Page, node: int) -> bool:
    return bool(page.around[node])


def extract_text(html: str | None, *, sigma: float = 1.0) -> str:
    """The main text of a page: its blocks, one a line.

    A line's ratio is its characters outside of links over its tags (in an article of links only, all its characters). Elements that
    are, or mark themselves as, something beside the article lower their lines' ratios, to almost nothing. Ratios are smoothed with a Gaussian within sections, and lines at or above
    half their standard deviation form the clusters. These select the regions: the innermost article or main element around a
    cluster's line; for lines in none their container; without any such element all that lies from the first cluster to the
    last in their common container, but for containers of mostly links. All lines of a region belong to the article, short ones too, except
    lowered ones that are in no cluster. A page whose every line is lowered or in links has no text. Comments and tags that never end run to the page's end.
    """
    if not html:
        return ""
    page = _parse(html)
    lines = page.lines
    if not lines:
        return ""
    m, parent = len(page.parent), page.parent
    around = page.around = [0] * m  # the innermost article or main element
    for k in range(1, m):
        around[k] = k if page.article[k] else around[parent[k]]
    plain = [max(0, len(text) - links) for text, _, links, _, _ in lines]
    said = [0] * m
    for (_, _, _, node, _), n in zip(lines, plain, strict=True):
        said[around[node]] += n
    plain = [n if said[around[node]] or not around[node] else len(text) for (text, _, _, node, _), n in zip(lines, plain, strict=True)]
    beside = _furniture(page, plain)
    title = [False] * m  # in the article's own header, of which only the headings are its text
    section = [0] * m
    for k in range(1, m):
        title[k] = title[parent[k]] or page.header[k]
        section[k] = k if page.section[k] or (beside[k] and not beside[parent[k]]) else section[parent[k]]
        around[k] = 0 if beside[k] else k if page.article[k] else around[parent[k]]
    weight = [LOW if beside[node] or (title[node] and not head) or (not around[node] and _RIGHTS.match(text)) else 1 for text, _, _, node, head in lines]
    by: dict[int, list[int]] = {}
    for i, (_, _, _, node, _) in enumerate(lines):
        by.setdefault(section[node], []).append(i)
    ratios = [w * n / max(1, tags) for w, n, (_, tags, _, _, _) in zip(weight, plain, lines, strict=True)]
    smooth = [0.0] * len(lines)
    for own in by.values():
        for i, x in zip(own, smoothed([ratios[i] for i in own], sigma), strict=True):
            smooth[i] = min(x, ratios[i]) if weight[i] < 1 or not ratios[i] else x  # neighbours don't make text of links
    high = clusters(smooth)
    if not any(w == 1 and x for w, x in zip(weight, ratios, strict=True)):
        return ""
    region, single, first, last = [False] * m, set(), 0, len(lines)
    held = [False] * m  # elements that hold an article of a region
    for i in range(len(lines)):
        if high[i] and around[lines[i][3]]:
            region[around[lines[i][3]]] = held[around[lines[i][3]]] = True
    links = [False] * m
    if any(region):
        for k in range(m - 1, 0, -1):
            held[parent[k]] = held[parent[k]] or held[k]
        for i in range(len(lines)):
            if high[i] and not around[lines[i][3]]:
                if held[lines[i][3]]:
                    single.add(i)
                else:
                    region[lines[i][3]] = True
    else:
        count, total, linked = [0] * m, [0] * m, [0] * m
        for i, (text, _, in_links, node, _) in enumerate(lines):
            count[node] += high[i]
            total[node] += len(text)
            linked[node] += in_links
        for k in range(m - 1, 0, -1):
            for a in (count, total, linked):
                a[parent[k]] += a[k]
        region[max(k for k in range(m) if count[k] == count[0])] = True
        links = [not c and 2 * a > t for c, a, t in zip(count, linked, total, strict=True)]
        first, last = high.index(True), len(high) - high[::-1].index(True)
    for k in range(1, m):
        region[k] = region[k] or region[parent[k]]
        links[k] = links[k] or links[parent[k]]
    chosen = (i for i in range(first, last) if i in single or (region[lines[i][3]] and (high[i] or (weight[i] == 1 and not links[lines[i][3]]))))
    return "\n".join(lines[i][0] for i in chosen)


def html_text(pages: DataFrame, *, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all but ``html`` by default), text (empty if none) and n_chars (its code points), a row a page.

    No shuffle; a page is parsed whole, in time and memory that grow with its length, also if it is very long or deeply
    nested. Null or empty HTML gives an empty text; repeated rows are treated alike; an empty table gives an empty one.
    Columns named text or n_chars are replaced; others may have any name.
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c not in ("text", "n_chars", html)]
    rows = pages.select(*carried(carry), F.col(quoted(html)).alias("t"))
    held = rows.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [extract_text(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*held, "text", "n_chars"])

    done = rows.mapInArrow(lean(run), output(rows, held, "text string, n_chars long"))
    return done.select(*restored(carry), "text", "n_chars")
