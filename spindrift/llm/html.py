"""Main-text extraction by composite text density: link-adjusted characters per tag for every node of the page's tree, the
children's densities summed up, the subtree with the largest sum chosen. What stands beside that subtree is text as well
where it is as dense as the thinnest node between the body and it."""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_arrow, table

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Content that is text, not markup, up to the closing tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in (
    "script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"
)}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends the nearest of these elements, unless one of the others stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NEVER = frozenset("script style noscript template iframe svg canvas object embed button select option textarea input title head".split())
_AROUND = frozenset("nav aside footer form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TALK = frozenset("comment comments commentlist commentary disqus reply replies respond responses discussion".split())
_MARKS = _TALK | frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising advertorial adsense banner banners breadcrumb breadcrumbs consent cookie cookies copyright "
    "disclaimer footer gdpr login masthead menu menus nav navbar navigation newsletter notice notices notification pager pagination popup popups promo promos promoted promotion "
    "recommended related search share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: Words of layout, which say nothing of the content: a class is furniture if all of its words are marks or of these.
_LAYOUT = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content desktop entries feed fixed form global group header heading holder icon icons image inner item items "
    "large left level link links list main media mobile module news outer overlay page panel post posts primary right row secondary section site slot small stories sub sticky tag tags text thread title top "
    "unit video view wrap wrapper zone js id".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements below one another that the tree holds, as in browsers; deeper ones are beside each other. Their text is kept.
DEPTH = 512


def _furniture(token: str, marks: frozenset[str]) -> bool:
    """Whether a class or id names furniture: one of its words does, and no other word says something else."""
    words = [w.lower() for w in _WORD.findall(token)]
    return not marks.isdisjoint(words) and all(w in _MARKS or w in _LAYOUT for w in words)


class Page:
    """The tree of a page as arrays in page order: a node's index is larger than its parent's."""

    def __init__(self, html: str):
        self.tag, self.parent, self.mark = ["#root"], [0], [""]
        self.events: list[tuple[int, str | None]] = []  # text of a node, or None: a block begins or ends
        stack, open_ = [0], {"#root": 1}
        tag, parent, mark, events = self.tag, self.parent, self.mark, self.events

        def close(depth: int) -> None:
            while len(stack) > depth:
                t = tag[stack.pop()]
                open_[t] -= 1
                if t in _BLOCK:
                    events.append((stack[-1], None))

        at, n, quoted = 0, len(html), True
        while at < n:
            begin = html.find("<", at)
            m = None
            while begin >= 0 and not (m := _NAME.match(html, begin + 1)) and html[begin + 1 : begin + 2] not in ("!", "?"):
                begin = html.find("<", begin + 1)
            if begin < 0:
                begin = n
            if begin > at:
                events.append((stack[-1], html[at:begin]))
            if begin == n:
                break
            if m is None:
                if html.startswith("<!--", begin):
                    end = _COMMENT_END.search(html, begin + 4)
                    at = end.end() if end else n
                else:
                    at = html.find(">", begin) + 1 or n
                continue
            # The end of the tag. A quote that nothing closes is none, and so are all behind it: the rest is read once.
            end = self._end(html, m.end()) if quoted else html.find(">", m.end())
            if quoted and end < 0:
                quoted, end = False, html.find(">", m.end())
            if end < 0:  # no tag ends from here on
                events.append((stack[-1], html[begin:]))
                break
            at, closes, name = end + 1, m[0][0] == "/", m[0].lstrip("/")
            name = name.lower()
            if closes:
                if open_.get(name):
                    close(next(i for i in range(len(stack) - 1, -1, -1) if tag[stack[i]] == name))
                elif name == "p":
                    events.append((stack[-1], None))
                continue
            if name == "br":
                events.append((stack[-1], " "))
                continue
            if name in _BLOCK and open_.get("p"):  # what stands above a paragraph is inline
                close(next(i for i in range(len(stack) - 1, -1, -1) if tag[stack[i]] == "p"))
            if name in _ENDS and any(open_.get(t) for t in _ENDS[name][0]):
                ends, stops = _ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if (t := tag[stack[i]]) in ends:
                        close(i)
                        break
                    if t in stops:
                        break
            node = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            mark.append(html[m.end() : end])
            if name in _BLOCK:
                events.append((stack[-1], None))
            if name in _RAW:
                end = _RAW[name].search(html, at)
                at = end.end() if end else n
            elif name not in _VOID and len(stack) < DEPTH:
                stack.append(node)
                open_[name] = open_.get(name, 0) + 1

    @staticmethod
    def _end(html: str, at: int) -> int:
        """Where the > of a tag is whose attributes begin at `at`, outside quotes; -1: nowhere."""
        while True:
            at = _PLAIN.match(html, at).end()
            if at == len(html):
                return -1
            if html[at] == ">":
                return at
            at = html.find(html[at], at + 1) + 1
            if not at:
                return -1

    def unseen(self) -> list[bool]:
        """Nodes that hold no text to read, and all below them."""
        gone = [False] * len(self.tag)
        for i in range(1, len(gone)):
            gone[i] = gone[self.parent[i]] or self.tag[i] in _NEVER
        return gone

    def boilerplate(self) -> list[bool]:
        """Nodes that aren't main text by their tag, role, class or id, and all below them."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        # What stands below: an article, a main part or a first heading; without the article; without the heading.
        holds, heads, parts = [False] * n, [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            t, p = tag[i], parent[i]
            heads[p] |= heads[i] or t in ("main", "h1")
            parts[p] |= parts[i] or t in ("article", "main")
            holds[p] |= holds[i] or t in ("article", "main", "h1")
        within, gone = [False] * n, [False] * n
        for i in range(1, n):
            p, t = parent[i], tag[i]
            within[i] = within[p] or t in ("article", "main")
            gone[i] = gone[p] or t in _NEVER or (t in _AROUND and not (t == "form" and holds[i])) or (t == "header" and not within[p] and not parts[i])  # a heading alone is the site's name
            if gone[i] or not self.mark[i] or self.mark[i].isspace() or t in ("html", "body", "main"):
                continue
            a = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(self.mark[i])}
            if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
                gone[i] = not heads[i]
            elif a.get("role", "").lower() in _ROLES:
                gone[i] = not holds[i]
            else:
                tokens = [x for k in ("class", "id") for x in a.get(k, "").split()]
                talk, marked = (any(_furniture(x, marks) for x in tokens) for marks in (_TALK, _MARKS))
                gone[i] = talk and not heads[i] or marked and not holds[i] and t != "article"
        return gone


class Density:
    """Characters, tags, link characters and link tags below every node, its composite density and its children's sum."""

    def __init__(self, page: Page, gone: list[bool]):
        n, tag, parent = len(page.tag), page.tag, page.parent
        self.c, self.t, self.lc, self.lt = c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
        for i, text in page.events:
            if text and not gone[i]:
                size = len("".join(text.split()))
                c[i] += size
                lc[i] += size * linked[i]
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = parent[i]
                c[p] += c[i]
                lc[p] += lc[i]
                t[p] += t[i] + 1
                lt[p] += lt[i] + (tag[i] == "a")
        body = tag.index("body") if "body" in tag else 0
        self.ratio = lc[body] / max(c[body], 1)
        self.d = [self.of(c[i], t[i], lc[i], lt[i]) if not gone[i] else 0.0 for i in range(n)]
        self.s = [0.0] * n
        for i in range(1, n):
            self.s[parent[i]] += self.d[i]

    def of(self, c: int, t: int, lc: int, lt: int) -> float:
        """Characters a tag, times a logarithm that falls with the share of links; its base grows with the page's share."""
        if not c:
            return 0.0
        base = math.log(math.log(c / max(c - lc, 1) * lc + self.ratio * c + math.e))
        factor = math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / base if base > 1e-9 else 1.0
        return c / max(t, 1) * factor


_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


def choose(page: Page, gone: list[bool]) -> list[bool]:
    """Which nodes' own text is main text.

    The subtree with the largest sum of densities is, but for what is mostly links and comes before any other text in it.
    The threshold is the least density on the path from the body to it, furniture counted in. Beside the path, from the
    body down, a subtree as dense as that is text; of a thinner one, its parts are tried; within an article, which says
    itself what it is, what isn't mostly links is text. First headings are, and headings before what is."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    at = Density(page, gone)
    c, lc = at.c, at.lc
    keep = [False] * n
    if not c[0]:
        return keep
    body = tag.index("body") if "body" in tag else 0
    if not c[body]:
        body = 0  # the text stands outside
    within = [i == body for i in range(n)]
    for i in range(body + 1, n):
        within[i] = within[parent[i]]
    best = max((i for i in range(body, n) if within[i]), key=lambda i: (at.s[i], -i))
    way = [best]
    while way[-1] != body:
        way.append(parent[way[-1]])
    on = set(way)
    every = Density(page, page.unseen())
    least = min(every.d[i] for i in way)
    below: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if not gone[i]:
            below[parent[i]].append(i)
    article = [False] * n
    for i in range(1, n):
        article[i] = article[parent[i]] or tag[i] == "article"
    links = lambda i: 2 * lc[i] > c[i]

    def whole(i: int) -> None:
        todo = [i]
        while todo:
            keep[i := todo.pop()] = True
            todo += below[i]

    def try_(first: int) -> None:
        """Marks what is text in a subtree beside the path; children before their parents' headings are looked at."""
        todo = [first]
        while todo:
            i = todo.pop()
            if at.d[i] >= least and not links(i) or article[i] and not links(i) or tag[i] == "h1":
                whole(i)
            else:
                todo += below[i]

    for k, i in enumerate(way):
        if i == best:
            seen = 0
            keep[i] = True
            for j in below[i]:
                if seen or not links(j) or not c[j]:
                    whole(j)
                    seen += c[j]
            if not seen and not (c[i] - sum(c[j] for j in below[i])):
                whole(i)  # nothing but links
            continue
        own = c[i] - sum(c[j] for j in below[i])
        keep[i] = own >= least or article[i]
        for j in below[i]:
            if j not in on:
                try_(j)
    # A heading is text if what follows it is.
    text = [False] * n
    for i in range(n - 1, 0, -1):
        text[i] = text[i] or keep[i] and c[i] > 0
        text[parent[i]] = text[parent[i]] or text[i]
    for i in way:
        if i != best:
            after = False
            for j in reversed(below[i]):
                if tag[j] in _HEADS and after:
                    whole(j)
                after = text[j] or keep[j] or tag[j] in _HEADS and after
    return keep


def extract(html: str) -> str:
    """The main text of a page; empty if there is none."""
    page = Page(html)
    gone = page.boilerplate()
    keep = choose(page, gone)
    blocks, own = [], []
    for i, text in page.events:
        if text is None:
            if own:
                blocks.append(" ".join(unescape("".join(own)).split()))
                own = []
        elif keep[i] and not gone[i]:
            own.append(text)
    blocks.append(" ".join(unescape("".join(own)).split()))
    return "\n\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null and empty html, and pages without a main text: empty text; markup that isn't closed or nested as it should be is
    read as browsers do, nearly; repeated rows: a row each; extra columns are left out; an empty table gives an empty one.
    A page is held whole, one at a time."""

    def run(batches):
        for b in batches:
            text = [extract(x or "") for x in b.column("html").to_pylist()]
            yield pa.record_batch(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).transform(by_arrow, run, "page_id long, url string, text string, n_chars long")


def op1_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
