"""The main text of web pages by composite text density.

A page is parsed into a tree. What is never article text goes first: scripts, styles, forms, menus, page
headers and footers, side bars, hidden parts, and what its class, id or role calls an advert, a notice, a
menu or reader comments: by a whole name, or a compound of such words and plain ones, and never if it holds most
of the page's text together with the article or its heading. For every node of the rest:

    density = C/T * log(C/LC * T/LT) to the base ln(C/NLC * LC + LCb/Cb * C + e)

with C its characters, LC those in links, NLC the others, T and LT its tags and link tags, Cb and LCb the
counts of the whole body (a zero counts as one below a fraction's line). The node whose children's
densities (those of running text, such as bold type, aside) have the largest sum is the heart of the article. The least density on its path to the body is
the threshold: every part of the page that reaches it is searched for its own largest sum, and these
subtrees, in page order, are the text. Densities of leaves and of containers differ, so the threshold only
adds: all that is left of the article or main element around the heart belongs to it; without one, so do the
heart's siblings below the lowest ancestor that reaches the threshold, but for those whose text is mostly
links. A page without any such sum gives the body's own text.

Character references are decoded; white space inside a block becomes one space; blocks are joined by two
line feeds. Null, empty and text-free pages give the empty text. Repeated rows stay; null ids and urls are
passed on. Other columns of the input play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import column, map_rows

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements of running text: they count as tags, and in sums they are part of their block.
PHRASE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Starting one of the first ends an open one of the second, up to the nearest of the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_SCOPE = frozenset("html body div article section main td th table button object caption blockquote li aside header footer nav form".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select textarea input iframe svg canvas object audio video dialog menu noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what isn't the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr comment comments commentlist disqus replies sidebar menu nav navbar navigation footer breadcrumb breadcrumbs popup modal overlay newsletter subscribe subscription signup social share sharing related recommended widget toolbar pagination pager login notice notices alert skip".split())
#: And those that do so outside the article's own element.
SITE_MARKS = frozenset("header masthead banner topbar".split())
#: What may stand beside such a word in a compound; any other part makes it something else ("has-sidebar", "ad-hoc").
PLAIN = frozenset("site page main global top bottom left right primary secondary header banner list box bar block container wrapper wrap section area links link posts post items item form slot unit button buttons icons inner outer content text body title thread reader user".split())
KEEP = frozenset("html body article main".split())


def marked(name: str, marks: frozenset[str]) -> bool:
    """Whether one name of a class is a mark, or a compound of marks and plain words."""
    if name in marks:
        return True
    parts = [x for x in re.split("[-_]+", name) if x]
    return len(parts) > 1 and any(x in marks for x in parts) and all(x in marks or x in PLAIN for x in parts)


def dropped(tag: str, raw: str, inside: bool) -> int:
    """Why an element isn't article text: TAG or NAMED; 0 if nothing says so."""
    if tag in NEVER or tag == "header" and not inside:
        return TAG
    if tag in KEEP or not raw.strip():
        return 0
    marks = MARKS if inside else MARKS | SITE_MARKS
    for name, a, b, c in ATTR.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if any(marked(x, marks) for x in value.split()):
                return NAMED
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return TAG
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return TAG
    return 0


TAG, NAMED = 1, 2


class Page:
    """A page's nodes: parents come before children, in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.inside = ["#root"], [-1], [False]
        why = [0]
        #: (node, text, whether a block begins before it)
        self.texts: list[tuple[int, str, bool]] = []
        stack, at, fresh = [0], 0, True
        for m in iter(TOKEN.scanner(source).search, None):
            if m.start() < at:  # inside a raw element
                continue
            if m.start() > at:
                fresh = self.text(stack[-1], source[at : m.start()], fresh)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                fresh = True
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                continue
            if tag in BLOCK and tag not in ("body", "html", "head"):
                self.end(stack, frozenset(["p"]), P_SCOPE)
            if tag in ENDS:
                self.end(stack, *ENDS[tag])
            if tag == "body" and (k := next((k for k, n in enumerate(stack) if self.tag[n] == "head"), 0)):
                del stack[k:]
            raw, up = m[3] if m[2] else m[6], stack[-1]
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(up)
            self.inside.append(self.inside[up] or tag in ("article", "main"))
            why.append(dropped(tag, raw, self.inside[node]))
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif tag == "br":
                self.texts.append((up, " ", False))
            elif tag not in VOID and not raw.endswith("/"):
                stack.append(node)
        if at < len(source):
            self.text(stack[-1], source[at:], fresh)
        self.drop = self.judged(why)

    def judged(self, why: list[int]) -> list[bool]:
        """Which nodes go. A name alone doesn't take away what holds most of the text and the article or its heading."""
        n = len(why)
        gone, chars, heart = [w == TAG for w in why], [0] * n, [t in ("article", "main", "h1") for t in self.tag]
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
        for i, t, _ in self.texts:
            if not gone[i]:
                chars[i] += len(" ".join(t.split()))
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            heart[self.parent[i]] = heart[self.parent[i]] or heart[i]
        for i in range(1, n):
            named = why[i] == NAMED and not (heart[i] and 2 * chars[i] > chars[0])
            gone[i] = gone[i] or named or gone[self.parent[i]]
        return gone

    def end(self, stack: list[int], which: frozenset[str], scope: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in which:
                if tag in ("td", "th") and k > 1 and "tr" in which:  # a row's cells end with it
                    continue
                del stack[k:]
                return
            if tag in scope:
                return

    def text(self, node: int, text: str, fresh: bool) -> bool:
        """Keeps a run of text; whether the next one begins a block."""
        if "&" in text:
            text = html.unescape(text)
        self.texts.append((node, text, fresh))
        return fresh and not text.strip()

    def densities(self) -> tuple[list[float], list[float]]:
        """Each node's density, and the sum of its children's."""
        n = len(self.tag)
        chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for i, t, _ in self.texts:
            if not self.drop[i]:
                c = len(" ".join(t.split()))
                chars[i] += c
                linked[i] += c if in_link[i] else 0
        for i in range(n - 1, 0, -1):
            if not self.drop[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + 1
                links[p] += links[i] + (self.tag[i] == "a")
        self.chars, self.linked = chars, linked
        ratio = linked[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc, t, lt = chars[i], linked[i], max(1, tags[i]), max(1, links[i])
            if c and not self.drop[i]:
                base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
                x = c / max(1, lc) * t / lt
                density[i] = c / t * (math.log(x) / math.log(base) if base > 1 + 1e-9 else math.log(x) + 1)
                if i and self.tag[i] not in PHRASE:
                    total[self.parent[i]] += density[i]
        return density, total

    def heart(self) -> list[bool]:
        """Which nodes belong to the article."""
        n = len(self.tag)
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        density, total = self.densities()
        article = [False] * n
        best = max(range(n), key=lambda i: (total[i], -i))
        if total[best] <= 0:
            article[body] = True
        else:
            least, i = density[best], best
            while i > 0 and i != body:
                i = self.parent[i]
                if i > 0 or body == 0:
                    least = min(least, density[i])
            # the largest sum at or below each node; a leaf stands for itself
            top, at = total[:], list(range(n))
            for i in range(n - 1, 0, -1):
                p = self.parent[i]
                if top[i] > top[p] or top[i] == top[p] > 0 and at[i] < at[p]:
                    top[p], at[p] = top[i], at[i]
            for i in range(body, n):
                if not self.drop[i] and density[i] >= least > 0:
                    article[at[i]] = True
            around = best
            while around > 0 and self.tag[around] not in ("article", "main"):
                around = self.parent[around]
            if around > 0:
                article[around] = True
            elif best != body:
                around = self.parent[best]
                while around > body and density[around] < least:
                    around = self.parent[around]
                for i in range(around + 1, n):
                    if self.parent[i] == around and 2 * self.linked[i] < self.chars[i]:
                        article[i] = True
        for i in range(1, n):
            article[i] = not self.drop[i] and (article[i] or article[self.parent[i]])
        return article


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    article = page.heart()
    blocks: list[list[str]] = []
    fresh = True
    for node, text, begins in page.texts:
        fresh = fresh or begins
        if article[node]:
            if fresh or not blocks:
                blocks.append([])
            fresh = False
            blocks[-1].append(text)
    return "\n\n".join(b for b in (" ".join("".join(x).split()) for x in blocks) if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages."""

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), column(pages, html_col).cast("string").alias("html")), run, "page_id long,url string,text string,n_chars long")
