"""Main text of web pages by scoring their element tree.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go first, by element,
role and name. Every block of text that is left passes points, one, one for each comma and one for each hundred
characters, whole to the container that holds it, half to the next one out and less to those beyond; a container's
points count by the share of its text that is no link. The best container is kept, or the ``article`` or ``main``
around it, with those siblings that look like text of the same article. Of what is kept nothing is dropped but lists
of links.

Null and empty html gives an empty text, and so does a page whose blocks all went; markup that is never closed ends with
its parent, and elements beyond a depth of 512 count as the one they are in; a page without any element is one block; very
long pages take time in proportion, whatever is in them; repeated rows are read each; an empty table gives an empty result. Columns of the input that are neither id, url nor html stay
out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements in the flow of a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
CONTAINERS = frozenset("body div section article main".split())
#: Text of these is never the article's.
GONE = frozenset("head title script style noscript template iframe object canvas svg audio video map button select textarea input datalist dialog".split())
#: Nor of these, unless the article itself stands inside.
LAYOUT = frozenset("nav aside footer header form menu".split())
LAYOUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
ADS = re.compile(r"ads?|adbox|adslot|adunit|adsense|advert\w*|sponsor\w*|promo\w*|banner|teaser")
LAYOUT_WORDS = re.compile(
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebar|aside|footer|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|widgets?|pagination|pager|skip|hidden"
)
COMMENTS = re.compile(r"comments?|commentlist|disqus|discussion|replies|respond|reactions")
#: What a new element of the first kind ends, if it is open within the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
COMMAS = re.compile("[,،、，]")


#: A tag: whether it ends, its name, its attributes. One with more parts than these ends at its first >.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'){0,200}+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: What is inside of these is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "xmp")}
DEPTH = 512


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page's tags and texts: kind ``<``, ``/`` or a blank. Comments and what is never closed are left out."""
    at, end, last = 0, len(html), html.rfind(">")
    while at < end:
        lt = html.find("<", at)
        if lt < 0 or lt > last:  # no tag can end any more
            yield "", html[at:].split("<!--", 1)[0], ""
            return
        if lt > at:
            yield "", html[at:lt], ""
        if html.startswith("<!--", lt):
            at = html.find("-->", lt + 2)
            at = end if at < 0 else at + 3
        elif (m := TAG.match(html, lt)) or (m := LOOSE_TAG.match(html, lt)):
            close, name, at = m[1], m[2].lower(), m.end()
            yield close or "<", name, m[3]
            if not close and name in RAW:
                m = RAW[name].search(html, at)
                at = m.start() if m else end
        elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
            at = html.find(">", lt) + 1
        else:
            yield "", "<", ""
            at = lt + 1


class Tree:
    """The elements of a page as parallel lists in page order, and its blocks: (element, characters, of these in links, text)."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.names = ["body"], [-1], [""]
        self.blocks: list[tuple[int, int, int, str]] = []
        self.open, self.count, self.lines, self.links = [0], {"body": 1}, [], 0
        for kind, name, rest in scan(html):
            if kind == "<":
                self.start(name, rest)
            elif kind:
                self.end(name)
            else:
                self.text(unescape(name) if "&" in name else name)
        self.end_block()

    def end_block(self) -> None:
        if self.lines:
            text = " ".join("".join(self.lines).split())
            if text:
                at = next(i for i in reversed(self.open) if self.tag[i] not in INLINE)
                self.blocks.append((at, len(text), min(self.links, len(text)), text))
            self.lines, self.links = [], 0

    def pop_to(self, depth: int) -> None:
        if any(self.tag[i] not in INLINE for i in self.open[depth:]):
            self.end_block()
        for i in self.open[depth:]:
            self.count[self.tag[i]] -= 1
        del self.open[depth:]

    def end_open(self, tags: set[str], within: set[str]) -> None:
        """End the innermost open element of ``tags``, if it is not outside of ``within``."""
        if any(self.count.get(t) for t in tags):
            for depth in range(len(self.open) - 1, 0, -1):
                tag = self.tag[self.open[depth]]
                if tag in tags:
                    return self.pop_to(depth)
                if tag in within:
                    return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in VOID:
            if tag not in INLINE:
                self.end_block()
            elif tag == "br":
                self.lines.append("\n")
            return
        if tag not in INLINE:
            self.end_open({"p"}, {"table", "button", "object"})
            self.end_block()
        elif tag == "a":
            self.end_open({"a"}, {"table", "td", "th"})
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if len(self.open) < DEPTH:
            self.tag.append(tag)
            self.parent.append(self.open[-1])
            self.names.append(_names(attributes))
            self.open.append(len(self.tag) - 1)
            self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag not in INLINE and (tag == "p" or len(self.open) >= DEPTH):
            self.end_block()
        if self.count.get(tag) and tag != "body":
            self.end_open({tag}, set() if tag not in INLINE else {"td", "th", "table"})

    def text(self, data: str) -> None:
        self.lines.append(data)
        if self.count.get("a"):
            self.links += len(" ".join(data.split()))


def _names(attributes: str) -> str:
    """Class and id as lower-case words, then the role and whether it is hidden, each as a word of its own kind."""
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    named = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}")
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    return " ".join([*re.split(r"[^a-z0-9]+", named.lower()), f"role={found.get('role', '').strip().lower()}", *(["=hidden"] if hidden else [])])


def _clean(tree: Tree) -> list[bool]:
    """Whether each element is left, itself and all around it."""
    n = len(tree.tag)
    words = [w.split() for w in tree.names]
    comment = [any(map(COMMENTS.fullmatch, w)) for w in words]
    ad = [any(map(ADS.fullmatch, w)) for w in words]
    holds = [False] * n  # the article, or its heading, is inside; comments are no article, even where they are marked up as such
    under = [False] * n
    for i in range(n):
        under[i] = comment[i] or ad[i] or tree.tag[i] in GONE or (i > 0 and under[tree.parent[i]])
    for i in range(n - 1, 0, -1):
        holds[i] = holds[i] or (tree.tag[i] in ("article", "main") and not under[i])
        if holds[i]:
            holds[tree.parent[i]] = True
    inside, left = [False] * n, [True] * n
    for i in range(1, n):
        p, tag, w = tree.parent[i], tree.tag[i], words[i]
        inside[i] = inside[p] or tag in ("article", "main")
        layout = tag in LAYOUT or any(x.startswith("role=") and x[5:] in LAYOUT_ROLES or LAYOUT_WORDS.fullmatch(x) for x in w)
        if tag == "header" and inside[p]:  # the article's own
            layout = False
        gone = tag in GONE or "=hidden" in w or comment[i] or (ad[i] and not holds[i]) or (layout and not holds[i])
        left[i] = left[p] and not gone
    return left


def _points(text: str) -> float:
    return 1 + len(COMMAS.findall(text)) + len(text) / 100


def main_text(html: str | None) -> str:
    """The blocks of the article in page order, two line feeds between."""
    tree = Tree(html or "")
    left, tag, parent, n = _clean(tree), tree.tag, tree.parent, len(tree.tag)
    blocks = [b for b in tree.blocks if left[b[0]]]
    if not blocks:
        return ""
    points, chars, links, anchors = [0.0] * n, [0] * n, [0] * n, [0] * n
    for at, size, linked, text in blocks:
        chars[at] += size
        links[at] += linked
        up, gain, level = at, _points(text) * (1 - linked / size), 0
        while up >= 0 and level < 5:
            if tag[up] in CONTAINERS:
                points[up] += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = parent[up]
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
        links[parent[i]] += links[i]
        anchors[parent[i]] += anchors[i] + (tag[i] == "a")
    density = [links[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (points[i] * (1 - density[i]), -i))
    up = best
    while up >= 0:  # the article around the best part of it
        if tag[up] in ("article", "main"):
            best = up
            if tag[up] == "article":
                break
        up = parent[up]
    top, least = parent[best], 0.2 * points[best] * (1 - density[best])
    def alike(i: int) -> bool:
        """Whether a sibling of the best container belongs to it: containers by points, headings before it, other blocks by length and links."""
        if tag[i] in CONTAINERS:
            return points[i] * (1 - density[i]) >= least
        if re.fullmatch("h[1-6]", tag[i]):
            return i < best
        return density[i] < 0.25 and (chars[i] > 80 or density[i] == 0)

    kept = [i == best or (parent[i] == top >= 0 and left[i] and chars[i] > 0 and alike(i)) for i in range(n)]
    dropped = [False] * n
    for i in range(1, n):
        p = parent[i]
        kept[i] = kept[i] or kept[p]
        dropped[i] = dropped[p] or (i != best and tag[i] in ("ul", "ol", "dl", "div", "section") and anchors[i] >= 3 and density[i] >= 0.8)
    own = top if top >= 0 and tag[best] not in ("article", "main") else -2  # text that stands loose beside the best container
    return "\n\n".join(text for at, size, linked, text in blocks if not dropped[at] and (kept[at] or (at == own and linked < size / 4)))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page; one pass, no shuffle."""
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h if isinstance(h, str) else None) for h in b["h"]]
            yield pd.DataFrame({"i": b["i"], "u": b["u"], "text": texts, "n_chars": [len(t) for t in texts]})

    slim = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    out = slim.mapInPandas(run, f"i {kind}, u {url_kind}, text string, n_chars long")
    return out.select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", "n_chars")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


ORACLE: dict[str, str] = {}
