"""Main text of web pages by composite text density.

A page becomes a tree of blocks. The runs of text between block borders are leaves.
What is never read (scripts, styles, form controls) is skipped; menus, page headers,
footers, sidebars, notices, adverts, forms and reader comments, as their element, role
or class says, are cut off, unless the article lies within. Of each node C are the
characters, T the tags below it, LC the characters in links, LT the links; formatting such
as <b> is no tag. Its density is

    C / T * ln(C T / (LC LT)) / ln(1 + ln(C LC / (C - LC) + C LCb / Cb + e))

with LCb and Cb of the whole body and 1 for a count of zero: long text between few tags
is dense, and links take away the more the more there are. A node's sum is that of its
children's densities; the node with the largest sum, of equals the first, is the main text.
The lowest density on its path to the body is the threshold: subtrees beside the path that
reach it give their own node of the largest sum, as where an article lies in several parts.
Where the page declares no article, blocks of the choice that are thinner than the threshold
go if over a third of them is links or they lie directly in the body. A choice within a
declared article, or else main element, grows to all of it; one that is a mere text block,
as a paragraph or a row, to the block around it.

All of the chosen text is returned: character references decoded, white space in a
block (any Unicode white space, and <br>) made one space, ends trimmed, empty blocks
left out, the others joined by one line feed in page order. A page without text, a null
and an empty html give the empty text. Broken markup is read as browsers do where it
matters here: paragraphs, items, rows and cells close themselves, end tags without a
start are ignored, formatting doesn't reach over blocks, and all that is open ends with
the page. Repeated rows and null ids are pages like others; other columns are ignored;
an empty table gives an empty result. Every page is one row, so it must fit a task; the
work is linear in its length. No shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import bound_batches, texts_of

# Names of HTML elements, and words that pages use for what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNREAD = frozenset("head script style textarea title iframe noembed noframes noscript template svg object audio video canvas map select datalist button input label legend optgroup option progress meter menu".split())
BLOCKS = frozenset("html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section search summary table tbody tfoot thead td th tr ul xmp".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption figure caption summary address tr td th tbody thead tfoot ul ol dl hgroup".split())
LINES = TEXT_BLOCKS - frozenset("ul ol dl tbody thead tfoot".split())
OUTSIDE = frozenset("nav header footer aside form dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar tablist status".split())
NAMES = frozenset("ad ads adbox adsense advert adverts advertisement advertisements advertising adslot sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars widget widgets nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer footers header masthead comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations toolbar pagination pager copyright".split())
NOT_NAMES = frozenset("has with no without not open closed enabled disabled".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Elements that close an open one of the same kind, up to one that holds them.
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"})}
SCOPES = frozenset("table td th caption html body".split())

# every form ends at the page's end at the latest, and nothing is tried twice
TOKEN = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|/[^a-zA-Z][^>]*+(?:>|\Z)|/>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    """A block, or a run of text (``text`` isn't None). ``outside``: it is named as
    something other than the article; ``comment``: as a reader's comment. ``readable``:
    the characters outside links; ``declared``: those in article and main elements."""

    tag: str
    parent: int
    outside: bool = False
    text: str | None = None
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    links: int = 0
    readable: int = 0
    declared: int = 0
    comment: bool = False
    sum: float = 0.0
    density: float = 0.0
    children: list[int] = field(default_factory=list)


@lru_cache(4096)
def named(names: str, by: frozenset[str]) -> bool:
    """Whether a class or id in ``names`` has one of the words."""
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not by.isdisjoint(words) and NOT_NAMES.isdisjoint(words):
            return True
    return False


class Page:
    """The tree of a page: ``nodes`` in page order, the first is the body."""

    def __init__(self, source: str):
        self.nodes = [Node("body", -1)]
        self.open: list[tuple[str, int]] = [("body", 0)]  # open elements and their blocks
        self.now_open = Counter(body=1)  # by name
        self.block = 0  # the innermost open block
        self.parts: list[str] = []  # the run's pieces
        self.run_links = self.run_link_chars = 0
        self.link = self.unread = 0  # how many open links, and unread elements
        self.in_article = 0
        self.read(source)
        self.end_run()

    # --- reading

    def read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if not m:
                self.say(source[at:])
                return
            if m.start() > at:
                self.say(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                close = RAW_ENDS[tag].search(source, at)
                inner = source[at : close.start() if close else n]
                if tag == "xmp":
                    self.say(inner, False)
                at = close.end() if close else n
                self.end(tag)

    def say(self, text: str, references: bool = True) -> None:
        if self.unread:
            return
        text = html.unescape(text) if references and "&" in text else text
        self.parts.append(text)
        if self.link:
            self.run_link_chars += len(" ".join(text.split()))

    def end_run(self) -> None:
        """Make a leaf of the text since the last border of a block."""
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            held = min(self.run_link_chars, len(text))
            self.nodes[self.block].children.append(len(self.nodes))
            self.nodes.append(Node("", self.block, False, text, len(text), self.run_links, held, self.run_links))
        self.parts, self.run_links, self.run_link_chars = [], 0, 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            self.close_head()
            return
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID and tag != "hr":
            return
        block = tag in BLOCKS
        if block:
            self.close_head()
            self.close_paragraph()
            kinds, within = SELF_CLOSING.get(tag, (None, None))
            if kinds:
                self.close_up_to(kinds, within)
            self.end_run()
        if tag == "hr":
            return
        if tag == "a":
            self.close_inline("a")  # links don't nest
        unread = tag in UNREAD
        if block:
            self.nodes[self.block].children.append(len(self.nodes))
            self.nodes.append(Node(tag, self.block))
            self.place(self.nodes[-1], attributes)
            self.block = len(self.nodes) - 1
            self.in_article += tag == "article"
        elif attributes and not unread and not tag == "a":
            unread = self.hidden(attributes)
        self.unread += unread
        if tag == "a":
            self.link += 1
            self.run_links += not self.unread
        # a name of its own for what is hidden, so that its end is known
        self.push(tag if not unread else "!" + tag, self.block)

    def push(self, name: str, block: int) -> None:
        self.open.append((name, block))
        self.now_open[name] += 1

    @staticmethod
    def hidden(attributes: str) -> bool:
        if "hidden" not in attributes.lower() and "none" not in attributes.lower():
            return False
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        return "hidden" in found or bool(HIDDEN.search(found.get("style", "")))

    def place(self, node: Node, attributes: str) -> None:
        """Note whether a block is something other than the article."""
        tag = node.tag
        # an article in an article is a reader's comment; the article's own header stays
        node.comment = tag == "article" and self.in_article > 0
        node.outside = node.comment or tag in OUTSIDE and not (tag == "header" and self.in_article)
        if "=" not in attributes and "hidden" not in attributes:
            return
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if tag not in ("header", "main"):
            node.comment |= named(names, COMMENTS)
            node.outside |= node.comment or tag != "article" and named(names, NAMES)
        node.outside |= found.get("role", "").lower() in ROLES or "hidden" in found or bool(HIDDEN.search(found.get("style", "")))

    # --- closing

    def pop(self) -> None:
        name, _ = self.open.pop()
        self.now_open[name] -= 1
        tag = name.lstrip("!")
        self.unread -= name != tag
        if tag == "a":
            self.link -= 1
        if tag in BLOCKS:
            self.end_run()
            self.in_article -= tag == "article"
        self.block = self.open[-1][1] if self.open else 0

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.pop()

    def close_head(self) -> None:
        if self.now_open["!head"] and self.unread == 1:
            self.pop_to([name for name, _ in self.open].index("!head"))

    def close_paragraph(self) -> None:
        if not self.now_open["p"]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == "p":
                return self.pop_to(k)
            if name in SCOPES or name.startswith("!"):
                return

    def close_up_to(self, kinds: set[str], within: set[str]) -> None:
        """Close the outermost open element of ``kinds`` inside the innermost of ``within``."""
        if not any(self.now_open[name] for name in kinds):
            return
        found = None
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name in within or name.startswith("!"):
                break
            if name in kinds:
                found = k
        if found:
            self.pop_to(found)

    def close_inline(self, tag: str) -> None:
        """Close the innermost such element in this block; what was opened in it stays."""
        if not self.now_open[tag] and not self.now_open["!" + tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0].lstrip("!")
            if name == tag:
                inner = self.open[k + 1 :]
                self.pop_to(k)
                for name, block in inner:
                    self.unread += name.startswith("!")
                    self.link += name.lstrip("!") == "a"
                    self.push(name, block)
                return
            if name in BLOCKS:
                return

    def end(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in ("html", "body"):
            return
        if tag not in BLOCKS and tag not in UNREAD:
            self.close_inline(tag)
            return
        if not self.now_open[tag] and not self.now_open["!" + tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name.lstrip("!") == tag:
                return self.pop_to(k)
            if name.lstrip("!") in SCOPES and tag not in SCOPES and tag not in ("tr", "tbody", "thead", "tfoot", "article", "section", "main", "div", "form"):
                return  # the end of something outside this cell

    # --- choosing

    def measure(self) -> None:
        """Counts of all nodes, bottom up, without what is outside; then densities."""
        nodes = self.nodes
        for node in reversed(nodes):
            if node.text is not None:
                node.readable = node.chars - node.link_chars
            if node.tag in ("article", "main") and not node.outside:
                node.declared = node.readable
            if node.parent >= 0:
                nodes[node.parent].readable += node.readable
                nodes[node.parent].declared += node.declared
        for node in reversed(nodes):
            if node.outside and not self.is_frame(node):
                node.chars = node.tags = node.link_chars = node.links = 0
                node.children = []
            if node.parent >= 0:
                up = nodes[node.parent]
                up.chars += node.chars
                up.tags += node.tags + (node.text is None)
                up.link_chars += node.link_chars
                up.links += node.links
        body = nodes[0]
        share = body.link_chars / max(1, body.chars)
        for node in nodes:
            if node.chars:
                c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.links)
                base = 1 + math.log(c * lc / max(1, c - lc) + c * share + math.e)
                node.density = c / t * max(0.0, math.log(max(1.0, c * t / (lc * lt)))) / math.log(base)
        for node in reversed(nodes):
            if node.children:
                node.sum = math.fsum(nodes[k].density for k in node.children)

    def is_frame(self, node: Node) -> bool:
        """Whether something that is named otherwise is the article's frame: it holds over
        half of the text of declared articles, or, being a form, of a page without any."""
        body = self.nodes[0]
        if body.declared:
            return 2 * node.declared > body.declared and not node.comment
        return node.tag == "form" and 2 * node.readable > body.readable

    def best(self, top: int) -> int:
        """Of the subtree the node of the largest sum; of equals the first."""
        found, order = top, [top]
        while order:
            k = order.pop()
            if self.nodes[k].sum > self.nodes[found].sum * (1 + 1e-12):
                found = k
            order += reversed([c for c in self.nodes[k].children if self.nodes[c].text is None])
        return found

    def grown(self, k: int, top: int) -> int:
        """The declared article around a choice, or the block around a mere text block."""
        path = [k]
        while path[-1] != top and path[-1] > 0:
            path.append(self.nodes[path[-1]].parent)
        for tag in ("article", "main"):
            for at in path:
                if self.nodes[at].tag == tag and not self.nodes[at].outside:
                    return at
        return next((at for at in path if self.nodes[at].tag not in TEXT_BLOCKS), path[-1])

    def chosen(self) -> tuple[list[int], float]:
        """The roots of the main text, and the threshold."""
        self.measure()
        if not self.nodes[0].chars:
            return [], 0.0
        main = self.grown(self.best(0), 0)
        path, at = {main}, main
        while at > 0:
            at = self.nodes[at].parent
            path.add(at)
        threshold = min(self.nodes[k].density for k in path)
        roots, left = [main], [0]
        while left:
            k = left.pop()
            if k == main:
                continue
            for c in self.nodes[k].children:
                node = self.nodes[c]
                if c in path:
                    left.append(c)
                elif node.chars and node.density >= threshold:
                    roots.append(c if node.text is not None else self.grown(self.best(c), c))
        return roots, threshold

    def is_list_of_links(self, node: Node, threshold: float) -> bool:
        """Whether a block that isn't mere text is thinner than the threshold, and over a
        third of it links, or a piece of the page's frame."""
        return node.text is None and node.tag not in LINES and node.density < threshold and (3 * node.link_chars > node.chars or node.parent == 0)

    def text(self) -> str:
        found = []
        left, threshold = self.chosen()
        undeclared = not self.nodes[0].declared
        while left:
            node = self.nodes[k := left.pop()]
            if node.text is not None:
                found.append(k)
            left += [c for c in node.children if not (undeclared and self.is_list_of_links(self.nodes[c], threshold))]
        return "\n".join(self.nodes[k].text for k in sorted(found))


def main_text(source: str) -> str:
    return Page(source).text() if source else ""


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (its code points) of each page."""
    bound_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [main_text(x.decode("utf-8", "replace")) for x in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(list(map(len, said)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
