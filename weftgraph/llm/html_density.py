"""Operator 7: main text of a page by composite text density (Sun, Song, Liao, SIGIR 2011).

Every node's density is its characters per tag, lowered by the share of
characters and tags inside links.  The node whose children's densities have
the largest sum only finds the container of the content: the outermost article
or main around it, else the highest element above it that adds text and not
mostly links, or keeps half of the density.  All of the container is kept,
and beside it every article, every block and every line of text that reaches
the least density on the path to the body.  Elements that HTML itself or their
class or id name as page furniture are left out before.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template iframe svg xmp noframes".split())
_SKIP = _RAW | frozenset("head nav header footer aside form button select option menu dialog canvas audio video annotation annotation-xml".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_INLINE = frozenset("a abbr br wbr b bdi bdo big cite code del dfn em font i ins kbd label map mark math mfrac mi mn mo mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover mover object q s samp semantics small span strike strong sub sup tt u var".split())
#: Elements that HTML names as content: all in them is kept.
_WHOLE = frozenset(("article", "main"))
#: Elements that no name makes furniture.
_NEVER = _WHOLE | frozenset("html body h1 h2 h3 h4 h5 h6".split())
#: An open element of the key is closed by a start tag of the set, inside the nearest of the bounds.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "tbody", "tfoot"}, {"table"}), "td": ({"td", "th", "tr", "tbody"}, {"table"}), "th": ({"td", "th", "tr", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
#: Whole names (of a class list, an id or a role) of page furniture, wherever it stands.
_FURNITURE = re.compile(
    r"(?i)ads?|ad[_-]?(?:box|slot|unit|banner|container|wrapper|block|space|label)s?|advert(?:s|isements?|ising)?|sponsor(?:ed)?[_-](?:links?|content|posts?)|promo[_-]?(?:box|banner|bar)"
    r"|cookies?[_-]?(?:notice|banner|consent|bar|popup|message)|(?:gdpr|consent)[_-](?:notice|banner|bar|popup)|newsletter(?:[_-](?:sign-?up|form|box|subscribe|subscription))?|skip-?link|skip-to-content"
    r"|nav|nav[_-]?(?:bar|menu|links?|list|items?|wrapper|container)|navigation|(?:site|page|main|global|top|bottom|post|posts|primary|secondary|mobile)[_-]?nav(?:igation|bar)?|breadcrumbs?(?:[_-](?:nav|list|trail))?|pagination"
    r"|menubar|(?:site|main|global|top|mobile|primary)[_-]menu|menu[_-](?:items?|list|bar|wrapper)|side-?bar(?:[_-](?:left|right|inner|wrapper|widget))?|(?:left|right|primary|secondary)[_-]side-?bar|site[_-](?:header|footer|banner)"
    r"|comments|comments?[_-](?:list|section|area|form|thread|wrapper|box)|disqus(?:_thread|_comments)?|(?:post|reader|user|article)[_-]comments|comment[_-]?respond"
    r"|(?:share|sharing|social)[_-](?:buttons?|links?|bar|icons?|tools|widgets?|media|share)|social[_-]media[_-](?:links|icons)|(?:post|article|social)[_-](?:share|sharing)|sharedaddy"
    r"|(?:related|recommended)[_-](?:posts?|articles?|links?|stories|content|items|products|reading)"
)
#: Names that are furniture beside the content but may name its parts inside an article or main.
_OUTSIDE = re.compile(
    r"(?i)(?:page|global|top|bottom|main)?[_-]?(?:header|footer)|(?:header|footer)[_-](?:links?|bar|menu|list|wrapper|container|inner|top|bottom|nav|widgets?)|banner|contentinfo|cookies?|menu|masthead|modal|pager|popup|promo|recommendations|respond|toolbar|complementary|search|sponsors?|sponsored|notice|consent|subscribe|share|sharing|social|related|recommend(?:ed|s)?|comment|reply|replies|widgets?|widget[_-]area"
)
_HIDDEN = re.compile(r"(?i)(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)")
_NAMED = re.compile(r"(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


class Node:
    """An element: its parts in page order are strings and nodes."""

    __slots__ = ("tag", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "skipped")

    def __init__(self, tag: str, skipped: bool = False) -> None:
        self.tag, self.parts, self.skipped = tag, [], skipped
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _furniture(tag: str, attributes: str, stack: list[Node]) -> bool:
    """Whether a class, id or role names an element in the open ``stack`` as page furniture."""
    names = [name for a, b, c in _NAMED.findall(attributes) for name in (a or b or c).split()]
    sure = [name for name in names if _FURNITURE.fullmatch(name)]
    if not sure and not any(_OUTSIDE.fullmatch(name) for name in names):
        return False
    if not any(n.tag in _WHOLE for n in stack):
        return True
    # A section of an article may be about menus or navigation; names of two words say more.
    return bool(sure) and (tag != "section" or any(name.lower() == "comments" or re.search("[_-]", name) for name in sure))


def parse(page: str) -> Node:
    """The element tree; unclosed elements end with their parents, stray end tags are ignored."""
    root = Node("html")
    stack, at, end_of = [root], 0, len(page)
    while at < end_of:
        found = _TOKEN.search(page, at)
        if not found:
            stack[-1].parts.append(page[at:])
            break
        if found.start() > at:
            stack[-1].parts.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            # Inline end tags don't close blocks around them.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag in _BLOCK:
                    break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in _BLOCK:
            # A block start ends an open paragraph with all inline elements in it.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _IMPLIED:
            closes, bounds = {k for k, (by, _) in _IMPLIED.items() if tag in by}, _IMPLIED[tag][1]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in closes:
                    del stack[k:]
                    break
        named = "=" in found[3] and tag not in _NEVER and _furniture(tag, found[3], stack)
        node = Node(tag, tag in _SKIP or named or bool(found[3] and tag != "body" and _HIDDEN.search(found[3])))
        stack[-1].parts.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end_of
        elif tag not in _VOID and not found[3].endswith("/"):
            stack.append(node)
    return root


def _count(node: Node) -> None:
    """Characters and tags of a node whose children have theirs."""
    for part in node.parts:
        if isinstance(part, str):
            node.chars += len("".join(part.split()))
        elif not part.skipped:
            node.chars += part.chars
            node.tags += part.tags + 1
            node.link_chars += part.link_chars
            node.link_tags += part.link_tags
    if node.tag == "a":
        node.link_chars, node.link_tags = node.chars, node.tags + 1


def _weigh(node: Node, share: float) -> None:
    chars, links = node.chars, node.link_chars
    if chars:
        base = max(e, chars * links / max(1, chars - links) + share * chars + e)
        node.density = chars / max(1, node.tags) * log(max(1.0, chars / max(1, links) * max(1, node.tags) / max(1, node.link_tags)) + 1) / log(base)


def _measure(root: Node) -> None:
    """Counts and densities, children before parents, without recursion."""
    order, queue = [], [root]
    while queue:
        node = queue.pop()
        order.append(node)
        queue += [p for p in node.parts if isinstance(p, Node) and not p.skipped]
    for node in reversed(order):
        _count(node)
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in order:
        _weigh(node, share)
    # Marks inside a line are tags of their block, not parts of the page of their own.
    for node in order:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.skipped and p.tag not in _INLINE)


def _children(node: Node) -> list[Node]:
    return [p for p in node.parts if isinstance(p, Node) and not p.skipped]


def _path(body: Node) -> list[Node]:
    """The way from the body to the node of the largest density sum."""
    best, above, queue = body, {}, [body]
    while queue:
        now = queue.pop()
        if now.total > best.total:
            best = now
        for child in reversed(_children(now)):
            if child.parts and child.tag not in _INLINE:
                above[child] = now
                queue.append(child)
    path = [best]
    while path[-1] in above:
        path.append(above[path[-1]])
    return path[::-1]


def _container(path: list[Node]) -> Node:
    """What holds the whole content around the last node of the path."""
    for node in path:
        if node.tag in _WHOLE:
            return node
    node = path[-1]
    for parent in reversed(path[:-1]):
        linked = 2 * (parent.link_chars - node.link_chars) > parent.chars - node.chars
        if linked and 2 * parent.density < path[-1].density:
            break
        node = parent
    return node


def _lines(node: Node) -> list[Node]:
    """The parts of a node, each run of text and inline elements as a node of its own."""
    out: list[Node] = []
    for part in node.parts:
        if isinstance(part, Node) and part.tag not in _INLINE:
            out.append(part)
            continue
        if not out or out[-1].tag:
            out.append(Node(""))
        out[-1].parts.append(part)
    return out


def _blocks(node: Node, out: list[str], inline: list[str]) -> None:
    """Texts of the blocks under ``node`` in page order; iterative, as pages may nest deeply."""

    def flush() -> None:
        text = " ".join(html.unescape("".join(inline)).split())
        if text:
            out.append(text)
        inline.clear()

    stack = [iter([node])]
    owners: list[Node] = []
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            if owners and owners.pop().tag in _BLOCK:
                flush()
        elif isinstance(part, str):
            inline.append(part)
        elif part.tag == "br":
            inline.append(" ")
        elif not part.skipped:
            if part.tag in _BLOCK:
                flush()
            owners.append(part)
            stack.append(iter(part.parts))
    flush()


def main_text(page: str | None) -> str:
    """Main text of a page: blocks joined by an empty line, '' if there is none."""
    if not page:
        return ""
    root = parse(page)
    _measure(root)
    if not root.chars:
        return ""
    body = next((c for c in _children(root) if c.tag == "body"), root)
    path = _path(body)
    container, threshold, above = _container(path), min(n.density for n in path), set(path)
    share = body.link_chars / max(1, body.chars)
    kept, queue = [], [body]
    while queue:
        node = queue.pop()
        if not node.tag:
            _count(node)
            _weigh(node, share)
        if node.skipped:
            continue
        if node is container:
            kept.append(node)
        elif node in above:
            queue += reversed(_lines(node))
        elif node.chars > node.link_chars and (node.tag in _WHOLE or node.density >= threshold and (not node.tag or node.tag in _BLOCK)):
            kept.append(node)
    out: list[str] = []
    for node in kept:
        _blocks(node, out, [])
    return "\n\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    Returns one row per input row: ``id_col``, ``url_col``, ``text`` (blocks in
    page order joined by two line ends; empty if there is none) and ``n_chars``
    (its code points).

    A null or empty page has no text; broken markup is read as browsers do in
    the main (unclosed elements end with their parents); ids and addresses may
    be null or repeated; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long"
    return rows.mapInArrow(_extracted, schema).withColumnsRenamed({"id": id_col, "url": url_col})
