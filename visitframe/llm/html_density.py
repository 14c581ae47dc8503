"""Main text of web pages by composite text density.

A page becomes a DOM. Every node gets its composite text density: characters per tag, adjusted by
the share of characters and tags in links against the page's. The densities of a node's children
are summed; the node with the largest sum (of equal ones the first in page order) is the core of
the article. The smallest density on its path to the body is the threshold: what lies beside the
path and reaches it belongs to the article as well. So do headings beside the path, text that lies
directly in a node of the path, and, in the innermost node of the path that holds other text, all that isn't
mostly links: titles and short paragraphs around the core. If the core lies in an article or
main element, that element is taken whole; if it holds some, those that reach the threshold
stand for it.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments by readers)
goes before. Tags such as nav, footer or script go always. Roles, class or id names, form and header only mark
an element. A name counts if a whole class token is one (`sidebar`), ends in one (`left-sidebar`) or is one among words
of layout (`comment-list`, `google-ad-container`), and not if it says `has`, `no` or `with` (`has-sidebar`). A mark is a vote
that text can outweigh:

* while unmarked elements hold less than half of the body's text that is in no link, the name that
  marks most of the rest counts for nothing, wherever it stands, unless a top heading, article or main element lies outside of
  its elements: pages are built of blocks that share one name. Names of comments need nearly all of the text for that;
* an element stays if it holds a top heading or main element, or most of the body's text that is in no
  link while no top heading, article or main element lies outside of it;
* names that authors give to parts of their text (WEAK) don't remove paragraphs and quotes, nor, inside an article, boxes, as long
  as these aren't mostly links.

Blocks: text between block elements; character references are decoded in each text node, white
space runs turn into one space, blocks are trimmed and joined by two line breaks in page order.

Parsing, pruning and measuring are linear in the page: each node knows which open element a tag
would close, so no tag searches the stack.

Defined cases: null or empty html, or a page without text, gives the empty string; unclosed and
misnested tags close as browsers close them; text outside any tag belongs to the body; from a tag
whose quotes never close, the rest of the page is read without quotes; equal rows, null ids included,
give equal results; a column of the input named `text` is replaced; long pages are taken whole, each in a slice
of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from visitframe.llm.common import text_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
#: The same without quotes.
PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)()()()", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr option optgroup html body legend".split())
#: Start tags that close an open element, and which: the nearest in the reach of Node's fields.
IMPLIED = {"li": "li", "dt": "dd", "dd": "dd", "tr": "row", "td": "cell", "th": "cell", "option": "option"}
#: Elements that go always.
FURNITURE = frozenset(
    "head script style noscript template svg math iframe object canvas audio video nav footer aside button select "
    "textarea input label dialog menu title noembed noframes".split()
)
#: Elements and roles that mark what probably isn't the article.
MARKS = frozenset("form header".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert status form menu menubar toolbar "
    "tablist tooltip".split()
)
#: Class and id names that mark.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promotions banner "
    "notice notices alert announcement announcements sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing "
    "related popup modal overlay pagination pager toolbar widget widgets comment comments discussion disqus respond reply replies login signup "
    "search skip gdpr consent cookie cookies newsletter subscribe subscription teaser teasers topbar recommended recommendations outbrain "
    "taboola".split()
)
#: Names that authors also give to parts of their text: those of paragraphs, and those of boxes in an article.
WEAK = frozenset("comment menu promo teaser teasers widget widgets".split())
BOXES = frozenset("menu teaser teasers widget widgets".split())
PASSAGES = frozenset("p blockquote pre figcaption span em strong b i h1 h2 h3 h4 h5 h6".split())
#: Names of comments by readers.
REMARKS = frozenset("comment comments discussion disqus respond reply replies".split())
#: Words of layout that may surround a name, and words that turn it round.
LAYOUT = frozenset(
    "area articles bar banner block body box button buttons cell col column container content entry fixed form global google group header "
    "holder inner item items left links list main message mobile notice outer overlay page panel popup posts primary right row secondary section "
    "site slot sticky stories sub text thread title top unit wrap wrapper x zone".split()
)
TURNED = frozenset("has no not non with without".split())
#: Compounds that mark: what a header or bar belongs to, and whole tokens.
HEADERS = frozenset("app blog fixed global main masthead mobile page primary secondary site sticky top".split())
BARS = frozenset("admin announcement bottom info menu nav notification side social tool top utility".split())
#: Elements that hold single comments.
ITEMS = frozenset("div article section ol ul li".split())
TOKENS = frozenset("cc-window cc-banner author-bio author-box author-info about-author about-the-author".split())


class Node:
    __slots__ = (
        "tag", "parent", "parts", "hard", "mark", "whole", "by_id", "block", "inline", "li", "dd", "row", "cell", "option",
        "headings", "mains", "articles", "chars", "tags", "link_chars", "link_tags", "density", "sum",
    )

    def __init__(self, tag: str, parent: Node | None, raw: str = ""):
        self.tag, self.parent = tag, parent
        self.hard, self.mark, self.whole, self.by_id = _judge(tag, raw)
        self.parts: list[str | Node] = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _named(names: str) -> str:
    """The name by which class or id tokens mark an element; empty if they don't."""
    for token in names.split():
        if token.lower() in TOKENS:
            return token.lower()
        words = [w.lower() for w in NAME_PART.findall(token)]
        if not words or not TURNED.isdisjoint(words):
            continue
        last, before = words[-1], words[:-1]
        if last in NAMES:
            return "menubar" if last == "menu" and LAYOUT.issuperset(before) else last
        if (last == "header" and HEADERS.issuperset(before)) or (last == "bar" and before and before[-1] in BARS):
            return last
        for k, w in enumerate(before):
            if w in NAMES and LAYOUT.issuperset(words[k + 1 :]) and LAYOUT.issuperset(words[:k]):
                return "menubar" if w == "menu" else w
            if w == "header" and k < 2 and LAYOUT.issuperset(words[k + 1 :]) and HEADERS.issuperset(words[:k]):
                return w
    return ""


def _judge(tag: str, raw: str) -> tuple[bool, str, bool, bool]:
    """Whether the element goes always, the name by which it is marked, whether it is an article or the main content, and whether
    its id gave the name. Comments are often articles of their own, so articles can be marked."""
    if tag in FURNITURE:
        return True, "", False, False
    whole, mark = tag == "article" or tag == "main", tag if tag in MARKS else ""
    if not raw or raw == "/":
        return False, mark, whole, False
    a = _attributes(raw)
    role = a.get("role", "").lower()
    whole = whole or role in ("main", "article")
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    mark = mark or (role if role in ROLES else "") or _named(a.get("class", ""))
    by_id = not mark and bool(mark := _named(a.get("id", "")))
    return hidden, "" if tag == "main" or role == "main" else mark, whole, by_id


def _push(stack: list[Node], node: Node) -> None:
    """Open node: what a later tag would close is known from its parent in one step."""
    up = stack[-1]
    node.block = node.tag in BLOCK
    # inline elements that are open below the nearest block
    node.inline = {} if node.block else up.inline
    through = not node.block or node.tag in ("address", "div", "p")
    node.li = node if node.tag == "li" else up.li if through else None
    node.dd = node if node.tag in ("dt", "dd") else up.dd if through else None
    table = node.tag == "table"
    node.row = node if node.tag == "tr" else None if table else up.row
    node.cell = node if node.tag in ("td", "th") else None if table or node.tag == "tr" else up.cell
    node.option = node if node.tag == "option" else None if node.tag == "select" else up.option
    if not node.block:
        node.inline[node.tag] = node.inline.get(node.tag, 0) + 1
    stack.append(node)


def parse(page: str) -> Node:
    """The page's body."""
    root = Node("body", None)
    root.block, root.inline = True, {}
    root.li = root.dd = root.row = root.cell = root.option = None
    stack, blocks = [root], [root]
    opened: Counter[str] = Counter()

    def close(last: Node) -> None:
        """Close open elements up to and with `last`."""
        while True:
            node = stack.pop()
            if node.block:
                blocks.pop()
                opened[node.tag] -= 1
            else:
                node.inline[node.tag] -= 1
            if node is last:
                return

    at, n, token = 0, len(page), TOKEN
    while at < n:
        m = token.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack[-1].parts.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[5]:
            token = PLAIN_TOKEN
        if m[1] or m[4]:
            if tag in BLOCK:
                if opened[tag]:
                    while blocks[-1].tag != tag:
                        close(blocks[-1])
                    close(blocks[-1])
            elif stack[-1].inline.get(tag):  # an inline end tag doesn't reach through a block
                while stack[-1].tag != tag:
                    close(stack[-1])
                close(stack[-1])
            continue
        raw = m[3] or m[6] or ""
        if tag in ("html", "body"):
            continue
        top = stack[-1]
        if tag in IMPLIED and (last := getattr(top, IMPLIED[tag]) or (top.cell if tag == "tr" else None)):
            close(last)
        elif tag in CLOSES_P and blocks[-1].tag == "p":
            close(blocks[-1])
        node = Node(tag, stack[-1], raw)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            node.hard = True
            at = end.end() if end else n
        elif tag not in VOID and not raw.endswith("/") or tag in BLOCK - VOID:
            _push(stack, node)
            if node.block:
                blocks.append(node)
                opened[tag] += 1
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [part for part in reversed(node.parts) if isinstance(part, Node)]
    return order


def _ignored(root: Node) -> set[str]:
    """Names whose marks count for nothing, since the elements they mark are what the page is built of."""
    free: set[str] = set()
    while True:
        text: Counter[str] = Counter()
        heads: Counter[str] = Counter()
        todo = [root]
        while todo:
            for part in todo.pop().parts:
                if not isinstance(part, Node):
                    continue
                if part.mark and part.mark not in free:
                    text[part.mark] += part.chars
                    heads[part.mark] += part.headings + part.mains + part.articles
                else:
                    todo.append(part)
        rest = root.chars - text.total()
        if 2 * rest >= root.chars:
            return free
        outside = root.headings + root.mains + root.articles
        able = [k for k in text if text[k] and heads[k] == outside and (k not in REMARKS or 8 * rest < root.chars)]
        if not able:
            return free
        free.add(max(able, key=lambda k: (text[k], k)))


def prune(root: Node) -> list[Node]:
    """Take furniture out; the remaining nodes, parents first, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.hard]
        todo += [p for p in node.parts if isinstance(p, Node)]
    order = _nodes(root)
    for node in reversed(order):  # what each element holds: top headings, main elements, articles, text in no link, all text
        node.headings = node.mains = node.articles = node.chars = node.link_chars = 0
        for part in node.parts:
            if isinstance(part, str):
                n = len("".join(part.split()))
                node.chars += n
                node.link_chars += n
            else:
                node.chars += part.chars
                node.link_chars += part.link_chars
                if not (part.tag == "header" and part.mark):
                    node.headings += part.headings + (part.tag == "h1")
                    node.mains += part.mains + (part.whole and part.tag != "article")
                    node.articles += part.articles + (part.whole and not part.mark)
        if node.tag == "a":
            node.chars = 0
    free = _ignored(root)

    def stays(node: Node, inside: bool) -> bool:
        if node.tag == "header" and inside and (node.headings or node.density):
            return True
        if node.tag == "article":
            return node.headings > 0
        if node.mains or (node.headings and node.tag != "header"):
            return True
        alone = root.headings == node.headings and root.articles == node.articles
        return alone and 2 * node.chars > root.chars

    def reads(node: Node, inside: bool) -> bool:
        """Whether an element with a weak name is a part of the text."""
        if 2 * node.chars <= node.link_chars:
            return False
        if node.mark == "discussion":  # of a paper
            return node.tag == "section" and node.by_id and not any(isinstance(p, Node) and p.tag in ITEMS for p in node.parts)
        if node.mark not in WEAK:
            return False
        return node.tag in PASSAGES and (inside or node.mark != "comment") or inside and node.mark in BOXES

    for node in reversed(order):  # of a header: whether it holds any heading
        node.density = any(isinstance(p, Node) and (p.density or p.tag in HEADINGS) for p in node.parts)
    kept, walk = [], [(root, False)]
    while walk:
        node, inside = walk.pop()
        kept.append(node)
        inside = inside or node.whole
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.mark or p.mark in free or stays(p, inside) or reads(p, inside)]
        walk += [(p, inside) for p in reversed(node.parts) if isinstance(p, Node)]
    return kept


def measure(order: list[Node]) -> None:
    """Characters, tags, links, densities and density sums, children first."""
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, Node):
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
            else:
                node.chars += len("".join(part.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    body = order[0]
    ratio = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        node.density = 0.0
        if node.chars:
            tags, c, lc = max(node.tags, 1), node.chars, node.link_chars
            base = math.log(math.log(c / max(c - lc, 1) * lc + ratio * c + math.e))
            adjust = math.log(c / max(lc, 1) * tags / max(node.link_tags, 1)) / base if base > 1e-12 else 1.0
            node.density = c / tags * adjust
        node.sum = sum(part.density for part in node.parts if isinstance(part, Node))


def belongs(part: Node, threshold: float, near: bool) -> bool:
    """Whether what lies beside the path is of the article."""
    if part.density >= threshold or part.tag in HEADINGS or part.tag not in BLOCK:
        return True
    return near and 2 * part.link_chars < part.chars


def choose(order: list[Node], semantic: bool = True) -> list[Node | str]:
    """Subtrees and texts that make the article, in page order. Without `semantic`, article and main elements
    are nodes like any other."""
    core = max(order, key=lambda v: v.sum)
    path, node = [], core
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(v.density for v in path)
    enclosing = [k for k, v in enumerate(path) if v.whole] if semantic else []
    chosen: list[Node | str] = [core]
    near = True
    if enclosing:
        articles = [k for k in enclosing if path[k].tag == "article"]
        path = path[(articles or enclosing)[-1] :]
        chosen = [path[0]]
    elif semantic and (inner := [v for v in _maximal(core) if v.chars and v.density >= threshold]):
        return inner
    elif core is order[0]:  # the body has nothing beside it: its children are judged like siblings
        return [p for p in core.parts if isinstance(p, str) or (p.chars and belongs(p, threshold, True))]
    for below, above in zip(path, path[1:], strict=False):
        parts = [v for v in above.parts if v is below or isinstance(v, str) or v.chars]
        at = next(k for k, v in enumerate(parts) if v is below)
        kept = [v if isinstance(v, str) or v is below or belongs(v, threshold, near) else None for v in parts]
        chosen = [v for v in kept[:at] if v is not None] + chosen + [v for v in kept[at + 1 :] if v is not None]
        if any(v is not below and (v.strip() if isinstance(v, str) else v.chars) for v in parts):
            near = False
    return chosen


def _maximal(root: Node) -> list[Node]:
    """The outermost article and main elements below root, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.whole and node is not root:
            found.append(node)
        else:
            todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return found


def render(roots: list[Node | str]) -> str:
    blocks: list[str] = []
    own: list[str] = []

    def flush() -> None:
        if own:
            if text := " ".join("".join(own).split()):
                blocks.append(text)
            own.clear()

    for root in roots:
        todo: list[Node | str | None] = [root]
        while todo:
            part = todo.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                own.append(part)
            elif part.tag in ("br", "wbr", "img"):
                own.append(" " if part.tag == "br" else "")
            else:
                if part.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(part.parts)
    flush()
    return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order = prune(parse(page))
    measure(order)
    return render(choose(order)) if order[0].chars else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without `html`, plus `text`: the main text of every page."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text")]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, n):
                texts = [main_text(p) for p in batch.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=names)

    names = [f.name for f in kept] + ["text"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return pages.select(*[f"`{f.name}`" for f in kept], f"`{html}`").mapInArrow(run, f"{kinds}text string")
