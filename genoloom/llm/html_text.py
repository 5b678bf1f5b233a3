"""Main text of web pages by composite text density.

A tolerant reader makes a tree of the page. What can't be article text goes first: scripts, styles, forms,
navigation, headers, footers, sidebars, notices, adverts and reader comments, known by their elements, roles,
and the words of their class and id (``_settle``): a name of a comment section, an advert, a newsletter, a notice or the like stands for
itself, wherever the element stands; names of page furniture and of related matter, and forms, are hints that content overrules. For every node left, the composite text density is
``C/T * log(C*T/(LC*LT)) / log(ln(C*LC/nLC + LCb*C/Cb + e))``, of characters C, tags T, link characters LC,
link tags LT, characters outside links nLC, and those of the body; a node's density sum is that of its
children. The node with the largest sum, and those subtrees whose density reaches the least density on
the path from it to the body, are the article, without blocks of links in them. Elements such as ``article`` or ``main``
only keep what stands in them from being taken for a page's header or for what names speak against.

Blocks are what block-level elements set apart; a line break inside a block is white space. Character
references are decoded as HTML5 does. Nothing is capped.

Defined results: null html is empty and gives an empty text; a page without any text gives an empty text;
a page that is plain text gives that text; a null id or url stays null; repeated rows stay separate; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)?|[\"'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: A start tag of the key ends an open element of the values, up to one of the limits.
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _BLOCK - frozenset("html body td th tr tbody thead tfoot caption".split())
_SAME = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

#: Elements and roles that are never article text.
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas math audio video form button input select textarea option nav aside footer menu dialog title noembed noframes xmp map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class or id. What is named so isn't the article's, wherever it stands;
KINDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies share sharing".split())
#: furniture, which an article may be built in;
FURNITURE = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside widget widgets banner banners pagination pager toolbar skip".split())
#: and what may be the article's own.
RELATED = frozenset("header social related recommended recommendations".split())
#: Beside words of a kind in one name, these leave the kind as it is; others (``social-science``) make it a mere hint.
NEUTRAL = frozenset("area article author bar blog block body bottom box button buttons container content count entry form group icons inline inner item items js left link links list main media message meta module news outer page panel post primary reader readers right row secondary section site slot story text thread title top unit user users wrap wrapper".split())
STATES = frozenset("has no not with without is".split())
SOFT, FIRM, STRONG = 1, 2, 3
#: Words of a sentence that may stand for prose.
PROSE_WORDS = 8
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("chars", "children", "dropped", "end", "hint", "link_chars", "link_tags", "parent", "parts", "score", "sum", "tag", "tags", "words")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped, self.hint = tag, parent, dropped, 0
        self.parts: list = []  # texts and nodes in order
        self.children: list[Node] = []


def _refused(tag: str, attrs: str, inside: bool) -> bool:
    """inside: an article or main element."""
    if tag in DROPPED and tag != "form" or tag == "header" and not inside:
        return True
    if not attrs.strip(" /") or tag in ("html", "body", "article", "main", "h1"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _hinted(tag: str, attrs: str) -> int:
    """How much the element's names in class and id speak against it."""
    hint = SOFT if tag == "form" else 0
    if not attrs.strip(" /") or tag in ("html", "body", "main", "h1"):
        return hint
    for name, a, b, c in _ATTR.findall(attrs):
        if name.lower() in ("class", "id"):
            for token in (a or b or c).split():
                words = [w for w in (w.lower() for w in _SPLIT.split(token)) if w]
                if not words or words[0] in STATES:
                    continue
                known = [STRONG if w in KINDS else FIRM if w in FURNITURE else SOFT if w in RELATED else 0 for w in words]
                if any(known):
                    plain = all(k or w in NEUTRAL for k, w in zip(known, words, strict=True))
                    hint = max(hint, max(known) if plain else SOFT)
    return hint


def _settle(root: Node) -> None:
    """Drop the elements that hints speak against, from the outermost.

    A strong hint drops its element unless that holds a main element, an article of good name or the page's first heading. Others drop theirs
    unless it holds a main element or such an article, or, on a page without these, half of the text. A soft one also spares prose inside
    an article or main element: no link, a sentence's length and end. All stay where nothing else would be left.
    """
    order = _measure(root)
    if not any(x.hint for x in order):
        return
    holds, heads = {}, {}
    for x in order:
        holds[id(x)] = any(holds[id(c)] or c.tag == "main" or c.tag == "article" and not c.hint for c in x.children)
        heads[id(x)] = x.tag == "h1" or any(heads[id(c)] for c in x.children)
    stack, lost = [(root, False)], []
    while stack:
        x, inside = stack.pop()
        inside = inside or x.tag in ("article", "main")
        for c in x.children:
            if c.hint == STRONG:
                drop = not holds[id(c)] and not heads[id(c)] and (c.tag != "article" or holds[id(root)])
            else:
                drop = c.hint and c.tag != "article" and not holds[id(c)] and (holds[id(root)] or 2 * c.chars < root.chars)
                drop = drop and not (c.hint == SOFT and inside and c.tag != "form" and not c.link_chars and c.words >= PROSE_WORDS and c.end.rstrip("\"'”’)").endswith((".", "!", "?", "…", "。")))
            if drop:
                lost.append(c)
            else:
                stack.append((c, inside))
    if sum(c.chars for c in lost) < root.chars:
        for c in lost:
            c.parent.children.remove(c)
            c.dropped = True


def tree(page: str) -> Node:
    """The page's nodes, without those that are dropped by what they are."""
    root = Node("html", None)
    path: list[Node] = [root]
    depths: dict[str, list[int]] = {}  # of the open elements of a name
    at, n = 0, len(page)

    def leave(depth: int):
        while len(path) > depth:
            depths[path.pop().tag].pop()

    def nearest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(tags, limits=()):
        """Leave the nearest open element of ``tags``, unless one of ``limits`` is nearer."""
        if (here := nearest(tags)) and here >= nearest(limits):
            leave(here)

    while at < n:
        k = page.find("<", at)
        m = _TAG.match(page, k) if k >= 0 else None
        while k >= 0 and m is None:
            k = page.find("<", k + 1)
            m = _TAG.match(page, k) if k >= 0 else None
        node = path[-1]
        text = page[at : k if k >= 0 else n]
        if text and not node.dropped:
            node.parts.append(_html.unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "p":
                close(("p",), ("td", "th", "article", "section", "div", "li", "main", "body"))
            elif tag in _HEADS:
                close(_HEADS, ("td", "th", "article", "section", "div", "main", "body"))
            elif tag not in _VOID and tag not in ("html", "body"):
                close((tag,), ("td", "th", "table") if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else ("table",) if tag != "table" else ())
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P:
            close(("p",), ("td", "th", "article", "section", "div", "li", "main", "button", "table", "blockquote"))
        if tag in _SAME:
            close(*_SAME[tag])
        if tag in _HEADS and path[-1].tag in _HEADS:
            leave(len(path) - 1)
        node = path[-1]
        if tag in _VOID:
            if not node.dropped:
                node.parts.append("\n" if tag == "hr" else " " if tag == "br" else "")
                if tag == "hr":
                    node.parts[-1] = Node("hr", node)
            continue
        if tag != "head" and node.tag == "head" and tag in _BLOCK:
            leave(len(path) - 1)
            node = path[-1]
        child = Node(tag, node, node.dropped or _refused(tag, m["attrs"], bool(nearest(("article", "main")))))
        child.hint = not child.dropped and _hinted(tag, m["attrs"])
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            at = (page.find(">", at) + 1 or n) if end else n
            continue
        if not m["attrs"].endswith("/") or tag in _BLOCK or tag == "a":
            node.parts.append(child)
            if not child.dropped:
                node.children.append(child)
            depths.setdefault(tag, []).append(len(path))
            path.append(child)
    _settle(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes, children first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += x.children
    order.reverse()
    for x in order:
        own, x.words, x.end = 0, sum(c.words for c in x.children), ""
        for p in x.parts:
            if isinstance(p, str):
                words = p.split()
                own += sum(map(len, words))
                x.words += len(words)
                x.end = words[-1][-8:] if words else x.end
            elif not p.dropped and p.tag != "hr":
                x.end = p.end or x.end
        x.chars = own + sum(c.chars for c in x.children)
        x.tags = sum(c.tags + 1 for c in x.children)
        x.link_chars = x.chars if x.tag == "a" else sum(c.link_chars for c in x.children)
        x.link_tags = sum(c.link_tags + (c.tag == "a") for c in x.children)
    c_b, lc_b = max(root.chars, 1), root.link_chars
    for x in order:
        c, t, lc, lt = x.chars, max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
        if not c:
            x.score = 0.0
        else:
            base = math.log(c / max(c - x.link_chars, 1) * x.link_chars + lc_b / c_b * c + math.e)
            ratio = c * t / (lc * lt)
            x.score = c / t * (math.log(ratio) / math.log(base) if base > 1 + 1e-9 else math.log(ratio) / 1e-3) if ratio > 0 else 0.0
        x.sum = sum(y.score for y in x.children)
    return order


def _path(x: Node):
    while x is not None:
        yield x
        x = x.parent


def _links(x: Node, most: int = 2) -> bool:
    return x.tag in ("div", "section", "ul", "ol", "table") and x.link_tags > most and x.link_chars > 0.8 * x.chars


def _unlinked(top: Node) -> Node:
    """``top`` without the blocks in it that are links and little else."""
    stack = [top]
    while stack:
        x = stack.pop()
        for c in list(x.children):
            if _links(c):
                x.children.remove(c)
                c.dropped = True
            else:
                stack.append(c)
    return top


def content(root: Node) -> list[Node]:
    """The subtrees that are the article, in page order, without blocks of links unless there is nothing else."""
    chosen = _chosen(root)
    return [_unlinked(x) for x in chosen if not _links(x)] or chosen


def _chosen(root: Node) -> list[Node]:
    order = _measure(root)
    best = max(order, key=lambda x: (x.sum, x.chars), default=root)
    if best.sum <= 0:
        return [root]
    least = min(x.score for x in _path(best))
    peak = {}
    for x in order:  # children first
        peak[id(x)] = max((peak[id(c)] for c in x.children), key=lambda y: y.sum, default=x)
        if x.sum >= peak[id(x)].sum:
            peak[id(x)] = x
    marked, stack = {}, [root]
    while stack:
        x = stack.pop()
        if x.score >= least and x.chars:
            y = peak[id(x)]
            marked[id(y)] = y
            stack += x.children
    tops, stack = [], [root]
    while stack:
        x = stack.pop()
        if id(x) in marked:
            tops.append(x)
        else:
            stack += x.children[::-1]
    marked = tops
    # headings and texts between the first and the last of them, under what holds them all
    paths = [list(_path(x))[::-1] for x in marked]
    depth = 0
    while all(len(p) > depth + 1 for p in paths) and len({id(p[depth]) for p in paths}) == 1 and len({id(p[depth + 1]) for p in paths}) == 1:
        depth += 1
    holder = paths[0][depth]
    heads = ("h1", "h2", "header", "hgroup")
    if len(marked) == 1 and (up := marked[0].parent) is not None:
        holder, on = up, [up.children.index(marked[0])]
    else:
        on = [i for i, c in enumerate(holder.children) if any(c is p[depth + 1] for p in paths if len(p) > depth + 1)]
    if not on:
        return [holder]
    first = min(on)
    while first and holder.children[first - 1].tag in heads:
        first -= 1
    chosen = set(on)
    # what stands between is the article's but for links, however few
    return [c for i, c in enumerate(holder.children[first : max(on) + 1], first) if i in chosen or not _links(c, 0)]


def blocks(nodes: list[Node]) -> list[str]:
    out, now = [], []

    def flush():
        if now:
            if text := " ".join("".join(now).split()):
                out.append(text)
            now.clear()

    for top in nodes:
        flush()
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif not x.dropped:
                inner = x.parts[::-1]
                stack += [None, *inner, None] if x.tag in _BLOCK else inner
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    return "\n".join(blocks(content(tree(page))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 256):
                own = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([main_text(t.as_py()) for t in own.column(2)], pa.string())], names=["id", "url", "text"])

    out = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
