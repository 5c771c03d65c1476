"""Main-text extraction from HTML by tree scoring.

Paragraphs pass points (one each, one per comma, one per 100 characters up to
three) to their parent, half to the grandparent and a third to the next one. A
container's points are discounted by its link density, and what leaves a box named
like a sidebar, an advert or the like counts a tenth. The best container and
those of its siblings that score well, or are long paragraphs with few links,
make up the main text; boxes so named within it are left out.

A page is read once from start to end and every step is linear in its length: of
open elements the innermost of each name is known without a search.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

#: Elements whose content isn't markup.
RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of the main text, with all inside them.
DROPPED = RAW | frozenset("head template nav footer aside form button select option datalist menu dialog svg math canvas object audio video map label fieldset".split())
BLOCK = frozenset(
    "address article blockquote body center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4".split())
HEADINGS = frozenset("h1 h2 h3".split())
BOXES = frozenset("div section article main body center html".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
CELLS = ("td", "th", "caption", "table")
#: What ends an open paragraph.
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul search".split())
#: What an element closes when it begins, and beyond which open elements it doesn't look.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr"), ("table",))),
}
HEAD_ONLY = frozenset("meta link base title style script noscript template head html".split())

#: Where something other than text begins.
MARK = re.compile(r"<(?=[!?/a-zA-Z])")
NAME = re.compile(r"[^\s/>]+")
#: An attribute, or the end of the tag. A quote that never closes is part of a name, so that it can't swallow the page.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*+)))?)")
COMMENT_END = re.compile(r"--!?>")

#: Names of boxes that aren't part of an article, as words of class, id or role.
MARKED = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright crumbs
    discussion disqus foot footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications outbrain overlay pager pagination popup promo promoted promotion
    recommended related replies reply respond responses search share sharing shoutbox sidebar sidebars signup social sponsor sponsored subscribe subscription taboola tags toolbar tooltip topbar alert alertdialog dialog
    widget""".split()
)
#: Words that such names may have before and after theirs.
AROUND = frozenset(
    """site page main top bottom global left right primary secondary post article entry user reader js l c block section box wrap wrapper list area container bar body item items link links unit slot inner outer content
    form text title group panel row holder zone posts articles stories news buttons icons count first last""".split()
)
GLUED = re.compile(rf"(?:sidebar|footer|navbar|cookie|comments?|newsletter|advert)(?:{'|'.join(sorted(AROUND))})")
LIKELY = frozenset("article body content entry main post story text".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("name", "parent", "children", "names", "hidden", "points", "chars", "linked", "heading")

    def __init__(self, name: str, parent: Node | None, names: tuple[str, ...] = (), hidden: bool = False):
        self.name, self.parent, self.names, self.hidden = name, parent, names, hidden
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked, self.heading = 0.0, 0, 0, False

    @property
    def marked(self) -> bool:
        """Whether a class, id or role names a box that is no part of an article."""
        return self.name not in ("body", "html", "main") and any(map(_is_marked, self.names))

    @property
    def likely(self) -> bool:
        return any(w in LIKELY for n in self.names for w in re.split(r"[-_]", n))


@lru_cache(maxsize=4096)
def _is_marked(name: str) -> bool:
    """Whether all words of a name are ones of MARKED and AROUND, some of the first."""
    words = [w.rstrip("0123456789") for w in re.split(r"[-_]+", name)]
    told = [w in MARKED or GLUED.fullmatch(w) is not None for w in words]
    return any(told) and all(t or not w or w in AROUND for t, w in zip(told, words, strict=True))


class _Open:
    """The elements that are open, with the places of each name among them."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {root.name: [0]}, [0]

    @property
    def here(self) -> Node:
        return self.stack[-1]

    def last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def inner(self, names: Iterable[str], scope: Iterable[str]) -> int:
        """The place of the innermost open element of these names, or -1 if one of scope is further in."""
        at = self.last(names)
        return at if at > self.last(scope) else -1

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, at: int, ended: bool = False) -> None:
        """Close the element at this place (never the first) and all within it. A link counts as one only if its own end tag ended it."""
        while len(self.stack) > max(at, 1):
            node = self.stack.pop()
            self.places[node.name].pop()
            if node.name in BLOCK:
                self.blocks.pop()
            if node.name == "a" and not (ended and len(self.stack) == at):
                node.name = "span"


def _attributes(html: str, at: int) -> tuple[int, dict[str, str]]:
    """What a tag says, from behind its name to its end: (where the tag ends, or -1 if the page ends first; first value of each name)."""
    found: dict[str, str] = {}
    while m := ATTRIBUTE.match(html, at):
        at = m.end()
        if m[1]:
            return at, found
        found.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
    return -1, found


def _element(name: str, parent: Node, said: dict[str, str]) -> Node:
    names: list[str] = []
    for key in ("class", "id", "role"):
        if value := said.get(key):
            names += re.sub(r"(?<=[a-z])(?=[A-Z])", "-", unescape(value)).lower().split()
    hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or bool(HIDING.search(said.get("style", "")))
    return Node(name, parent, tuple(names), hidden)


def parse(html: str) -> Node:
    """A tree of elements and undecoded text; unclosed and misplaced tags are mended."""
    root = Node("html", None)
    up = _Open(root)
    _read(html, up)
    up.close(1)
    return root


def _read(html: str, up: _Open) -> None:
    at = 0
    ends: dict[str, re.Pattern] = {}
    while True:
        m = MARK.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            up.here.children.append(text)
        if not m:
            return
        begin = m.end()
        if html.startswith("!--", begin):
            if html.startswith((">", "->"), begin + 3):
                at = html.index(">", begin) + 1
            elif end := COMMENT_END.search(html, begin + 3):
                at = end.end()
            else:
                return
            continue
        closing = html[begin] == "/"
        word = NAME.match(html, begin + closing)
        if html[begin] in "!?" or closing and (word is None or not word[0][0].isalpha()):
            end = html.find(">", begin)
            if end < 0:
                return
            at = end + 1
            continue
        name = word[0].lower()
        at, said = _attributes(html, word.end())
        if at < 0:
            return
        if closing:
            _end_tag(up, name)
        elif name in RAW:
            node = _start_tag(up, name, said)
            end = ends.setdefault(name, re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)).search(html, at)
            up.close(len(up.stack) - 1) if node else None
            if not end:
                return
            at = _attributes(html, end.end())[0]
            if at < 0:
                return
        else:
            _start_tag(up, name, said)


def _end_tag(up: _Open, name: str) -> None:
    at = up.last((name,))
    if at <= 0:
        return
    if name in BLOCK or name in DROPPED:
        # a cell holds in what is open within it
        if at > up.last(("table",) if name in TABLE_PARTS else CELLS) or name in CELLS and at >= up.last(("table",)):
            up.close(at)
    elif at > up.blocks[-1]:
        up.close(at, ended=True)


def _start_tag(up: _Open, name: str, said: dict[str, str]) -> Node | None:
    """Open an element (and close it again if it is void) after closing what it ends."""
    if name == "html" or name == "body" and up.last(("body",)) > 0:
        return None
    if name in P_CLOSERS and (at := up.inner(("p",), (*CELLS, "button"))) > 0:
        up.close(at)
    if name in CLOSES:
        names, scope = CLOSES[name]
        at = up.inner(names, scope)
        if name in ("tr", "tbody", "thead", "tfoot") and at > 0:
            # the outermost of these in this table
            least = up.last(scope)
            at = min(p for n in names for p in up.places.get(n, ()) if p > least)
        if at > 0:
            up.close(at)
    if name == "a":
        _end_tag(up, "a")
    if name not in HEAD_ONLY and (at := up.last(("head",))) > 0:
        up.close(at)
    node = _element(name, up.here, said)
    up.here.children.append(node)
    if name in VOID:
        return None
    up.push(node)
    return node


def _prune(root: Node) -> list[Node]:
    """Take out what is never main text; fill chars, linked and heading bottom-up; return all elements in page order."""
    order: list[Node] = []
    stack = [(root, False, False)]
    while stack:
        node, link, article = stack.pop()
        link, article = link or node.name == "a", article or node.name in ("article", "main")
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not (c.name in DROPPED or c.hidden)]
        node.chars = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.linked = node.chars if link else 0
        node.heading = node.name in HEADINGS
        stack += [(c, link, article) for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.heading |= node.heading
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_text(node: Node) -> str:
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.name not in BLOCK:
            stack += reversed(c.children)
    return " ".join("".join(out).split())


def _around(node: Node | None, name: str) -> Node | None:
    while node is not None and node.name != name:
        node = node.parent
    return node


def _boilerplate(node: Node) -> bool:
    """A box within or beside the main text that isn't part of it."""
    if node.name == "header":
        # a page's, unless it holds a title and stands within an article
        return not (node.heading and (_around(node, "article") or _around(node, "main") or node.parent.name not in ("body", "html")))
    if node.marked:
        # a box for a title may be called a header
        return not (node.heading and all(_is_marked(n) <= ("header" in n or "head" in re.split("[-_]", n)) for n in node.names))
    return False


def best_container(root: Node) -> tuple[list[Node], dict[int, float]]:
    """The best-scored container with the siblings that belong to it, in page order; and all scores by id of node."""
    order = _prune(root)
    shut = {id(n) for n in order if n.name != "html" and _boilerplate(n)}
    for node in order:
        if node.name in PARAGRAPHS or node.name in BOXES and any(isinstance(c, str) and c.strip() for c in node.children):
            text = _own_text(node)
            if not text:
                continue
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            to, factor = node, 1.0
            if node.name in PARAGRAPHS:
                factor, to = 0.1 if id(node) in shut else 1.0, node.parent
            for share in (1, 2, 3):
                if to is None:
                    break
                to.points += points * factor / share
                factor *= 0.1 if id(to) in shut else 1.0
                to = to.parent
    scores: dict[int, float] = {}
    best, most = None, 0.0
    for node in order:
        if node.points and node.name not in ("p", "pre", "a", "span", "li", "td", "h1", "h2", "h3"):
            bonus = {"article": 1.5, "main": 1.25}.get(node.name, 1.0) * (1.25 if node.likely else 1.0) * (0.1 if id(node) in shut else 1.0)
            scores[id(node)] = score = node.points * (1 - _density(node)) * bonus
            if score > most:
                best, most = node, score
    if best is None:
        best = next((x for x in order if x.name == "article" and id(x) not in shut), None) or next((x for x in order if x.name == "main"), None) or root
    while best.parent is not None and best.name in ("ul", "ol", "tbody", "tr", "table", "dl", "blockquote", "thead", "tfoot"):
        best = best.parent
    whole = _around(best, "article")
    while whole is not None and id(whole) in shut:
        whole = _around(whole.parent, "article")
    best = whole or best
    if best.parent is None:
        return [best], scores
    bar, chosen, seen = max(10.0, 0.2 * most), [], False
    for c in best.parent.children:
        if c is best:
            chosen.append(c)
            seen = True
        elif isinstance(c, Node) and id(c) not in shut:
            same = c.name == best.name and c.names == best.names
            score = scores.get(id(c), 0.0) + (0.2 * most if same and best.names else 0)
            long = c.name == "p" and (c.chars > 80 and _density(c) < 0.25 or 0 < c.chars <= 80 and c.linked == 0 and c.points == 0 and best.name in ("p", "div"))
            title = not seen and c.heading and c.name in (*HEADINGS, "header", "hgroup") and c.linked == 0
            if title or _density(c) < 0.5 and score >= bar and (best.name != "article" or same) or long and best.name != "article":
                chosen.append(c)
    return chosen, scores


def _menu(node: Node) -> bool:
    """Lists, tables and boxes that hold little but links of few words."""
    return node.name in ("ul", "ol", "dl", "table", "div", "section") and node.chars > 0 and _density(node) > 0.8


def blocks_of(nodes: list[Node]) -> list[str]:
    """Decoded text of every block in page order, white space made single."""
    blocks: list[str] = []
    piece: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(piece)).split())
        piece.clear()
        if text:
            blocks.append(text)

    tops = {id(n) for n in nodes}
    # an article's own lists of links are part of it
    stack: list[tuple[Node | str, bool, bool]] = [(n, False, _around(n, "article") is not None) for n in reversed(nodes)]
    while stack:
        c, over, inside = stack.pop()
        if isinstance(c, str):
            piece.append(c)
        elif over:
            close()
        elif c.name in ("br", "hr", "img", "wbr"):
            piece.append("" if c.name == "wbr" else " ")
        elif id(c) not in tops and (_boilerplate(c) or not inside and _menu(c)):
            close() if c.name in BLOCK else None
        else:
            inside = inside or c.name == "article"
            if c.name in BLOCK:
                close()
                stack.append((c, True, inside))
            stack += [(x, False, inside) for x in reversed(c.children)]
    close()
    return blocks


def extract_text(html: str | None) -> str:
    """Main text: blocks joined by an empty line; "" for null, empty or text-free input."""
    if not html:
        return ""
    chosen, _ = best_container(parse(html))
    return "\n\n".join(blocks_of(chosen))


def extract(pages: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """Add the main text of column `html` as column `into` (replacing one of that name, also `html` itself).

    Null or empty html gives "". All other columns and repeated rows pass through.
    """
    kept = [c for c in pages.columns if c != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != into)
    schema = ", ".join(x for x in (schema, f"`{into}` string") if x)

    def run(reader) -> Iterator[pa.RecordBatch]:
        for batch in batches(reader, 512):
            texts = [extract_text(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.record_batch([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, into])

    page = "__page"
    while page in kept:
        page += "_"
    return pages.select(*kept, F.col(html).alias(page)).mapInArrow(run, schema)
