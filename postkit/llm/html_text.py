"""Main text of web pages by tree scoring.

The page is read into a tree (implied end tags, raw-text elements, broken markup). Furniture is
pruned by tag and role, and by class or id names made of furniture words only, with or without a
word such as list, box or section (``ad-slot``, ``user-comments``). A name with other words in it
(``related-work``) prunes a block only if it is mostly links or holds form fields; headings are never
pruned by name and paragraphs by a whole class only. Each paragraph passes points for its length and its
commas to its ancestors (all to the parent, less with each step up), as does text set directly
in a block; a container's points are
discounted by the share of its text that is inside links. The best container is kept, with
those of its siblings that score well or read like running text; an ``article`` or ``main``
around it counts as the container. Blocks are the text between block-level boundaries.

Each page is independent, so Spark streams pages through ``mapInArrow`` with no shuffle.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postkit.llm.common import arrow_batches, field

#: What makes a doubtful block a form: a search, a login, a box for comments.
FIELDS = frozenset("form input textarea select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split())
#: Start tags that end an open element of the second set (which is inside no element of SCOPE).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("table ul ol dl body article section div main td th blockquote button".split())
#: Kinds of open elements that a start tag may end: their tags and what hides them.
_CELLS = SCOPE - {"td", "th"}
ENDED = {"p": (frozenset({"p"}), SCOPE), **{k: (frozenset(v), _CELLS if k in ("tr", "td", "th", "tbody") else SCOPE) for k, v in CLOSES.items()}}
CLOSABLE = SCOPE.union(*(tags for tags, _ in ENDED.values()))
PRUNED = frozenset(
    "nav footer aside form script style textarea title xmp noframes noscript template iframe head button select input "
    "svg canvas object embed audio video dialog menu".split())
PRUNED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words that name furniture.
FURNITURE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletters?|"
    r"subscri\w*|signup|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|"
    r"replies|respond|related|recommend\w*|share|sharing|social|widgets?|toolbar|pagination|pager|skip|login|paywall|tags?")
#: Words that add nothing to a name beside such a word: a name of both is furniture, too.
ROLES = frozenset(
    "list lists box boxes section slot unit form wrapper wrap container area block bar panel button buttons link links icons item items row "
    "inner outer group user reader site page main global top bottom left right header head title thread count body".split())
#: Parts of a name: at hyphens, underscores and where lower case meets upper case.
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of linked text from which a part of a name marks an element as furniture.
MOSTLY_LINKS = 0.5
#: Blocks whose own text counts for themselves; that of others counts for their parent.
SECTIONS = frozenset("article main section body".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][^\s=/>\"']*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "keep", "doubtful", "points", "chars", "linked", "fields", "inside", "depth", "block", "near")

    def __init__(self, tag: str, parent: "Node | None", furniture: bool | None = False):
        self.tag, self.parent, self.keep, self.doubtful = tag, parent, not furniture, furniture is None
        self.children: list = []                            # nodes and strings
        self.points, self.chars, self.linked, self.fields = 0.0, 0, 0, 0
        # What would else be found by climbing: inside an article, depth, depth of the nearest block, open elements to close.
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.block = self.depth if tag in BLOCK else parent.block if parent else 0
        self.near: dict = {} if parent is None else parent.near
        if tag in CLOSABLE:
            self.near = {k: self if tag in tags else None if tag in scope else self.near.get(k) for k, (tags, scope) in ENDED.items()}


def _named(name: str) -> bool | None:
    """Whether a class or id names furniture; None if only a part of it does."""
    parts = [x.lower() for x in PARTS.split(name) if x]
    hits = [bool(FURNITURE.fullmatch(x)) for x in parts]
    if not any(hits):
        return False
    return True if all(hit or x in ROLES for hit, x in zip(hits, parts, strict=True)) else None


def _furniture(tag: str, attributes: str, inside: bool) -> bool | None:
    """Whether an element is pruned; None if that depends on its links and form fields. A heading is never pruned by its names and a
    paragraph by a class only: their ids are anchors made of their words."""
    if tag in PRUNED or tag == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    a = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTR.findall(attributes)}
    if a.get("role", "").lower() in PRUNED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return False
    found = [_named(x) for x in a.get("class", "").split()]
    if tag != "p":
        found += [_named(x) for x in a.get("id", "").split()]
    if any(found):
        return True
    return None if None in found and tag != "p" else False


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its nodes in page order, in time linear in the page, however deep it is: open elements are kept
    by tag, and nodes know what else would be looked for among their ancestors."""
    root = Node("#root", None)
    at, pos, nodes = root, 0, [root]
    opened: dict[str, list[Node]] = {}

    def leave(node: Node, up: Node) -> Node:
        """Closes everything from ``node`` to ``up``."""
        while True:
            opened[node.tag].pop()
            if node is up:
                return up.parent
            node = node.parent

    while True:
        m = TOKEN.search(page, pos)
        if m is None:
            break
        if m.start() > pos:
            at.children.append(page[pos:m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            up = opened.get(tag)
            if up and (tag in BLOCK or at.block <= up[-1].depth):       # an inline end tag ends no block
                at = leave(at, up[-1])
            continue
        if tag in BLOCK and (up := at.near.get("p")):       # a block ends an open paragraph
            at = leave(at, up)
        if tag in CLOSES and (up := at.near.get(tag)):
            at = leave(at, up)
        node = Node(tag, at, _furniture(tag, m[3] or "", at.inside))
        at.children.append(node)
        nodes.append(node)
        if tag in VOID or (m[3] or "").rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            if end is None:
                if tag not in ("noscript", "template", "iframe"):
                    pos = len(page)
                    continue
            else:
                pos = end.end()
                continue
        opened.setdefault(tag, []).append(node)
        at = node
    if pos < len(page):
        at.children.append(page[pos:])
    return root, nodes


def _measure(nodes: list[Node]) -> None:
    """Characters, linked characters and points of every node, children before parents."""
    for node in reversed(nodes):
        commas = 0
        own = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                own += n
                commas += c.count(",") + c.count("،") + c.count("、") + c.count("，")
        node.chars += own
        if node.tag == "a":
            node.linked = node.chars
        if node.tag in FIELDS:
            node.fields += 1
        if node.doubtful and (node.fields or node.linked >= MOSTLY_LINKS * node.chars):
            node.keep = False
        if node.parent is not None:
            node.parent.fields += node.fields
        if not node.keep:
            continue
        paragraph = node.tag in PARAGRAPHS or node.tag == "div" and own
        if node.chars and (paragraph or own and node.tag in BLOCK and node.tag not in HEADINGS):
            points = 1 + commas + min((node.chars if paragraph else own) / 100, 3)
            up, share = node if node.tag in SECTIONS else node.parent, 1.0
            while up is not None and share > 0.1:
                up.points += points * share
                up, share = up.parent, share / 2
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def _score(node: Node) -> float:
    bonus = 25 if node.tag in ("article", "main") else 0
    return (node.points + bonus) * (1 - node.linked / node.chars) if node.chars else 0.0


def main_containers(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    _measure(nodes)
    dead: set[int] = set()
    best, top = root, 0.0
    for n in nodes:
        if not n.keep or (n.parent is not None and id(n.parent) in dead):
            dead.add(id(n))
        elif n.points and _score(n) > top:
            best, top = n, _score(n)
    up = best
    while up is not None:                                   # an article or main around it is the container
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    if best.parent is None or best.tag == "main":
        return [best]
    kept = []
    for c in best.parent.children:
        if isinstance(c, str) or not c.keep or not c.chars:
            continue
        density = c.linked / c.chars
        if c is best or _score(c) >= max(10.0, 0.2 * top) and c.tag == best.tag \
                or c.tag == "p" and density < 0.25 and best.tag != "article" and (c.chars > 80 or not density):
            kept.append(c)
    return kept


def blocks(containers: list[Node]) -> list[str]:
    """Text between block boundaries, character references decoded, white space made one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = list(reversed(containers))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.keep:
            if x.tag == "br":
                run.append(" ")
            edge = x.tag in BLOCK or x.tag == "#root"
            if edge:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by two line breaks; empty if there is none."""
    if not page:
        return ""
    root, nodes = parse(page)
    return "\n\n".join(blocks(main_containers(root, nodes)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` and ``n_chars`` (code points).

    A null or empty page, or one of furniture only, has the empty text. Repeated pages give
    repeated rows, null ids and urls stay null, other columns are ignored, an empty table
    gives no rows. Pages of any length and depth are read whole.
    """
    schema = T.StructType([field(pages, id_col), field(pages, url_col), T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    return arrow_batches(pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string")), run, schema)
