"""Main text of web pages by scoring the element tree.

A page is read into a tree of elements; blocks (paragraphs, headings, list items and loose text) are its leaves.
Every paragraph passes points for its length and its commas to its parent, half of them to the grandparent and a third to the one above,
an element's points are discounted by the share of its text inside links, and the element with
the most points is the main container.  What stands beside it is kept if it has few links, however short or long it is.  While nothing but headings,
paragraphs and loose text stands beside it, the same holds for the element around, and so on up to the body.  Elements that never hold the article (menus, headers, footers, sidebars,
forms, scripts, styles, and those whose class or id says notice, advert or comment) are left out beforehand; a class never leaves out an
element with an article or main element inside, nor one with the bulk of the page's text unless it says reader comments.  A form around the bulk of the text is
no form of the page, if paragraphs make up most of it; a header with a heading inside a post, entry or story is part of that.  Inside a block, hidden elements and those whose class says
advert or share are left out up to their end tags.

Reading is forgiving: end tags that nothing opened are skipped, block tags end an open paragraph, character
references are decoded, scripts and styles end only at their own end tag, and a page may stop anywhere.

Results for unusual rows: a null, empty or text-free page gives an empty text; repeated ids stay
rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from oxidara.llm.rows import own_columns

# Elements of HTML by what they mean for the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
NEVER = frozenset("nav footer aside button select option head script style noscript iframe template svg math canvas object embed dialog menu textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
#: Elements that an opening tag of the same group ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Class, id or role of what is no article.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disclaimer|disqus|footer|header|legal|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|site-header|skip|social|sponsor\w*|subscribe|tags|toolbar|widget)(?:[\s_-]|$)",
    re.I,
)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:[\s_-]|$)", re.I)

TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>\"']|$)", re.I)
BLANKS = re.compile(r"\s+")

#: Class words of reader comments; like all of UNWANTED they win over words of content beside them.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:[\s_-]|$)", re.I)
#: The heading of an article is no header of the page.
OWN_HEADER = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|text)[_-]header(?:[\s_-]|$)", re.I)
#: Elements of drawings and formulas end at the latest where the one that holds them does; inside, "/>" ends an element.
FOREIGN = frozenset(("svg", "math"))
#: Elements of HTML that end an open drawing or formula.
BREAKS_OUT = frozenset("article aside blockquote body center dd div dl dt footer h1 h2 h3 h4 h5 h6 head header hr li main menu nav ol p pre section table ul".split())
#: Elements inside drawings and formulas that hold HTML.
HOLDS_HTML = frozenset(("foreignobject", "annotation-xml"))
TEMPLATE_END = re.compile(r"</template[\s/>]", re.I)
#: An element with more than this share of the text outside links is not left out by its class alone.
BULK = 0.5

#: A paragraph of fewer characters gives no points.
LEAST_POINTS_CHARS = 25
#: What has a smaller share of its text in links is kept beside the container.
FEW_LINKS = 0.25
#: Elements of text in a row; a form is around an article if they hold most of its text.
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where the main container ends at the latest.
OUTERMOST = frozenset("article main body html #".split())
#: Class words of elements inside a block that are no part of its text, and what may say so at all.
UNWANTED_INLINE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|newsletter|popup|promo\w*|share|sharing|skip|social|sponsor\w*)(?:[\s_-]|$)", re.I)
INLINE_HINT = re.compile(r"class|hidden|display", re.I)
#: Around a header with a heading: the article that it belongs to.
POST = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|text)(?:[\s_-]|$)", re.I)
#: Elements that an end tag which is left out does not reach across.
LISTS = ("ul", "ol", "dl", "table", "div", "article", "section")


class Element:
    __slots__ = ("by_class", "children", "link_chars", "name", "parent", "points", "post", "skip", "text_chars", "weight")

    def __init__(self, name: str, parent: Element | None, skip: bool, weight: float, by_class: str = ""):
        #: skip: left out for good.  by_class: "comment" or "other" if its class says that it should be, "form" and "header" of elements that mostly should.  post: inside a post by class.
        self.name, self.parent, self.skip, self.weight, self.by_class = name, parent, skip, weight, by_class
        self.post = parent is not None and parent.post
        self.children: list[Element | tuple[str, int]] = []
        self.points = 0.0
        self.text_chars = self.link_chars = 0


def _hidden(key: str, value: str) -> bool:
    return key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower())


def _muted(attributes: str) -> bool:
    """If an element inside a block is no part of its text."""
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if _hidden(key, value) or key == "class" and UNWANTED_INLINE.search(value):
            return True
    return False


def _about(name: str, attributes: str) -> tuple[bool, float, str, bool]:
    """If an element is left out with all inside, its head start of points, what its class says against it, and if it is a post."""
    weight, skip, by_class, post = 0.0, name in NEVER, "form" if name == "form" else "", False
    if name == "article" or name == "main":
        weight = 25.0
    if attributes and not attributes.isspace():
        said = ""
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if _hidden(key, value):
                skip = True
            elif key in ("class", "id", "role"):
                said += " " + value
        if said and name in ("article", "main"):
            by_class = "comment" if COMMENTS.search(said) and not WANTED.search(said) else ""
        elif said and name not in ("html", "body"):
            if COMMENTS.search(said):
                by_class = "comment"
            elif UNWANTED.search(OWN_HEADER.sub(" ", said)) or "complementary" in said or "contentinfo" in said:
                by_class = "other"
            elif WANTED.search(said):
                weight += 15.0
                post = POST.search(said) is not None
    return skip, weight, by_class, post


def parse(page: str) -> Element:
    """The tree of a page, in time linear in its length however deep it is.  Text inside elements that are left out is not kept."""
    root = here = Element("#", None, False, 0.0)
    path = [root]  # the open elements
    places: dict[str, list[int]] = {}  # where in path the elements of a name are
    at, n = 0, len(page)
    block: list[str] = []  # text since the last border of a block
    links = 0  # characters of it inside links
    depth = 0  # open links
    muted = ""  # the inline element that is left out, if one is open
    nested = muted_in = 0  # open elements of its name inside it, and open elements around it
    last_template = None  # where the last end tag of a template is

    def close() -> None:
        """End the block: its text becomes a child of the element that is open."""
        nonlocal block, links
        if block:
            text = BLANKS.sub(" ", "".join(block)).strip()
            if text and not here.skip:
                here.children.append((text, min(links, len(text))))
            block, links = [], 0

    def leave(to: int) -> None:
        """End all open elements from place to of the path."""
        nonlocal here, muted
        while len(path) > to:
            places[path.pop().name].pop()
        here = path[-1]
        if muted and len(path) < muted_in:
            muted = ""

    def last(names: tuple[str, ...]) -> int:
        """Where in the path the innermost open element of these names is, or 0."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def add(raw: str) -> None:
        nonlocal links
        if not here.skip and not muted:
            text = html.unescape(raw) if "&" in raw else raw
            block.append(text)
            if depth:
                links += len(text)

    while at < n:
        next_tag = page.find("<", at)
        if next_tag < 0:
            add(page[at:])
            break
        if next_tag > at:
            add(page[at:next_tag])
        m = TAG.match(page, next_tag) or LOOSE.match(page, next_tag)
        if m is None:
            add("<")
            at = next_tag + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                depth = max(0, depth + (-1 if m[1] else 1))
            elif name == "br":
                add("\n")
            if name in VOID:
                continue
            if not muted:
                if not m[1] and m[3] and INLINE_HINT.search(m[3]) and not m[3].rstrip().endswith("/") and _muted(m[3]):
                    muted, nested, muted_in = name, 0, len(path)
            elif name == muted:
                nested += -1 if m[1] else 1
                if nested < 0:
                    muted = ""
            continue
        close()
        if m[1]:  # an end tag: up to the element that it ends, if one is open
            if places.get(name):
                leave(places[name][-1])
                depth = 0
            continue
        if name in VOID:
            continue
        depth = 0
        attributes = m[3]
        closed = attributes.rstrip().endswith("/")
        if here.name in FOREIGN and (closed or name not in BREAKS_OUT and name not in HOLDS_HTML and name not in ("script", "style")):
            continue  # parts of a drawing or formula, whose text is skipped with it
        while here.name in FOREIGN and name in BREAKS_OUT:
            leave(len(path) - 1)
        if name in FOREIGN and closed:
            continue
        if name == "template":
            if last_template is None:
                last_template = max((x.start() for x in TEMPLATE_END.finditer(page)), default=-1)
            if last_template < at:
                continue  # never ended: it would take the rest of the page with it
        if name in RAW:
            end = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if here.name == "p":  # a block ends an open paragraph
            leave(len(path) - 1)
        ended = ENDS.get(name)
        if ended and (to := last(ended)) > last(LISTS):
            leave(to)
        if name == "body" and here.name == "head":
            leave(len(path) - 1)
        skip, weight, by_class, post = _about(name, attributes)
        if name == "header" and not last(("article", "main")):
            if not here.post or by_class:
                skip = True
            by_class = "header"
        child = Element(name, here, skip or here.skip, weight, by_class)
        child.post = child.post or post
        here.children.append(child)
        places.setdefault(name, []).append(len(path))
        path.append(child)
        here = child
    close()
    _leave_out(root)
    return root


def _leave_out(root: Element) -> None:
    """Decide by class, once the tree is known: skip what holds neither the article nor the bulk of the text.

    The article is the longest one that no comment holds, if there is such a one.  Comments with the bulk of the text
    go as well, unless their one article has it; if nothing were left, nothing is skipped by class."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        if not element.skip:
            order.append(element)
            stack += [c for c in element.children if isinstance(c, Element)]
    if not any(e.by_class for e in order):
        return
    among: dict[Element, bool] = {}
    for element in order:  # parents before children
        among[element] = element.by_class == "comment" or among.get(element.parent, False)
    plain: dict[Element, int] = {}
    prose: dict[Element, int] = {}  # in elements of text in a row
    heads: dict[Element, bool] = {}  # if it holds a heading with text
    inside: dict[Element, int] = {}  # articles
    for element in reversed(order):  # children before parents
        inner = [c for c in element.children if isinstance(c, Element) and c in plain]
        plain[element] = sum(len(c[0]) - c[1] for c in element.children if isinstance(c, tuple)) + sum(plain[c] for c in inner)
        prose[element] = plain[element] if element.name in PROSE else sum(prose[c] for c in inner)
        heads[element] = element.name in HEADINGS and plain[element] > 0 or any(heads[c] for c in inner)
        inside[element] = (element.name in ("article", "main") and not element.by_class) + sum(inside[c] for c in inner)
    found = [e for e in order if e.name in ("article", "main") and not e.by_class]
    chief = max([x for x in found if not among[x]] or found, key=plain.__getitem__, default=None)
    holds = set()  # the chief article and all that it stands in
    element = chief
    while element is not None:
        holds.add(element)
        element = element.parent
    within: dict[Element, bool] = {}
    for element in order:
        within[element] = element is chief or within.get(element.parent, False)
        if element.parent is not None and element.parent.skip:
            element.skip = True
        elif element.by_class:
            bulk = plain[element] > BULK * plain[root]
            if element.by_class == "form":
                bulk = bulk and prose[element] > BULK * plain[element]
            if element.by_class == "header":
                bulk = heads[element]
            if element.by_class == "comment":  # in the one longer text that there is, comments may be named on what holds the article
                bulk = bulk and inside[element] == 1 and within[element]
            element.skip = not (bulk or element in holds)
    if not any(isinstance(c, tuple) for element in order if not element.skip for c in element.children):
        for element in order:  # better all than nothing, but a form is no article
            element.skip = element.by_class in ("form", "header") or element.parent is not None and element.parent.skip


def _score(root: Element) -> Element:
    """Points of all elements; returns the best one."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        if element.skip:
            continue
        order.append(element)
        element.points += element.weight
        for child in element.children:
            if isinstance(child, Element):
                stack.append(child)
            else:
                text, links = child
                element.text_chars += len(text)
                element.link_chars += links
                if len(text) >= LEAST_POINTS_CHARS:
                    points = 1 + text.count(",") + min(len(text) / 100, 3) if links < len(text) else 0
                    to = element.parent if element.name in PARAGRAPHS and element.parent is not None else element
                    for share in (1, 2, 3):
                        if to is None:
                            break
                        to.points += points / share
                        to = to.parent
    for element in reversed(order):
        if element.parent is not None:
            element.parent.text_chars += element.text_chars
            element.parent.link_chars += element.link_chars
    best, most = root, -1.0
    for element in order:
        if element.name in PARAGRAPHS and element.name not in ("td", "blockquote", "pre"):
            continue
        share = element.link_chars / element.text_chars if element.text_chars else 1.0
        element.points *= 1 - share
        # Equal points: the one with more text; a page with only short paragraphs still has a container.
        rank = element.points + min(element.text_chars - element.link_chars, 1000) * 1e-6
        if element.text_chars and rank > most:
            best, most = element, rank
    return best


def _blocks(element: Element, out: list[str]) -> None:
    stack = [iter(element.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, tuple):
            out.append(child[0])
        elif not child.skip:
            stack.append(iter(child.children))


def main_text(page: str | None) -> str:
    """The main text of a page, one line for each block."""
    if not page:
        return ""
    root = parse(page)
    best = _score(root)
    # for each element on the way up from the container: which children are kept
    levels: list[tuple[Element, list[Element | tuple[str, int]]]] = []
    here = best
    while here.parent is not None and (here.name not in OUTERMOST or not levels and here.name in ("article", "main")):
        around, kept, plain = here.parent, [], True
        for child in around.children:
            if child is here:
                kept.append(child)
            elif isinstance(child, tuple):
                if child[1] < FEW_LINKS * len(child[0]):
                    kept.append(child)
            elif not child.skip and child.link_chars < FEW_LINKS * child.text_chars and (here.name not in OUTERMOST or child.name == here.name):
                kept.append(child)
                plain = plain and (child.name in PARAGRAPHS or child.name in ("header", "hgroup"))
        if here.name in OUTERMOST:  # beside an article, only other ones
            kept = [child for child in kept if isinstance(child, Element)]
            plain = False
        levels.append((here, kept))
        here = around
        if not plain:
            break
    before: list[list[str]] = []  # what is kept before and after the way up, from the inside out
    after: list[list[str]] = []
    for on_the_way, kept in levels:
        place = next(i for i, child in enumerate(kept) if child is on_the_way)
        for side, some in ((before, kept[:place]), (after, kept[place + 1 :])):
            texts: list[str] = []
            for child in some:
                if isinstance(child, tuple):
                    texts.append(child[0])
                else:
                    _blocks(child, texts)
            side.append(texts)
    out: list[str] = []
    _blocks(best, out)
    return "\n".join([*(t for texts in reversed(before) for t in texts), *out, *(t for texts in after for t in texts)])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    rows = own_columns(pages, {"page_id": id_col, "url": url_col, "html": html_col})
    kind, url = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars bigint")
