"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page becomes a sequence of words and tags. Words score positive and tags negative, with weights learned from pages that label
their own content (an ``article`` or ``main`` element): the log odds of a token class inside against outside the labelled part.
One linear scan finds the contiguous region of the largest sum; what stands in it in named side elements (adverts, forms,
comments and the like) is left out, and the rest is joined block by block. The page itself, its labelled content and what stands
around that are never side elements.

Null, empty and tag-only pages give an empty text. Unclosed and unmatched tags are tolerated; a page without any labelled part
is scored like the others. Without labelled pages the prior weights hold. Ties go to the first region. Repeated rows are
treated alike; columns besides those kept and the html are ignored. Pages of any length are read whole. Bytes that are no UTF-8
read as U+FFFD. Formulas are text in their line; only their annotations, which no browser shows, are left out.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftgrid.llm.common import map_rows, need

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|annotation-xml|annotation)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Elements by what they are in HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong "
    "sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom mspace menclose msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mtd semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE = frozenset("nav footer aside form button select dialog menu head object audio video canvas".split())
CONTENT = frozenset(("article", "main"))
# A class, id or role is a side name when all its parts are of these words, one of SIDE_WORDS among them.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side header masthead footer cookie cookies consent gdpr notice popup modal overlay comment comments commentlist respond "
    "reply replies disqus related recommended share sharing social newsletter subscribe signup login pagination pager widget toolbar "
    "copyright legal hidden tags meta byline".split())
AROUND = frozenset(
    "site main global top bottom left right primary secondary list box container wrapper wrap area section block bar slot unit links "
    "buttons icons form dialog posts articles stories items widgets".split())
HEADERS = frozenset(("header", "masthead"))  # inside content these hold its heading
# Never side elements by their name or kind: they are the page or its content.
WHOLE = frozenset(("html", "body", "main", "article"))
PARTS = frozenset(("h1", "nav", "header", "footer", "aside"))
# Weights before any page is seen.
WORD_PRIOR, TAG_PRIOR = 1.0, -0.2
# A piece of text in a side element, whatever its length: it is left out of the result, so it need not end the region.
SIDE_TEXT = -0.3
LEAST_WORD, LEAST_TAG, MOST_TAG = 0.25, -1.0, -0.1
# Rarer classes in the labelled pages take the prior.
LEAST_TOKENS = 20


def is_side_name(names: str, inside: bool) -> bool:
    """One of the listed names is a side name; header-like names inside content are none."""
    for token in names.split():
        parts = [p for p in re.split(r"[_-]+", token) if p]
        side = [p for p in parts if p in SIDE_WORDS]
        if side and all(p in SIDE_WORDS or p in AROUND for p in parts) and not (inside and HEADERS.issuperset(side)):
            return True
    return False


class Element:
    __slots__ = ("name", "key", "parent", "own_side", "side", "content", "label")

    def __init__(self, name: str, attrs: str, parent: Element | None):
        names = ""
        hidden = False
        if attrs:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
            names = " ".join(found[a] for a in ("class", "id", "role") if a in found).lower()
            hidden = (re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs, re.I) is not None
                      or "display:none" in found.get("style", "").replace(" ", "") or found.get("aria-hidden") == "true")
        inside = parent is not None and parent.content
        self.name = name
        self.parent = parent
        self.label = name in CONTENT and not inside and not hidden  # outermost content element
        self.content = inside or name in CONTENT
        self.own_side = name not in ("html", "body") and (hidden or name not in WHOLE and (
            name in SIDE or is_side_name(names, inside) or (name == "header" and not inside)))
        self.side = self.own_side or (parent is not None and parent.side)
        self.key = f"{name}.{names.split()[0]}" if names else name


def lift(elements: list[Element]) -> None:
    """Elements around the labelled content are no side elements, when no other content is labelled outside side elements.

    The labelled content is a ``main`` or a page's only ``article``; several articles in a side element are teasers or comments,
    unless the element is a form around them. Without a label, a form is around the page when it holds the page's heading or parts.
    """
    labels = [e for e in elements if e.label]
    if not all(e.side for e in labels):
        return
    lifted = set()
    for e in labels or [e for e in elements if e.name in PARTS]:
        above = e.parent
        while above is not None:
            if above.name == "form" or labels and (e.name == "main" or len(labels) == 1):
                lifted.add(id(above))
            above = above.parent
    for e in elements:  # parents come first
        e.side = (e.own_side and id(e) not in lifted) or (e.parent is not None and e.parent.side)


ROOT = Element("html", "", None)
# An opening block ends an open element of these kinds.
ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
        "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
                     "pre section table ul".split())


def tokens(page: str) -> list[tuple[str, str, Element, str]]:
    """(kind, class, innermost block element, text) in page order; kind is w (words), i (inline tag) or b (block tag)."""
    elements: list[Element] = []
    found = list(scan(page, elements))
    lift(elements)
    return found


def scan(page: str, elements: list[Element]) -> Iterator[tuple[str, str, Element, str]]:
    """The tokens before elements around the labelled content are known; ``elements`` takes all elements in page order."""
    stack: list[Element] = [ROOT]
    opened: dict[str, int] = {}  # how many elements of a name are open
    links = 0
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield ("w", f"w:{'a:' if links else ''}{stack[-1].key}", stack[-1], page[at:m.start()])
        at = m.end()
        name = m["tag"]
        if name is None:
            continue
        name = name.lower()
        closing = bool(m["close"])
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            yield ("i", f"i:{name}", stack[-1], "")
            continue
        if closing:
            if opened.get(name):
                while True:
                    ended = stack.pop().name
                    opened[ended] -= 1
                    if ended == name:
                        break
                links = 0
        else:
            ends = ENDS.get(name) or (("p",) if name in CLOSES_P else ())
            while len(stack) > 1 and stack[-1].name in ends:
                opened[stack.pop().name] -= 1
            if name not in VOID and not m["attrs"].rstrip().endswith("/"):
                stack.append(Element(name, m["attrs"], stack[-1]))
                elements.append(stack[-1])
                opened[name] = opened.get(name, 0) + 1
        yield ("b", f"b:{'/' if closing else ''}{name}", stack[-1], "")
    if at < len(page):
        yield ("w", f"w:{'a:' if links else ''}{stack[-1].key}", stack[-1], page[at:])


def class_counts(page: str) -> dict[str, tuple[int, int]]:
    """Tokens of each class inside and outside the labelled part; nothing for a page that labels none."""
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for kind, name, element, text in tokens(page):
        n = len(text.split()) if kind == "w" else 1
        if n:
            part = inside if element.content and not element.side else outside
            part[name] = part.get(name, 0) + n
    if not inside:
        return {}
    return {k: (inside.get(k, 0), outside.get(k, 0)) for k in inside.keys() | outside.keys()}


class Weights:
    """Score of a token class; unseen classes take the prior."""

    def __init__(self, counts: dict[str, tuple[int, int]], totals: tuple[int, int] | None = None):
        """``counts``: tokens inside and outside by class; ``totals``: those of all classes, where rare ones are left out of it."""
        total_in, total_out = totals or (sum(c[i] for c in counts.values()) for i in (0, 1))
        self.known: dict[str, float] = {}
        for name, (a, b) in counts.items():
            if a + b < LEAST_TOKENS:
                continue
            odds = math.log((a + 0.5) / (total_in + 1)) - math.log((b + 0.5) / (total_out + 1))
            odds = max(-5.0, min(5.0, odds))
            if not name.startswith("w:"):
                odds = max(LEAST_TAG, min(odds, MOST_TAG))
            elif odds > 0:
                odds = max(odds, LEAST_WORD)
            self.known[name] = odds

    def of(self, name: str, element: Element, words: int) -> float:
        """Score of a tag, or of ``words`` words; inside a labelled part side elements cost nothing."""
        if element.side:
            return 0.0 if element.content else SIDE_TEXT if words else TAG_PRIOR
        if name.startswith("w:"):
            return words * self.known.get(name, WORD_PRIOR * (0.3 if name.startswith("w:a:") else 1))
        return self.known.get(name, TAG_PRIOR)


def main_text(page: str, weights: Weights) -> str:
    """Text of the best region."""
    found = tokens(page)
    best, best_from, best_to = 0.0, 0, 0
    total, begin = 0.0, 0
    for k, (kind, name, element, text) in enumerate(found):
        if total <= 0:
            total, begin = 0.0, k
        total += weights.of(name, element, len(text.split())) if kind != "w" or not text.isspace() else 0.0
        if total > best:
            best, best_from, best_to = total, begin, k + 1
    blocks: list[str] = []
    parts: list[str] = []
    for kind, _, element, text in found[best_from:best_to]:
        if kind == "b":
            blocks.append("".join(parts))
            parts = []
        elif kind == "w" and not element.side:
            parts.append(text)
    blocks.append("".join(parts))
    lines = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def fit(pages: DataFrame, id_col: str = "page_id", html: str = "html", sample: int = 4_000) -> Weights:
    """Weights from at most ``sample`` pages, those with the smallest hash of their id (a bounded list that may be broadcast).

    Every class of token they hold often enough gets a weight; the sample alone bounds their number.
    """
    need(pages, id_col, html)
    ids = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(html).alias("_html")).join(F.broadcast(ids.distinct()), "_id")

    def make():
        def function(pages_):
            for page in pages_:
                counts = class_counts((page or b"").decode(errors="replace"))
                yield ([{"name": k, "a": v[0], "b": v[1]} for k, v in counts.items()],)
        return function

    item = T.StructType([T.StructField("name", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    counted = map_rows(rows, [], "_html", make, T.StructType([T.StructField("counts", T.ArrayType(item))]))
    # the row without a name holds the totals of all classes
    summed = counted.select(F.explode("counts").alias("_c")).select("_c.*").rollup("name").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("name").isNull() | (F.col("a") + F.col("b") >= LEAST_TOKENS)).collect()
    by_name = {r["name"]: (r["a"] or 0, r["b"] or 0) for r in summed}
    totals = by_name.pop(None, (0, 0))
    return Weights(by_name, totals)


def extract(pages: DataFrame, weights: Weights, keep: list[str], html: str = "html") -> DataFrame:
    """``keep``, text (empty if none) and n_chars (code points)."""
    def make():
        def function(pages_):
            for page in pages_:
                text = main_text(page.decode(errors="replace"), weights) if page else ""
                yield (text, len(text))
        return function

    return map_rows(pages, keep, html, make, T.StructType([
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
