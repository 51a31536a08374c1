"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of a page; containers that
can't be the article's (menus, headers, footers, sidebars, notices, adverts,
forms, comments, by element, role or class) are stripped with it, and where a
page marks its article, so is what lies outside. Each line left has a weight:
its length; less (``GENERIC``) where no paragraph, heading or list item holds it,
nothing where it is a menu's by its links (in a list and more than half links,
or nothing but several links outside a paragraph or heading), and at least
``FLOOR`` in a paragraph or heading. Being inside a marked article is a prior: a
line weighs ``MARKED`` times its length there, but a menu's ``GENERIC`` times, so
that text density still decides where the article begins and ends. Over the lines slides a
window of ``WINDOW`` lines whose weights are summed. The text surges at a line of
some weight where the window from there on reaches the threshold (``SURGE``, or
``SHARE`` of the page's largest window where that is less), and dives at a line of
little weight where the window no longer does; lines between are kept, but for
menus.

Defined cases: null, empty and malformed pages give what text can be read,
an empty text if there is none; unclosed elements end with what holds them, and
self-closed pictures, frames, objects and formulas with their own tag; of lines
that weigh the same none goes before another; repeated rows are extracted each;
an empty table gives one; columns named text or n_chars give way to the
result's; pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Lines of a window, and the weight that a window needs, or its share of the largest if that is less.
WINDOW, SURGE, SHARE = 3, 80, 0.3
#: Least weight of a line of prose; what a character weighs outside prose, and how much more in a marked article.
FLOOR, GENERIC, MARKED = 20, 0.3, 4
_BATCH_BYTES = 4_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|iframe|object|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+(?<=/)>|<(script|style|noscript|template|textarea|svg|iframe|object|math|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture q rb rp rt ruby s samp"
    " small source span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the kind ends, as their end tags may be left out.
_OPTIONAL = frozenset("p li dt dd tr td th option".split())
_OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
_OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo"
    " promoted promotion related replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription"
    " teaser toolbar topbar widget widgets".split()
)
_LISTS = frozenset("ul ol li dl dt dd".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
_TEXTUAL = _PROSE | _LISTS - {"ul", "ol", "dl"} | {"pre", "td", "th", "caption", "figcaption"}
_COMMENTS = frozenset("comment comments replies disqus respond".split())


def _kind(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element isn't part of the article, and whether it holds comments."""
    if name in _OUTSIDE or (name == "header" and not in_article):
        return True, False
    if not attributes or name in ("body", "html"):
        return False, False
    for key, a, b, c in _NAMES.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, False
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
        elif key == "role":
            if value.lower() in _OUTSIDE_ROLES:
                return True, False
        elif name not in ("article", "main", "p", "h1") or key == "class":
            words = {w.lower() for w in _WORD.findall(value)}
            if words & _COMMENTS:
                return True, True
            if words & _OUTSIDE_WORDS and name not in ("article", "main"):
                return True, False
    return False, False


class Line:
    """A block's text, whether it is a menu's by its links, whether it is set aside, whether it lies in an article, and
    whether a paragraph, heading, item or cell holds it."""

    __slots__ = ("article", "aside", "menu", "prose", "text")

    def __init__(self, text: str, menu: bool, aside: bool, article: bool, prose: bool = True):
        self.text, self.menu, self.aside, self.article, self.prose = text, menu, aside, article, prose


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, set aside, comments
    pieces: list[tuple[str, bool]] = []
    aside = comments = articles = links = anchors = 0

    def flush() -> None:
        nonlocal anchors
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                names = {x[0] for x in stack}
                if names & _LISTS and not names & _PROSE:
                    menu = 2 * sum(len(p.strip()) for p, l in pieces if l) > len(text)
                else:
                    menu = not names & _PROSE and anchors > 1 and not any(c.isalnum() for p, l in pieces if not l for c in html.unescape(p))
                lines.append(Line(text, menu, aside > 0, articles > 0, bool(names & _TEXTUAL)))
            pieces.clear()
        anchors = links

    def close(to: int) -> None:
        nonlocal aside, comments, articles, links
        for name, out, said in stack[to:]:
            aside -= out
            comments -= said
            articles -= name in ("article", "main")
            links -= name == "a"
        del stack[to:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append((page[at : m.start()], links > 0))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            if name == "br":
                pieces.append((" ", False))
                continue
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                # An inline element's end tag doesn't end blocks, nor does any end tag an article.
                if name in _INLINE and stack[i][0] not in _INLINE or stack[i][0] in ("article", "main") and name not in ("body", "html"):
                    break
            continue
        if name in _VOID:
            continue
        if name in _OPTIONAL:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name or name in ("td", "th", "dt", "dd") and stack[i][0] in _OPTIONAL and stack[i][0] not in ("tr", "p", "li"):
                    close(i)
                    break
                if stack[i][0] not in _INLINE and stack[i][0] not in ("p", "td", "th"):
                    break
        elif name in ("article", "main") and aside and not comments:
            # An article isn't part of a menu or an advert: that one was left open.
            close(next(i for i, x in enumerate(stack) if x[1]))
        elif name not in _INLINE:
            # Blocks end inline elements and paragraphs that were left open.
            to = len(stack)
            while to and (stack[to - 1][0] in _INLINE or stack[to - 1][0] == "p"):
                to -= 1
            close(to)
        out, said = _kind(name, m[4] or "", articles > 0)
        stack.append((name, out, said))
        aside += out
        comments += said
        articles += name in ("article", "main")
        links += name == "a"
        anchors += name == "a"
    if at < len(page):
        pieces.append((page[at:], links > 0))
    flush()
    return lines


def sums(weights: list[float], window: int = WINDOW) -> list[float]:
    """The weight of the window that begins at each line."""
    total, out = 0.0, [0.0] * len(weights)
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        out[i] = total
    return out


def weighed(lines: list[Line], window: int = WINDOW) -> tuple[list[float], float]:
    """The lines' weights, and the threshold of a window."""
    prose = lambda x: max(len(x.text), FLOOR) if x.prose else len(x.text)
    inside = lambda x: GENERIC * len(x.text) if x.menu else MARKED * prose(x)
    outside = lambda x: 0 if x.menu else prose(x) if x.prose else GENERIC * len(x.text)
    weights = [float(inside(x) if x.article else outside(x)) for x in lines]
    return weights, min(SURGE, SHARE * max(sums(weights, window), default=0))


def stretches(weights: list[float], least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """[surge, dive) of each stretch of text."""
    ahead, some, found, start = sums(weights, window), min(FLOOR, least), [], None
    for i, w in enumerate(weights):
        reached = ahead[i] >= least - 1e-9
        if start is None and reached and w >= some - 1e-9 and w > 0:
            start = i
        elif start is not None and not reached and w < some - 1e-9:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(weights)))
    return found


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = [x for x in lines_of(page) if not x.aside] if page else []
    if any(x.article for x in lines):
        lines = [x for x in lines if x.article]
    weights, least = weighed(lines, window)
    return " ".join(lines[i].text for a, b in stretches(weights, least, window) for i in range(a, b) if weights[i])


def extract(pages: DataFrame, *, source: str = "html") -> DataFrame:
    """pages without their source, with text and n_chars (long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, source, _BATCH_BYTES):
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            rest = batch.select([n for n in batch.schema.names if n != source])
            yield common.extended(rest, text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    added = (T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()))
    return pages.mapInArrow(run, common.with_fields(T.StructType([f for f in pages.schema.fields if f.name != source]), *added))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
