"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, comments and the like go. The
first pass decides each block by where it stands (menus, footers, sidebars, forms, adverts,
notices and reader comments are out), link density, length and stop-word density, or leaves it
open if it is short or unclear. In the second pass an open block inherits the label of its
nearest decided neighbour; if both are as near, of the one before it, a heading of the one after
it; with none, it stays out.
Within ``<article>`` or ``<main>`` the same rules run with the place as a prior: a long block of some
stop-word density is in there; one of mostly links, or of so few stop words that by the density of
those that are in fewer than ``RARE`` of such blocks have them, is out only from ``SHORT_CHARS`` on, not if it is a heading, a list item, a cell, a caption or preformatted, and not
if such blocks hold as much of the page's articles as those that are in (then links and stop words
tell nothing about them). An open block there goes out only between two blocks that are.
Stop words are known of four languages. Where no long block of a page is dense in them and all its
blocks together stay under ``STOP_SOME``, its language is taken as another (whose words may chance to
be stop words), and length and link density alone decide: blocks from ``SHORT_CHARS`` on are in.

A class or id name and a form are marks that may be lifted: an element's mark counts no more where
it holds most of the page's prose (alone, or with all elements of that name together if little stands free), or holds the
page's larger part of article or main prose. Names of reader comments and of consent notices, which
are often longer than the page's own text, are lifted only where little other prose stands free.
Names that tell a state (``with-sidebar``, ``comments-open``) are no marks. What is hidden, and menus,
footers and the like by tag or role, are never lifted.

Blocks that stay are decoded, white space inside becomes one space, and they are joined in page
order by two line breaks; nothing else is dropped or cut. Null and empty pages give empty text;
unclosed, overlapping and stray tags are taken as browsers roughly do; each row is its own page,
so repeated rows, ties and null ids need no rule.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Frequent words of four languages, element names and name parts.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are with as be this by at or from his not have had but they an he she you we which their were been has will would there what all if can more when who so no out up into them then its only some could these two may other than now do any my "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux cette mais comme on tout nous sa ses ont être fait leur elle "
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Within an article, blocks of these are terse by nature; few stop words or many links leave them open.
TERSE_TAGS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("nav footer aside button select textarea dialog menu head title iframe object canvas audio video map datalist search".split())
#: Elements that are out as marked ones are: page-wide forms hold whole articles.
MARK_TAGS = frozenset(("form", "fieldset"))
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar widget widgets "
    "related recommended share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist respond disqus reply replies "
    "subscribe subscription newsletter signup login search form copyright disclaimer".split()
)
#: Name parts that make a name tell of a state or layout of the element, not of its kind.
STATE_PARTS = frozenset("with without has no open opened closed enabled disabled".split())
#: Names of what is often longer than the page's own text.
LONG_WINDED = frozenset("comment comments commentlist respond disqus reply replies cookie cookies consent gdpr".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())

LONG_CHARS = 140
SHORT_CHARS = 60
LINKS_OUT = 0.5
STOP_GOOD = 0.2
STOP_SOME = 0.1
RARE = 1e-3

RAW_TAGS = frozenset("script style noscript template svg math".split())
#: Name parts of a header that is the site's, wherever it stands.
SITE_PARTS = frozenset("site global masthead".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in RAW_TAGS}
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_TELLING = frozenset("class id role hidden aria-hidden style".split())
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int) -> int:
    """The place of the first > outside of quotes, or -1."""
    while True:
        at = _UNQUOTED.match(page, at).end()
        if at == len(page):
            return -1
        if page[at] == ">":
            return at
        at = page.find(page[at], at + 1) + 1
        if not at:
            return -1


def _tags(page: str):
    """(start, end, is an end tag, name, attributes) of the page's tags; the name is None for what
    only goes: comments, declarations, and scripts and the like with their content. Each part of
    the page is read a bounded number of times: once a tag's quotes don't close, quotes are not
    looked at any more, and an unclosed comment, script or tag takes all that is left."""
    at, quotes, size = 0, True, len(page)
    while (at := page.find("<", at)) >= 0:
        start = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, False, None, ""
            continue
        ending = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + ending)
        if m is None:
            if page[at + 1 : at + 2] not in ("!", "?"):
                at += 1
                continue
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            yield start, at, False, None, ""
            continue
        end = _tag_end(page, m.end()) if quotes else -1
        if end < 0:
            quotes, end = False, page.find(">", m.end())
        if end < 0:
            yield start, size, False, None, ""
            return
        name, at = m.group().lower(), end + 1
        if name in RAW_TAGS and not ending and page[end - 1] != "/":
            close = _RAW_END[name].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else size
            yield start, at, False, None, ""
        else:
            yield start, at, ending, name, page[m.end() : end]


class _Block:
    __slots__ = ("heading", "held", "inside", "link_chars", "marks", "out", "parts", "stops", "terse", "words")

    def __init__(self, out: bool, inside: bool, heading: bool, terse: bool, marks: tuple[_Mark, ...], held: int):
        self.parts: list[str] = []
        self.heading, self.terse = heading, terse
        self.words, self.stops = 0, 0
        self.link_chars, self.out, self.inside = 0, out, inside
        #: Marks of the elements around; the first ``held`` stand around an article or main, too.
        self.marks, self.held = marks, held


class _Mark:
    """An element whose names, or being a form, call it boilerplate."""

    __slots__ = ("lifted", "long_winded", "names")

    def __init__(self, names: set[str]):
        self.names, self.lifted = names, False
        self.long_winded = any(not LONG_WINDED.isdisjoint(_NAME_PARTS.split(n)) for n in names)


def _marked_out(attributes: str, header: bool = False) -> tuple[bool, set[str]]:
    """Whether an element's own attributes hide it or give it a boilerplate role, and its
    boilerplate names."""
    out, names = False, set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _TELLING:
            continue
        value = (a or b or c).lower()
        if name in ("class", "id"):
            for n in value.split():
                parts = _NAME_PARTS.split(n)
                if (not OUT_NAMES.isdisjoint(parts) or header and not SITE_PARTS.isdisjoint(parts)) and STATE_PARTS.isdisjoint(parts):
                    names.add(n)
        elif name == "role":
            if value.strip() in OUT_ROLES:
                out = True
            elif value.strip() == "form":
                names.add("form")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out = True
    return out, names


def blocks(page: str) -> list[_Block]:
    found: list[_Block] = []
    #: Open elements: (name, out of the text, inside an article, in a link, marks, marks around an article).
    stack: list[tuple[str, bool, bool, bool, tuple[_Mark, ...], int]] = []
    current: _Block | None = None
    at = 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            _, out, inside, _, marks, held = stack[-1] if stack else ("", False, False, False, (), 0)
            current = _Block(out, inside, any(e[0] in HEADINGS for e in stack[-3:]), any(e[0] in TERSE_TAGS for e in stack[-3:]), marks, held)
            found.append(current)
        decoded = entities.unescape(piece) if "&" in piece else piece
        current.parts.append(decoded)
        if stack and stack[-1][3]:
            current.link_chars += len(decoded.strip())

    opened: Counter[str] = Counter()

    def close(name: str, stop: frozenset[str] = frozenset()) -> None:
        if not opened[name]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                opened.subtract(e[0] for e in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    for start, end, ending, name, attributes in _tags(page):
        text(page[at:start])
        at = end
        if name is None:
            continue
        block = name in BLOCK_TAGS
        if block or name in OUT_TAGS:
            current = None
        if name == "br" and current is not None:
            current.parts.append(" ")
        if ending:
            close(name)
            continue
        if name in VOID_TAGS:
            continue
        if block:
            close("p", BLOCK_TAGS - {"p"})
        if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            close(name, frozenset(("ul", "ol", "dl", "select", "table", "menu")))
        if attributes.rstrip().endswith("/"):
            continue
        _, out, inside, link, marks, held = stack[-1] if stack else ("", False, False, False, (), 0)
        out = out or name in OUT_TAGS or name == "header" and not inside
        names: set[str] = set()
        if not out and name not in ("html", "body") and ("=" in attributes or "hidden" in attributes.lower()):
            out, names = _marked_out(attributes, name == "header")
        if name in ("article", "main"):
            names = {n for n in names if not LONG_WINDED.isdisjoint(_NAME_PARTS.split(n))}
            if not names:  # reader comments, too, are often articles
                inside, held = True, len(marks)
        if not out and name not in ("html", "body"):
            if name in MARK_TAGS:
                names.add(name)
            if names:
                marks = (*marks, _Mark(names))
        opened[name] += 1
        stack.append((name, out, inside, link or name == "a", marks, held))
    text(page[at:])
    return found


def _lift(kept: list[tuple[_Block, str]]) -> None:
    """Lift the marks that the page's prose speaks against."""
    free = [(b, len(t) - b.link_chars, len(t)) for b, t in kept if not b.out and b.link_chars <= LINKS_OUT * len(t)]
    prose = [(b, n) for b, n, whole in free if whole >= SHORT_CHARS] or [(b, n) for b, n, _ in free]
    if not any(b.marks for b, _ in prose):
        return
    total = sum(n for _, n in prose)
    holds: dict[_Mark, int] = {}
    articles: dict[_Mark, int] = {}
    for b, n in prose:
        for k, m in enumerate(b.marks):
            holds[m] = holds.get(m, 0) + n
            if k < b.held:
                articles[m] = articles.get(m, 0) + n

    def stands_free(b: _Block) -> bool:
        return all(m.lifted for m in b.marks)

    def lift(marks: list[_Mark], size: int) -> None:
        if any(m.long_winded for m in marks):
            own = set(marks)
            others = sum(n for b, n in prose if own.isdisjoint(b.marks) and stands_free(b))
            if others >= max(LONG_CHARS, size // 10):
                return
        for m in marks:
            m.lifted = True

    for m in sorted(holds, key=lambda m: m.long_winded):
        rivals = 0
        if m in articles and 2 * holds[m] <= total:
            rivals = sum(n for b, n in prose if b.inside and m not in b.marks and len(b.marks) == b.held and (m.long_winded or not any(x.long_winded for x in b.marks)))
        if 2 * holds[m] > total or articles.get(m, 0) >= max(1, rivals):
            lift([m], holds[m])
    left = sum(n for b, n in prose if stands_free(b))
    if 2 * left > total:
        return
    shared: dict[str, dict[_Mark, None]] = {}
    for m in holds:
        if not m.lifted:
            for name in m.names:
                shared.setdefault(name, {})[m] = None
    common: set[str] = set()
    for name, marks in shared.items():
        size = sum(n for b, n in prose if any(m in marks for m in b.marks))
        if 2 * size > total and left < size // 5:
            common.add(name)
    for long_winded in (False, True):
        same = [m for m in holds if not m.lifted and m.long_winded == long_winded and m.names <= common]
        if same:
            lift(same, sum(n for b, n in prose if any(m in same for m in b.marks)))


def _place_out(block: _Block) -> bool:
    return block.out or not all(m.lifted for m in block.marks)


def _count(block: _Block, text: str) -> None:
    words = text.lower().split()
    block.words, block.stops = len(words), sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words)


def _stop_words_tell(kept: list[tuple[_Block, str]]) -> bool:
    """Whether the page seems to be in a language whose stop words are known."""
    found = [(b, t) for b, t in kept if not _place_out(b) and b.link_chars <= LINKS_OUT * len(t)]
    if any(len(t) >= LONG_CHARS and b.stops >= STOP_GOOD * b.words for b, t in found):
        return True
    return sum(b.stops for b, _ in found) >= STOP_SOME * sum(b.words for b, _ in found)


def _label(block: _Block, text: str, stop_words_tell: bool) -> bool | None:
    """First pass: in, out or open."""
    if _place_out(block):
        return False
    share = block.link_chars / max(1, len(text))
    if block.inside:
        if len(text) < SHORT_CHARS:
            return None
        if share > LINKS_OUT:
            return None if block.terse else False
    elif share > LINKS_OUT or text.startswith(("©", "(c) ", "(C) ")):
        return False
    if len(text) < SHORT_CHARS:
        return None
    if not stop_words_tell:
        return True
    stops = block.stops / block.words
    if stops >= (STOP_SOME if block.inside else STOP_GOOD):
        return True if len(text) >= LONG_CHARS else None
    if block.inside and block.terse:
        return None
    return None if stops >= STOP_SOME or len(text) >= LONG_CHARS else False


def _rare(block: _Block, density: float) -> bool:
    """Whether so few stop words are improbable for a block of that density."""
    n = block.words
    return sum(math.comb(n, k) * density**k * (1 - density) ** (n - k) for k in range(block.stops + 1)) < RARE


def _nearest(labels: list[bool | None]) -> tuple[list[int | None], list[int | None]]:
    """The places of the nearest decided labels at or before and at or after each place."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for k in order:
            if labels[k] is not None:
                last = k
            near[k] = last
    return before, after


def extract(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    kept = [(b, t) for b in blocks(page) if (t := _SPACE.sub(" ", "".join(b.parts)).strip())]
    _lift(kept)
    for b, t in kept:
        _count(b, t)
    stop_words_tell = _stop_words_tell(kept)
    labels = [_label(b, t, stop_words_tell) for b, t in kept]
    within = [k for k, (b, _) in enumerate(kept) if b.inside and not _place_out(b)]
    sure = [kept[k][0] for k in within if labels[k]]
    density = sum(b.stops for b in sure) / max(1, sum(b.words for b in sure))
    for k in within:
        if labels[k] is False and kept[k][0].link_chars <= LINKS_OUT * len(kept[k][1]) and not _rare(kept[k][0], density):
            labels[k] = None
    size = {x: sum(len(kept[k][1]) for k in within if labels[k] is x) for x in (True, False)}
    if size[False] >= size[True]:
        for k in within:
            labels[k] = labels[k] or None
    gone = {k for k in within if labels[k] is False}
    before, after = _nearest(labels)
    chosen = []
    for k, (b, t) in enumerate(kept):
        label = labels[k]
        if label is None and b.inside:
            label = not {k - 1, k + 1} <= gone
        elif label is None:
            options = [(abs(x - k), -x if b.heading else x, x) for x in (before[k], after[k]) if x is not None]
            label = labels[min(options)[2]] if options else False
        if label:
            chosen.append(t)
    return "\n\n".join(chosen)


def main_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without ``html`` but with ``text`` and ``n_chars`` (columns of those names are
    replaced). One pass, no shuffle."""
    kept = [f for f in df.schema.fields if f.name.lower() not in (html.lower(), "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [extract(p) for p in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
