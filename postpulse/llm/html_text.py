"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of blocks.  A block knows its words and link density, those of the
blocks before and after it, and what its open tags say.  A tree grown on a small labelled
table (below) keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from postpulse.llm.common import map_rows

# Elements of HTML by their role.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("head title noscript template button select option textarea svg math object iframe audio video canvas datalist".split())
_FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
_MAIN = frozenset("article main".split())
_CLOSED_BY = {  # an open element that the begin of one of these ends
    "p": _BLOCKS - {"body", "html", "title"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}), "tr": frozenset({"tr"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
}
#: What can stand in head; any other begin ends an open head.
_IN_HEAD = frozenset("head title base basefont bgsound link meta noframes noscript script style template".split())
_OWN_CONTENT = frozenset("title noscript noframes template".split())  # of these in head: nothing inside ends head
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that mark page furniture, and readers' comments.
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer "
    "footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination "
    "popup promo promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget "
    "alert banners complementary contentinfo search login byline".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond responses thread".split())
#: A name with one of these says how a page is laid out or what state it is in: no-sidebar, comments-open.
_STATES = frozenset(
    "active closed collapsed disabled enabled expanded fixed has have hide inactive is layout no non not off on open "
    "opened show static sticky template with without".split()
)
#: Headlines and names of authors inside an article are its own.
_OWN_HEADS = frozenset("header masthead".split())
_FIRM = frozenset("nav footer aside menu dialog header".split())
#: A class or id does not make these furniture.
_NEVER = frozenset("html body main article".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>script|style)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)(?:>|$|(?=<))",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_MAY_HIDE = re.compile(r"hidden|display|visibility", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Mark:
    """An element that by its tag or names holds furniture or comments, and what it holds."""

    comment: bool
    firm: bool = False  # by its tag, whatever it holds
    words: int = 0
    anchored: bool = False  # by a main, an article or a first heading inside


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_main: bool
    furniture: bool
    comment: bool
    heading: bool
    marks: tuple[Mark, ...] = ()

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Open:
    name: str
    hidden: bool = False
    unseen: bool = False  # by visibility, which an element inside can turn back
    main: bool = False
    marks: tuple[Mark, ...] = ()
    link: bool = False
    heading: bool = False


def hints(name: str, rest: str, main: bool) -> tuple[bool, bool]:
    """(furniture, comments): what the names of an element in class, id and role say of it."""
    furniture = comment = False
    if "=" in rest and name not in _NEVER:
        for found in _NAMED.findall(rest):
            for token in "".join(found).lower().split():
                named = set(_WORDS.findall(token))
                if not named & _STATES:
                    furniture |= bool(named & (_FURNITURE_WORDS - _OWN_HEADS if main else _FURNITURE_WORDS))
                    comment |= bool(named & _COMMENT_WORDS)
    return furniture, comment


def hiding(rest: str) -> tuple[bool, bool | None]:
    """(hidden with all that is inside, invisible or None if its visibility is not set), from
    the names and values of a begin tag's attributes; the first of one name counts."""
    if not _MAY_HIDE.search(rest):
        return False, None
    named: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        named.setdefault(name.lower(), html.unescape("".join(values)).strip().lower())
    style: dict[str, tuple[bool, str]] = {}
    for entry in re.sub(r"/\*.*?\*/", "", named.get("style", ""), flags=re.DOTALL).split(";"):
        name, _, value = entry.partition(":")
        value, important, _ = value.partition("!")
        if bool(important) >= style.get(name.strip(), (False, ""))[0]:
            style[name.strip()] = bool(important), value.strip()
    hidden = named.get("hidden", "false") != "false" or named.get("aria-hidden") == "true"
    visibility = style.get("visibility", (False, ""))[1]
    return (
        hidden or style.get("display", (False, ""))[1] == "none",
        visibility in ("hidden", "collapse") if visibility in ("hidden", "collapse", "visible", "initial") else None,
    )


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=lambda: [_Open("")])
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    head: bool = False  # whether a head may be open
    words: int = 0
    anchored: bool = False

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(t for t, _ in self.parts)).split())
        if text:
            top = self.stack[-1]
            linked = sum(len(html.unescape(t).split()) for t, link in self.parts if link)
            n = len(text.split())
            self.words += n
            for mark in top.marks:
                mark.words += n
            self.blocks.append(Block(text, n, min(linked, n), top.main, False, False, top.heading, top.marks))
        self.parts = []

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if not (top.hidden or top.unseen):
            self.parts.append((text, top.link))

    def leave_head(self) -> None:
        """Ends an open head: its end tag may be left out."""
        head = next((i for i, o in enumerate(self.stack) if o.name == "head"), len(self.stack))
        if not any(o.name in _OWN_CONTENT for o in self.stack[head:]):
            del self.stack[head:]
            self.head = False

    def begin(self, name: str, rest: str) -> None:
        if name == "head":
            self.head = True
        elif self.head and name not in _IN_HEAD and name != "html":
            self.leave_head()
        while len(self.stack) > 1 and name in _CLOSED_BY.get(self.stack[-1].name, ()):
            self.flush()
            self.stack.pop()
        if name in _BLOCKS:
            inline = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].name in _BLOCKS), 0)
            if self.stack[inline].name == "p" and name in _CLOSED_BY["p"]:  # <p><b>... <p>
                self.flush()
                del self.stack[inline:]
            self.flush()
        elif name == "br":
            self.parts.append((" ", False))
        if name in _VOID or rest.rstrip().endswith("/") and name not in _BLOCKS and name not in ("a", "b", "i", "span"):
            return
        top = self.stack[-1]
        hidden, unseen = hiding(rest)
        main = top.main or name in _MAIN
        furniture, comment = hints(name, rest, main)
        if name == "div" and not furniture and "main" in rest:
            main |= any("main" in _WORDS.findall("".join(x).lower()) for x in _NAMED.findall(rest))
        marks = top.marks
        if furniture or name in _FURNITURE or name == "header" and not main:
            marks += (Mark(False, name in _FIRM),)
        if comment:
            marks += (Mark(True),)
        if (name in _MAIN or name == "h1") and not any(m.comment for m in marks):
            self.anchored = True
            for mark in marks:
                mark.anchored = True
        self.stack.append(_Open(
            name, hidden=top.hidden or name in _HIDDEN or hidden, unseen=top.unseen if unseen is None else unseen,
            main=main, marks=marks, link=top.link or name == "a", heading=top.heading or name in _HEADINGS,
        ))

    def judge(self) -> None:
        """Furniture and comments by the marks that count: an element that is called so, or a form,
        is the page itself if it holds most of the page's words and the article (a main, an article
        or a first heading), or nine tenths of the words where a page has no such thing."""
        for block in self.blocks:
            for mark in block.marks:
                page = 2 * mark.words > self.words if mark.anchored else not self.anchored and 10 * mark.words > 9 * self.words
                if mark.firm or not page:
                    block.comment |= mark.comment
                    block.furniture |= not mark.comment

    def end(self, name: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].name == name), 0)
        if name in _BLOCKS:
            self.flush()
        if at and (name in _BLOCKS or all(o.name not in _BLOCKS for o in self.stack[at + 1 :])):
            del self.stack[at:]


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; hidden parts, scripts, styles and markup are gone.
    Broken and cut pages are read as far as they go."""
    state, at = _Page(), 0
    for token in _TOKEN.finditer(page):
        if state.stack[-1].name == "head" and page[at : token.start()].strip():
            state.leave_head()
        if token.start() > at:
            state.add(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if name:
            (state.end if token["close"] else lambda n, r=token["rest"]: state.begin(n, r))(name.lower())
    if state.stack[-1].name == "head" and page[at:].strip():
        state.leave_head()
    state.add(page[at:])
    state.flush()
    state.judge()
    return state.blocks


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "in_main", "furniture", "comment", "heading")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    rows, n = [], len(found)
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < n else None
        rows.append((
            b.words, b.density,
            before.words if before else 0, before.density if before else 0.0,
            after.words if after else 0, after.density if after else 0.0,
            b.in_main, b.furniture, b.comment, b.heading,
        ))
    return rows


# The labelled table: pages as rows of blocks.  A block is
#   label words/linked flags      (label: + main text, - the rest; flags: m in article or main,
#                                  f furniture by tag or name, c readers' comments, h heading)
LABELLED = """
- 1/1 f | - 1/1 f | - 1/1 f | - 9/0 f | + 8/0 mh | + 60/0 m | + 45/2 m | + 12/0 m | - 14/0 f
- 1/1 f | - 1/1 f | - 2/2 f | + 6/0 mh | + 1/0 m | + 3/0 m | + 140/4 m | + 2/0 m | - 9/1 f
- 30/0 f | + 9/0 mh | + 210/0 m | - 25/0 mf | + 80/3 m | - 4/4 mf | - 12/0 f
- 3/3 | - 2/2 | - 4/4 | - 1/1 | + 7/0 h | + 55/1 | + 90/0 | + 35/2 | - 5/5 | - 3/3 | - 8/0
- 2/2 | - 2/2 | + 40/0 | + 65/3 | + 5/0 h | + 70/0 | - 6/6 | - 9/9
- 1/1 f | + 10/0 mh | + 33/1 m | + 28/0 m | - 2/0 mch | - 5/0 mc | - 40/0 mc | - 22/0 mc | - 3/3 f
+ 11/0 mh | + 75/0 m | + 4/4 m | + 80/2 m | + 18/18 m | + 60/0 m | - 3/0 ch | - 70/0 c | - 35/1 c | - 12/4 f
- 5/5 | - 6/6 | - 4/0 | + 9/0 h | + 120/5 | + 14/0 | + 88/0 | - 12/0 f | - 55/0 f | - 3/3
- 16/0 f | - 20/2 f | + 5/0 h | + 48/0 | + 52/1 | - 60/0 c | - 44/0 c | - 2/2
- 1/1 | - 1/1 | - 1/1 | - 2/0 | - 1/1 | - 3/3 | + 6/0 h | + 32/0 | + 45/0 | - 10/8 | - 6/6
+ 3/0 mh | + 9/0 m | + 7/0 m | + 2/0 m | + 11/0 m | - 18/0 f
- 40/38 f | - 9/0 f | + 6/0 mh | + 25/0 m | + 7/7 m | + 31/0 m | - 50/50 f | - 35/0 f
- 7/7 | + 300/3 | + 280/0 | - 8/7 | - 4/4
- 1/1 f | - 12/0 f | + 12/0 mh | + 0/0 m | + 500/10 m | + 420/0 m | - 15/0 f
- 2/0 f | - 2/0 f | - 1/0 f | + 1/0 mh | + 1/0 m | + 1/0 m | - 1/0 f
- 1/0 fh | - 5/5 f | + 7/0 h | + 60/0 | + 12/0 | + 17/0 | + 90/2 | - 3/0 fh | - 8/8 f | - 6/0 f
- 2/0 fh | - 3/3 f | + 6/0 mh | + 50/0 m | - 2/0 fh | - 30/0 f | - 10/0 f
+ 5/0 h | + 70/0 | + 13/0 | + 16/1 | + 55/0 | - 4/4 | - 2/2
- 3/3 | - 2/0 h | - 4/4 | - 5/5 | + 8/0 h | + 44/0 | + 11/0 | + 38/1 | - 2/0 h | - 6/6
- 1/0 fh | - 1/1 f | + 5/0 mh | + 36/0 m | - 1/0 mch | - 16/0 mc | - 4/0 mc | - 3/0 f
- 6/0 | - 3/3 | - 3/3 | - 5/5 | + 22/0 | + 19/0 h | + 64/0 | + 41/3 | - 2/0 | - 4/4 | - 7/5
"""


def labelled_rows() -> tuple[list[tuple[float, ...]], list[bool]]:
    rows, labels = [], []
    for line in LABELLED.strip().splitlines():
        found = []
        for entry in line.split("|"):
            label, size, *flags = entry.split()
            words, linked = map(int, size.split("/"))
            marks = "".join(flags)
            found.append(Block("", words, linked, "m" in marks, "f" in marks, "c" in marks, "h" in marks))
            labels.append(label == "+")
        rows += features(found)
    return rows, labels


def grow(rows: list[tuple[float, ...]], labels: list[bool], depth: int = 6, fewest: int = 2) -> tuple | bool:
    """A decision tree as nested (feature, threshold, at most, above); leaves are verdicts.
    Splits lower the Gini impurity most; ties go to the first feature and threshold."""
    n, good = len(labels), sum(labels)
    if good in (0, n) or depth == 0 or n < 2 * fewest:
        return 2 * good >= n
    impurity = lambda k, m: 2 * k * (m - k) / m if m else 0.0
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(n), key=lambda i, f=f: rows[i][f])
        left = 0
        for at in range(1, n):
            left += labels[order[at - 1]]
            low, high = rows[order[at - 1]][f], rows[order[at]][f]
            if low == high or at < fewest or n - at < fewest:
                continue
            cost = impurity(left, at) + impurity(good - left, n - at)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (low + high) / 2)
    if best is None or best[0] >= impurity(good, n) - 1e-12:
        return 2 * good >= n
    _, f, cut = best
    sides = [[i for i in range(n) if (rows[i][f] > cut) == above] for above in (False, True)]
    return (f, cut, *(grow([rows[i] for i in s], [labels[i] for i in s], depth - 1, fewest) for s in sides))


def decide(tree: tuple | bool, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def main_text(page: str, tree: tuple | bool) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extract_text(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, list[str]]:
    """``pages`` with one more column (its name is returned): the main text.

    * White space inside a block is one space; blocks are joined by two line feeds in page
      order.  Nothing kept is cut.
    * A null or empty page, and one without main text, gives the empty text.
    * Every row and column of ``pages`` stays and nothing is shuffled.
    """
    tree = grow(*labelled_rows())

    def run(texts: pa.Array) -> Iterator[tuple]:
        for text in texts:
            yield (main_text(text.as_py() or "", tree),)

    return map_rows(pages, html_col, run, [("text", "string", pa.string())])
