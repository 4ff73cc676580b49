"""HTML extraction (12) by tree scoring: the main text of each page.

A page becomes a tree of its block elements; a run of text between the edges of blocks is a paragraph. A paragraph
passes points for its length and its commas to the element that it stands in, half of them to that one's parent, and a
growing fraction to LEVELS ancestors in all. An element's score is its points, with a bonus for what says that it holds
an article, times the share of its text that isn't in links. The best container is kept with those siblings that belong
to it: with a score near its own, or headings right before it. A container within an article stands for the article.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and readers' comments neither
score nor stay, by element, role, or the words of class and id; an article's own header keeps its headings. Lists and
tables within the container of which more than half is links go as well. If nothing is left outside forms, forms count
as containers (some pages are one form).

Character references are decoded, white space within a paragraph becomes one space, and paragraphs are joined by two
line feeds in page order. Nothing else is dropped or cut. Null, empty and text-free pages give an empty text; html that
breaks off is read as far as it goes; unclosed and misplaced tags end where a browser would end them. Ties go to the
element that begins first. Repeated rows are extracted each. An empty table gives no rows. A page is read in time
proportional to its length, whatever its nesting, and is one row of one task: nothing is shuffled. Columns other than
page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import in_parts, table

ORACLE_SQL = None  # a parser of html

#: Bytes of html that Python copies at once.
BLOCK_BYTES = 2_000_000
#: Ancestors that get points from a paragraph.
LEVELS = 5
#: Share of the best container's score from which on a sibling belongs to it (LEAST_SCORE at least), and share of links
#: from which on lists go.
SIBLING_SHARE, LEAST_SCORE, LINK_SHARE = 0.2, 5.0, 0.5
SEMANTIC_BONUS, PARAGRAPH_CHARS = 25.0, 25

_words = lambda text: frozenset(text.split())
RAW = _words("script style textarea title xmp iframe noembed noframes")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
SKIPPED = _words("script style noscript template svg math iframe object canvas audio video select datalist button textarea title nav aside footer menu dialog head noframes noembed")
BLOCKS = _words(
    "html body address article blockquote center details summary dd div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup li main ol p pre"
    " section search table caption tbody td tfoot th thead tr ul hr"
)
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
LISTS = _words("ul ol dl table div section")
#: What an opening tag ends, if it is open within the nearest of the second.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
ROLES = _words("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status")
#: Words of class and id that name what isn't main text; the second kind also as the beginning of a longer word.
OTHER = _words(
    "ad ads adbox adslot adunit adsense adblock nav navbar subnav topnav mainnav sitenav menu submenu mainmenu topbar bottombar footer foot masthead banner crumbs pager notice notices alert"
    " popup overlay consent gdpr share sharing social related recommended recommendations subscribe signup login toolbar widget widgets copyright colophon skip skyscraper"
    " reply replies respond responses discussion shoutbox feedback form search tags hidden teaser rail trending"
)
OTHER_STEMS = ("advert", "sponsor", "promo", "comment", "disqus", "cookie", "sidebar", "newsletter", "breadcrumb", "pagination", "navigation", "modal", "outbrain", "taboola")
#: A class with one of these says that a page has or lacks something, not what the element is.
ABOUT = _words("has with without no is open closed enabled disabled")
MAIN = _words("article content main body entry post story text prose")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_ATTRIBUTE = r"""[\s/]*+(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?+"""
_MARKUP = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^A-Za-z][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:{_ATTRIBUTE})*+)[\s/]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_COMMAS = re.compile("[,،、，]")


class Element:
    """A block element: its paragraphs' points and text. hides: 0 nothing, 1 all but headings, 2 everything.

    stands_for: "article" or "main" if its name or role says so, or else what its parent stands for; whole: whether it says so itself.
    """

    __slots__ = ("bonus", "chars", "hides", "linked", "links", "name", "number", "parent", "points", "stands_for", "whole")

    def __init__(self, name: str, parent: Element | None, number: int, hides: int, stands_for: str, whole: bool, bonus: float):
        self.name, self.parent, self.number, self.hides, self.stands_for, self.whole, self.bonus = name, parent, number, hides, stands_for, whole, bonus
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, 0

    def score(self) -> float:
        return (self.points + self.bonus) * (1 - self.linked / self.chars) if self.chars and self.points else 0.0


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _NAMED.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def parts_of(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def is_other(name: str, first_only: bool = False) -> bool:
    """Whether a class or an id names what isn't main text, by any of its words or by the first one."""
    parts = parts_of(name)
    return any(p in OTHER or p.startswith(OTHER_STEMS) for p in parts[: 1 if first_only else None]) and not ABOUT.intersection(parts)


def hidden(name: str, found: dict[str, str]) -> bool:
    style = re.sub(r"\s", "", found.get("style", "").lower())
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    if name in ("main", "body", "html"):
        return False
    # Articles carry the words of their subjects in further classes.
    return any(is_other(c, first_only=name == "article") for c in [*found.get("class", "").split(), found.get("id", "")])


class Page:
    """The tree of one page: elements in page order, and (element, text) of each paragraph."""

    def __init__(self, html: str, with_forms: bool):
        self.with_forms = with_forms
        self.elements = [Element("html", None, 0, 0, "", False, 0.0)]
        self.paragraphs: list[tuple[Element, str]] = []
        self.stack: list[Element] = [self.elements[0]]
        self.open: dict[str, list[int]] = {"html": [0]}
        self.text: list[str] = []
        self.link_at, self.link_text, self.link_count = 0, [], 0
        self.inline_hidden: list[tuple[str, int]] = []
        self.read(html)

    def read(self, html: str) -> None:
        at = 0
        while at < len(html):
            found = _MARKUP.search(html, at)
            self.add(html[at : found.start() if found else len(html)])
            if not found:
                break
            at, name = found.end(), (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                self.end(name)
                continue
            self.begin(name, found[3])
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                at = end.start() if end else len(html)
        self.flush()

    def add(self, text: str) -> None:
        if text and not self.inline_hidden and self.stack[-1].hides < 2:
            self.text.append(text)
            if self.link_at:
                self.link_text.append(text)

    def flush(self) -> None:
        """Ends a paragraph."""
        if not self.text:
            return
        text, linked = " ".join(unescape("".join(self.text)).split()), len(" ".join(unescape("".join(self.link_text)).split()))
        here, links = self.stack[-1], self.link_count
        self.text, self.link_text, self.link_count = [], [], 0
        heading = here.name in HEADINGS
        if not text or here.hides and not heading:
            return
        self.paragraphs.append((here, text))
        points = len(text) / 100 if heading or len(text) < PARAGRAPH_CHARS else 1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)
        here.chars, here.linked, here.links = here.chars + len(text), here.linked + linked, here.links + links
        # An element of paragraphs is their container; p, pre and headings pass their points on whole.
        to = here.parent if here.name in ("p", "pre", "li", "td", "blockquote", *HEADINGS) and here.parent else here
        for level in range(LEVELS):
            to.points += points / (1 if not level else 2 if level == 1 else 3 * level)
            if not to.parent:
                break
            to = to.parent

    def close(self, position: int) -> None:
        """Ends the open elements from that position of the stack on. Their text counts as their parents' as well."""
        self.flush()
        while len(self.stack) > position:
            element = self.stack.pop()
            self.open[element.name].pop()
            up = element.parent
            if up:
                up.chars, up.linked, up.links = up.chars + element.chars, up.linked + element.linked, up.links + element.links
        if self.link_at > position:
            self.link_at = 0
        while self.inline_hidden and self.inline_hidden[-1][1] > position:
            self.inline_hidden.pop()

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    def begin(self, name: str, attribute_text: str) -> None:
        if name == "br" or name == "hr" or name == "wbr":
            if name == "hr":
                self.flush()
            elif name == "br":
                self.add(" ")
            return
        if name in ("html", "body") and self.open.get(name):
            return
        if name in VOID:
            return
        found = attributes(attribute_text) if attribute_text.strip(" /\n\t") else {}
        skip = name in SKIPPED or (name == "form" and not self.with_forms) or (bool(found) and hidden(name, found))
        if name not in BLOCKS and name not in SKIPPED:
            if name == "a":
                self.link_at = len(self.stack)
                self.link_count += 1
            if self.inline_hidden or skip:
                self.inline_hidden.append((name, len(self.stack)))
            return
        if name in ENDS:
            ended, within = ENDS[name]
            if (at := self.last(ended)) > self.last(within):
                self.close(at)
        if (at := self.last(("p",))) > self.last(("td", "th", "table", "button", "li", "div", "blockquote")):
            self.close(at)
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.close(len(self.stack) - 1)
        self.flush()
        up = self.stack[-1]
        hides = max(up.hides, 2 if skip else 0)
        named = [parts_of(c) for c in [*found.get("class", "").split(), found.get("id", "")]] if found else []
        says_main = name not in ("html", "body") and any(MAIN.intersection(parts) for parts in named)
        if (name == "header" or (name == "div" and any(parts[-1:] == ["header"] for parts in named))) and hides < 2:
            hides = 1 if says_main or up.stands_for else 2
        role, item = found.get("role", "").lower(), found.get("itemprop", "").lower()
        stands_for = name if name in ("article", "main") else role if role in ("article", "main") else "article" if item == "articlebody" else ""
        bonus = SEMANTIC_BONUS * (bool(stands_for) + says_main)
        element = Element(name, up, len(self.elements), hides, stands_for or up.stands_for, bool(stands_for), bonus)
        self.elements.append(element)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(element)

    def end(self, name: str) -> None:
        if name == "br":
            self.add(" ")
        elif name in BLOCKS or name in SKIPPED:
            if name in ("html", "body"):
                self.flush()
                return
            if name in HEADINGS and not self.open.get(name) and self.stack[-1].name in HEADINGS:
                name = self.stack[-1].name
            held = self.open.get(name)
            if held and not (name in ("p", "li", "td", "th", "tr") and held[-1] < self.last(("table", "ul", "ol"))):
                self.close(held[-1])
        else:
            if name == "a":
                self.link_at = 0
            if self.inline_hidden and any(n == name for n, _ in self.inline_hidden):
                while self.inline_hidden.pop()[0] != name:
                    pass

    def finish(self) -> None:
        self.close(1)

    def main(self) -> list[str]:
        """The paragraphs of the best container and of the siblings that belong to it."""
        self.finish()
        candidates = [e for e in self.elements if not e.hides and e.points]
        if not candidates:
            return []
        best = max(candidates, key=lambda e: (e.score(), -e.number))
        if best.score() <= 0:
            return []
        # The nearest element that stands for an article, or else for the main part.
        if best.stands_for:
            while best.parent and best.parent.stands_for == best.stands_for and not best.whole:
                best = best.parent
        kept = {best.number}
        if best.parent and not best.stands_for:
            enough = max(best.score() * SIBLING_SHARE, LEAST_SCORE)
            for e in self.elements:
                if e.parent is best.parent and not e.hides:
                    before = e.name in ("h1", "h2", "hgroup") and e.number < best.number
                    linked = e.linked / max(e.chars, 1)
                    paragraph = e.name == "p" and (linked < 0.25 if e.chars > 80 else e.chars > 0 and not linked)
                    if before or paragraph or e.score() >= enough:
                        kept.add(e.number)
        # Whether each element is kept, from its parent on; elements come after their parents.
        inside: list[bool] = []
        for e in self.elements:
            within = e.number in kept or (e.parent is not None and inside[e.parent.number])
            linked = e.name in LISTS and e.number not in kept and e.links > 1 and e.linked > LINK_SHARE * e.chars
            inside.append(within and not linked)
        return [text for e, text in self.paragraphs if inside[e.number]]


def main_text(html: str) -> str:
    """The main text of one page."""
    blocks = Page(html, with_forms=False).main() if html else []
    if not blocks and "<form" in html.lower():
        blocks = Page(html, with_forms=True).main()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 2, BLOCK_BYTES):
            texts = [main_text(html or "") for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
