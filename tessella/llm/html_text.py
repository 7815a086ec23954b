"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one a block of the page. Each line has a length: a share for being a
line and one for its characters, times a weight. Plain text weighs 1. What markup says of a line is
only a weight: lines of parts with telling names (adverts, comments and the like) or in forms, lines
of links, and lines outside the article on pages that mark one weigh little. Elements that are never
text (menus, footers and so on) make no lines. Lengths are summed over a sliding window of WINDOW lines.
Where the sums rise over a bound the text surges; where they fall under it, it dives; the lines of
full weight between the two points are kept, and lines of links that stand between them. No text is
too short: one line of plain text makes a surge. The bound falls with the page's largest sum, so
where a page names all its parts as something else, the heaviest of them surge.

An article is what article, main, role=main or itemprop=articleBody mark; in it links weigh 1.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_text, table

WINDOW = 3
#: What a line counts for besides its characters, and how many of these count.
LINE, MOST_CHARS = 200, 1000
#: Weights of lines in parts with telling names or in forms, of lines of links, and of lines outside a marked article.
NAMED, LINKED, OUTSIDE = 0.02, 0.025, 0.005
#: The bound of window sums: more than what WINDOW lines of little weight add up to, less than one line of plain text.
SURGE = 100.0
#: Where all lines weigh little: the share of the largest sum.
SURGE_SHARE = 0.5

#: Elements whose content is no markup and never shown.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that hold other things than text of the page, or than the article.
ASIDE = frozenset("nav footer aside menu dialog head noscript template svg math object canvas audio video select datalist button".split())
#: Elements that a head may hold; any other ends it.
IN_HEAD = frozenset("title meta link style script base noscript template".split())
#: Elements that end a line.
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that inline ones in them don't outlast.
SCOPE = BLOCK | ASIDE
#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Class, id or role names that tell such parts.
TELLING = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus "
    "footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies respond search share sharing sidebar sidebars signup social sponsor "
    "sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Words that say only where or what kind of box, and leave a name as telling as its other words make it.
BOX = frozenset("area bar block bottom box buttons container content form global header inner items left links list main outer page panel posts primary right secondary section site slot top unit wrap wrapper".split())
#: A quoted value ends before the next tag, or else where an attribute or the tag's end follows; a quote without an end is a character like others.
_QUOTED = "|".join(rf"=\s*{q}[^{q}<]*{q}|=\s*{q}[^{q}]*{q}(?=\s*/?>|\s+[\w:@.-]+\s*=)" for q in "\"'")
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|{_QUOTED}|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What a start tag of one of these ends by itself, as its end tag may be left out.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def tells(names: str) -> bool:
    """Whether one of the names is telling as a whole: all its words are, but for those of BOX ("cookie-banner", "site-footer"; not "comment-free")."""
    for name in names.split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if any(w in TELLING for w in words) and all(w in TELLING or w in BOX or w.isdigit() for w in words):
            return True
    return False


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v[1:-1] if v[:1] in "\"'" else v) if v else "") for k, v in reversed(ATTRIBUTE.findall(raw))}


def part(name: str, raw: str) -> tuple[bool, bool, bool]:
    """Of a start tag: whether what it holds is never the article, whether names or forms say that it is something else, and whether it marks the article."""
    told = attributes(raw) if "=" in raw or "hidden" in raw.lower() else {}
    other = name in ASIDE or "hidden" in told or told.get("aria-hidden", "").lower() == "true" or "display:none" in told.get("style", "").replace(" ", "").lower()
    main = name in ("article", "main") or told.get("role", "").lower() == "main" or told.get("itemprop", "").lower() == "articlebody"
    names = " ".join(HUMP.sub("-", told.get(k, "")).lower() for k in ("class", "id", "role"))
    named = name == "form" or (name not in ("body", "html") and not main and tells(names))
    return other, named, main and not other


class Line(NamedTuple):
    text: str
    #: In a named part or a form; in a marked article; all letters and digits are links'.
    named: bool
    inside: bool
    linked: bool


class _Open(NamedTuple):
    name: str
    other: bool
    named: bool
    main: bool
    #: Named parts outside, which an article that this element marks sets aside if they are forms.
    forms: int


class Lines:
    """Reads a page's lines. Elements that are open lie on a stack; an inline element is not looked for beyond the block that holds it."""

    def __init__(self, page: str):
        self.out: list[Line] = []
        self.stack: list[_Open] = []
        #: By name, how many blocks are open; and by open block, by name, how many inline elements are open in it.
        self.blocks: Counter = Counter()
        self.inline: list[Counter] = [Counter()]
        self.other = self.named = self.forms = self.inside = self.linked = 0
        self.words: list[tuple[str, bool]] = []
        self.read(page)

    def end_line(self) -> None:
        text = " ".join("".join(w for w, _ in self.words).split())
        if text:
            linked = any(link and w.strip() for w, link in self.words) and not any(c.isalnum() for w, link in self.words if not link for c in w)
            self.out.append(Line(text, self.named + self.forms > 0, self.inside > 0, linked))
        self.words.clear()

    def push(self, name: str, raw: str) -> None:
        other, named, main = part(name, raw)
        if name == "header" and not self.inside:
            other = True
        self.stack.append(_Open(name, other, named and name != "form", main, self.forms))
        if name in SCOPE or main:
            self.blocks[name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1
        self.other += other
        self.named += named and name != "form"
        self.inside += main
        self.forms = 0 if main else self.forms + (name == "form")
        self.linked += name == "a"

    def pop(self) -> None:
        top = self.stack.pop()
        if top.name in SCOPE or top.main:
            self.blocks[top.name] -= 1
            self.inline.pop()
        else:
            self.inline[-1][top.name] -= 1
        self.other -= top.other
        self.named -= top.named
        self.inside -= top.main
        self.forms = top.forms
        self.linked -= top.name == "a"

    def close(self, name: str) -> None:
        """End the innermost element of the name and what is open in it."""
        if self.blocks[name] if name in SCOPE else self.inline[-1][name]:
            while self.stack[-1].name != name:
                self.pop()
            self.pop()
        elif self.blocks[name]:  # an element that marks the article by an attribute
            while self.stack[-1].name != name:
                self.pop()
            self.pop()

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            tag = TAG.search(page, at)
            text = page[at : tag.start() if tag else n]
            if text and not self.other:
                self.words.append((html.unescape(text), self.linked > 0))
            if not tag:
                break
            at = tag.end()
            if tag[2] is None:
                if tag[0].startswith("<![CDATA[") and not self.other:
                    self.words.append((tag[0][9:].removesuffix("]]>"), self.linked > 0))
                continue
            name, raw = tag[2].lower(), tag[3]
            if (name in BLOCK and not self.other) or name in ("body", "head"):
                self.end_line()
            if tag[1]:
                self.close(name)
                continue
            if self.blocks["head"] and name not in IN_HEAD:
                self.close("head")
            if name in RAW:
                end = re.compile(rf"</{name}(?![^\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                continue
            for closed in CLOSED_BY.get(name, ()):
                if self.stack and self.stack[-1].name == closed:
                    self.pop()
            if name in VOID or (raw.rstrip().endswith("/") and name not in BLOCK):
                continue
            if name == "a" and self.inline[-1]["a"]:
                self.close("a")
            if name in BLOCK or name in ASIDE or name == "a" or "=" in raw or "hidden" in raw.lower():
                self.push(name, raw)
        self.end_line()


def lengths(own: list[Line]) -> np.ndarray:
    """What each line counts for."""
    marked = any(x.inside for x in own)
    out = np.zeros(len(own))
    for i, x in enumerate(own):
        weight = 1.0
        if marked and not x.inside:
            weight *= OUTSIDE
        elif x.named:
            weight *= NAMED
        elif x.linked and not marked:
            weight *= LINKED
        out[i] = weight * (LINE + min(len(x.text), MOST_CHARS))
    return out


def between(lengths: np.ndarray) -> np.ndarray:
    """Which lines lie between a surge and a dive of the window sums: from the line that lifts the sum to the bound to the last one that holds it there."""
    kept = np.zeros(len(lengths), bool)
    if not len(lengths) or lengths.max() <= 0:
        return kept
    sums = np.convolve(lengths, np.ones(WINDOW))  # the windows that end at line 0 ... start at the last line
    over = sums >= min(SURGE, SURGE_SHARE * sums.max()) - 1e-9
    edges = np.flatnonzero(np.diff(np.concatenate([[False], over, [False]])))
    for surge, dive in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept[surge : max(dive - WINDOW + 1, surge + 1)] = True
    return kept


def main_text(page: str | None) -> str:
    """The lines of a page's article, joined by line feeds; empty for null, empty and textless pages."""
    own = Lines(page or "").out
    length = lengths(own)
    full = length >= (LINE if length.max(initial=0) >= LINE else np.finfo(float).tiny)
    plain = np.array([x.linked and not x.named for x in own], bool)
    marked = any(x.inside for x in own)
    return "\n".join(own[i].text for i in np.flatnonzero(between(length) & (full | (plain & (not marked)))))


def extract(df: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Kept columns with `text`, the main text of each page: empty for null and empty pages. Repeated rows stay apart."""
    return map_text(df, lambda: lambda pages: {"text": [main_text(p) for p in pages]}, "text string", column, keep)


def op9_html_lineblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
