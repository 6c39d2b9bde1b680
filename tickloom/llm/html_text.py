"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides what it
can: blocks below page furniture (by element or by the words of class and id)
are bad; else link density, length and stop-word density give good, near good,
bad or, for what is too short to tell, ambiguous.  An element that its class or
id names, or a form, is a wrapper and no furniture if it holds most of the
page's prose and an article, a first heading or several good blocks; what names
reader comments needs ``main`` or a first heading for that.  Density is not read
in scripts that the lists do not know, nor on a page where no block has any.
Where no block is good, the near good ones are.  ``article`` and ``main``
elements are evidence where they hold much of a page's text, and not less than
the good blocks outside them: inside, near good and short blocks become good,
bad ones near good, and those of mostly links ambiguous.  The second pass
gives ambiguous blocks the label of their nearest decided neighbours, good on a
tie; near good ones stay unless both neighbours are bad.  Where containers are
evidence, blocks outside gain nothing from good ones inside.

Good blocks are joined in page order by a line feed, white space within a block
being one space and character references decoded.  Null and empty pages give the
empty text.  Malformed markup is read as far as it goes: an unclosed element
ends with its parent, a head at the latest where the body or other content
begins; only script, style, textarea and title run to the end of the page.  A
lone ``<`` is text, as is a tag that another ``<`` cuts off outside of quotes.
Buttons and choices inside a paragraph leave it whole.  The time taken grows
with the length of a page, whatever its markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Fixed lists: elements, words of class and id that name page furniture, and
# the commonest function words of the four languages.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside option input dialog menu menuitem fieldset".split())
CONTROLS = frozenset("button select".split())
RAW = "script style textarea title"
#: Elements without text of the page; and what may stand in a head.
MUTE = frozenset("template noscript svg math iframe object xmp noembed noframes canvas audio video head".split())
IN_HEAD = frozenset("base basefont bgsound link meta template noscript noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("html body div section article main header nav footer aside form ul ol dl table thead tbody tfoot tr td th blockquote figure details dialog menu fieldset select button center".split())
NAMED = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer sidebar side aside rail widget "
    "widgets related recommended share sharing social form search pagination pager toolbar skip".split()
)
#: Names of reader comments; those of the second list in class and role only.
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
TALK = frozenset("discussion discussions".split())
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which who will with you "
    "aber als am an auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch oder sich sie sind so über um und uns "
    "von vor war wie wir zu zum zur au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous ou où par pas plus pour qu que qui sa se ses son sont sur "
    "un une vous al como con cual cuando de del el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una uno y ya".split()
)
MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.4, 70, 200, 0.12, 0.25
#: Share of a page's text that articles must hold to be evidence.
ARTICLE_SHARE = 0.25

#: Share of a page's prose above which a named element is a wrapper.
WRAPPER_SHARE = 0.5
#: Letters beyond Latin ones.
_FOREIGN = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff]")

_RAW = "|".join(RAW.split())
# Possessive throughout: what a tag read is never read again for the same tag.
_QUOTED = r"""(?:[^"'<>]++|"[^"]*+"|'[^']*+')*+"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{_RAW})(?=[\s/>])(?>{_QUOTED}>|[^<>]*+>)(?:(?<=/>)|.*?(?:</(?P=raw)\s*+>|\Z))|<[!?][^<>]*+>"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>{_QUOTED}|[^<>]*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    furniture: bool
    article: bool
    heading: bool
    #: Number of the innermost named element around it, 0 if none.
    named: int
    label: str = ""


@dataclass
class Named:
    """An element whose class or id names furniture, or a form."""

    parent: int
    comments: bool
    article: bool = False
    headline: bool = False
    prose: int = 0
    good: int = 0


def _furnished(name: str, rest: str, in_article: bool) -> bool:
    return name in FURNITURE or (name == "header" and not in_article) or ("hidden" in rest.lower() or "=" in rest) and _HIDDEN.search(rest) is not None


def _role(name: str, rest: str) -> str:
    """What class, id and role name: ``comments``, other ``furniture``, or nothing."""
    if name in ("html", "body", "main", "article"):
        return ""
    words: set[str] = set()
    if "=" in rest:
        for m in _NAMES.finditer(rest):
            found = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower())
            words.update(w for w in found if w not in TALK or m[1].lower() != "id")
    if words & COMMENTS or words & TALK:
        return "comments"
    return "furniture" if name == "form" or words & NAMED else ""


class _Stack:
    """Open elements: name, furniture, inside an article, mute, named element; with the places of each name."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, 0)]
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> tuple[str, bool, bool, bool, int]:
        return self.parts[-1]

    def push(self, name: str, furniture: bool, article: bool, mute: bool, named: int) -> None:
        self.places.setdefault(name, []).append(len(self.parts))
        self.parts.append((name, furniture, article, mute, named))

    def pop(self) -> None:
        self.places[self.parts.pop()[0]].pop()

    def last(self, name: str) -> int:
        """Where ``name`` was opened last, 0 if it is not open."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def cut(self, place: int) -> None:
        while len(self.parts) > place:
            self.pop()


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    named = [Named(0, False)]
    stack = _Stack()
    pieces: list[str] = []
    linked, link, heading, at = 0, 0, False, 0
    hidden: list[str] = []

    def flush() -> None:
        nonlocal linked, pieces
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                _, furniture, article, _, inner = stack.top
                out.append(Block(text, linked, furniture, article, heading, inner))
        pieces, linked = [], 0

    def leave() -> None:
        while stack.top[3]:
            stack.pop()

    for tag in _TAG.finditer(page):
        if stack.top[0] == "head" and page[at : tag.start()].strip():
            leave()
        if tag.start() > at and not hidden and not stack.top[3]:
            piece = page[at : tag.start()]
            pieces.append(piece)
            if link:
                linked += len(piece.strip())
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        if stack.top[3] and not tag["end"] and (name == "body" or (stack.top[0] == "head" and name not in IN_HEAD)):
            leave()
        if name in MUTE and not tag["end"]:
            if not tag["rest"].endswith("/"):
                stack.push(name, *stack.top[1:3], True, stack.top[4])
            continue
        if stack.top[3]:
            # an end tag of what is open outside ends mute elements and is read below
            if not tag["end"]:
                if name not in INLINE and name not in VOID and not tag["rest"].endswith("/"):
                    stack.push(name, *stack.top[1:])
                continue
            place = stack.last(name)
            if not place or stack.parts[place][3]:
                stack.cut(place or len(stack.parts))
                continue
            leave()
        elif name in MUTE:
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in INLINE or name in CONTROLS or (hidden and name in ("option", "optgroup")):
            if name == "a":
                link = 0 if tag["end"] else 1
            elif not tag["end"] and name not in VOID and not tag["rest"].endswith("/") and (name in CONTROLS or _HIDDEN.search(tag["rest"])):
                hidden.append(name)
            if tag["end"] and hidden and hidden[-1] == name:
                hidden.pop()
            if name in CONTROLS:
                pieces.append(" ")
            continue
        flush()
        hidden, link = [], 0
        if tag["end"]:
            heading = False
            if place := stack.last(name):
                stack.cut(place)
            continue
        if name in HEADINGS:
            heading = True
        elif name in PARTS or name in ("p", "li"):
            heading = False
        if name in VOID or tag["rest"].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "option") or name in HEADINGS:
            # these end where their like or a part begins
            while stack.top[0] in ("p", "dt", "dd", "option") or stack.top[0] in HEADINGS or (name == "li" and stack.top[0] == "li"):
                stack.pop()
        elif name in PARTS:
            while stack.top[0] == "p" or stack.top[0] in HEADINGS:
                stack.pop()
        _, furniture, article, _, inner = stack.top
        if role := _role(name, tag["rest"]):
            named.append(Named(inner, role == "comments"))
            inner = len(named) - 1
        around = named[inner]
        around.headline |= name in ("h1", "main")
        around.article |= name == "article"
        article = article or name in ("article", "main")
        stack.push(name, furniture or _furnished(name, tag["rest"], article), article, False, inner)
    if stack.top[0] == "head" and page[at:].strip():
        leave()
    if at < len(page) and not hidden and not stack.top[3]:
        pieces.append(page[at:])
    leave()
    flush()
    _furnish(out, named)
    return out


def _furnish(blocks: list[Block], named: list[Named]) -> None:
    """Marks what stands in named elements that are no wrappers."""
    for b in blocks:
        if not b.furniture and b.linked / len(b.text) <= MAX_LINKS:
            named[b.named].prose += len(b.text)
            named[b.named].good += len(b.text) > LONG and _stop_density(b.text) >= STOP_LOW
    # children come after their parents
    for e in reversed(named[1:]):
        up = named[e.parent]
        up.prose, up.good, up.article, up.headline = up.prose + e.prose, up.good + e.good, up.article or e.article, up.headline or e.headline
    bad = [False] * len(named)
    for i, e in enumerate(named[1:], 1):
        landmark = e.headline or (not e.comments and (e.article or e.good > 1))
        bad[i] = bad[e.parent] or not (landmark and e.prose > WRAPPER_SHARE * named[0].prose)
    for b in blocks:
        b.furniture = b.furniture or bad[b.named]


def _stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _density(text: str) -> float:
    """Share of stop words; 1 in scripts that have none in the lists."""
    foreign = len(_FOREIGN.findall(text))
    return 1.0 if 2 * foreign > sum(map(len, _WORD.findall(text))) else _stop_density(text)


def _own_label(b: Block, dense: bool) -> str:
    """By links, length and, if ``dense``, density alone."""
    if b.furniture or b.linked / len(b.text) > MAX_LINKS:
        return "bad"
    if len(b.text) < SHORT:
        return "ambiguous"
    density = _density(b.text) if dense else 1.0
    if density >= STOP_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if density >= STOP_LOW else "bad"


def _first_pass(blocks: list[Block]) -> bool:
    """Labels all blocks; whether containers are evidence."""
    for b in blocks:
        b.label = _own_label(b, True)
    if not any(b.label in ("good", "near") for b in blocks):
        for b in blocks:
            b.label = _own_label(b, False)
    loose = [b for b in blocks if not b.furniture]
    held = sum(len(b.text) for b in loose if b.article)
    prose = sum(len(b.text) for b in loose if b.article and b.linked / len(b.text) <= MAX_LINKS)
    rival = sum(len(b.text) for b in loose if not b.article and b.label == "good")
    framed = held > 0 and held >= ARTICLE_SHARE * sum(len(b.text) for b in loose) and rival <= prose
    if framed:
        for b in loose:
            if b.article:
                mostly_links = b.linked / len(b.text) > MAX_LINKS
                b.label = "ambiguous" if mostly_links else "near" if b.label == "bad" else "good"
    if not any(b.label == "good" for b in blocks):
        for b in blocks:
            b.label = "good" if b.label == "near" else b.label
    return framed


def _second_pass(blocks: list[Block], framed: bool) -> None:
    n = len(blocks)
    decided = [b.label in ("good", "bad") for b in blocks]
    before, after = [(n + 1, "bad")] * n, [(n + 1, "bad")] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: int | None = None
        for i in order:
            if last is not None:
                foreign = framed and blocks[last].article and not blocks[i].article
                found[i] = (abs(i - last), "bad" if foreign else blocks[last].label)
            if decided[i]:
                last = i
    for i, b in enumerate(blocks):
        if not decided[i]:
            (da, a), (db, z) = before[i], after[i]
            if b.label == "near":
                good = "good" in (a, z)
            elif b.heading and z == "good":
                good = True
            else:
                good = a == z == "good" or (a != z and (a if da < db else z if db < da else "good") == "good")
            b.label = "good" if good else "bad"


def labelled_blocks(page: str | None) -> list[Block]:
    """All blocks of a page, each good or bad."""
    blocks = blocks_of(page) if page else []
    _second_pass(blocks, _first_pass(blocks))
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in labelled_blocks(page) if b.label == "good")


def _texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([main_text(page.as_py()) for page in batch], pa.string())


def _blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("text", pa.string()), ("good", pa.bool_())]))
    for batch in batches:
        yield pa.array([[{"text": b.text, "good": b.label == "good"} for b in labelled_blocks(page.as_py())] for page in batch], kind)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, replaced if there."""
    return pages.withColumn("text", arrow_udf("string")(_texts)(html))


def blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``blocks``, every block's text and whether it is kept."""
    return pages.withColumn("blocks", arrow_udf("array<struct<text:string,good:boolean>>")(_blocks)(html))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
