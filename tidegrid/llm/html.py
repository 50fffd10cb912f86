"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. Blocks in menus, footers,
adverts, forms, comments and the like are boilerplate by their place. A form, or
an element that only its class or id sets apart, is a neutral wrapper instead
if it holds most of the page's articles and long prose, or all that there is. The
others are judged by stop-word density, length and link density, inside and
outside articles: the first pass decides those that are clear, the second lets
each undecided one inherit the label of its nearest decided neighbour in the same
article (or outside of all). An article or main element is a hint: in it, long
blocks with few stop words are undecided, neighbours that are not text count as
twice as far away, and blocks without a decided neighbour are text. Where no list
of stop words fits the page's language, length and link density decide alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tidegrid.llm.common import bounded_batches, without

LINKED = 0.5  # more of a block's characters in links: boilerplate
LONG = 140  # characters of a block that can decide by itself
DENSE = 0.20  # stop words among the words of prose
SPARSE = 0.05  # fewer in a long block outside an article: not prose
FAR = 2  # how much farther a neighbour that is not text counts in an article
FIT = 0.10  # a list with fewer of a page's words is not its language's
WIDE = 3  # letters that a character of a script without spaces stands for

#: Very frequent words of some languages, and the names that markup uses.
STOP_WORDS = {
    "en": "a an and are as at be by for from has he in is it its of on or that the this to was were which will with you",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im in ist mit nicht sich sie und von war werden wird zu zur",
    "fr": "a au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour qui que sa se son sur un une vous",
    "es": "a al como con de del el en es esta este ha la las lo los más no o para pero por que se sin son su sus un una y ya",
    "it": "a al alla che con da dei del della di e è gli ha i il in la le lo ma nel non per più si sono su un una",
    "pt": "a ao as com como da das de do dos e em é mais não no na o os para por que se sem sua um uma",
    "nl": "aan als bij dat de den der die dit door een en er het hij ik in is je met niet of om op te van voor was ze zijn",
}
BLOCK_TAGS = "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
HIDDEN_TAGS = "head script style template noscript iframe object svg math canvas audio video map title".split()
ASIDE_TAGS = "nav footer aside menu dialog button select textarea input fieldset label option datalist".split()
ASIDE_ROLES = "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split()
ASIDE_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer gdpr header login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription tagcloud tags toolbar topbar widget widgets"
).split()
#: Names of adverts, notices and other people's texts, which long prose does not turn into wrappers of the page.
FOREIGN_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense comment comments commentlist consent cookie cookies disqus gdpr newsletter popup promo promoted promotion related reply replies respond sponsor sponsored"
).split()
#: A name behind one of these tells of a layout, as in has-sidebar or no-ads.
MODIFIERS = "has have with without no non not hide show".split()
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
#: Tags whose end is understood when one of the others begins: what begins, and what it ends.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_RAW = {tag: re.compile(f"</{tag}(?![a-z0-9-])", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_LISTS = {"ul", "ol", "dl", "table", "select"}

_BLOCK, _HIDDEN, _ASIDE, _VOID = set(BLOCK_TAGS), set(HIDDEN_TAGS), set(ASIDE_TAGS), set(VOID_TAGS)
_ROLES, _NAMES, _FOREIGN, _MODIFIERS = set(ASIDE_ROLES), set(ASIDE_NAMES), set(FOREIGN_NAMES), set(MODIFIERS)
_STOP = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_BLANKS = re.compile(r"\s+")
#: Scripts that write words without spaces, or syllables as one character: a character there says as much as about three letters.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)


class _Hint:
    """A form, or an element whose names hint at boilerplate."""

    __slots__ = ("foreign", "article", "active", "weight")

    def __init__(self, foreign: bool):
        self.foreign, self.article, self.active, self.weight = foreign, False, True, 0


class _Block:
    __slots__ = ("parts", "linked", "aside", "article", "hints")

    def __init__(self, aside: bool, article: int, hints: tuple[_Hint, ...] = ()):
        self.parts: list[str] = []
        self.linked = 0
        self.aside, self.article, self.hints = aside, article, hints

    def text(self) -> str:
        return _BLANKS.sub(" ", "".join(self.parts)).strip()


def _set_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag, role or style say that it is not the article."""
    if tag in _ASIDE or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _hint(tag: str, attributes: str) -> _Hint | None:
    """A hint if the element is a form or its names look like boilerplate."""
    seen = {"form"} if tag == "form" else set()
    if tag not in ("body", "html", "article", "main"):
        for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            if name.lower() == "role" and value.strip("\"'").lower() == "form":
                seen.add("form")
            if name.lower() in ("class", "id"):
                for part in value.strip("\"'").split():
                    for words in ([w.lower() for w in re.split(r"[-_:]+", part) if w], [w.lower() for w in _NAME_PARTS.findall(part)]):
                        seen |= {w for before, w in zip(["", *words], words, strict=False) if w in _NAMES and before not in _MODIFIERS}
    return _Hint(bool(seen & _FOREIGN)) if seen else None


def blocks(page: str) -> Iterator[_Block]:
    """Blocks in page order. ``article`` numbers the outermost article or main element around a block (0: none)."""
    stack: list[tuple[str, bool, bool, int, tuple[_Hint, ...]]] = []  # tag, hidden, aside, article, hints
    hidden = aside = False
    hints: tuple[_Hint, ...] = ()
    article = articles = links = 0
    block = _Block(False, 0)
    place = 0
    places: dict[str, list[int]] = {}  # where a tag is open in the stack
    walls: list[int] = []  # where a block other than a paragraph is

    def say(raw: str) -> None:
        if raw and not hidden:
            text = unescape(raw)
            block.parts.append(text)
            if links:
                block.linked += len("".join(text.split()))

    def pop(to: int) -> None:
        nonlocal hidden, aside, article, hints, links
        while len(stack) > to:
            tag, hidden, aside, article, hints = stack.pop()
            places[tag].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            links -= tag == "a"

    def nearest(tags: set[str]) -> int:
        """The innermost open element of some tags, or -1."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while True:
        found = _MARKUP.search(page, place)
        say(page[place : found.start()] if found else page[place:])
        if not found:
            break
        place = found.end()
        if found[1] is not None:
            say(found[1])
        if not found[3]:
            continue
        tag, ending = found[3].lower(), bool(found[2])
        if tag == "br":
            block.parts.append(" ")
            continue
        fresh = tag in _BLOCK
        if ending:
            at = nearest({tag})
            if at >= 0 and (fresh or not walls or walls[-1] <= at):
                pop(at)
            elif not fresh:
                continue
        else:
            if fresh and stack and tag not in ("li", "td", "th", "tr", "dt", "dd", "option"):
                at = nearest({"p"})
                if at > (walls[-1] if walls else -1):
                    pop(at)
            elif tag in _CLOSES:
                while (at := nearest(_CLOSES[tag] | _LISTS)) >= 0 and stack[at][0] in _CLOSES[tag]:
                    pop(at)
            if tag == "a" and links:  # links do not nest
                pop(nearest({"a"}))
            if tag not in _VOID and not found[4].rstrip().endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                if fresh and tag != "p":
                    walls.append(len(stack))
                stack.append((tag, hidden, aside, article, hints))
                hidden = hidden or tag in _HIDDEN
                aside = aside or _set_aside(tag, found[4], article > 0)
                if not aside and (hint := _hint(tag, found[4])):
                    hints = (*hints, hint)
                if tag in ("article", "main") and not aside:
                    for hint in hints:
                        hint.article = True
                    if not article:
                        articles += 1
                        article = articles
                links += tag == "a"
                if tag in _RAW:
                    end = _RAW[tag].search(page, place)
                    say(page[place : end.start() if end else len(page)])
                    place = end.start() if end else len(page)
        if fresh or block.aside != aside or block.article != article or block.hints is not hints:
            yield block
            block = _Block(aside, article, hints)
    yield block


def densities(texts: list[str], aside: list[bool], lang: str | None) -> list[float] | None:
    """Share of stop words in each text, by the list of the language or, if that has none or does not fit, the one that fits the texts
    that are not aside. None if no list fits: under ``FIT`` of their words are in it."""
    words = [[w.strip(".,;:!?\"'()[]").lower() for w in text.split()] for text in texts]
    seen = [w for ws, out in zip(words, aside, strict=True) if not out for w in ws]
    hits = {x: sum(w in stop for w in seen) for x, stop in _STOP.items()}
    if lang not in _STOP or hits[lang] < FIT * len(seen):
        lang = max(_STOP, key=hits.__getitem__)
    if hits[lang] < FIT * len(seen):
        return None
    return [sum(w in _STOP[lang] for w in ws) / max(len(ws), 1) for ws in words]


def _lengths(texts: list[str], weigh: bool) -> list[int]:
    """Characters of each text; ``weigh``: characters of scripts without spaces count as ``WIDE``."""
    return [len(t) + ((WIDE - 1) * len(_WIDE.findall(t)) if weigh and not t.isascii() else 0) for t in texts]


def _unwrap(found: list[_Block], weights: list[int]) -> None:
    """Makes wrappers of the page neutral, from the outside in. ``weights``: characters in articles and long prose of each block."""
    total = sum(weights)
    while True:
        free, outer = 0, {}
        for block, weight in zip(found, weights, strict=True):
            own = next((h for h in block.hints if h.active), None)
            if own is None:
                free += weight
            elif weight:
                outer[id(own)] = own
                own.weight += weight
        good = [h for h in outer.values() if (not h.foreign and 2 * h.weight > total) or (not free and (h.article or not h.foreign))]
        most = max(good, key=lambda h: h.weight, default=None)
        for hint in outer.values():
            hint.weight = 0
        if most is None:
            return
        most.active = False


def label(found: list[tuple[int, float, bool, int]], dense: list[float] | None) -> list[bool]:
    """Which blocks (length, link density, aside, article) are main text, given the density of stop words of each. Without densities
    long blocks of few links are text, but for those outside of a page's articles, which are undecided."""
    first: list[bool | None] = []
    in_articles = any(article and not aside and linked <= LINKED for _, linked, aside, article in found)
    for k, (length, linked, aside, article) in enumerate(found):
        if aside or linked > LINKED:
            first.append(False)
        elif length < LONG:
            first.append(None)
        elif dense is None:
            first.append(True if article or not in_articles else None)
        elif dense[k] >= DENSE:
            first.append(True)
        elif dense[k] < SPARSE and not article:
            first.append(False)
        else:
            first.append(None)
    return _inherit(first, [f[2] for f in found], [f[3] for f in found])


def _inherit(first: list[bool | None], aside: list[bool], article: list[int]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block of the same article (0: outside), a good one on a tie. What is
    aside says nothing about its neighbours. In an article without a good block all undecided blocks are text; outside, without a
    decided block, they are if no article has text."""
    good: dict[int, list[int]] = {}
    bad: dict[int, list[int]] = {}
    for k, x in enumerate(first):
        if x is not None and not aside[k]:
            (good if x else bad).setdefault(article[k], []).append(k)
    has_article = any(a and not out and x is not False for a, out, x in zip(article, aside, first, strict=True))
    labels = []
    for k, x in enumerate(first):
        if x is None:
            a = article[k]
            if a:
                x = a not in good or _distance(good[a], k) <= FAR * _distance(bad.get(a, []), k)
            elif a in good or a in bad:
                x = _distance(good.get(a, []), k) <= _distance(bad.get(a, []), k)
            else:
                x = not has_article
        labels.append(x)
    return labels


def _distance(places: list[int], k: int) -> float:
    """From ``k`` to the nearest of sorted places."""
    at = bisect_left(places, k)
    return min((abs(p - k) for p in places[max(at - 1, 0) : at + 1]), default=inf)


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, one a line; empty if there is none."""
    if not page:
        return ""
    kept = [(t, b) for b in blocks(page) if (t := b.text())]
    if not kept:
        return ""
    texts, own = [t for t, _ in kept], [b for _, b in kept]
    lang = _LANG.search(page)
    linked = [b.linked / max(len(t.replace(" ", "")), 1) for t, b in kept]
    dense = densities(texts, [b.aside for b in own], lang and lang[1].lower())
    lengths = _lengths(texts, dense is None)
    if any(b.hints for b in own):
        good = [b.article or n >= LONG and (dense is None or dense[k] >= DENSE) for k, (b, n) in enumerate(zip(own, lengths, strict=True))]
        _unwrap(own, [0 if b.aside or link > LINKED or not g else n for g, b, link, n in zip(good, own, linked, lengths, strict=True)])
    found = [(n, link, b.aside or any(h.active for h in b.hints), b.article) for n, link, b in zip(lengths, linked, own, strict=True)]
    return "\n".join(t for t, good in zip(texts, label(found, dense), strict=True) if good)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text``. Null and empty pages have an empty text; repeated rows get repeated results; an input
    column named text is replaced."""
    bounded_batches(pages.sparkSession)
    pages = without(pages, ["text"])
    others = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], texts], [*others, "text"])

    return pages.mapInArrow(run, StructType([*[pages.schema[c] for c in others], StructField("text", StringType())]))
