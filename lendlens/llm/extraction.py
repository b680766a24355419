"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags, read in one pass. Words score positive and tags negative; where an element weighs as
boilerplate (a menu, a footer, an advert), its words are charged like its tags, within an article with nothing. The content is the contiguous run of the
highest sum, found by a linear scan; of that run the words of boilerplate elements within it are left out.

The weights come from labelled pages: those that mark their article themselves, by exactly one closed ``article`` element, or
one ``main`` where there is no article. An element (its name, with the words of class, id and role) counts for content where
it holds the article or lies in it, else against; its weight is the logarithm of the two counts' ratio. Tags are counted inside
and outside the same way. Elements named like a menu, header, footer, sidebar, notice, advert, form or comment (``TAGS``,
``NAMES``) start with ``PRIOR`` cases against them and are no content inside an article either; a header inside an article is
the article's own. All labelled pages are counted. The model holds the ``VOCABULARY`` elements on most pages, of those
on ``PAGES`` pages or more; any other has its starting weight. That is a bound of the model, not of the pages.

Text: character references are decoded, white space within a block is one space, blocks are joined by one space in page
order. Comments, scripts, styles and other elements without text of their own (``RAW``, ``HIDDEN``) are neither words nor
part of a block.

Defined cases: a null or empty page, one without words and one whose words are all boilerplate give the empty text; a page cut
off anywhere ends there, open elements with it; a closing tag without its element is a tag and no more; ``<`` before
anything but a letter, ``/``, ``!`` or ``?`` is text; of several runs of the same sum the first is taken; pages that repeat are
rows like any others; an empty table, or one without labelled pages, leaves the starting weights. Pages are read whole, whatever
their length, a batch of them at a time. Other columns of the table are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import pieces

# Kinds of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = set("head script style textarea title xmp iframe noembed noframes plaintext noscript template select option button svg canvas object audio video map".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
IN_HEAD = set("base link meta noscript script style template title".split())
#: Elements that hold others, by which the place of a word is told.
HOLDERS = set("article aside dialog div dl footer form header main menu nav ol section table ul".split()) | (HIDDEN - RAW)
# Names of what is not the article.
TAGS = set("aside dialog footer form header menu nav".split())
NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "form header login masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)

BATCH_BYTES = 8 << 20
#: Cases that an element named like boilerplate has against it, and others for and against them, before any page is counted.
PRIOR = 20.0
USUAL = (1.5, 0.5)
#: Weights lie within these bounds; a tag costs the least of it at all times.
MOST = 3.0
TAG = 0.1
VOCABULARY, PAGES = 20_000, 5

_MARK = re.compile("[\"'>]")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_WORD = re.compile("[a-z]+")


class _Scanner:
    """Goes through a page once; a quote that is never closed is looked for once only."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def end_of_tag(self, at: int) -> int:
        """The place of the ``>`` that closes a tag, past quoted values; -1 at the end of the page."""
        page = self.page
        while found := _MARK.search(page, at):
            place, mark = found.start(), found.group()
            if mark == ">":
                return place
            at = place + 1
            # A quote that opens no value, or is never closed, is a character like others.
            if mark not in self.missing and page[max(0, place - 8) : place].rstrip().endswith("="):
                stop = page.find(mark, at)
                if stop < 0:
                    self.missing.add(mark)
                else:
                    at = stop + 1
        return -1

    def parts(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name, rest): ``text``, ``open``, ``close``; rest is the text or the attributes. Comments are left out."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            start = page.find("<", at)
            if start < 0:
                yield "text", "", page[at:]
                return
            mark = page[start + 1 : start + 2]
            closing = mark == "/"
            named = _TAG_NAME.match(page, start + 1 + closing)
            if not named and mark not in ("!", "?", "/"):
                yield "text", "", page[at : start + 1]
                at = start + 1
                continue
            if start > at:
                yield "text", "", page[at:start]
            if not named:
                comment = page.startswith("<!--", start)
                stop = page.find("-->" if comment else ">", start + (4 if comment else 1))
                if stop < 0:
                    return
                at = stop + (3 if comment else 1)
                continue
            stop = self.end_of_tag(named.end())
            if stop < 0:
                return
            name = named.group().lower()
            yield ("close" if closing else "open"), name, page[named.end() : stop]
            at = stop + 1
            if not closing and name in RAW:
                found = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                if not found:
                    return
                at = found.start()


def _words_of(attributes: str) -> list[str]:
    found = [a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)]
    return sorted({w for value in found for w in _WORD.findall(value.lower())})


@dataclass
class Element:
    """An element that holds others: its key, whether it is named like boilerplate, and the items it spans."""

    name: str
    key: str
    named: bool
    start: int
    parent: Element | None
    stop: int = -1
    #: Where the innermost element named like boilerplate begins, this one or one around it; -1 where there is none.
    named_from: int = -1
    in_article: bool = False

    def __post_init__(self) -> None:
        self.in_article = self.name in ("article", "main") or bool(self.parent and self.parent.in_article)
        self.named_from = self.start if self.named else self.parent.named_from if self.parent else -1


@dataclass
class Page:
    #: (tag name, text, holder): of a tag its name and no text.
    items: list[tuple[str, str, Element | None]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def read_page(text: str) -> Page:
    page = Page()
    inside: Element | None = None
    names: Counter = Counter()

    def close(element: Element) -> Element | None:
        element.stop = len(page.items)
        names[element.name] -= 1
        return element.parent

    for kind, name, rest in _Scanner(text).parts():
        if kind == "text":
            page.items.append(("", rest, inside))
            continue
        if inside and inside.name == "head" and name not in IN_HEAD and name != "head":
            inside = close(inside)
        if kind == "open" and name in HOLDERS and not rest.endswith("/"):
            words = _words_of(rest) if rest else []
            own = names["article"] + names["main"] > 0  # a header in an article is the article's own
            key = " ".join([f"own {name}" if own and name == "header" else name, *words])
            named = name in HIDDEN or (name in TAGS and not (own and name == "header"))
            named = named or any(w in NAMES and not (own and w == "header") for w in words)
            if name in ("article", "main"):
                named = False
            inside = Element(name, key, named, len(page.items), inside)
            names[name] += 1
            page.elements.append(inside)
        page.items.append((name, "", inside))
        if kind == "close" and names[name] > 0:
            while inside.name != name:
                inside = close(inside)
            inside = close(inside)
    while inside:
        inside = close(inside)
    return page


def labelled(page: Page) -> Element | None:
    """The element in which a page marks its article, if it does so once."""
    for name in ("article", "main"):
        found = [e for e in page.elements if e.name == name]
        if found:
            return found[0] if len(found) == 1 and found[0].stop < len(page.items) else None
    return None


def evidence(pages: Iterator[str]) -> dict[tuple[str, str], list[int]]:
    """(kind, key) of elements and tags: times for content, times against, pages."""
    counts: dict[tuple[str, str], list[int]] = {}
    for text in pages:
        page = read_page(text)
        article = labelled(page)
        if not article:
            continue
        seen: dict[tuple[str, str], list[int]] = {}

        def count(kind: str, key: str, content: bool) -> None:
            seen.setdefault((kind, key), [0, 0])[not content] += 1

        for e in page.elements:
            if e.parent and e.parent.named_from >= 0:
                continue  # a list in a menu says nothing about lists
            holds = e.start <= article.start and e.stop >= article.stop
            lies = e.start >= article.start and e.stop <= article.stop
            count("element", e.key, holds or (lies and not e.named))
        for at, (name, _, holder) in enumerate(page.items):
            if name and not (holder and holder.named_from >= 0):
                count("tag", name, article.start <= at < article.stop)
        for key, (content, other) in seen.items():
            total = counts.setdefault(key, [0, 0, 0])
            total[0] += content
            total[1] += other
            total[2] += 1
    return counts


def _bounded(weight: float) -> float:
    return max(-MOST, min(MOST, weight))


@dataclass
class Weights:
    elements: dict[str, tuple[int, int]] = field(default_factory=dict)
    tags: dict[str, tuple[int, int]] = field(default_factory=dict)

    def element(self, e: Element) -> float:
        content, other = self.elements.get(e.key, (0, 0))
        if e.named:
            return _bounded(math.log((content + 1) / (other + 1 + PRIOR)))
        return _bounded(math.log((content + USUAL[0]) / (other + USUAL[1])))

    def tag(self, name: str) -> float:
        """Never above ``-TAG``: a tag that occurs outside of articles only costs most."""
        content, other = self.tags.get(name, (0, 0))
        return -max(TAG, _bounded(math.log((other + 1) / (content + 1))))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and stop of the contiguous run with the highest sum above zero, the first of several; (0, 0) if there is none."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(text: str, weights: Weights) -> str:
    page = read_page(text)
    known: dict[int, float] = {}

    def weight_in(holder: Element | None) -> float:
        """That of the element least like content around a word."""
        if holder is None:
            return math.log(USUAL[0] / USUAL[1])
        if id(holder) not in known:
            own = weights.element(holder)
            known[id(holder)] = min(own, weight_in(holder.parent)) if holder.parent else own
        return known[id(holder)]

    for e in page.elements:  # outer elements first, so that a page of any depth needs no deep recursion
        weight_in(e)
    tags = {name: weights.tag(name) for name in {x[0] for x in page.items}}

    def score(name: str, text: str, holder: Element | None) -> float:
        if name:
            return tags[name]
        weight = weight_in(holder)
        # Boilerplate within an article is left out of it and does not part it.
        return 0.0 if weight < 0 and holder.in_article else len(text.split()) * weight

    scores = [score(*item) for item in page.items]
    start, stop = best_run(scores)
    blocks, block = [], []
    for name, rest, holder in [*page.items[start:stop], ("p", "", None)]:
        if not name:
            if weight_in(holder) > 0:
                block.append(html.unescape(rest))
        elif name not in INLINE and name not in RAW:
            blocks += "".join(block).split()
            block = []
    return " ".join(blocks)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html", BATCH_BYTES):
        found = evidence(iter(batch.column("html").to_pylist()))
        rows = [(*key, *counts) for key, counts in found.items()]
        kind, key, content, other, pages = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.string()), pa.array(key, pa.string()), *(pa.array(x, pa.int64()) for x in (content, other, pages))],
            ["kind", "key", "content", "other", "pages"],
        )


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def learn(pages: DataFrame, vocabulary: int = VOCABULARY, least: int = PAGES) -> Weights:
    """Weights from all labelled pages; ``vocabulary`` elements and tags at most, each on ``least`` labelled pages."""
    counted = _pages(pages).select("html").mapInArrow(_count, "kind string, key string, content long, other long, pages long")
    added = counted.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("content", "other", "pages")])
    kept = added.where(F.col("pages") >= least).orderBy(F.desc("pages"), "kind", "key").limit(vocabulary).collect()
    weights = Weights()
    for r in kept:
        (weights.elements if r.kind == "element" else weights.tags)[r.key] = (r.content, r.other)
    return weights


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; ``weights`` are learnt from these pages if none are given."""
    weights = weights or learn(pages)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", BATCH_BYTES):
            found = [main_text(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    rows = _pages(pages)
    fields = rows.schema
    schema = f"page_id {fields['page_id'].dataType.simpleString()}, url {fields['url'].dataType.simpleString()}, text string"
    return rows.mapInArrow(extracted, schema).withColumn("n_chars", F.char_length("text").cast("long"))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages)
