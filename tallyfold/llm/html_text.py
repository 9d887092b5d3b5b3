"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags in one pass, linear in its length.
The first pass decides blocks: bad where they are mostly links, good where they are
long enough and dense in stop words, bad where they are long without stop words; the
rest is ambiguous.  In the second pass an ambiguous block takes the label of the
nearest decided block of its region, before or after it.

A region is the whole page, or, on a page that marks its article (``article`` or
``main``), the article: blocks outside are bad then, and inside blocks without stop
words (tables, code) are ambiguous and not bad.  Where a good and a bad block are
equally near, a heading goes with the block after it and any other block is good if
it holds a stop word; an ambiguous block as dense in stop words as prose, only short, is
good if the nearest decided block on either side is; where a marked article has no decided block, all of it is good,
and elsewhere the run of ambiguous blocks that holds most stop words is, if it looks like
prose.  The language is the one whose stop words the text holds most of; a text that
holds few of any list is judged by length and links.

Boilerplate is cut out before and nobody's neighbour.  Menus, page footers, hidden
elements and reader comments always are; asides, headers, forms, dialogs and what
class names call boilerplate are, unless they hold more than half of the page's text
(links and comments aside) or the greater part of its marked article.  If then nothing
good is left, or on an unmarked page less than a quarter of what these hold, they
are read with the rest.

Text inside a block has its character references decoded and its white space
turned into single blanks; kept blocks are joined by line feeds.

Defined cases: null or empty html gives an empty text of 0 characters; unclosed
tags close with their parents; a tag cut off at the end of the page is dropped;
unclosed scripts, styles, titles and text areas reach to the end of the page, other
silent elements without an end tag hold nothing; a page of menus, links and single short
lines has the empty text; repeated rows are extracted one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Stop words by language.
STOP_WORDS = {
    "en": "a an and are as at be been but by can for from had has have he her his if in into is it its not of on or our she so that the their them then there these they this to was we were which who will with would you",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wird zu zum zur",
    "fr": "à au aux avec ce ces dans de des du elle en est et été être il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tout un une vous",
    "es": "a al como con de del el ella en entre era es esta este fue ha han hay la las le lo los más me mi muy no o para pero por que se ser si sin sobre son su sus también un una y ya",
}
# Elements by their part in the layout.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT_TAGS = frozenset("noscript template svg object select canvas audio video".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BOILERPLATE_TAGS = frozenset("nav footer menu button".split())
WEIGHED_TAGS = frozenset("aside header form dialog".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login toolbar pagination pager".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: A class like "has-sidebar" speaks of something else on the page.
NOT_OF_ITSELF = frozenset("has with no without show hide".split())
BOILERPLATE_ROLES = frozenset("navigation contentinfo search menu menubar".split())
WEIGHED_ROLES = frozenset("banner complementary form dialog alert alertdialog".split())

MAX_LINK_DENSITY = 0.33
SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
#: Characters a word may have on average where no list of stop words tells text from data.
WORD_CHARS = 60
#: Share of a language's stop words from which a text is taken to be in it.
STOP_LEAST = 0.25

_langs: dict[str, int] = {}  # languages of a stop word, a bit each
for _k, _words in enumerate(STOP_WORDS.values()):
    for _w in _words.split():
        _langs[_w] = _langs.get(_w, 0) | 1 << _k
_name = re.compile(r"[a-zA-Z][^\s/>]*")
_until_value = re.compile(r"[^>=]*")
_blank = re.compile(r"\s*")
_attribute = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_word = re.compile(r"\w+")
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}
_silent_end = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SILENT_TAGS}


@dataclass(slots=True)
class Region:
    """An element whose tag, role, class or id says boilerplate, and what was found in it."""

    parent: Region | None
    tag: str
    comments: bool
    in_article: bool
    chars: int = 0
    article_chars: int = 0
    bad: bool = False


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    cut: bool  # in a menu, a page footer, a hidden element or reader comments
    in_article: bool
    heading: bool
    region: Region | None = None
    doubtful: bool = False  # in a region that seems to be boilerplate
    words: int = 0
    held: tuple[int, ...] = ()  # stop words by language


def tag_end(page: str, at: int) -> int:
    """Position after the ``>`` of a tag that begins before ``at``; -1 if it is cut off."""
    begin = at
    while True:
        at = _until_value.match(page, at).end()
        if at == len(page):
            return -1
        if page[at] == ">":
            return at + 1
        at = _blank.match(page, at + 1).end()
        if page[at : at + 1] in ('"', "'"):
            end = page.find(page[at], at + 1)
            if end < 0:  # a quote that never ends: the first bracket ends the tag
                return page.find(">", begin) + 1 or -1
            at = end + 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _attribute.finditer(text)} if "=" in text else {}


def _says_boilerplate(names: str) -> set[str]:
    """Boilerplate words in the values of class and id."""
    out = set()
    for name in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        out.update(w for i, w in enumerate(words) if w in BOILERPLATE_WORDS and not (i and words[i - 1] in NOT_OF_ITSELF))
    return out


@dataclass(slots=True)
class _Reader:
    """State of the pass over one page."""

    page: str
    blocks: list[Block] = field(default_factory=list)
    regions: list[Region] = field(default_factory=list)
    stack: list[tuple] = field(default_factory=list)  # (tag, flagged, region before it)
    at_blocks: list[int] = field(default_factory=list)  # places of block elements in the stack
    open: dict[str, int] = field(default_factory=dict)  # open elements by tag
    flagged: int = 0  # open elements that are boilerplate for certain
    silent: int = 0
    region: Region | None = None
    text: list[str] = field(default_factory=list)
    link_chars: int = 0
    breaks: int = 0
    closings: dict[str, list[int]] = field(default_factory=dict)

    def in_article(self) -> bool:
        return bool(self.open.get("article") or self.open.get("main"))

    def end_block(self) -> None:
        whole = " ".join(html.unescape("".join(self.text)).split())
        if whole:
            heading, region = any(self.open.get(h) for h in HEADINGS), self.region
            # the heading of an article may stand in the article's own header
            if heading and region and region.tag == "header" and region.in_article and not region.parent:
                region = None
            self.blocks.append(Block(whole, self.link_chars, self.flagged > 0, self.in_article(), heading, region))
        self.text.clear()
        self.link_chars = self.breaks = 0

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, flagged, region = self.stack.pop()
            self.open[tag] -= 1
            self.silent -= tag in SILENT_TAGS
            self.region = region
            self.flagged -= flagged
            if self.at_blocks and self.at_blocks[-1] == len(self.stack):
                self.at_blocks.pop()

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.pop_to(k)

    def push(self, tag: str, text: str) -> None:
        values, inside = _attributes(text), self.in_article()
        role, region = values.get("role"), self.region
        flagged = tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or values.get("aria-hidden") == "true"
        flagged = flagged or bool(_hidden.search(values.get("style", "")))
        flagged = flagged or "hidden" in text and "hidden" in _attribute.sub(" ", text).lower().split()
        if tag not in ("html", "body"):
            words = _says_boilerplate(f"{values.get('class', '')} {values.get('id', '')}") if values else set()
            comments = not words.isdisjoint(COMMENT_WORDS)
            # an article is a comment only inside another; its other names speak of its parts
            if tag in ("article", "main"):
                words = words if comments and inside else set()
            if words or tag in WEIGHED_TAGS or role in WEIGHED_ROLES:
                self.region = Region(region, tag, comments, inside)
                self.regions.append(self.region)
        self.stack.append((tag, flagged, region))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT_TAGS
        self.flagged += flagged
        if tag in BLOCK_TAGS:
            self.at_blocks.append(len(self.stack) - 1)

    def ends_later(self, tag: str, at: int) -> bool:
        if tag not in self.closings:
            self.closings[tag] = [m.start() for m in _silent_end[tag].finditer(self.page)]
        return bisect(self.closings[tag], at) < len(self.closings[tag])

    def start(self, tag: str, text: str, at: int) -> int:
        """Handles a start tag that ends at ``at``; returns where to go on."""
        if tag == "br":
            self.breaks += 1
            self.text.append(" ")
            if self.breaks == 2:
                self.end_block()
            return at
        empty = text.rstrip().endswith("/")
        if tag in RAW_TAGS and not empty:
            end = _raw_end[tag].search(self.page, at)
            return end.start() if end else len(self.page)
        if tag in BLOCK_TAGS:
            self.end_block()
            # an unclosed paragraph or list item ends here
            last = self.stack[self.at_blocks[-1]][0] if self.at_blocks else None
            if last == "p" or tag == last == "li":
                self.pop_to(self.at_blocks[-1])
        if not (tag in VOID_TAGS or empty or tag in SILENT_TAGS and not self.ends_later(tag, at)):
            self.push(tag, text)
        return at

    def read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            mark = page.find("<", at)
            mark = n if mark < 0 else mark
            kind = page[mark + 1 : mark + 2]
            stop = mark
            if mark < n and not (kind.isascii() and kind.isalpha() or kind in ("/", "!", "?") and kind):
                stop = mark + 1  # a bracket that begins no tag
            if stop > at:
                if not self.silent:
                    piece = page[at:stop]
                    self.text.append(piece)
                    if self.open.get("a"):
                        self.link_chars += len("".join(piece.split()))
                    if self.breaks and not piece.isspace():
                        self.breaks = 0
                at = stop
                continue
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 2)
                at = n if end < 0 else end + 3
                continue
            name = _name.match(page, mark + (2 if kind == "/" else 1))
            end = tag_end(page, name.end()) if name else page.find(">", mark) + 1 or -1
            if end < 0:
                break
            at = end
            if name:
                tag = name[0].lower()
                if kind == "/":
                    if tag in BLOCK_TAGS:
                        self.end_block()
                    self.close(tag)
                else:
                    at = self.start(tag, page[name.end() : end - 1], end)
        self.end_block()


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order, boilerplate marked."""
    reader = _Reader(page)
    reader.read()
    for region in reader.regions:  # parents come first
        region.comments |= bool(region.parent and region.parent.comments)
    total = article = 0
    for block in reader.blocks:
        region = block.region
        block.cut |= bool(region and region.comments)
        if not block.cut:
            n = max(len(block.text) - block.link_chars, 0)
            total, article = total + n, article + n * block.in_article
            if region:
                region.chars += n
                region.article_chars += n * block.in_article
    for region in reversed(reader.regions):
        if region.parent:
            region.parent.chars += region.chars
            region.parent.article_chars += region.article_chars
    for region in reader.regions:
        around = not region.in_article and 2 * region.article_chars > article and 4 * region.chars > total
        region.bad = not (around or 2 * region.chars > total) or bool(region.parent and region.parent.bad)
    for block in reader.blocks:
        block.doubtful = bool(block.region and block.region.bad)
        words = _word.findall(block.text.lower())
        found = Counter(filter(None, map(_langs.get, words)))
        block.words, block.held = len(words), tuple(sum(c for bits, c in found.items() if bits >> k & 1) for k in range(len(STOP_WORDS)))
    return reader.blocks


GOOD, BAD, AMBIGUOUS = 1, 0, None


def language(blocks: list[Block]) -> int | None:
    """Number of the language whose stop words the blocks hold most of; None if they hold few."""
    words = sum(b.words for b in blocks)
    held = [sum(b.held[k] for b in blocks) for k in range(len(STOP_WORDS))]
    best = max(range(len(held)), key=held.__getitem__)
    return best if held[best] >= STOP_LEAST * max(words, 1) else None


def first_pass(block: Block, lang: int | None, marked: bool) -> tuple[int | None, bool]:
    """(label of a block by itself, whether it holds a stop word)."""
    n, held = len(block.text), 0 if lang is None else block.held[lang]
    density = held / block.words if block.words else 0.0
    if block.link_chars > MAX_LINK_DENSITY * max(1, n - block.text.count(" ")):
        return BAD, held > 0
    if n < SHORT_CHARS:
        return BAD if block.link_chars and not marked else AMBIGUOUS, held > 0
    if lang is None:
        if n > WORD_CHARS * block.words:
            return BAD, False
        return GOOD if n > LONG_CHARS else AMBIGUOUS, False
    if marked:
        return GOOD if density >= STOP_LOW else AMBIGUOUS, held > 0
    if density >= STOP_HIGH:
        return GOOD if n > LONG_CHARS else AMBIGUOUS, held > 0
    return AMBIGUOUS if density >= STOP_LOW else BAD, held > 0


def prose_run(blocks: list[Block], labels: list[int | None], lang: int | None) -> list[int | None]:
    """Labels of a region without good blocks: its best run of ambiguous blocks is good.

    The run with most stop words, or characters where there is no list; it must be
    SHORT_CHARS long and, where there is one, as dense in stop words as prose.
    """
    runs: list[list[int]] = [[]]
    for i, label in enumerate(labels):
        if label is AMBIGUOUS:
            runs[-1].append(i)
        elif runs[-1]:
            runs.append([])

    def sums(run: list[int]) -> tuple[int, int, int]:
        chars, words = sum(len(blocks[i].text) for i in run), sum(blocks[i].words for i in run)
        return (chars if lang is None else sum(blocks[i].held[lang] for i in run)), chars, words

    best = max(runs, key=lambda run: sums(run)[0])
    held, chars, words = sums(best)
    if chars < SHORT_CHARS or lang is not None and held < STOP_LOW * words:
        return labels
    for i in best:
        labels[i] = GOOD
    return labels


def second_pass(labels: list[int | None], leans: list[int | None], alone: int = BAD, prose: list[bool] | None = None) -> list[int]:
    """Ambiguous blocks inherit from the nearest decided block of their region.

    ``prose``: blocks that read like text and are only short; they are good if the nearest
    decided block on either side is.

    ``leans``: the label of a block between a good and a bad one equally near; None
    for the label of the one after it.  ``alone``: what they are where none is decided.
    """
    n = len(labels)
    far = (n + 1, None)

    def nearest(order) -> list[tuple]:
        out, last = [far] * n, far
        for i in order:
            last = (0, labels[i]) if labels[i] is not None else (last[0] + 1, last[1])
            out[i] = last
        return out

    out = []
    for (a, before), (b, after), lean, text in zip(nearest(range(n)), nearest(range(n - 1, -1, -1)), leans, prose or [False] * n):
        if before is None and after is None:
            out.append(alone)
        elif text and a and GOOD in (before, after):
            out.append(GOOD)
        elif before is None or after is None:
            out.append(after if before is None else before)
        elif before == after or a != b:
            out.append(before if a <= b else after)
        else:
            out.append(after if lean is None else lean)
    return out


def _kept(blocks: list[Block]) -> tuple[list[Block], bool]:
    """(good blocks, whether the page marks its article)."""
    marked = any(b.in_article for b in blocks)
    region = [b for b in blocks if b.in_article or not marked]
    spoken = language(region)
    for lang in [spoken] if spoken is None else [spoken, None]:
        first = [first_pass(b, lang, marked) for b in region]
        labels = [label for label, _ in first]
        if not marked and GOOD not in labels:
            labels = prose_run(region, labels, lang)
        leans = [None if b.heading else GOOD if held else BAD for b, (_, held) in zip(region, first)]
        prose = [len(b.text) >= SHORT_CHARS and (lang is None or b.held[lang] >= STOP_HIGH * b.words) for b in region]
        good = [b for b, label in zip(region, second_pass(labels, leans, GOOD if marked else BAD, prose)) if label == GOOD]
        if good:
            break
    return good, marked


def main_text(page: str | None) -> str:
    blocks = [b for b in blocks_of(page) if not b.cut] if page else []
    if not blocks:
        return ""
    good, marked = _kept([b for b in blocks if not b.doubtful] or blocks)
    if any(b.doubtful for b in blocks) and not (good and marked):
        chars = lambda some: sum(len(b.text) for b in some)
        more, _ = _kept(blocks)
        good = more if 4 * chars(good) < chars(more) else good
    return "\n".join(b.text for b in good)


OUT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page (OUT); nothing is shuffled."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 256):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, OUT)
