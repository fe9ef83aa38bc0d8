"""The main text of a page by scores of its blocks, as an Arrow UDF over Python's own HTML parser.

Blocks are the elements that hold text without holding blocks. A block scores a point for each word beyond the first five,
less the share of its words that are links; it hands its score to its parent and half of it to its grandparent (a plain
container without a paragraph's tag hands on a quarter of that). The element with the greatest score, less its own share of
links, is the article, with those of its siblings that score a fifth as much, or that are long paragraphs with few
links. Headers, footers, navigation, asides, forms, scripts, styles and what a class or id marks as advertising are left out from the start. A page
without any scoring block gives the text of its article, main or body element.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whole_entities

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEFT_OUT = frozenset("head script style noscript template header footer nav aside form button select svg iframe".split())
#: Words of a class or id.
ADVERTISING = frozenset("ad ads advert advertisement banner sponsor sponsored promo".split())
BLOCKS = frozenset("address article blockquote body dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 html li main ol p pre section table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FREE_WORDS, SIBLING_SHARE, LONG_WORDS, FEW_LINKS = 5, 0.2, 40, 0.25
ARTICLE = T.StructType([T.StructField("content", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType()))])
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_WORDS = re.compile(r"[^a-z0-9]+")


def _advertises(attrs) -> bool:
    return any(k in ("class", "id") and v and not ADVERTISING.isdisjoint(_WORDS.split(v.lower())) for k, v in attrs)


class _Tree(HTMLParser):
    """Elements as lists by number (tag, parent), and pieces of text with their element and whether they are in a link."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.open, self.left_out, self.ignored = ["#page"], [-1], [0], [False], 0
        self.texts: list[tuple[int, str, bool]] = []
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._end_paragraph()
        if tag == "li" or tag in ("td", "th", "tr", "dd", "dt"):
            self._end_same(tag)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.open.append(len(self.tags) - 1)
        self.left_out.append(tag in LEFT_OUT or (tag not in ("html", "body") and _advertises(attrs)))
        self.ignored += self.left_out[-1]
        self.links += tag == "a"

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[k]] == tag:
                self._close(k)
                return
            if self.tags[self.open[k]] in BLOCKS and tag not in BLOCKS:
                return  # an inline element's end doesn't end a block

    def _close(self, k: int) -> None:
        for e in self.open[k:]:
            self.ignored -= self.left_out[e]
            self.links -= self.tags[e] == "a"
        del self.open[k:]

    def _end_paragraph(self) -> None:
        """A block begins: an open p, and what is open in it, ends."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[k]] == "p":
                self._close(k)
                return
            if self.tags[self.open[k]] in BLOCKS:
                return

    def _end_same(self, tag: str) -> None:
        """The item or cell before this one ends, unless a list or table has begun within it."""
        for k in range(len(self.open) - 1, 0, -1):
            name = self.tags[self.open[k]]
            if name == tag:
                self._close(k)
                return
            if name in ("ul", "ol", "table", "dl") or (tag == "tr" and name == "table"):
                return

    def handle_data(self, data):
        if not self.ignored:
            self.texts.append((self.open[-1], data, self.links > 0))


def _plain(pieces: list[str]) -> str:
    return _SPACE.sub(" ", " ".join(pieces)).strip(" ")


def article_of(html: str | None) -> tuple[str, list[str]]:
    """(text, paragraphs) of a page's article; empty for an empty page."""
    tree = _Tree()
    tree.feed(whole_entities(html or ""))
    tree.close()
    n = len(tree.tags)
    words, linked, has_block = [0] * n, [0] * n, [False] * n
    for element, data, in_link in tree.texts:
        count = len(data.split())
        while element >= 0:
            words[element] += count
            linked[element] += count if in_link else 0
            element = tree.parents[element]
    for e in range(n - 1, 0, -1):
        has_block[tree.parents[e]] |= has_block[e] or tree.tags[e] in BLOCKS
    share = lambda e: linked[e] / words[e] if words[e] else 0.0
    own, score = [0.0] * n, [0.0] * n
    for e in range(1, n):
        if tree.tags[e] in BLOCKS and not has_block[e] and tree.tags[e] not in HEADINGS:
            own[e] = max(0, words[e] - FREE_WORDS) * (1 - share(e))
            handed = own[e] if tree.tags[e] in PARAGRAPHS else own[e] / 4
            score[tree.parents[e]] += handed
            if (above := tree.parents[tree.parents[e]]) >= 0:
                score[above] += handed / 2
    final = [s * (1 - share(e)) for e, s in enumerate(score)]
    best = max(range(n), key=lambda e: (final[e], -e))
    if final[best] > 0:
        within = {best}
        for e in range(1, n):
            if e != best and tree.parents[e] == tree.parents[best] >= 0:
                long = tree.tags[e] in PARAGRAPHS and words[e] >= LONG_WORDS and share(e) < FEW_LINKS
                if long or final[e] >= SIBLING_SHARE * final[best]:
                    within.add(e)
    else:
        within = {next((e for name in ("article", "main", "body") for e in range(n) if tree.tags[e] == name), 0)}
    inside = [False] * n
    for e in range(n):  # parents come before their children
        inside[e] = e in within or (e > 0 and inside[tree.parents[e]])
    pieces, by_paragraph = [], {}
    for element, data, _ in tree.texts:
        if inside[element]:
            pieces.append(data)
            while element > 0 and tree.tags[element] != "p":
                element = tree.parents[element]
            if element > 0:
                by_paragraph.setdefault(element, []).append(data)
    paragraphs = [_SPACE.sub(" ", "".join(p)).strip(" ") for _, p in sorted(by_paragraph.items())]
    return _plain(pieces), [p for p in paragraphs if p]


@F.pandas_udf(ARTICLE)
def article(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article_of(x) for x in html], columns=["content", "paragraphs"])
