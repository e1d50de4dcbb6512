"""Main text of web pages as the maximum-scoring run of a page.

A page is a sequence of words and tags.  A word scores above zero by the kind
of its block and below zero in links and in elements whose name, class, id or
role tells of boilerplate; tags score below zero.  All weights are log ratios
counted on pages that mark their article, so that a class word counts for what
it stands for in the table.  A linear scan finds the run of the largest sum,
and its words, without those that stand in boilerplate, are the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import hash_sample

MAX_LABELLED = 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Elements that no page shows as text.
HIDDEN = frozenset("head script style noscript template iframe object svg select textarea title noembed noframes canvas audio video".split())
#: Elements whose name is a feature of the words within.  header is another one inside a marked article.
NAMED = frozenset("nav header footer aside button dialog menu form section figure details".split())
#: Those of them that count as boilerplate until the pages say otherwise.
BOILERPLATE = frozenset("nav header footer aside button dialog menu form".split())
MARKED = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Words of a class, id or role that count as boilerplate until the pages say otherwise.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login social share sharing "
    "related recommended recommendations comment comments commentlist disqus respond reply replies widget toolbar copyright legal disclaimer search pagination pager "
    "contentinfo complementary form".split()
)
#: Those that count on an article or main element too, of which other words are no features.
ARTICLE_CUES = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments respond reply".split())
#: An element of these is closed by a new one of the same set.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table menu select article main body".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_HINT = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Region:
    """An element with features, and the tokens within."""

    begin: int
    end: int
    features: tuple[str, ...]
    strong: bool  # by a cue that counts on an article too
    holds_article: bool
    wraps: bool  # may be a wrapper of the page, whose features then say nothing of its words


@dataclass(slots=True)
class Token:
    """A tag, or a run of text in one block."""

    feature: str
    words: int  # 0: a tag
    text: str
    block: int
    marked: bool


@dataclass
class _Open:
    """The open elements of a page; those of one name are found without a walk."""

    stack: list[tuple[str, Region | None]] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    lists: list[int] = field(default_factory=list)
    hidden: int = 0
    marked: int = 0

    def push(self, name: str, region: Region | None) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in _LISTS:
            self.lists.append(len(self.stack))
        self.stack.append((name, region))
        self.hidden += name in HIDDEN
        self.marked += name in MARKED

    def last(self, name: str) -> int:
        return (self.places.get(name) or [-1])[-1]

    def pop(self, to: int, end: int) -> None:
        while len(self.stack) > to:
            name, region = self.stack.pop()
            self.places[name].pop()
            if name in _LISTS:
                self.lists.pop()
            if region:
                region.end = end
            self.hidden -= name in HIDDEN
            self.marked -= name in MARKED


def _hints(attributes: str) -> set[str]:
    return {part for m in _HINT.finditer(attributes) for part in _PART.findall(m[1].lower())}


def tokens(page: str) -> tuple[list[Token], list[Region]]:
    """The page's tags and texts in order, and its elements with features.

    Comments, declarations and hidden elements (scripts, styles) give no text.
    A missing end tag is supplied where a block, list item or the parent's end
    implies it.  Takes time in proportion to the page's length.
    """
    out: list[Token] = []
    regions: list[Region] = []
    around: list[Region] = []  # regions begun since the last article
    held = _Open()
    block = 0
    kind = "other"
    at, n = 0, len(page)

    def put(text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        if text and not held.hidden:
            out.append(Token(f"w:{kind}:{'a' if held.places.get('a') else '-'}", len(text.split()), text, block, held.marked > 0))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        if lt > at:
            put(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            continue
        if after in ("!", "?"):
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt)
        if m:
            closing, name, attributes = m[1] == "/", m[2].lower(), m[3]
            at = m.end()
        elif re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a broken quote: up to the next >
            stop = page.find(">", lt)
            m2 = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", page[lt : lt + 64])
            closing, name, attributes = m2[1] == "/", m2[2].lower(), ""
            at = n if stop < 0 else stop + 1
        else:
            put("<")
            at = lt + 1
            continue
        if name in BLOCK:
            block += 1
        elif name == "br":
            put("\n")
        if closing:
            if held.last(name) >= 0:
                held.pop(held.last(name), len(out))
        else:
            if name in BLOCK and held.last("p") >= 0:  # no block stands within a paragraph, so the last one is open still
                held.pop(held.last("p"), len(out))
            if name in _CLOSES:
                to = max(held.last(x) for x in _CLOSES[name])
                if to >= 0 and to > (held.lists or [-1])[-1]:
                    held.pop(max(min(held.places[x][-1] for x in _CLOSES[name] if held.last(x) > (held.lists or [-1])[-1]), 0), len(out))
            if name not in VOID:
                hints = _hints(attributes) if attributes and name not in ("html", "body") else set()
                strong = not hints.isdisjoint(ARTICLE_CUES)
                if name in MARKED:
                    hints &= ARTICLE_CUES
                    if not strong and not held.hidden:
                        for r in around:
                            r.holds_article = r.end < 0
                        around = []
                own = [f"c:{x}" for x in sorted(hints)]
                if name in NAMED:
                    own.append("e:header:m" if name == "header" and held.marked else f"e:{name}")
                region = Region(len(out), -1, tuple(own), strong, False, name not in BOILERPLATE or name == "form") if own else None
                if region:
                    regions.append(region)
                    around.append(region)
                held.push(name, region)
        if not held.hidden:
            out.append(Token(f"t:{name}" if name in _KNOWN else "t:other", 0, "", block, held.marked > 0))
        if name in BLOCK:
            kind = {"p": "p", "li": "li", "td": "cell", "th": "cell"}.get(name, "h" if name in _HEADS else "other") if not closing else "other"
        if not closing and name in RAW:
            stop = re.compile(rf"</{name}", re.I).search(page, at)
            at = stop.start() if stop else n
    held.pop(0, len(out))
    return out, regions


def boilerplate(found: list[Token], regions: list[Region], weights: dict[str, float]) -> tuple[list[float], list[float]]:
    """For each token what elements around it say against it, and for it.

    An element of more than half of the page's words is a wrapper, and none of
    its features counts; one with a strong cue is a wrapper only if it holds an
    article besides.  Menus and the like go first and elements with a strong cue
    second, so that their words are none of the page when others are judged.
    """
    against, good = [0.0] * (len(found) + 1), [0.0] * (len(found) + 1)
    for turn in range(3):
        own = [r for r in regions if turn == (2 - r.strong if r.wraps else 0)]
        if not own:
            continue
        total = list(accumulate(against))
        words = [0, *accumulate(t.words if total[k] >= LEAVE else 0 for k, t in enumerate(found))]
        for r in own:
            if r.wraps and 2 * (words[r.end] - words[r.begin]) > words[-1] and (not r.strong or r.holds_article):
                continue
            for name in r.features:
                w = weights.get(name, 0.0) if name in weights or name[2:] not in CUES else CUE
                side = against if w < 0 else good
                side[r.begin] += w
                side[r.end] -= w
    return list(accumulate(against))[:-1], list(accumulate(good))[:-1]


_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KNOWN = BLOCK | frozenset("a b i em strong span br img code small u sup sub abbr time cite q mark".split())
_KINDS = ("p", "li", "cell", "h", "other")
#: Weight of a boilerplate cue that the pages say nothing of, and the sum below which a word is left out of the run it stands in.
CUE, LEAVE = -5.3, -4.0
#: Bounds of a feature's weight, and the words as which the weight without labelled pages counts against theirs.
LEAST_WEIGHT, MOST_WEIGHT, PRIOR_WORDS = -6.0, 3.0, 20.0
#: A stretch of boilerplate within a run costs this much, however long.
SKIP = -1.0
MOST_TAG, MARKED_TAG = -0.05, -0.01
#: Weights where labelled pages say nothing.  m: inside a marked article, o: outside on a page that has one.
PRIOR = (
    {f"w:{k}:-": 1.0 for k in _KINDS} | {f"w:{k}:a": -1.0 for k in _KINDS} | {f"t:{k}": -0.2 for k in _KNOWN} | {"t:other": -0.2, "m": 5.0, "o": -5.0}
    | {f"e:{k}": CUE for k in BOILERPLATE} | {f"e:{k}": 0.0 for k in NAMED - BOILERPLATE} | {"e:header:m": 0.0}
)


def count_features(page: str) -> tuple[Counter, Counter]:
    """Words (of tags: tags) with each feature inside the marked article and outside, in a page that has one.

    What stands in the article's boilerplate (by the weights without labelled
    pages) is no content, and counts for the elements around it only.
    """
    found, regions = tokens(page)
    against, _ = boilerplate(found, regions, PRIOR)
    inside, outside = Counter(), Counter()
    within, without = [0], [0]
    for t, a in zip(found, against, strict=True):
        content = t.marked and a >= LEAVE
        if content or not t.marked:
            (inside if content else outside)[t.feature] += t.words if t.feature[0] == "w" else 1
        if t.words:
            (inside if content else outside)["m" if t.marked else "o"] += t.words
        within.append(within[-1] + (t.words if content else 0))
        without.append(without[-1] + (0 if content else t.words))
    for r in regions:
        if r.wraps and 2 * (within[r.end] - within[r.begin]) > within[-1] > 0:
            continue
        for name in r.features:
            inside[name] += within[r.end] - within[r.begin]
            outside[name] += without[r.end] - without[r.begin]
    return inside, outside


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0):
            for total, own in zip((inside, outside), count_features(page.as_py()), strict=True):
                total.update(own)
    names = sorted(set(inside) | set(outside))
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([inside[k] for k in names], pa.int64()), pa.array([outside[k] for k in names], pa.int64())],
        names=["feature", "inside", "outside"],
    )


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Log ratios of standing inside the article, from pages that mark theirs.

    A page with an article or main element labels itself.  About
    ``max_labelled`` of them, chosen by a hash of the id, are counted.  Class
    words count from PRIOR_WORDS words on, which bounds their number by the
    sample's words.  Words of running text and of links keep their signs, tags
    stay below zero.
    """
    labelled = pages.filter(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    labelled = hash_sample(labelled, "id", labelled.count(), max_labelled)
    rows = (
        labelled.select("html").mapInArrow(_count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .filter((F.col("inside") + F.col("outside") >= PRIOR_WORDS) | ~F.col("feature").startswith("c:")).collect()
    )
    return weights_of([tuple(r) for r in rows])


def weights_of(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weights from (feature, count inside, count outside)."""
    weights = dict(PRIOR)
    totals = {kind: [sum(r[k] for r in rows if r[0][0] == kind) for k in (1, 2)] for kind in "wt"}
    if not any(totals["w"]):
        return weights
    for name, a, b in rows:
        inside, outside = totals["t" if name[0] == "t" else "w"]
        if name[0] in "wt":
            odds = math.log((a + 1) / (inside + 2)) - math.log((b + 1) / (outside + 2))
            low, high = (-3.0, MOST_TAG) if name[0] == "t" else (0.5, 3.0) if name.endswith("-") else (-3.0, -0.1)
        else:
            before = PRIOR.get(name, CUE if name[2:] in CUES else 0.0)
            share, chance = PRIOR_WORDS / (inside + outside), 1 / (1 + math.exp(-before))
            odds = math.log(a / max(1, inside) + share * chance) - math.log(b / max(1, outside) + share * (1 - chance))
            low, high = (LEAST_WEIGHT, MOST_WEIGHT) if name not in ("m", "o") else (-6.0, 6.0)
        weights[name] = min(high, max(low, odds))
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and end of the run of the largest sum; (0, 0) if none is above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, found = total, (start, k + 1)
    return found


def scored(page: str, weights: dict[str, float] = PRIOR) -> tuple[list[Token], list[float], list[bool]]:
    """The page's tokens, their scores, and which are left out of any run."""
    found, regions = tokens(page)
    against, good = boilerplate(found, regions, weights)
    has_mark = any(t.marked and t.words and a >= LEAVE for t, a in zip(found, against, strict=True))
    scores, left = [], []
    for t, a, g in zip(found, against, good, strict=True):
        gone = a < LEAVE
        side = 0.0 if not has_mark else weights["m"] if t.marked else weights["o"]
        if gone:
            scores.append(0.0 if left and left[-1] else SKIP)
        elif t.words:
            scores.append(t.words * (weights[t.feature] + a + min(g, MOST_WEIGHT) + side))
        elif t.feature[0] == "t":
            scores.append(MARKED_TAG if has_mark and t.marked else weights[t.feature])
        else:
            scores.append(0.0)  # white space
        left.append(gone or a + min(side, 0.0) < LEAVE)
    return found, scores, left


def extract(page: str | None, weights: dict[str, float] = PRIOR) -> str:
    """The main text: blocks in page order joined by an empty line."""
    found, scores, left = scored(page or "", weights)
    begin, end = best_run(scores)
    blocks: list[list[str]] = []
    last = None
    for t, gone in zip(found[begin:end], left[begin:end], strict=True):
        if t.text and not gone:
            if t.block != last:
                blocks.append([])
                last = t.block
            blocks[-1].append(t.text)
    texts = (" ".join("".join(parts).split()) for parts in blocks)
    return "\n\n".join(t for t in texts if t)


def _extract(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weights) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (empty if none) and n_chars.

    Null html counts as empty; rows repeated with one id come out each; a null
    id stays null.  A page takes time in proportion to its length and some 100
    bytes of memory a word.  Without weights they are fitted on the table's own
    labelled pages; if there are none, fixed weights hold.
    """
    weights = weights or fit_weights(pages, id_col, html_col)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return source.mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
