"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tokens: words score positive, tags negative, and a linear scan finds the contiguous
run with the largest sum, the content region. Weights come from labelled pages: pages that mark their
article or main element label their own tokens, and a bounded sample of them gives each tag its cost, and the
words in each kind of container (landmark tag, role, class or id word) their score, on top of a prior.
Words whose container scores negative (menus, adverts, comments, ...) are left out of the region's text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import bounded

#: Labelled pages that the weights are learned from: the documented bound of the sample.
SAMPLE_PAGES = 500

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = "script|style|noscript|template|svg|iframe|select|textarea|button|title|datalist"
#: Elements of the text itself: of their class values only whole ones say anything.
INNER = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot table caption figure figcaption blockquote pre span a em strong b i u small sup sub code br hr img".split())

#: Prior of containers, in words seen: landmark tags and roles, and words of class and id values.
BAD_TAGS = frozenset("nav aside footer form dialog menu fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORD = re.compile(
    r"^(ad|ads|adv|advert\w*|adsense|adbox|banner|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice|notification|alert|comment\w*|disqus|respond|reply|replies|discussion|sidebar\w*|side|aside|widget\w*|menu\w*|nav|navbar|navigation|topnav|breadcrumb\w*|crumbs|footer\w*|foot|header\w*|masthead|topbar|share\w*|sharing|social\w*|related\w*|recommend\w*|newsletter\w*|subscri\w*|signup|login|register|popup|modal|overlay|toolbar|pagination|pager|paging|skip|search\w*|copyright|legal|disclaimer|hidden|form|outbrain|taboola|feedback|rating|tagcloud|toc)$",
    re.I,
)
PRIOR = 30.0

#: A dropped element goes with its end tag; one without an end tag is hidden up to the end of its parent, a self-closed svg is empty.
_DROPPED = frozenset(DROPPED.split("|"))
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?!svg[\s/](?:\"[^\"]*\"|'[^']*'|[^'\">])*/>)({DROPPED})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?</\1\s*>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W_]+")


def features(tag: str, attrs: str) -> list[str]:
    """What a container says about the words in it."""
    out = [tag] if tag in BAD_TAGS or tag in GOOD_TAGS or tag == "header" else []
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            out.append(f"role={value}")
        elif name in ("hidden", "aria-hidden"):
            out += ["hidden"] if name == "hidden" or value == "true" else []
        elif tag in INNER:
            out += [f".{w}" for w in value.split()]
        else:
            out += [f".{w}" for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower()) if w]
    return out


def prior(feature: str) -> tuple[float, float]:
    """(words inside, outside) that a feature counts for before any are seen."""
    if feature in BAD_TAGS or feature == "hidden" or feature.startswith("role=") and feature[5:] in BAD_ROLES or feature[0] == "." and BAD_WORD.match(feature[1:]):
        return 0.0, PRIOR
    if feature == "~article":
        return 0.0, PRIOR
    if feature == "header":
        return 0.0, PRIOR
    return PRIOR, 0.0


@dataclass
class Token:
    """A run of text, or a tag (then text is its name)."""

    text: str
    tag: bool
    block: bool
    where: tuple[str, ...] = ()


class Stack:
    """The elements that are open: each with its name and the features of all that it is in."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.where: list[tuple[str, ...]] = [()]
        self.open: Counter = Counter()

    def push(self, name: str, own: list[str]) -> None:
        new = tuple(f for f in own if f not in self.where[-1])
        self.names.append(name)
        self.where.append(self.where[-1] + new if new else self.where[-1])
        self.open[name] += 1

    def cut(self, at: int) -> None:
        self.open.subtract(self.names[at:])
        del self.names[at:], self.where[at + 1 :]

    def end(self, name: str) -> None:
        """Closes the innermost element of that name with all that is in it, if there is one."""
        if self.open[name] > 0:
            self.end_before(name, frozenset())

    def end_before(self, name: str, stop: frozenset[str]) -> None:
        """As end, but elements of the names in stop aren't closed."""
        for at in range(len(self.names) - 1, -1, -1):
            if self.names[at] == name:
                return self.cut(at)
            if self.names[at] in stop:
                return None

    def any(self, names: frozenset[str]) -> bool:
        return any(self.open[n] > 0 for n in names)


_IN_P, _LISTS = BLOCK - {"p"}, frozenset(("ul", "ol", "menu"))


def tokens(page: str) -> list[Token]:
    """A page's tokens; where: the features of the containers that a text is in."""
    out: list[Token] = []
    stack = Stack()
    marked = False
    for m in _TOKEN.finditer(page):
        name = m[3]
        if name:
            name = name.lower()
            out.append(Token(name, True, name in BLOCK))
            if m[2]:
                stack.end(name)
            elif name not in VOID:
                if name in BLOCK and name != "body" and stack.open["p"] > 0:
                    stack.end_before("p", _IN_P)
                if name == "li" and stack.open["li"] > 0:
                    stack.end_before("li", _LISTS)
                own = features(name, m[4])
                if stack.any(GOOD_TAGS):
                    own = [f for f in own if f not in ("header", ".header", ".head", ".title")]
                marked |= name in GOOD_TAGS
                if not m[4].endswith("/") or name in BLOCK:
                    stack.push(name, own)
        elif m[0][0] != "<" or m[0] == "<":
            if not stack.any(_DROPPED):
                out.append(Token(html.unescape(m[0]), False, False, stack.where[-1]))
        elif m[1]:
            out.append(Token(m[1].lower(), True, False))
    if marked:
        for t in out:
            if not t.tag and "article" not in t.where and "main" not in t.where:
                t.where = (*t.where, "~article")
    return out


@dataclass
class Weights:
    """Scores of tags and of containers' words; what isn't seen has its prior's."""

    tags: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def count(page: str) -> tuple[Counter, bool]:
        """Counts of (kind, name, inside) in a labelled page; whether it is one: it marks an article or main element with words."""
        seen: Counter = Counter()
        found, inside, depth = tokens(page), False, 0
        for t in found:
            if t.tag:
                seen["tag", t.text, inside] += 1
            else:
                n = len(_WORD.findall(t.text))
                good = [prior(f)[0] > 0 for f in t.where]
                inside = bool(n) and ("article" in t.where or "main" in t.where) and all(good) if n else inside
                depth += n * inside
                for f in set(t.where):
                    seen["word", f, inside] += n
        return seen, depth > 0

    @classmethod
    def learn(cls, total: Counter) -> Weights:
        """From counts of (kind, name, inside) over labelled pages."""
        out = cls()
        for kind, name in {(k, n) for k, n, _ in total}:
            inside, outside = total[kind, name, True], total[kind, name, False]
            if kind == "tag":
                out.tags[name] = -min(2.0, max(0.1, math.log((outside + 1) / (inside + 1))))
            else:
                a, b = prior(name)
                out.words[name] = math.log((inside + a + 1) / (outside + b + 1))
        return out

    def word(self, where: tuple[str, ...]) -> float:
        """The score of a word: 1, or slightly below 0 where a container says it is no content."""
        for f in where:
            known = self.words.get(f)
            if known is None:
                a, b = prior(f)
                known = a - b
            if known < 0:
                return -0.2
        return 1.0


def region(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous run with the largest sum, the first and shortest of those; (0, 0) if none is above 0."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: its blocks, each with single spaces, joined by newlines."""
    if not page:
        return ""
    found = tokens(page)
    word = [0.0 if t.tag else weights.word(t.where) for t in found]
    a, b = region([weights.tags.get(t.text, -0.3) if t.tag else w * len(_WORD.findall(t.text)) for t, w in zip(found, word, strict=True)])
    # the block that the region begins or ends in counts whole
    while a > 0 and not (found[a - 1].tag and found[a - 1].block):
        a -= 1
    while b < len(found) and not (found[b].tag and found[b].block):
        b += 1
    blocks: list[str] = []
    own: list[str] = []
    for t, w in zip(found[a:b], word[a:b], strict=True):
        if t.tag:
            if t.block:
                blocks.append(" ".join("".join(own).split()))
                own = []
            elif t.text == "br":
                own.append(" ")
        elif w > 0:
            own.append(t.text)
    blocks.append(" ".join("".join(own).split()))
    return "\n".join(x for x in blocks if x)


def learn(pages: DataFrame) -> Weights:
    """Weights from at most SAMPLE_PAGES distinct pages that label themselves, those with the smallest hashes of their html.

    Only hashes and counts reach the driver: pages are counted where they are.
    """
    marked = pages.where(F.lower("html").rlike("<(article|main)[\\s>]")).select("html", F.xxhash64("html").alias("h"))
    least = marked.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if least is None:
        return Weights.learn(Counter())
    some = marked.where(F.col("h") <= least).groupBy("h").agg(F.first("html").alias("html")).select("html")

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for page in batch.column(0):
                seen, labelled = Weights.count(page.as_py())
                if labelled and seen:
                    kinds, names, inside = zip(*seen, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(names), pa.array(inside), pa.array([int(n) for n in seen.values()], pa.int64())], names=["kind", "name", "inside", "n"])

    counts = some.mapInArrow(count, "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return Weights.learn(Counter({(r["kind"], r["name"], r.inside): r.n for r in counts.collect()}))  # the names in the sample


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    text: the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and comments; character references are decoded, white space in a block is one space, blocks are
    joined by a newline in page order. The text of drawings (svg) counts as markup. Null or empty html, or a page without content, gives an empty text.
    The same html always gives the same text. Other columns are ignored, and null ids or urls stay null.
    """
    bounded(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(learn(pages))
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                texts = [extract(x, shared.value) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
