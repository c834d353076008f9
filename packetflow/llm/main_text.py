"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of words and tags.  A word scores positive or negative by the part of the page it stands in, a tag scores
negative; one linear scan (Kadane) finds the run with the largest sum, and the words of that run that score positive are
the text.  The weights are learned from labelled pages, here pages that mark their own content with ``<article>`` or ``<main>``:
for each sectioning element, and each word of a class or id, the log-odds of words inside content against outside,
over prior counts for the names that pages commonly use (menus, adverts, comments, ...).  For each tag, how much more often it
comes per word outside than inside.

``<article>`` and ``<main>`` are one feature among these, on every page: their weight, at most MOST_MARK, is added to the negative scores of
the parts and tags inside them, so that a form or comments rarely cut an article in two.  They neither make the words of such a
part text nor take words outside them from the text.  As the labels come from these marks, that weight itself is not put to the test.

Defined cases: null and empty pages have the empty text; unclosed elements end with their parent or the page; text of a
page without any markup is kept whole; repeated pages get equal texts; an empty table stays empty; other columns stay.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetflow.llm.tables import as_texts, table

#: Labelled pages the weights are learned from at most; which ones is decided by a hash of their address.
MOST_LABELLED = 2_000

# The element names of HTML by their part in a page.
CONTENT = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math")
SECTIONS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "figcaption", "section", "head", "address", "fieldset", "object", "video", "audio", "canvas"}
NEVER = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset", "object", "video", "audio", "canvas"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
# Words of classes, ids and roles that commonly name parts outside the main text.
OUTSIDE_NAMES = """
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar side-bar aside footer header masthead topbar
cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment
comments commentlist disqus reply replies respond form widget widgets toolbar pagination pager skip copyright legal disclaimer complementary contentinfo
""".split()
INSIDE_NAMES = "article content main post entry story body text".split()
#: Words that a name of the lists counts for before any page is seen.
PRIOR = 50.0
#: The most that a mark (``<article>``, ``<main>``) adds, as much as the worst part takes; every tag scores at most LEAST_TAG.
MOST_MARK, LEAST_TAG = 3.0, -0.05

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</?[a-z][^<>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def names_of(attributes: str) -> list[str]:
    """The words of class, id and role: whole names and their parts at - and _."""
    out = []
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            out += [name, *([x for x in re.split(r"[-_]+", name) if x] if re.search(r"[-_]", name) else [])]
    return out


def tokens(page: str) -> Iterator[tuple[str, str, list[str]]]:
    """("text", characters, []), ("open", name, features) and ("close", name, []) in page order."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], []
        at = m.end()
        if m[3]:
            name = m[3].lower()
            if m[2]:
                yield "close", name, []
            else:
                yield "open", name, ([name] if name in SECTIONS or name in CONTENT else []) + ["." + x for x in names_of(m[4] or "")]
                if name not in VOID and (m[4] or "").endswith("/"):
                    yield "close", name, []
    if at < len(page):
        yield "text", page[at:], []


def walk(page: str) -> tuple[list[tuple[str, str, tuple[str, ...], bool]], bool]:
    """Tokens with the features of all open elements and whether they stand inside marked content; whether the page marks any."""
    stack: list[tuple[str, int, bool]] = []
    features: tuple[str, ...] = ()
    out, marked, inside = [], False, False
    for kind, value, own in tokens(page):
        if kind == "open" and value not in VOID:
            stack.append((value, len(features), inside))
            features += tuple(own)
            inside = inside or value in CONTENT
            marked = marked or value in CONTENT
        elif kind == "close":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == value:
                    features, inside = features[: stack[depth][1]], stack[depth][2]
                    del stack[depth:]
                    break
                # The end of an inline or paragraph element does not close a section around it.
                if stack[depth][0] in SECTIONS | CONTENT and value not in SECTIONS | CONTENT | {"body", "html", "div"}:
                    break
        out.append((kind, value, features, inside))
    return out, marked


def counts(page: str) -> list[tuple[str, bool, int]]:
    """(feature or <tag, inside content, words or tags) of a labelled page; nothing for a page that marks no content."""
    seen, marked = walk(page)
    found: Counter[tuple[str, bool]] = Counter()
    for kind, value, features, inside in seen:
        if kind == "text":
            n = len(value.split())
            found["", inside] += n
            for f in set(features):
                found[f, inside] += n
        else:
            found[f"<{value}", inside] += 1
    return [(f, i, n) for (f, i), n in found.items() if n] if marked else []


class Weights:
    """Word scores by part of the page and tag scores, from counts (feature, inside, words)."""

    def __init__(self, rows: list[tuple[str, bool, int]]):
        got = {(f, bool(i)): n for f, i, n in rows}
        words = {i: got.get(("", i), 0) + 1 for i in (True, False)}
        self.parts = {}
        for f in {f for f, _ in got if f and f[0] != "<"} | NEVER | CONTENT | {"." + x for x in OUTSIDE_NAMES + INSIDE_NAMES}:
            prior_out = 1.0 + PRIOR * (f in NEVER or f[1:] in OUTSIDE_NAMES)
            prior_in = 1.0 + PRIOR * (f in CONTENT or f[1:] in INSIDE_NAMES)
            self.parts[f] = math.log((got.get((f, True), 0) + prior_in) / (got.get((f, False), 0) + prior_out))
        for f in NEVER:  # elements that are outside by their meaning, whatever was counted
            self.parts[f] = min(self.parts[f], -1.0)
        self.tags = {}
        for f in {f for f, _ in got if f[:1] == "<"}:
            rate = [(got.get((f, i), 0) + 1) / (words[i] + 1000) for i in (True, False)]
            self.tags[f] = -min(max(math.log(rate[1] / rate[0]), -LEAST_TAG), 2.0)

    def word(self, features: tuple[str, ...]) -> float:
        """Negative when any part around the word is; else positive."""
        low = min((self.parts.get(f, 0.0) for f in features), default=0.0)
        return max(low, -3.0) if low < -0.5 else 1.0

    def mark(self, features: tuple[str, ...]) -> float:
        """What a mark around a word or tag adds to a negative score."""
        return min(max((self.parts[f] for f in features if f in CONTENT), default=0.0), MOST_MARK)

    def run(self, features: tuple[str, ...]) -> float:
        """The score of a word in the run: a mark outweighs a negative part, but makes no word of it positive."""
        own = self.word(features)
        return own if own > 0 else min(own + self.mark(features), 0.0)

    def tag(self, name: str, features: tuple[str, ...]) -> float:
        return min(self.tags.get(f"<{name}", -0.1) + self.mark(features), LEAST_TAG)


def extract(page: str, weights: Weights) -> str:
    """The text of the best run, blocks joined by one space, white space made one space."""
    seen, _ = walk(page)
    if not any(kind != "text" for kind, *_ in seen):
        return " ".join(html.unescape(page).split())
    scores = []
    for kind, value, features, _ in seen:
        scores.append(weights.run(features) * len(value.split()) if kind == "text" else weights.tag(value, features))
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, last = total, start, i + 1
    out: list[str] = []
    for i in range(first, last):
        kind, value, features, _ = seen[i]
        if kind == "text":
            if weights.word(features) > 0:
                out.append(value)
        elif value not in INLINE:
            out.append(" ")
    return " ".join(html.unescape("".join(out)).split())


def learn(pages: DataFrame, most: int = MOST_LABELLED) -> Weights:
    """Weights from at most ``most`` labelled pages, the first in the order of a hash of their address and text."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("f", T.StringType()), T.StructField("i", T.BooleanType()), T.StructField("n", T.LongType())])))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"f": f, "i": i, "n": n} for f, i, n in counts(t)] for t in as_texts(texts)], pa.list_(pa.struct([("f", pa.string()), ("i", pa.bool_()), ("n", pa.int64())])))

    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    sample = marked.select("html", F.xxhash64("url", "html").alias("_order")).orderBy("_order").limit(most)
    rows = sample.select(F.explode(counted("html")).alias("c")).groupBy("c.f", "c.i").agg(F.sum("c.n").alias("n"))
    return Weights([(r.f, r.i, r.n) for r in rows.collect()])


def main_text(spark: SparkSession, weights: Weights, page: Column) -> Column:
    held = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(T.StringType())
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([extract(p, held.value) for p in as_texts(pages)], pa.string())

    return extracted(page)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", main_text(spark, learn(pages), F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
