"""Main text of web pages: the contiguous region of words and tags with the highest score."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import table, tidy

LABELLED = 2_000
"""Pages at most that the weights are learned from: those of smallest hash among the pages that mark their article."""

# Fixed values of HTML: elements whose content is no markup, elements that never hold main text, and inline elements.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes")
ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "head", "object", "audio", "video", "canvas", "fieldset", "label")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What sites call the parts of a page that are not its article.
PARTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|subscri\w+|sidebar|rail|widgets?|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|comments?|disqus|respond|repl(?:y|ies)|share|sharing|social|"
    r"related|recommend\w*|popup|modal|overlay|login|signup|search)(?:$|[\s_-])", re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\s(?:\"[^\"]*\"|'[^']*'|[^'\">])*+|/)*+)>"
    r"|</?[a-z][^>]*(?:>|$)", re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Token:
    """A run of text (``text``) or a tag (``tag``, with its context as ``context``)."""

    text: str | None
    tag: str | None
    context: str
    outside: bool
    breaks: bool
    main: int = 0


def tokens(page: str) -> Iterator[Token]:
    """Text runs and tags in page order; ``outside``: in an element that is no part of an article, ``breaks``: ends
    a block, ``main``: the number of the outermost article or main element around it, 0 outside of any."""
    at, stack, outside, main, mains = 0, [], 0, 0, 0  # stack: (name, context, whether it is outside)
    for match in TOKEN.finditer(page):
        if match.start() > at:
            yield Token(page[at:match.start()], None, stack[-1][1] if stack else "", outside > 0, False, main)
        at = match.end()
        name = match["name"]
        if name is None:
            if match["raw"]:
                yield Token(None, match["raw"].lower(), match["raw"].lower(), True, match["raw"].lower() not in INLINE, main)
            continue
        name = name.lower()
        breaks = name not in INLINE
        if match["close"]:
            depth, within = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == name), None), outside > 0
            if depth is not None:
                outside -= sum(entry[2] for entry in stack[depth:])
                del stack[depth:]
            if name in ("article", "main") and not any(entry[0] in ("article", "main") for entry in stack):
                main = 0
            yield Token(None, "/" + name, name, within, breaks, main)
            continue
        called = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(match["rest"])) if match["rest"].strip(" /") else ""
        aside = name in ASIDE and not (name == "header" and any(entry[0] in ("article", "main") for entry in stack))
        aside = aside or bool(called and name not in ("body", "html", "article", "main") and PARTS.search(called))
        if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):  # an open one ends where the next begins
            siblings = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] in siblings:
                    outside -= sum(entry[2] for entry in stack[n:])
                    del stack[n:]
                    break
                if stack[n][0] not in INLINE:
                    break
        context = f"{name}.{'.'.join(sorted(set(called.lower().split())))}" if called else name
        if name not in VOID and not match["rest"].endswith("/"):
            parent = stack[-1][1] if stack else ""
            stack.append((name, context if breaks or not parent else parent, aside))
            outside += aside
        if name in ("article", "main") and not main and not outside:
            mains += 1
            main = mains
        yield Token(None, name, context, outside > 0, breaks, main)
    if at < len(page):
        yield Token(page[at:], None, stack[-1][1] if stack else "", outside > 0, False, main)


@dataclass
class Weights:
    """Scores of a word by the element that it stands in and costs of tags; those never seen have the defaults."""

    words: dict[str, float]
    tags: dict[str, float]
    word: float = 1.0
    tag: float = 0.5

    @classmethod
    def learned(cls, counts: dict[tuple[str, str, bool], int]) -> Weights:
        """From counts of (kind, name, whether in an article): log odds, smoothed, words at most 2 and tags a cost."""
        odds: dict[str, dict[str, float]] = {"word": {}, "tag": {}}
        for kind, name in {key[:2] for key in counts}:
            inside, outside = counts.get((kind, name, True), 0), counts.get((kind, name, False), 0)
            odds[kind][name] = math.log((inside + 0.5) / (outside + 0.5))
        return cls({k: max(-4.0, min(2.0, v)) for k, v in odds["word"].items()}, {k: max(0.05, min(8.0, 1 - v)) for k, v in odds["tag"].items()})


def count_page(page: str) -> Counter:
    """Words by element and tags of one page that marks its article, in it and outside."""
    counts, depth = Counter(), 0
    for token in tokens(page):
        if token.tag is None:
            if not token.outside:  # what is named as no part of an article is known without learning
                counts["word", token.context, depth > 0] += len(token.text.split())
        else:
            if token.tag == "/article":
                depth = max(0, depth - 1)
            if token.tag.lstrip("/") != "article" and not token.outside:
                counts["tag", token.tag if token.tag[0] == "/" else token.context, depth > 0] += 1
            if token.tag == "article":
                depth += 1
    return counts


def extract(page: str | None, weights: Weights) -> str:
    """The blocks that the best region touches, without the parts of the page that are no article, joined by newlines."""
    if not page:
        return ""
    found = list(tokens(page))
    best, best_end, first, best_first, running = 0.0, -1, 0, 0, 0.0
    for n, token in enumerate(found):
        if token.tag is None:
            words = len(token.text.split())
            score = -0.2 * min(words, 10) if token.outside else words * weights.words.get(token.context, weights.word)
        else:
            score = -weights.tags.get(token.tag if token.tag[0] == "/" else token.context, weights.tag)
        if running <= 0:
            running, first = 0.0, n
        running += score
        if running > best:
            best, best_end, best_first = running, n, first
    while best_first > 0 and not found[best_first - 1].breaks:
        best_first -= 1
    while -1 < best_end < len(found) - 1 and not found[best_end + 1].breaks:
        best_end += 1
    words = Counter()
    for token in found[best_first:best_end + 1]:
        if token.tag is None and not token.outside:
            words[token.main] += len(token.text.split())
    mains = {main for main, n in words.items() if main and n}
    clipped = bool(mains) and 2 * words[0] <= words.total()
    if mains:  # a region in an article takes in the short blocks at its ends, and ends with it if that is where its words are
        within = [n for n, token in enumerate(found) if token.main in mains]
        best_first, best_end = (within[0], within[-1]) if clipped else (min(best_first, within[0]), max(best_end, within[-1]))
    blocks, block = [], []
    for token in found[best_first:best_end + 1]:
        if token.tag is None:
            if not token.outside and (not clipped or token.main in mains):
                block.append(token.text)
        elif token.breaks:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (SPACE.sub(" ", entities.unescape(block)).strip() for block in blocks)
    return "\n".join(block for block in clean if block)


def learn(pages: DataFrame, limit: int = LABELLED, id: str = "page_id", html: str = "html") -> Weights:
    """Weights from at most ``limit`` pages that mark their article; the defaults where there is none."""
    marked = pages.where(F.contains(F.lower(html), F.lit("<article")) & F.col(id).isNotNull())
    chosen = [row[0] for row in marked.select(id).orderBy(F.xxhash64(id), id).limit(limit).collect()]
    if not chosen:
        return Weights({}, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for page in batch.column(html):
                counts.update(count_page(page.as_py()))
        rows = [{"kind": k, "name": name, "inside": inside, "n": n} for (k, name, inside), n in counts.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    sample = pages.where(F.col(id).isin(chosen)).where(F.contains(F.lower(html), F.lit("<article"))).select(html)
    counted = sample.mapInArrow(tidy(run), "kind string, name string, inside boolean, n long").groupBy("kind", "name", "inside").agg(F.sum("n").alias("n"))
    return Weights.learned({(r.kind, r.name, r.inside): r.n for r in counted.collect()})


def main_text(pages: DataFrame, weights: Weights, html: str = "html") -> DataFrame:
    """``pages`` without the html and with ``text``, the main text, empty if there is none, and ``n_chars``, its code points.

    Null and empty html have no text; a page without any article-like region gives what scores best or nothing. Columns
    of ``pages`` named ``text`` or ``n_chars`` are replaced, rows may repeat, an empty table gives an empty table.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weights) for page in batch.column(html)]
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest, "text", "n_chars"])

    return pages.select(*rest, html).mapInArrow(tidy(run), schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``; null and empty html gives an empty text, repeated rows each their own (see ``main_text``)."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return main_text(pages, learn(pages))
