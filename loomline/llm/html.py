"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one line for each block of text, and empty lines where a part of the page stands that is no
article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), known by its
element, role, class or id. The text lengths of the lines are summed over sliding windows. A stretch starts where the sums
surge from nothing and ends where they dive to nothing; stretches are kept if their sums reach a threshold, or the page
has none that does and it is the one with the most text. An article or main element is one more signal: every stretch
inside is the article's, whatever its length, and outside the distribution decides as on other pages.

Furniture within a text parts a short stretch from its neighbours. It is kept too if it lies between kept ones, if it is in an
element that holds a kept one's text directly, or is held directly by an element around one. The page itself (body) is no
such element: there a short stretch is kept next to a kept one, with nothing between but adverts and asides.

Cases: null and empty html give the empty text. Unclosed comments, scripts and tags run to the end of the page, as in a
browser. Headings and paragraphs of any length are kept whole. Repeated rows are extracted each. Clashing column names of the
input are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Elements whose content is never article text.
FURNITURE = set("nav footer aside form script style noscript template head iframe svg button select textarea option object canvas menu dialog".split())
#: Elements that stand inside a line.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark furniture.
MARKS = set("ad ads advert adverts advertisement banner sponsor sponsored promo promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer masthead comment comments replies disqus cookie cookies consent notice popup modal newsletter subscribe signup share sharing social related recommended widget toolbar pagination pager login search".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Elements that the next one of their kind, or the end of what holds them, closes.
SOFT = set("p li dt dd tr td th option thead tbody tfoot colgroup".split())
#: Furniture that stands within a text, by element and by word of a class or id.
INSET = set("aside iframe noscript template svg button object canvas".split())
INSET_MARKS = set("ad ads advert adverts advertisement sponsor sponsored promo promoted newsletter subscribe sharing share social related recommended".split())
#: Elements that are the whole page, and blocks of text, which hold no other blocks to speak of.
PAGE = set("html body".split())
BLOCK = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre ul ol dl".split())
WINDOW = 3
SURGE = 86  # code points in a window

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/][^>]*+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")


def furniture(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's content is no article text."""
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() == "role":
            if value.strip() in ROLES:
                return True
        elif any(w in MARKS for w in WORD.findall(value)):
            return True
    return bool(HIDDEN.search(attributes))


def inset(name: str, attributes: str) -> bool:
    """Whether furniture is of a kind that stands within a text."""
    values = ("".join(v).lower() for _, *v in ATTRIBUTE.findall(attributes))
    return name in INSET or name not in FURNITURE and any(w in INSET_MARKS for v in values for w in WORD.findall(v))


def lines(page: str) -> list[tuple[str, bool, tuple[int, ...]]]:
    """(text, whether inside an article, numbers of the elements around it) of each line; furniture leaves WINDOW empty lines,
    whose second value is whether it is of a kind that stands within a text."""
    out: list[tuple[str, bool, tuple[int, ...]]] = []
    held: list[str] = []
    stack: list[str] = []
    numbers: list[int] = []  # of the elements of the stack; 0 for those that are no container
    opened = 0
    dropped = articles = at = 0  # dropped: height of the stack at which furniture began

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, articles > 0, tuple(filter(None, numbers))))

    def close(height: int) -> None:
        nonlocal articles, dropped
        for n in stack[height:]:
            articles -= n in ("article", "main")
        del stack[height:], numbers[height:]
        if dropped and height < dropped:
            dropped = 0

    for m in TOKEN.finditer(page):
        if m.start() > at and not dropped:
            held.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:  # a comment, a raw element or a tag that is cut off
            continue
        name = name.lower()
        if name in VOID:
            if name in ("br", "hr") and not dropped:
                held.append(" ")
            continue
        if name not in INLINE and not dropped:
            flush()
        if m["end"]:
            if name in stack:
                height = len(stack) - 1 - stack[::-1].index(name)
                if not (name in INLINE or name in SOFT) or not {"article", "main"} & set(stack[height + 1 :]):
                    close(height)
            continue
        attributes = m["attr"] or ""
        if name in SOFT and stack and stack[-1] == name:
            close(len(stack) - 1)
        if attributes.endswith("/") and name not in ("p", "div", "a", "span"):
            continue
        stack.append(name)
        opened += 1
        numbers.append(0 if name in INLINE or name in BLOCK or name in SOFT or name in PAGE else opened)
        if name in ("article", "main"):
            articles += 1
        if not dropped and furniture(name, attributes, articles > 0):
            flush()
            out += [("", inset(name, attributes), ())] * WINDOW
            dropped = len(stack)
    if not dropped:
        held.append(page[at:])
        flush()
    return out


def stretches(found: list[tuple[str, bool, tuple[int, ...]]]) -> list[tuple[int, int, bool]]:
    """([from, to), whether it is dense) of the stretches, by the sums of text lengths over WINDOW lines."""
    sizes = [len(t) for t, *_ in found]
    sums = [sum(sizes[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(sizes))]
    runs, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i  # surge
        elif not s and start is not None:
            runs.append((start, i, max(sums[start:i]) >= SURGE))  # dive
            start = None
    return runs


def outside(found: list[tuple[str, bool, tuple[int, ...]]], alone: bool) -> list[tuple[int, int]]:
    """[from, to) of the kept stretches of lines outside articles; alone: the page has no others, so that one is kept at least."""
    runs = stretches(found)
    kept = {i for i, r in enumerate(runs) if r[2]}
    if not kept and alone and runs:
        kept = {max(range(len(runs)), key=lambda i: (sum(len(t) for t, *_ in found[runs[i][0] : runs[i][1]]), -i))}
    if not kept:
        return []
    paths = [[path for t, _, path in found[a:b] if t] for a, b, _ in runs]
    direct = {p[-1] for i in kept for p in paths[i] if p}  # hold kept text directly
    around = {n for i in kept for p in paths[i] for n in p}
    first, last = min(kept), max(kept)
    kept |= {i for i, of in enumerate(paths) if first < i < last or any(p and (p[-1] in around or direct & set(p)) for p in of)}
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        step = order.step  # to the right, then to the left
        for i in order:
            if i - step in kept and not paths[i][0] and not paths[i - step][0]:
                a, b = sorted((runs[i], runs[i - step]))
                if all(kind for t, kind, _ in found[a[0] : b[0]] if not t):
                    kept.add(i)
    return [runs[i][:2] for i in sorted(kept)]


def main_text(page: str) -> str:
    found = lines(page)
    inside = [bool(t) and kind for t, kind, _ in found]
    # articles part the lines outside as furniture does
    other: list[tuple[str, bool, tuple[int, ...]]] = []
    place: list[int] = []
    for i, line in enumerate(found):
        parts = [("", False, ())] * WINDOW if inside[i] else [line]
        other += parts
        place += [i] * len(parts)
    keep = {place[k] for a, b in outside(other, not any(inside)) for k in range(a, b)}
    return " ".join(t for i, (t, *_) in enumerate(found) if t and (inside[i] or i in keep))


def extracted(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars (code points) to each page."""
    spark = pages.sparkSession
    common.ship(spark)
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() not in {"text", "n_chars"}]
    body = common.fresh(pages, "_html")
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*[pages[c] for c in kept], F.coalesce(F.col(html), F.lit("")).alias(body)).mapInArrow(run, schema)
