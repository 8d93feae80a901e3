"""Main text of web pages: parser events make lines, text-to-tag ratios tell which are content, their regions are kept.

The standard library's parser reads a page as a stream of events. Blocks begin and end lines; what is a menu, header,
footer, sidebar, notice, advert, form, script, style or reader comment by its tag or its attributes goes at once. Each
line has a ratio, its characters outside of links a tag; the ratios are smoothed by a Gaussian and parted by a threshold
at the middle of the two means it makes. The region kept is the article or main element that holds the content, else
the smallest element that holds nearly all of it and its headings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import tidy

# Elements of HTML by what they mean for a reader.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body div section article main td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea fieldset label datalist iframe object embed applet video audio canvas svg map dialog menu frameset noframes search".split())
#: Words of classes, ids and roles. Those of the first kind hold whatever is within.
SURE = frozenset("nav navbar navigation menu menubar header masthead footer comment comments commentlist disqus respond replies breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr contentinfo".split())
LIKELY = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside widget related recommended notice alert popup modal overlay newsletter subscribe signup share sharing social toolbar skip complementary search dialog".split())
NEGATIONS = frozenset("has with no without".split())
WORDS = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Settings:
    #: Width of the Gaussian, in lines.
    sigma: float = 1.0
    #: An element holds the content if at most this share of it is outside.
    outside: float = 0.1
    #: Article elements count if they hold so much of the largest one's content, and of the page's.
    article: float = 0.25


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    heading: bool = False
    at: int = 0  # container
    within: int = 0  # the outermost element that is likely to go, or 0
    gap: bool = False  # stands for a part that has gone

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def attribute_kind(tag: str, attrs: dict[str, str | None]) -> str:
    """sure, likely or nothing: whether the attributes of an element say that it is no content."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
        return "sure"
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return ""
    found = ""
    for name in ("class", "id", "role"):
        before = ""
        for word in WORDS.findall((attrs.get(name) or "").lower()):
            if before not in NEGATIONS:
                if word in SURE and (tag != "article" or word.startswith("comment")):
                    return "sure"
                if word in LIKELY and tag != "article":
                    found = "likely"
            before = word
    return found


class Lines(HTMLParser):
    """Lines of a page, and its containers in the order of their starts: parent, tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.line = [], Line()
        self.stack: list[tuple[str, str, int]] = []  # tag, kind, container
        self.open: Counter[str] = Counter()
        self.parents, self.names = [0], ["page"]
        self.gone = 0  # elements open that are dropped for sure
        self.likely: list[int] = []  # numbers of those open that are likely to go
        self.doubted: set[int] = set()  # of those that hold a main element or a first heading
        self.count = 0

    # ---- events

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if "head" in self.open and tag not in IN_HEAD and tag != "head":
            self.close_to("head")
        if tag in BLOCKS:
            if "p" in self.open:
                self.close_to("p")
            self.cut()
        self.line.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.line.parts.append(" ")
            return
        given = dict(attrs)
        kind = "sure" if tag in DROPPED else attribute_kind(tag, given)
        if tag == "header" and not (self.open["article"] or self.open["main"]):
            kind = "sure"
        if tag in ("main", "h1"):
            self.doubted.update(self.likely)
        container = self.container()
        if tag in CONTAINERS and not self.gone and kind != "sure":
            self.parents.append(container)
            self.names.append("main" if given.get("role") == "main" else tag)
            container = len(self.parents) - 1
        if kind == "sure":
            self.gap()
            self.gone += 1
        elif kind == "likely":
            self.cut()
            self.count += 1
            self.likely.append(self.count)
        self.stack.append((tag, kind, container))
        self.open[tag] += 1
        if tag in BLOCKS or kind == "likely":
            self.line.at, self.line.within = container, self.likely[0] if self.likely else 0
        self.line.heading |= tag in HEADINGS

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self.close_to(tag)
        if tag in BLOCKS:
            self.cut()
        self.line.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.gone:
            self.line.parts.append(data)
            if self.open["a"]:
                self.line.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    # ---- state

    def container(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def close_to(self, tag: str) -> None:
        while self.stack:
            name, kind, _ = self.stack.pop()
            self.open[name] -= 1
            if not self.open[name]:
                del self.open[name]
            if kind == "sure":
                self.gap()
                self.gone -= 1
            elif kind == "likely":
                self.cut()
                self.likely.pop()
            if name in BLOCKS:
                self.cut()
            if name == tag:
                return

    def cut(self) -> None:
        """The line ends, if it has any text; its tags count for the next one else."""
        if any(not p.isspace() for p in self.line.parts):
            self.lines.append(self.line)
            self.line = Line()
        else:
            self.line = Line(tags=self.line.tags)
        self.line.at, self.line.within = self.container(), self.likely[0] if self.likely else 0
        self.line.heading = any(t in HEADINGS for t, _, _ in self.stack[-3:])

    def gap(self) -> None:
        """A dropped element parts what is before it from what is after, unless it stands within a sentence."""
        if self.gone:
            return
        if not self.line.parts or "p" not in self.open:
            self.cut()
            if not (self.lines and self.lines[-1].gap):
                self.lines.append(Line(gap=True, at=self.container()))


def parsed(markup: str) -> Lines:
    reader = Lines()
    reader.feed(markup)
    reader.close()
    reader.cut()
    return reader


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return padded / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The point in the middle between the means of the values above and below it."""
    at = float(values.mean())
    for _ in range(100):
        high, low = values[values >= at], values[values < at]
        if not len(low) or not len(high):
            break
        new = (high.mean() + low.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = float(new)
    return at


def main_text(markup: str | None, settings: Settings = Settings()) -> str:
    """The page's main text, a line for each block; empty if there is none."""
    page = parsed(markup or "")
    lines = [x for x in page.lines if not x.within or x.within in page.doubted]
    if not any(not x.gap for x in lines):
        return ""
    texts = [x.text() for x in lines]
    ratios = np.array([0.0 if x.gap else max(0, len(t) - x.linked) / max(1, x.tags) for x, t in zip(lines, texts, strict=True)])
    dense = np.log1p(smoothed(ratios, settings.sigma))
    content = (dense >= threshold(dense)) & np.array([not x.gap for x in lines])
    mass = np.where(content, np.array([len(t) for t in texts], float), 0.0)
    at = np.array([x.at for x in lines])
    low, high = regions(page, lines, at, mass, content, settings)
    inside = ((at[:, None] >= low) & (at[:, None] < high)).any(axis=1) if len(low) else np.ones(len(at), bool)
    if not len(low):  # no element of its own: what lies between the content's ends, without lists of links
        own = np.flatnonzero(content)
        if len(own):
            first = own[0]
            while first and lines[first - 1].heading:
                first -= 1
            inside = (np.arange(len(at)) >= first) & (np.arange(len(at)) <= own[-1])
            inside &= content | np.array([2 * x.linked <= len(t) for x, t in zip(lines, texts, strict=True)])
    return "\n".join(t for t, x, keep in zip(texts, lines, inside, strict=True) if keep and t and not x.gap)


def regions(page: Lines, lines: list[Line], at: np.ndarray, mass: np.ndarray, content: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of container numbers that hold the content: containers are numbered as they start, so each has a range of its own."""
    n = len(page.parents)
    held, last = np.bincount(at, mass, n), np.arange(1, n + 1)
    heads = np.bincount(at[[i for i, x in enumerate(lines) if x.heading and content[i]]], minlength=n) if n else None
    best = np.zeros(n, int)  # the child that holds most
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        held[p] += held[i]
        heads[p] += heads[i]
        last[p] = max(last[p], last[i])
        if not best[p] or held[i] >= held[best[p]]:
            best[p] = i
    named = [i for i in range(n) if page.names[i] in ("article", "main") and held[i] > 0]
    if not held[0]:  # too even to tell: what there is in such elements, or all
        named = [i for i in range(n) if page.names[i] in ("article", "main") and ((at >= i) & (at < last[i])).any()]
    if named:
        top = max(held[i] for i in named)
        good = [i for i in named if held[i] >= settings.article * max(top, held[0])]
        # The innermost that still holds nearly all of the one around it.
        inner = [i for i in good if not any(i < j < last[i] and held[j] >= (1 - settings.article) * held[i] for j in good)]
        outer = [i for i in inner if not any(j < i < last[j] for j in inner)]
        if outer:
            return np.array(outer), last[outer]
    here = 0
    while best[here] and held[here] > 0 and held[here] - held[best[here]] <= settings.outside * held[here] and heads[best[here]] == heads[here]:
        here = best[here]
    if page.names[here] in ("page", "html", "body"):
        return np.empty(0, int), np.empty(0, int)
    return np.array([here]), np.array([last[here]])


def extract_pages(pages: DataFrame, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url"), settings: Settings = Settings()) -> DataFrame:
    """The columns ``keep`` of every page, text and n_chars, the code points of its main text.

    Pages are passed through one by one; nothing is shuffled, and no other column is read. A null page is an empty one;
    it, and a page without main text, has the empty text. Repeated pages give repeated rows, an empty table none.
    Markup that is cut off or nested wrongly is read as far as it goes.
    """
    own = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{markup}`").cast("string").alias("_markup"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema[:-1]) + "text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), settings) for x in b.column(len(keep))]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # references may name lone surrogates
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])
        tidy()

    return own.mapInArrow(run, schema)


#: For pages whose article is one element with flat blocks, as in the given tables, the same in SQL.
ORACLE = r"""WITH cut AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(p|h1)>') AS parts FROM pages),
  said AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM cut)
  SELECT page_id, url, text, length(text) AS n_chars FROM said"""
