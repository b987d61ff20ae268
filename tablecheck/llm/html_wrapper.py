"""Main text of web pages by wrapper induction.

For every host a bounded sample of its pages (``SAMPLE``, by hash order) is aligned by simple tree matching with the
first of them. Text that differs between aligned nodes varies; walking from the body towards the child
that holds most of the varying text finds the host's content slot, and blocks of any kind inside it whose text is the
same on nearly all pages are template, in an article as well. The wrapper (the tree down to the slot) is joined to all pages of the
host; each page is aligned with it and the slot's blocks are its text. Pages of unknown hosts, and pages that
do not fit their wrapper, are read by themselves: article, else main, else body.

Whatever the wrapper says, parts that are navigation, header, footer, aside, form, advert, notice or comments by their tag, role or whole
name (``site-footer``, not ``share-price``) are left out. A page of which nothing but template would be left keeps it.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.session import cut_lineage, ship_by_value

ship_by_value(__name__)

#: Pages of a host that are aligned, share of text that makes a child the way to the slot, share of pages on
#: which a template container has the same text, and pages needed to say so.
SAMPLE, DOMINANT, CONSTANT, LEAST_PAGES = 8, 0.7, 0.8, 3
#: Product of two lists of children up to which they are aligned in plain Python; larger ones in numpy, with the same pairs.
SMALL = 4096

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea select title".split())
CHROME_TAGS = frozenset("head nav footer aside form button dialog menu label fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "disqus replies respond share sharing social related recommended newsletter subscribe signup login paywall widget toolbar pagination pager skip".split()
)
#: Words that a chrome name may have besides: where the part is and what kind of thing.
PLACES = frozenset(
    "site page main top bottom left right inner outer global user users box bar block wrap wrapper container section list lists item items link links button "
    "buttons icon icons panel area text title content slot unit bg fixed sticky mobile desktop primary secondary js is the my".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption".split())
#: An open element of the left kind ends where one of the right kind begins.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "head": {"body"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


class Node:
    """An element: label for matching, whether it is chrome by name, children (elements and text)."""

    __slots__ = ("chrome", "kids", "label", "tag")

    def __init__(self, tag: str, label: str, chrome: bool):
        self.tag, self.label, self.chrome = tag, label, chrome
        self.kids: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]

    def own_text(self) -> str:
        return " ".join(" ".join(k for k in self.kids if isinstance(k, str)).split())


_SEEN: dict[tuple[str, str, bool], tuple[str, bool]] = {}


def describe(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """``_describe``, remembered for the last few thousand kinds of start tag."""
    key = (tag, attributes, in_article)
    if key not in _SEEN:
        if len(_SEEN) > 4096:
            _SEEN.clear()
        _SEEN[key] = _describe(tag, attributes, in_article)
    return _SEEN[key]


def _describe(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """Label and chrome flag of a start tag. A header inside an article holds its headline and stays."""
    found = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = [{w for w in re.split(r"[^a-z]+", name) if w} for name in names.split()]
    parts = set().union(*words)
    # a name is chrome if it is made of chrome words and places alone
    named = {w for name in words if name & CHROME_NAMES and name <= CHROME_NAMES | PLACES for w in name & CHROME_NAMES}
    chrome = tag in CHROME_TAGS or found.get("role", "").lower() in CHROME_ROLES or "hidden" in re.split(r"[\s=]+", attributes.lower())
    chrome = chrome or (tag == "header" and not in_article) or (tag not in ("html", "body", "article", "main") and bool(named))
    chrome = chrome or (tag == "article" and bool(named & {"comment", "comments", "replies", "ad", "advert", "promo", "related"}))
    return " ".join([tag, *sorted(parts)]), chrome


def parse(page: str) -> Node:
    """The page's tree. Missing end tags are supplied, stray ones ignored; raw elements and comments vanish."""
    root = Node("", "", False)
    stack, at, articles = [root], 0, 0
    size = len(page)
    while at < size:
        token = TOKEN.search(page, at)
        begin = token.start() if token else size
        if begin > at:
            stack[-1].kids.append(html.unescape(page[at:begin]))
        if not token:
            break
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            if any(n.tag == tag for n in stack):
                while stack[-1].tag != tag:
                    articles -= stack.pop().tag == "article"
                articles -= stack.pop().tag == "article"
            continue
        if tag in RAW and not token[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        while len(stack) > 1:
            # inline elements left open inside a paragraph end with it
            nearest = next((n for n in reversed(stack) if n.tag in BLOCKS or n.tag in ENDS), root)
            if tag not in ENDS.get(nearest.tag, ()):
                break
            while stack.pop() is not nearest:
                pass
        label, chrome = describe(tag, token[3], articles > 0)
        node = Node(tag, label, chrome)
        stack[-1].kids.append(node)
        if tag not in VOID and not token[3].endswith("/"):
            stack.append(node)
            articles += tag == "article"
    return root


def _best(left: Sequence[int], right: Sequence[int], size: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Places of the order-preserving pairs of two lists of shapes with the largest sum of sizes; of equal ones the pairs lying first are left out."""
    if len(left) * len(right) > SMALL:
        return _best_of_many(left, right, size)
    rows = [[0] * (len(right) + 1)]
    for child in left:
        above, row = rows[-1], [0]
        for j, other in enumerate(right):
            best = max(above[j + 1], row[j])
            row.append(max(best, above[j] + w) if (w := size(child, other)) else best)
        rows.append(row)
    found, i, j = [], len(left), len(right)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found


def _best_of_many(left: Sequence[int], right: Sequence[int], size: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """``_best`` by whole rows, of which every so many are kept and those between made again: the same pairs, with memory for a few hundred rows."""
    kinds, places = np.unique(np.array(right), return_inverse=True)

    def below(row: np.ndarray, child: int) -> np.ndarray:
        gains = np.array([size(child, int(o)) for o in kinds], np.int64)[places]
        out = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gains), out=out[1:])
        return out

    step = math.isqrt(len(left)) + 1
    row, kept = np.zeros(len(right) + 1, np.int64), []
    for i, child in enumerate(left):
        if i % step == 0:
            kept.append(row)
        row = below(row, child)
    found, i, j = [], len(left), len(right)
    while i and j:
        start = (i - 1) // step * step
        rows = [kept[start // step]]
        for child in left[start:i]:
            rows.append(below(rows[-1], child))
        while i > start and j:
            here, above = rows[i - start], rows[i - start - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
    return found


def match(a: Node, b: Node, pairs: dict[int, Node] | None = None) -> int:
    """Simple tree matching: the largest order-preserving matching of equally labelled nodes. ``pairs`` gets the partner of each matched node of ``a``.

    Subtrees with the same labels throughout are one shape, and two shapes are weighed once, so long lists of like elements cost little. All
    trees are aligned in this one way; two lists of all different subtrees cost the product of their lengths. No recursion: pages may be nested at any depth.
    """
    shapes: dict[tuple[str, tuple[int, ...]], int] = {}
    of: dict[int, int] = {}
    for root in (a, b):
        for node in in_post_order(root):
            of[id(node)] = shapes.setdefault((node.label, tuple(of[id(k)] for k in node.elements())), len(shapes))
    made = list(shapes)
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    size = lambda x, y: done.get((x, y), (0,))[0]
    waiting = [(of[id(a)], of[id(b)], False)]
    while waiting:
        x, y, ready = waiting.pop()
        (label, left), (other_label, right) = made[x], made[y]
        if ready:
            chosen = _best(left, right, size)
            done[x, y] = 1 + sum(size(left[i], right[j]) for i, j in chosen), chosen
        elif label == other_label and (x, y) not in done:
            waiting.append((x, y, True))
            by_label: dict[str, list[int]] = {}
            for o in dict.fromkeys(right):
                by_label.setdefault(made[o][0], []).append(o)
            waiting.extend((c, o, False) for c in dict.fromkeys(left) for o in by_label.get(made[c][0], ()))
    found = size(of[id(a)], of[id(b)])
    if pairs is not None and found:
        follow = [(a, b)]
        while follow:
            x, y = follow.pop()
            pairs[id(x)] = y
            left, right = x.elements(), y.elements()
            follow.extend((left[i], right[j]) for i, j in done[of[id(x)], of[id(y)]][1])
    return found


def in_post_order(root: Node) -> list[Node]:
    """All nodes, each after those below it."""
    out, waiting = [], [root]
    while waiting:
        here = waiting.pop()
        out.append(here)
        waiting.extend(here.elements())
    return out[::-1]


def whole_text(node: Node) -> str:
    out, waiting = [], [node]
    while waiting:
        here = waiting.pop()
        if isinstance(here, str):
            out.append(here)
        else:
            waiting.extend(reversed(here.kids))
    return " ".join(" ".join(out).split())


def induce(pages: list[str]) -> list | None:
    """Wrapper of a host from its sample pages: rows of parent's number (-1 for the first), label, mark and text, down to the content slot.

    Marks: 1 content slot, 2 template block inside it, 0 the way there. None where fewer than two pages differ.
    """
    first, *others = [parse(p) for p in pages]
    said = whole_text(first)
    aligned = []
    for other in others:
        if whole_text(other) != said:  # a copy says nothing about what varies
            partners: dict[int, Node] = {}
            match(first, other, partners)
            aligned.append(partners)
    if not aligned:
        return None
    varying: dict[int, int] = {}
    for node in in_post_order(first):
        own = node.own_text()
        changes = sum(1 for p in aligned if (o := p.get(id(node))) is None or o.own_text() != own)
        varying[id(node)] = 0 if node.chrome else len(own) * changes + sum(varying[id(k)] for k in node.elements())
    if not varying[id(first)]:
        return None
    path = [first]
    while True:
        best = max(path[-1].elements(), key=lambda n: varying[id(n)], default=None)
        if best is None or best.tag in PROSE or best.tag not in BLOCKS or varying[id(best)] < DOMINANT * varying[id(path[-1])]:
            break
        path.append(best)
    wrapper: list[list] = []
    above = -1
    for node, child in zip(path[:-1], path[1:], strict=True):
        here = len(wrapper)
        wrapper.append([above, node.label, 0, ""])
        for kid in node.elements():
            if kid is child:
                break
            wrapper.append([here, kid.label, 0, ""])
        above = here
        after = [k.label for k in node.elements()[node.elements().index(child) + 1 :]]
        wrapper[here].append(after)  # set behind the way below
    slot = len(wrapper)
    wrapper.append([above, path[-1].label, 1, ""])
    # constant blocks of any kind inside the slot; what lies between is kept as the way to them
    waiting = [(path[-1], slot)]
    while waiting:
        node, here = waiting.pop()
        for kid in node.elements():
            if kid.chrome:
                continue
            text = whole_text(kid)
            same = sum(1 for p in aligned if (o := p.get(id(kid))) is not None and whole_text(o) == text) if kid.tag in BLOCKS else 0
            constant = bool(text) and len(aligned) >= LEAST_PAGES and same >= CONSTANT * len(aligned)
            wrapper.append([here, kid.label, 2 if constant else 0, text if constant else ""])
            if not constant:
                waiting.append((kid, len(wrapper) - 1))
    for here in range(slot):
        if len(wrapper[here]) > 4:
            wrapper += [[here, label, 0, ""] for label in wrapper[here].pop()]
    return wrapper


def skeleton(wrapper: list, marks: dict[int, tuple[int, str]]) -> Node:
    nodes = []
    for above, label, mark, text in wrapper:
        node = Node(label.split(" ")[0], label, False)
        if above >= 0:
            nodes[above].kids.append(node)
        marks[id(node)] = (mark, text)
        nodes.append(node)
    return nodes[0]


def find(node: Node, tag: str) -> list[Node]:
    """Outermost elements of that tag outside chrome."""
    out, waiting = [], [node]
    while waiting:
        here = waiting.pop()
        if here.chrome:
            continue
        if here.tag == tag:
            out.append(here)
        else:
            waiting.extend(reversed(here.elements()))
    return out


def blocks(roots: list[Node], template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below ``roots`` in page order, without chrome and template."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for root in roots:
        waiting: list[Node | str | None] = [root]
        while waiting:
            here = waiting.pop()
            if here is None:
                close()
            elif isinstance(here, str):
                run.append(here)
            elif here.tag == "br":
                run.append(" ")
            elif not here.chrome and id(here) not in template:
                if here.tag in BLOCKS:
                    close()
                    waiting.append(None)
                waiting.extend(reversed(here.kids))
        close()
    return out


def extract(page: str, wrapper: list | None = None) -> str:
    """Main text of one page: blocks joined by one line feed, white space inside a block as one space."""
    tree = parse(page)
    by_itself = find(tree, "article") or find(tree, "main") or [tree]
    if wrapper is None:
        return "\n".join(blocks(by_itself))
    marks: dict[int, tuple[int, str]] = {}
    frame = skeleton(wrapper, marks)
    partners: dict[int, Node] = {}
    match(frame, tree, partners)
    slot = next((partners[k] for k, (mark, _) in marks.items() if mark == 1 and k in partners), None)
    if slot is None:
        return "\n".join(blocks(by_itself))
    template = {id(partners[k]) for k, (mark, text) in marks.items() if mark == 2 and k in partners and whole_text(partners[k]) == text}
    # a slot around a marked article is narrowed to it; a slot inside one is widened to it
    inner = find(slot, "article")
    roots = inner or next(([a] for a in by_itself if a.tag in ("article", "main") and any(n is slot for n in in_post_order(a))), [slot])
    return "\n".join(blocks(roots, template) or blocks(roots))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """host, wrapper (JSON) from at most ``sample`` different pages of each host, those of the least hashes."""
    marked = pages.filter("host <> ''").withColumn("mark", F.xxhash64("html"))
    # ranked as hashes; the few pages are fetched by them, equal ones once
    rank = F.row_number().over(Window.partitionBy("host").orderBy("mark"))
    chosen = marked.select("host", "mark").distinct().withColumn("rank", rank).filter(F.col("rank") <= sample).select("host", "mark")
    chosen = marked.join(cut_lineage(chosen, "page-sample"), ["host", "mark"]).groupBy("host", "mark").agg(F.min("html").alias("html"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = induce(list(group.sort_values("mark")["html"]))
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(wrapper) if wrapper else None]})

    return chosen.groupBy("host").applyInPandas(fit, "host string, wrapper string").filter("wrapper IS NOT NULL")


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html; others are ignored): page_id, url, text.

    A null page is an empty one and has an empty text. A null or odd address has no host and no wrapper. Repeated rows
    give repeated rows. The join with the wrappers moves pages only if these are too large to broadcast by
    Spark's own measure; AQE then splits a host with many pages, as its other side is one row.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    joined = rows.join(wrappers(rows.select("host", "html"), sample), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lru_cache(1024)(lambda text: text and json.loads(text))
        for batch in batches:
            pairs = zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True)
            texts = pa.array([extract(page, load(wrapper)) for page, wrapper in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:2])
    return joined.mapInArrow(run, f"{kinds}, text string")
