"""Main text of web pages by differencing each page with its nearest page by URL.

A page is cut into text lines, one for each block.  Within a host, pages are sorted by URL path and each is
paired with the neighbour that shares the longest path prefix.  Pages in a row with the same lines count as one
there, whatever their number, so all of them have the same partner and result.  The lines of both are aligned by longest
common subsequence and the shared ones are deleted: what two pages of a site have in common is its frame.
Lines in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are known by their
elements and go as well, before lines are compared, so copies under other adverts are equal too.  Where a page
marks its article, no words of it go because another page has them too: pages quote each other.  Only a line that is
links and nothing else goes, if the nearest page and a second one, different from both, share it ("share", "next page").

Pages are dealt out by ranges of (host, path), so a host of any size spreads over tasks; the outermost runs
of equal pages of each range are known to all tasks, so that pairs do not depend on the ranges.

Null or empty html gives the empty text; a null or unparsable url is a host and path of its own, the empty
one; repeated rows count once in pairing and each get their text; a null page_id is kept; pages of any length are taken
whole; of two neighbours with equally long shared prefixes the one before counts; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import collections
import html
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.llm.common import cut
from lexmill.shipping import ship

# Elements of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg annotation annotation-xml object canvas audio video".split())
FRAME = frozenset("nav header footer aside form menu dialog button select search head".split())
ARTICLE = frozenset("article main".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_NAME = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
_CLUTTER = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|notices?|newsletter|subscribe\w*|popup|modal|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footer|header|masthead|comments?|commentlist|replies|respond|disqus\w*|share|sharing|social\w*|"
    r"related|recommend\w*|widgets?|toolbar|pagination|pager|complementary|contentinfo|search",
    re.I,
)
#: Words that may stand beside one of those in a name that still is the element's own, unlike has-sidebar or entry-header.
_BESIDE = re.compile(
    r"site|page|main|global|primary|secondary|top|bottom|left|right|mobile|desktop|sub|mega|sticky|fixed|floating|user|reader|blog|"
    r"area|bars?|box|block|section|container|wrap|wrapper|inner|outer|panel|list|links?|items?|buttons?|icons?|form|input|results?|"
    r"media|policy|law|slot|unit|space|signup|posts|articles|stories|thread|trail|toggle|you|me|us|of|the|for|and|\d*",
    re.I,
)
_SPACE = re.compile(r"\s+")


def _is_clutter(said: list[tuple[str, str]]) -> bool:
    """Whether a whole class, id, role or label names an element that is no main text."""
    for kind, value in said:
        for token in [value] if kind == "aria-label" else value.split():
            parts = re.split(r"[\s_-]+", token.strip())
            if any(_CLUTTER.fullmatch(x) for x in parts) and all(_CLUTTER.fullmatch(x) or _BESIDE.fullmatch(x) for x in parts):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The text lines of a page and what each is: 0 part of a frame element, 1 open text, 2 article, 3 a line of an
    article that is all links."""
    if not page:
        return []
    found: list[tuple[str, bool, tuple[int, ...], int]] = []  # line, in a frame element, in which elements named so, 1 open, 2 in an article, 3 and all links
    stack: list[tuple[str, bool, int, bool]] = []  # name, is a frame, number of an element named like one, is an article
    named, cleared = 0, set()  # elements named like frames; those of them that hold an article
    text: list[str] = []
    plain = False  # whether the line has words outside links
    at, end = 0, len(page)

    def add(part: str) -> None:
        nonlocal plain
        text.append(part)
        plain = plain or not (part.isspace() or any(s[0] == "a" for s in stack))

    def flush() -> None:
        nonlocal plain
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                kind = (2 if plain else 3) if any(s[3] for s in stack) else 1
                found.append((line, any(s[1] for s in stack), tuple(s[2] for s in stack if s[2]), kind))
            plain = False

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            add(page[at:])
            break
        if tag > at:
            add(page[at:tag])
        m = _TAG.match(page, tag)
        if m is None:
            add("<")
            at = tag + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BLOCKS or not any(s[0] in BLOCKS for s in stack[k + 1 :]):
                        del stack[k:]
                    break
            continue
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = m.end() if m else end
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph or item ends where a block begins
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in VOID or m[3].endswith("/"):
            continue
        said = [(k.lower(), a or b or c) for k, a, b, c in _NAME.findall(m[3])] if m[3] else []
        in_article = any(s[3] for s in stack)
        article = name in ARTICLE or any("articlebody" in v.lower() or v.lower() == "main" for _, v in said)
        heading = name == "header" and in_article
        frame = name in FRAME and not heading or bool(m[3] and _HIDDEN.search(m[3]))
        own = 0
        if said and not (article or heading or name in ("html", "body")) and _is_clutter(said):
            named += 1
            own = named
        if article:  # what holds an article is no frame, whatever its name
            cleared.update(s[2] for s in stack)
        stack.append((name, frame, own, article))
    flush()
    return [(line, 0 if frame or not cleared.issuperset(names) else kind) for line, frame, names, kind in found]


def address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path.rstrip("/") or "/"
    except ValueError:
        return "", "/"


def _hash(line: str) -> int:
    raw = line.encode("utf-8", "replace")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw) ^ len(raw) << 20


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in one longest common subsequence with ``b``, in memory linear in both."""
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            found.add(j - 1)
            j, m = j - 1, m - 1
        if i >= j or k >= m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                found.add(i)
            continue
        mid = (i + j) // 2
        left, right = _lengths(a[i:mid], b[k:m]), _lengths(a[mid:j][::-1], b[k:m][::-1])[::-1]
        at = k + int(np.argmax(left + right))
        todo += [(i, mid, k, at), (mid, j, at, m)]
    return found


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``, by bit-parallel rows."""
    where: dict[int, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Address and hashes of the lines that are no part of a frame element."""
    for batch in batches:
        hosts, paths, hashes = [], [], []
        for url, page in zip(batch.column("url"), batch.column("html")):
            host, path = address(url.as_py())
            hosts.append(host)
            paths.append(path)
            hashes.append([_hash(line) for line, kind in blocks(page.as_py()) if kind])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "host", "path", "lines"])


_NEAR = 2  # runs on each side that a page looks at; the second one serves where the first lies on no or an equal side


def _runs(rows: Iterator[tuple]) -> Iterator[list]:
    """Pages in a row with one host and the same lines: [host, lines, first path, last path, keys]."""
    run = None
    for key, host, path, lines in rows:
        if run is not None and run[0] == host and run[1] == lines:
            run[3] = path
            run[4].append(key)
            continue
        if run is not None:
            yield run
        run = [host, lines, path, path, [key]]
    if run is not None:
        yield run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("key", "host", "path", "lines")))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outermost runs of a range; one more than are looked at, since the outermost may go on in the next range."""
    n = _NEAR + 1
    head: list[list] = []
    tail: collections.deque = collections.deque(maxlen=n)
    for at, run in enumerate(_runs(_rows(batches))):
        (head if at < n else tail).append([at, *run[:4]])
    if head:
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string()]
        rows = [[TaskContext.get().partitionId(), *r] for r in [*head, *tail]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "at", "host", "lines", "first", "last"])


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _pair(edges: list[tuple]):
    """edges: (part, at, host, lines, first, last), outermost runs of each range, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = [list(e[2:]) for e in edges if e[0] == part]
        before = _joined([list(e[2:]) for e in edges if e[0] < part])
        after = _joined([list(e[2:]) for e in edges if e[0] > part])
        if own and before and before[-1][:2] == own[0][:2]:  # a run begins in an earlier range
            start = before.pop()[2]
        else:
            start = None
        if own and after and after[0][:2] == own[-1][:2]:  # or goes on in a later one
            stop = after.pop(0)[3]
        else:
            stop = None
        seen: collections.deque = collections.deque([None] * _NEAR + [[*r, []] for r in before[-_NEAR:]], maxlen=2 * _NEAR + 1)
        done: list[tuple] = []

        def judge(k: int) -> None:
            host, lines, first, last, keys = seen[k]
            near = []  # the nearer side first, on a tie the earlier one
            for step in range(1, _NEAR + 1):
                for j, path in ((k - step, first), (k + step, last)):
                    x = seen[j] if 0 <= j < len(seen) else None
                    if x is not None and x[0] == host and x[1] != lines:
                        near.append((_common(path, x[3] if j < k else x[2]), x[1]))
            near.sort(key=lambda n: -n[0])
            gone = shared_lines(lines, near[0][1]) if near else set()
            other = next((x for _, x in near if x != near[0][1]), None)
            both = gone & shared_lines(lines, other) if gone and other is not None else set()
            done.extend((key, sorted(gone), sorted(both)) for key in keys)

        def emit(least: int) -> Iterator[pa.RecordBatch]:
            while len(done) >= least:
                some = done[:5000]
                del done[:5000]
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in some], pa.int64()), *(pa.array([d[k] for d in some], pa.list_(pa.int32())) for k in (1, 2))], names=["of_key", "shared", "twice"])

        def ordered() -> Iterator[list]:
            previous = None
            for r in _runs(_rows(batches)):
                if previous is None:
                    r[2] = r[2] if start is None else start
                else:
                    yield previous
                previous = r
            if previous is not None:
                previous[3] = previous[3] if stop is None else stop
                yield previous
            for r in after[:_NEAR]:
                yield [*r, []]
            for _ in range(_NEAR):
                yield None

        for r in ordered():
            seen.append(r)
            k = len(seen) - 1 - _NEAR
            if k >= 0 and seen[k] is not None and seen[k][4]:
                judge(k)
            yield from emit(5000)
        yield from emit(1)

    return run


def _joined(edges: list[list]) -> list[list]:
    """Runs (host, lines, first, last) of which those that go on across a border are one."""
    out: list[list] = []
    for e in edges:
        if out and out[-1][:2] == e[:2]:
            out[-1][3] = e[3]
        else:
            out.append(list(e))
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each page, compressed for the way to the join."""
    for batch in batches:
        packed = []
        for page in batch.column("html"):
            found = blocks(page.as_py())
            packed.append(zlib.compress("\n".join(f"{kind}{line}" for line, kind in found).encode("utf-8", "replace"), 6) if found else b"")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("key"), pa.array(packed, pa.binary())], names=["page_id", "url", "key", "packed"])


def remaining(lines: list[tuple[str, int]], shared: set[int], twice: set[int]) -> list[str]:
    """The main text of a page, of which the lines in ``shared`` (counted without those of frame elements) are
    also in its nearest page, and those in ``twice`` in a second one too."""
    gone = {1: shared, 2: frozenset(), 3: twice}
    return [line for k, (line, kind) in enumerate(x for x in lines if x[1]) if k not in gone[kind]]


@F.pandas_udf(StringType())
def _article(packed: pd.Series, shared: pd.Series, twice: pd.Series) -> pd.Series:
    out = []
    for p, *gone in zip(packed, shared, twice):
        lines = [(x[1:], int(x[0])) for x in zlib.decompress(p).decode().split("\n")] if p else []
        out.append("\n".join(remaining(lines, *(set() if g is None else {int(k) for k in g} for g in gone))))
    return pd.Series(out, dtype=object)


def shared_with_nearest(pages: DataFrame) -> DataFrame:
    """of_key and the positions (among its lines outside frame elements) that a page shares with its nearest page,
    and those of them that it shares with a second page as well, which differs from both."""
    outlines = pages.mapInArrow(_outlines, "key bigint, host string, path string, lines array<bigint>")
    outlines = outlines.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("lines").alias("lines"))
    outlines = outlines.filter("size(lines) > 0")  # a page without lines shares none
    ranged = cut(outlines.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key"))
    edges = ranged.mapInArrow(_edges, "part int, at bigint, host string, lines array<bigint>, first string, last string").collect()  # six rows for each range
    edges = sorted((tuple(e) for e in edges), key=lambda e: e[:2])
    return ranged.mapInArrow(_pair(edges), "of_key bigint, shared array<int>, twice array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page (page_id, url, html)."""
    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    shared = shared_with_nearest(pages)
    packed = pages.mapInArrow(_pack, "page_id bigint, url string, key bigint, packed binary")
    joined = packed.join(shared, F.col("key") == F.col("of_key"), "left")
    return joined.select("page_id", "url", _article("packed", "shared", "twice").alias("text"))
