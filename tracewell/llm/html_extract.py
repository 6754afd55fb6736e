"""HTML extraction: mark-up regions, and differencing against the nearest URL's page.

A page is read into text lines (blocks) with their region: article, main, open (neither), or chrome (menus, headers, footers,
sidebars, notices, adverts, forms, comments; by element, role and class words). Pages are sorted by host and URL
path, and each is aligned with the pages before and behind it on its host by a longest common subsequence of its lines
outside the article; lines they share are deleted. The text is the article's lines; without an article those of main;
without both, the open lines that the differencing has left.

Shared lines inside an article stay: articles repeat passages, and whole articles, of others in earnest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MAIN, ARTICLE = 0, 1, 2

#: Elements that end a block; whose content is never text; that hold no main text.
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th thead tbody tfoot caption blockquote pre section article main header footer nav aside figure figcaption hr address details summary form fieldset body html head".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
CHROME = frozenset("nav footer aside form menu dialog button select svg canvas object audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id that mark chrome.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment "
    "comments reply replies respond disqus discussion share sharing social related recommended widget toolbar skip pagination pager".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</?[a-zA-Z!][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
#: Cells of an alignment whose rows are held at once.
CELLS = 4_000_000


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in CHROME or (name == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id") and name not in ("html", "body"):
            words = set(WORD.findall(value))
            if words & MARKS or ("header" in words and not in_article and name not in ("h1", "h2", "h3")):
                return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(region, text) of each block that isn't chrome, in page order, white space collapsed and references decoded."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    depth = {ARTICLE: 0, MAIN: 0}
    opened: list[tuple[str, int]] = []  # elements that opened a region
    skipping, level, at = "", 0, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((ARTICLE if depth[ARTICLE] else MAIN if depth[MAIN] else OPEN, text))

    position, end = 0, len(page)
    while position < end:
        m = TAG.search(page, position)
        if not skipping:
            parts.append(page[position : m.start() if m else end])
        if not m:
            break
        position = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not name:
            continue
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}[^>]*>", re.I).search(page, position)
            position = stop.end() if stop else end
            continue
        in_article = depth[ARTICLE] > 0
        if skipping:
            region_starts = name in ("article", "main") and not closing and not in_article and not _is_chrome(name, attributes, False)
            if name == skipping:
                level += -1 if closing else 1
            if level == 0 or region_starts:  # a region that starts ends chrome that was never closed
                skipping = ""
            if not region_starts:
                continue
        if name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
        if closing:
            if opened and name in (x for x, _ in opened):
                while opened:
                    x, region = opened.pop()
                    depth[region] -= 1
                    if x == name:
                        break
            continue
        if name in VOID:
            continue
        if _is_chrome(name, attributes, in_article):
            if name not in BLOCK:
                parts.append(" ")
            skipping, level = name, 1
            continue
        if name in ("article", "main"):
            region = ARTICLE if name == "article" else MAIN
            depth[region] += 1
            opened.append((name, region))
    flush()
    return out


def prefix_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x with y's prefixes, the empty one first."""
    masks: dict[int, int] = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    for v in x:
        u = row & masks.get(v, 0)
        row = (row + u | row - u) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), count=len(y), bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b.

    Bit-parallel rows with a walk back; beyond CELLS a is halved until the parts are small enough, so the rows that are held stay bounded.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if not x or not y:
        return out
    if len(x) * len(y) > CELLS and len(x) > 1:
        # Hirschberg: the place in y where an optimal alignment crosses the middle of x
        middle = len(x) // 2
        ahead, behind = prefix_lengths(x[:middle], y), prefix_lengths(x[:middle - 1 : -1], y[::-1])
        cut = int(np.argmax(ahead + behind[::-1]))
        out |= {low + k for k in common_lines(x[:middle], y[:cut])}
        return out | {low + middle + k for k in common_lines(x[middle:], y[cut:])}
    masks: dict[int, int] = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for v in x:
        rows.append(row)
        u = row & masks.get(v, 0)
        row = (row + u | row - u) & full
    rows.append(row)
    j = len(y)
    for i in range(len(x) - 1, -1, -1):
        # zeros among the first j bits count the subsequence's length; drop columns that don't add to it
        while j and rows[i + 1] >> j - 1 & 1:
            j -= 1
        if not j:
            break
        mask = (1 << j) - 1
        if (~rows[i] & mask).bit_count() < (~rows[i + 1] & mask).bit_count():
            out.add(low + i)
            j -= 1
    return out


def path_of(url: str | None) -> tuple[str, str]:
    """Host, and the path by which pages are near one another."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), unquote(parts.path).rstrip("/").lower()
    except ValueError:
        return "", url or ""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            found = [blocks(h or "") for h in batch.column(2).to_pylist()]
            near = [path_of(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h for h, _ in near], pa.string()), pa.array([p for _, p in near], pa.string()),
                 pa.array([[r for r, _ in f] for f in found], pa.list_(pa.int8())), pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))],
                names=["page_id", "url", "host", "path", "regions", "lines"],
            )


def _lines_outside(regions: list[int], lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for r, t in zip(regions, lines, strict=True) if r != ARTICLE]


def main_text(regions: list[int], lines: list[str], neighbours: list[list[int]]) -> str:
    """The page's text; neighbours: the lines outside the article of the nearest pages on its host."""
    for region in (ARTICLE, MAIN):
        if region in regions:
            return "\n\n".join(t for r, t in zip(regions, lines, strict=True) if r == region)
    own = _lines_outside(regions, lines)
    shared: set[int] = set()
    for other in neighbours:
        same = common_lines(own, other)
        if len(same) < len(own):  # a page that is a copy of this one, or holds all of it, tells nothing apart
            shared |= same
    return "\n\n".join(t for k, t in enumerate(lines) if k not in shared)


EDGE = "host string, path string, regions array<tinyint>, lines array<string>, has_before boolean, has_after boolean, before array<bigint>, after array<bigint>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    hashes = pa.list_(pa.int64())
    kinds = [schema.field("page_id").type, pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.string()), pa.bool_(), pa.bool_(), hashes, hashes]
    names = ["page_id", "url", "text", "host", "path", "regions", "lines", "has_before", "has_after", "before", "after"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host and path; one page behind and one ahead are held. The task's first and last page, whose other
    neighbour another task has, are passed on with what is known of them instead of a text."""
    before: tuple[str, list[int]] | None = None
    held: dict | None = None
    schema = None

    def done(r: dict, own: list[int], following: tuple[str, list[int]] | None) -> tuple:
        near = [x[1] if x is not None and x[0] == r["host"] else [] for x in (before, following)]
        if before is None or following is None:
            return (r["page_id"], r["url"], None, r["host"], r["path"], r["regions"], r["lines"], before is not None, following is not None, *near)
        return (r["page_id"], r["url"], main_text(r["regions"], r["lines"], near), *[None] * 8)

    own: list[int] = []
    for whole in batches:
        schema = whole.schema
        for at in range(0, whole.num_rows, 500):
            out = []
            for r in whole.slice(at, 500).to_pylist():
                lines = _lines_outside(r["regions"], r["lines"])
                if held is not None:
                    out.append(done(held, own, (r["host"], lines)))
                    before = (held["host"], own)
                held, own = r, lines
            if out:
                yield _batch(out, schema)
    if held is not None:
        yield _batch([done(held, own, None)], schema)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' first and last pages, sorted: two a task at most."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    outside = [_lines_outside(r["regions"], r["lines"]) for r in rows]

    def near(k: int, other: int, known: bool, lines: list[int]) -> list[int]:
        if known:
            return lines
        return outside[other] if 0 <= other < len(rows) and rows[other]["host"] == rows[k]["host"] else []

    texts = [main_text(r["regions"], r["lines"], [near(k, k - 1, r["has_before"], r["before"]), near(k, k + 1, r["has_after"], r["after"])]) for k, r in enumerate(rows)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows]), pa.array([r["url"] for r in rows], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html).

    Null and empty pages have an empty text. Null and broken URLs count as one host. Pages are range-partitioned by host and path, so
    that a host with a third of all pages is spread over tasks; the tasks' first and last pages meet their other neighbour in a second step,
    so the result doesn't depend on where the ranges are cut. A page of any length is read whole, one at a time; pages with one host, path and
    url are neighbours in order of page_id, and equal ones, which tell nothing apart, keep their lines. Repeated rows pass through, other columns are ignored, an empty table
    gives an empty result.
    """
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    order = ["host", "path", "url", "page_id"]
    read = rows.mapInArrow(_read, f"page_id {kind}, url string, host string, path string, regions array<tinyint>, lines array<string>")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = read.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = near.mapInArrow(_difference, f"page_id {kind}, url string, text string, {EDGE}")
    # both branches read the one range exchange; only the tasks' edge pages, two a task, go on to the second step
    edges = out.filter("text is null").repartition(1).sortWithinPartitions(*order).mapInArrow(_settle, f"page_id {kind}, url string, text string")
    return out.filter("text is not null").select("page_id", "url", "text").unionByName(edges).withColumn("n_chars", F.length("text").cast("long"))
