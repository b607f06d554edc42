"""Main text of web pages by differencing each page with the page of nearest URL.

A page is read as text lines (its blocks), each with the part of the page it stands in. Lines in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments go by their element. Equal pages of a host count as one; the pages of a host are sorted by URL path, over all
tasks alike, and a page is paired with the neighbour that shares the longer path. Their lines are aligned by longest common subsequence, and lines that both have
go: what differs is the article. Lines inside an article or main element are known to be the article's, so a copy next door doesn't delete them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import among, pieces, staged

#: Elements of HTML by role (fixed values).
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUT = set("aside button canvas datalist dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
#: Elements that a start tag or their parent's end closes, and where the search for them ends (fixed values of HTML).
IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
ENDS_P = set("address article aside blockquote details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
CLOSED = {"p", "caption", "tbody", "thead", "tfoot"}.union(*IMPLIED.values())
BARRIERS = set("ul ol menu dl table select div section article aside blockquote button td th".split())
#: Words of a name that is a heading's, not a role's: notice-of-death (fixed values).
PHRASE = re.compile(r"[_-](?:a|an|and|at|by|for|from|in|of|on|or|the|to|with)[_-]", re.IGNORECASE)
#: Words in class, id and role that mark what isn't the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notification|alert|popup|modal|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|site-header|page-header|topbar|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|newsletter|subscribe|widget|complementary|contentinfo|search|login|signup|pagination|pager|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names that end so say that the marked thing is missing (ad-free).
WITHOUT = re.compile(r"[_-](?:free|less)$", re.IGNORECASE)
#: Cells of an alignment that are kept at once, a bit each; longer pages are halved first.
CELLS = 1 << 28


def _names(attrs: list) -> Iterator[str]:
    """What an element is called by its attributes, without names of missing things and phrases as ids."""
    for k, v in attrs:
        if v and k in ("class", "id", "role", "aria-label"):
            yield " ".join(n for n in v.split() if not WITHOUT.search(n) and not (k == "id" and PHRASE.search(n)))


def _still_open(out: list[str], tag: str) -> int:
    """How many of the open elements a start tag leaves open: HTML lets it end an earlier sibling and an open paragraph."""
    ends = IMPLIED.get(tag, set())
    keep = len(out)
    for i in range(len(out) - 1, -1, -1):
        if out[i] in ends or (out[i] == "p" and tag in ENDS_P):
            keep = i
        elif out[i] in BARRIERS:
            break
    return keep


class _Lines(HTMLParser):
    """Blocks as (text, kept for sure); what stands in an element that isn't the article's is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.out: list[str] = []  # the open elements from the first left-out one on
        self.sure = 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((text, self.sure > 0))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self.end_block()
            elif not self.out:
                self.parts.append(" " if tag == "br" else "")
            return
        del self.out[_still_open(self.out, tag) :]
        # a mark on a word inside a sentence says how it looks
        marked = tag in BLOCKS and tag not in ("html", "body") and any(MARKS.search(v) for v in _names(attrs))
        article = tag in ("article", "main") and not marked
        if self.out:
            if not article or {"aside", "dialog", "template", "noscript", "svg"} & {*self.out} or self.sure:
                self.out.append(tag)
                return
            self.out = []  # an article ends what was left open before it
        if tag in BLOCKS:
            self.end_block()
        if tag in OUT or marked or (tag == "header" and not self.sure):
            self.end_block()
            self.out = [tag]
        elif article:
            self.sure += 1

    def handle_endtag(self, tag: str) -> None:
        if self.out:
            if tag in self.out:
                del self.out[len(self.out) - 1 - self.out[::-1].index(tag) :]
                return
            if not (tag in ("article", "main") and self.sure) and not (tag in BLOCKS - {"p"} and {*self.out} <= CLOSED):
                return  # else the parent's end closes what has no end of its own
            self.out = []
        if tag in BLOCKS:
            self.end_block()
        if tag in ("article", "main"):
            self.sure = max(0, self.sure - 1)

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts.append(data)


def lines(html: str) -> list[tuple[str, bool]]:
    """The text lines of a page that no element rules out, and whether each stands in an article."""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_block()
    return page.lines


def _steps(x: list[int], y: list[int]) -> Iterator[int]:
    """A row of the alignment table for each of x, as a number whose bit j is 0 where the table grows at y[j]."""
    at: dict[int, int] = {}
    for j, c in enumerate(y):
        at[c] = at.get(c, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for c in x:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """How long the longest common subsequence of x and each beginning of y is."""
    row = (1 << len(y)) - 1
    for row in _steps(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(x: list[int], y: list[int]) -> list[int]:
    """Places in x of a longest common subsequence."""
    if not x or not y:
        return []
    if len(x) * len(y) > CELLS and len(x) > 1:  # halve x; the best cut of y is where both halves together are longest
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        return _aligned(x[:half], y[:cut]) + [half + i for i in _aligned(x[half:], y[cut:])]
    size = len(y) // 8 + 1
    rows = [row.to_bytes(size, "little") for row in _steps(x, y)]
    out, i, j = [], len(x), len(y)
    while i and j:
        if rows[i - 1][(j - 1) >> 3] >> ((j - 1) & 7) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1][(j - 1) >> 3] >> ((j - 1) & 7) & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, whatever their lengths."""
    codes = {x: i for i, x in enumerate({*a} & {*b})}
    left = [i for i, x in enumerate(a) if x in codes]
    x, y = [codes[a[i]] for i in left], [codes[s] for s in b if s in codes]
    first = 0
    while first < min(len(x), len(y)) and x[first] == y[first]:
        first += 1
    last = 0
    while last < min(len(x), len(y)) - first and x[len(x) - 1 - last] == y[len(y) - 1 - last]:
        last += 1
    middle = _aligned(x[first : len(x) - last], y[first : len(y) - last])
    return {left[i] for i in [*range(first), *(first + i for i in middle), *range(len(x) - last, len(x))]}


PARSED = "uid long, page_id long, url string, host string, path string, digest binary, text string, open array<int>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines of a page as one text, and the places of those that stand in no article."""
    uid = TaskContext.get().partitionId() << 33
    for batch in pieces(batches, "html"):
        html = [h or "" for h in batch.column("html").to_pylist()]
        found = [lines(h) for h in html]
        made = [
            pa.array(range(uid, uid + len(html)), pa.int64()), *(batch.column(c) for c in ("page_id", "url", "host", "path")), pa.array([hashlib.blake2b(h.encode("utf-8", "surrogatepass"), digest_size=16).digest() for h in html], pa.binary()),
            pa.array(["\n".join(t for t, _ in f) for f in found], pa.string()), pa.array([[i for i, (_, sure) in enumerate(f) if not sure] for f in found], pa.list_(pa.int32())),
        ]
        uid += len(html)
        yield pa.RecordBatch.from_arrays(made, [x.split()[0] for x in PARSED.split(", ")])


def _common(a: str, b: str) -> Column:
    """Length of the leading path segments that columns a and b share, with their slashes."""
    equal = f"zip_with(split({a}, '/'), split({b}, '/'), (x, y) -> coalesce(x = y, false))"
    same = f"slice(split({a}, '/'), 1, if(array_position({equal}, false) = 0, size(split({a}, '/')), int(array_position({equal}, false)) - 1))"
    return F.expr(f"aggregate({same}, 0, (n, x) -> n + length(x) + 1)")


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the open lines that its neighbour has too."""
    for batch in pieces(pieces(batches, "text"), "other"):
        out = []
        for text, other, places in zip(*(batch.column(c).to_pylist() for c in ("text", "other", "open")), strict=True):
            own = text.split("\n")
            drop = shared(own, other.split("\n")) & {*places} if other is not None else set()
            out.append("\n".join(t for i, t in enumerate(own) if i not in drop))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("digest"), pa.array(out, pa.string())], ["host", "digest", "text"])


def _numbered(first: DataFrame) -> DataFrame:
    """first with `number`, gapless from 1 in order of host, path, page_id and uid over all tasks."""
    order = ["host", "path", "page_id", "uid"]
    placed = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "order")
    # a row for each partition of the order
    sizes = placed.groupBy("part").agg((F.max("at") + 1).alias("n"))
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return placed.join(F.broadcast(ahead), "part").withColumn("number", F.col("ahead") + F.col("at") + 1).drop("part", "at", "ahead")


def nearest(first: DataFrame) -> DataFrame:
    """uid and other: the page before or after it on its host in order of path, whichever shares more of it (the one before in a tie). first: uid, host, path, page_id."""
    numbered = staged(_numbered(first.select("uid", "host", "path", "page_id")).select("uid", "host", "path", "number"), "numbers")
    nexts = numbered.select(F.col("uid").alias("next_uid"), F.col("host").alias("next_host"), F.col("path").alias("next_path"), (F.col("number") - 1).alias("number"))
    edges = staged(numbered.join(nexts, "number").where("host = next_host").select("uid", "next_uid", "number", _common("path", "next_path").alias("same")), "edges")
    ahead = edges.select("uid", F.col("next_uid").alias("other"), F.struct("same", F.lit(0).alias("before")).alias("rank"))
    behind = edges.select(F.col("next_uid").alias("uid"), F.col("uid").alias("other"), F.struct("same", F.lit(1).alias("before")).alias("rank"))
    return ahead.unionAll(behind).groupBy("uid").agg(F.expr("max_by(other, rank)").alias("other"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    A null or empty html has the empty text. A null url counts as a host of its own name, the empty one. Repeated rows give a row each. Equal pages of
    a host have equal texts: the first of them by path and page_id (a null one first) is compared for all. A page alone on its host, or whose
    host has only its copies, is compared with none. Of two neighbours that share as much of the path the one before is taken. An empty table
    gives no rows. Other columns of pages play no part.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), "html")
    parsed = staged(source.mapInArrow(_parse, PARSED), "lines")
    one = F.min(F.struct("path", "page_id", "uid", F.size("open").alias("open"))).alias("one")
    first = staged(parsed.groupBy("host", "digest").agg(one).select("host", "digest", "one.*"), "firsts")
    hosts = staged(first.where("open > 0").select("host").distinct(), "hosts")  # the others need no order
    asked = first.where("open > 0").select("uid").join(nearest(among(first, hosts, F.col("host"))), "uid", "left")
    asked = staged(asked, "asked")
    open_ = parsed.where("size(open) > 0")
    others = among(parsed, staged(asked.where("other is not null").select("other").distinct(), "others"), F.col("uid"))
    both = asked.join(open_.select("uid", "host", "digest", "text", "open"), "uid").join(others.select(F.col("uid").alias("other"), F.col("text").alias("other_text")), "other", "left")
    bare = both.select("host", "digest", "text", F.col("other_text").alias("other"), "open").mapInArrow(_difference, "host string, digest binary, text string")
    whole = parsed.where("size(open) = 0").select("page_id", "url", "text")
    rows = open_.select("page_id", "url", "host", "digest").join(bare, ["host", "digest"]).select("page_id", "url", "text")
    return whole.unionAll(rows).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
