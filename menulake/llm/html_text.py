"""Main text of web pages by nearest-URL page differencing, with structure as the tie-break."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import Answers, Workspace, batch_of, ranked, table

# Names of HTML elements by what they do to text.
RAW = frozenset("script style noscript template textarea iframe svg canvas object title".split())
FURNITURE = frozenset("nav header footer aside form button select dialog menu".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th img wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
AROUND_P = BLOCK - {"p"}
LISTS = frozenset("ul ol dl menu table select".split())
# Roles and whole class or id tokens of furniture. PARTS may follow one of ALWAYS after
# a hyphen, as numbers may; OUTSIDE counts as furniture only outside an article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog".split())
ALWAYS = frozenset("ad ads advert advertisement advertising adsense breadcrumb breadcrumbs comment comments consent cookie cookies disqus nav navbar navigation newsletter sidebar sponsored".split())
PARTS = frozenset("area bar banner block body box container content form item list menu notice section slot thread text unit widget wrapper".split())
OUTSIDE = frozenset("banner footer header masthead menu modal notice popup promo related search share sharing social sponsor subscribe toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
HINT = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")

#: Pages in one block of the sorted order, and bits of alignment that are held at once.
BLOCK_PAGES, HELD_BITS = 512, 1 << 27
#: What becomes of a line: it stays, goes if the nearest page shares it, or goes.
STAYS, IF_SHARED, GOES = range(3)


def hint(attributes: str) -> int:
    """2 if a class or id token or the role names furniture anywhere, 1 if it does outside an article."""
    found = 0
    if "=" in attributes:
        for name, *values in HINT.findall(attributes):
            for token in "".join(values).lower().split():
                first, *rest = re.split("[-_]", token)
                if name.lower() == "role":
                    found = max(found, 2 * (token in ROLES))
                elif token in ALWAYS or first in ALWAYS and all(x in PARTS or x.isdigit() for x in rest):
                    found = 2
                elif token in OUTSIDE:
                    found = max(found, 1)
    return found


@dataclass(slots=True)
class Element:
    """An element that can decide about the text in it. article: 2 in one, 1 in a main element."""

    outer: Element | None
    article: int
    tag: bool = False
    header: bool = False
    hint: int = 0
    holds_article: bool = False
    holds_title: bool = False

    def mark(self) -> int:
        """2: its text goes; 1: it goes unless it is in an article and the nearest page hasn't it."""
        if self.holds_article or self.holds_title and not self.header:
            return 0
        return 2 if self.tag else self.hint


def lines_of(page: str) -> list[tuple[str, int]]:
    """(line, STAYS, IF_SHARED or GOES) for each block of visible text, in page order, without the text
    of elements that are furniture by their names or hints.

    Character references are decoded, white space is one space, blank blocks are left out. An element
    that isn't closed ends with the one around it. No element counts as furniture that holds an
    article or a first heading, but for a header around the heading.
    """
    pieces: list[tuple[int, int, Element | None]] = []  # of the block so far; a width of 0 is a space
    blocks: list[list[tuple[int, int, Element | None]]] = []
    stack: list[tuple[str, Element | None]] = []  # names, and the element in charge outside
    count: dict[str, int] = {}
    now: Element | None = None
    at = 0

    def flush() -> None:
        nonlocal pieces
        if pieces:
            blocks.append(pieces)
            pieces = []

    def pop(name: str) -> None:
        nonlocal now
        while True:
            n, now = stack.pop()
            count[n] -= 1
            if n == name:
                return

    def holds(what: str) -> None:
        e = now
        while e is not None and not getattr(e, what):
            setattr(e, what, True)
            e = e.outer

    def close_siblings(names: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(map(count.get, names)):
            return
        for n, _ in reversed(stack):
            if n in names:
                pop(n)
                return
            if n in stop:
                return

    scan = TOKEN.scanner(page)
    while True:
        m = scan.search()
        end = m.start() if m else len(page)
        if end > at:
            pieces.append((at, end, now))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in RAW:
            close = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            scan = TOKEN.scanner(page, at)
            continue
        if name in BLOCK:
            flush()
        elif name in SPACED:
            pieces.append((at, at, now))
        if closing:
            if count.get(name):
                pop(name)
            continue
        if name in BLOCK:
            close_siblings(("p",), AROUND_P)
        if name in SIBLINGS:
            close_siblings(SIBLINGS[name], LISTS)
        if name in VOID or m[4]:
            continue
        stack.append((name, now))
        count[name] = count.get(name, 0) + 1
        inside = now.article if now else 0
        own = hint(m[3]) if name not in ("html", "body", "h1") else 0
        if name == "main" or name == "article" and own < 2:
            if inside < 2:
                holds("holds_article")
            now = Element(now, max(inside, 2 if name == "article" else 1))
        elif name in FURNITURE and not (inside and name == "header"):
            now = Element(now, inside, True, name == "header")
        elif own:
            now = Element(now, inside, hint=own)
        elif name == "h1":
            holds("holds_title")
    flush()

    marks: dict[int, int] = {}

    def mark(e: Element | None) -> int:
        chain = []
        while e is not None and id(e) not in marks:
            chain.append(e)
            e = e.outer
        found = marks[id(e)] if e is not None else 0
        for x in reversed(chain):
            found = marks[id(x)] = max(found, x.mark())
        return found

    found = []
    for block in blocks:
        kept = [p for p in block if mark(p[2]) < 2]
        line = SPACE.sub(" ", html.unescape("".join(page[s:e] if e > s else " " for s, e, _ in kept))).strip()
        if line:
            found.append((line, kept[0][2].article if kept[0][2] else 0, min(mark(e) for *_, e in kept)))
    best = max((article for _, article, _ in found), default=0)
    return [(line, decision(article, marked, best)) for line, article, marked in found]


def decision(article: int, marked: int, best: int) -> int:
    """What becomes of a line in an article (2), a main element (1) or neither (0), on a page whose best
    such element is `best`. Where structure doesn't tell, the nearest page does."""
    if article == 2:
        return IF_SHARED if marked else STAYS
    if marked or best and not article:
        return GOES
    return STAYS if article == best == 1 else IF_SHARED


def alignment(own: list, other: list) -> list[int]:
    """Prefix lengths: entry j is the length of a longest common subsequence of own and other[:j].

    Bit-parallel: the zero bits below j count it."""
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = v = (1 << len(other)) - 1
    for x in own:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(own: list[int], other: list[int], held: int = HELD_BITS) -> set[int]:
    """Positions of own that a longest common subsequence with other holds.

    Lines that the other side hasn't are left out first, and equal ends are matched. What is then
    longer than `held` bits of alignment is cut in two where the lengths of both halves add up to the
    most, so that memory grows with the lines and not with their product.
    """
    in_own, in_other = set(own), set(other)
    at = [i for i, x in enumerate(own) if x in in_other]
    a, b = [own[i] for i in at], [x for x in other if x in in_own]
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, begin, end = todo.pop()
        while lo < hi and begin < end and a[lo] == b[begin]:
            found.add(at[lo])
            lo, begin = lo + 1, begin + 1
        while lo < hi and begin < end and a[hi - 1] == b[end - 1]:
            hi, end = hi - 1, end - 1
            found.add(at[hi])
        if lo == hi or begin == end:
            continue
        if (hi - lo) * (end - begin) > held and hi - lo > 1:
            half = (lo + hi) // 2
            both = alignment(a[lo:half], b[begin:end]) + alignment(a[half:hi][::-1], b[begin:end][::-1])[::-1]
            cut = begin + int(np.argmax(both))
            todo += [(lo, half, begin, cut), (half, hi, cut, end)]
            continue
        found.update(at[lo + i] for i in _matched(a[lo:hi], b[begin:end]))
    return found


def _matched(own: list[int], other: list[int]) -> list[int]:
    """Positions of own in a longest common subsequence, from all rows of the alignment."""
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    rows = [full]
    for x in own:
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    length = lambda i, j: ((~rows[i]) & ((1 << j) - 1)).bit_count()
    found, i, j = [], len(own), len(other)
    while i and j:
        here = length(i, j)
        if here == length(i - 1, j):
            i -= 1
        elif here == length(i, j - 1):
            j -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found


def address(url: str | None) -> tuple[str, str]:
    """(host, path and query) of a URL; an odd one is a path on the nameless host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), f"{parts.path}?{parts.query}" if parts.query else parts.path
    except ValueError:
        return "", url or ""


def key_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed(pages: DataFrame) -> DataFrame:
    """(part, nr, page_id, url, host, path, list, keys, body) of each page. part and nr are its place;
    list names the host and its lines' keys; body is the lines and what becomes of them, compressed."""
    names = ["part", "nr", "page_id", "url", "host", "path", "list", "keys", "body"]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        part_no, nr = TaskContext.get().partitionId(), 0
        for b in batches:
            for begin in range(0, b.num_rows, 128):
                part = b.slice(begin, 128)
                out = []
                for page_id, url, page in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    lines = lines_of(page or "")
                    host, path = address(url)
                    keys = np.array([key_of(x) for x, _ in lines], np.int64)
                    name = xxhash.xxh3_128_digest(host.encode("utf-8", "surrogatepass") + b"\0" + keys.tobytes())
                    body = bytes(rule for _, rule in lines) + "\n".join(x for x, _ in lines).encode("utf-8", "replace")
                    out.append((part_no, nr, page_id, url, host, path, name, keys, packer.compress(body)))
                    nr += 1
                yield batch_of(names, [list(c) for c in zip(*out, strict=True)], [*[pa.int64()] * 3, *[pa.string()] * 3, pa.binary(), pa.list_(pa.int64()), pa.binary()])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "part long, nr long, page_id long, url string, host string, path string, list binary, keys array<long>, body binary")


def common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def differences(ws: Workspace, lines: DataFrame) -> DataFrame:
    """(list, shared): for each different list of lines on a host, which of them the page of the
    nearest path there has too, by longest common subsequence; one byte a line.

    Pages of equal lines on a host are one, at the first of their paths, so a page is compared with
    the nearest that differs, however many copies lie between. Lists are sorted by host and path and
    cut into blocks of equal counts that see one list on either side, so a host of any size is
    spread out. Of two lists as near that with more lines in common is taken."""
    one = lines.groupBy("list").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.first("keys").alias("keys"))
    order = ranked(ws, one, "host", "path", "list", name="row")
    block = F.expr(f"row div {BLOCK_PAGES}L")
    to = F.array_distinct(F.array(block, F.expr(f"(row + 1) div {BLOCK_PAGES}L"), F.expr(f"greatest(row - 1, 0L) div {BLOCK_PAGES}L")))
    dealt = order.select("host", "path", "list", "keys", "row", F.explode(to).alias("block"))

    def near(key, pdf):
        pdf = pdf.sort_values("row").reset_index(drop=True)
        hosts, paths, keys = pdf["host"].tolist(), pdf["path"].tolist(), [x.tolist() for x in pdf["keys"]]
        own = (pdf["row"] // BLOCK_PAGES == key[0]).to_numpy()
        shared = []
        for i in np.flatnonzero(own).tolist():
            beside = [j for j in (i - 1, i + 1) if 0 <= j < len(pdf) and hosts[j] == hosts[i]]
            best = max(beside, key=lambda j: (common(paths[i], paths[j]), len(set(keys[i]) & set(keys[j])), -j), default=None)  # noqa: B023
            there = shared_lines(keys[i], keys[best]) if best is not None else set()
            shared.append(bytes(n in there for n in range(len(keys[i]))))
        return pdf[own][["list"]].assign(shared=shared)

    return dealt.groupBy("block").applyInPandas(near, "list binary, shared binary")


def text_of(body: bytes, shared: bytes) -> str:
    """The lines that stay, joined. If differencing would leave nothing, it takes nothing."""
    data = zstandard.ZstdDecompressor().decompress(body)
    n = len(shared)
    lines = data[n:].decode().split("\n") if n else []
    stay = [x for x, rule, there in zip(lines, data[:n], shared, strict=True) if rule == STAYS or rule == IF_SHARED and not there]
    return "\n".join(stay or [x for x, rule in zip(lines, data[:n], strict=True) if rule != GOES])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of each page, blocks joined by a line feed.

    The lines of every page are aligned by longest common subsequence with those of the page of the
    nearest URL path (and query) on its host, and shared ones go. Structure breaks the tie where it
    tells more: an article's own lines stay although another page has them, as do those of a main
    element on a page without an article; menus, headers, footers, sidebars, notices, adverts, forms
    and comments go although no other page has them, as does what stands outside an article. Names
    that only hint at furniture inside an article leave it to the nearest page.

    A page that is alone on its host, or shares its lines with all of it, is compared with none; one
    of which nothing would be left keeps what structure leaves. A null or empty html has an empty
    text, a null or odd url is on the nameless host. Pages of equal lines on a host have equal texts.
    Repeated rows and ids each give a row; other columns are ignored; an empty table gives no rows.
    """
    ws = Workspace(pages.sparkSession, "html")
    lines = ws.save(parsed(pages), "lines")
    shared = differences(ws, lines.select("list", "host", "path", "keys"))
    answers = Answers.write(ws, lines.select("part", "nr", "list").join(shared, "list").drop("list"), ["nr"], "shared")

    def run(batches):
        for b in batches:
            text = []
            for part, nr, body in zip(*(b.column(c).to_pylist() for c in (0, 1, 4)), strict=True):
                text.append(text_of(body, answers.of(part).column("shared")[nr].as_py()))
            yield batch_of(["page_id", "url", "text"], [b.column(2), b.column(3), text], [pa.int64(), pa.string(), pa.string()])

    return lines.select("part", "nr", "page_id", "url", "body").mapInArrow(run, "page_id long, url string, text string")


def op4_nearest_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
