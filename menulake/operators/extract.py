"""Rows out of pages and documents: HTML blocks and priced items, JSON-LD menus, refused numbers."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menulake.functions.keys import plain_words
from menulake.functions.prices import number_tokens, prices
from menulake.operators.coverage import name_of, named
from menulake.operators.diagnosis import windows

#: Work limits for one page, so that no page can hold up a task; priced items that make a menu; and
#: characters and different words that make a block spam.
MAX_BYTES, MAX_NODES, LEAST_ITEMS, SPAM_CHARS, SPAM_WORDS = 2 << 20, 50_000, 3, 80, 2
HEADINGS, ITEMS = {"h1", "h2", "h3", "h4"}, {"li", "p", "tr", "dd", "dt"}
UNSEEN, VOID = {"script", "style", "template", "noscript"}, {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Words of injected text, each a sign of it.
SPAM = re.compile(r"\b(unibet|bet365|1xbet|20bet|bwin|betway|casinos?|sportwetten|apuestas|bookmakers?|betting|viagra|cialis|payday(?:\s+loans?)?|forex)\b", re.I)
LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)
TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
# Words in a menu's name that tell its context, in the order in which they are tried.
CONTEXTS = (("lunch", "lunch"), ("diner", "diner dinner avond"), ("borrel", "borrel"), ("dranken", "drank drink beverage wijn bier"), ("specialiteiten", "specialiteit special"), ("ontbijt", "ontbijt breakfast brunch"))


class TooMuchWork(Exception):
    pass


class Blocks(HTMLParser):
    """(section, text, cells, place) of the list items, paragraphs and rows that are to be seen.

    What is hidden by an attribute or an inline style is left out with all in it. The number of nodes
    is counted while they are read, and reading ends at the limit."""

    def __init__(self, limit: int = MAX_NODES) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, list[str], str]] = []
        self.section, self.kind, self.text, self.cells = "", "", [], []
        self.open: list[tuple[str, bool]] = []
        self.limit, self.nodes = limit, 0

    def flush(self) -> None:
        self.cell()
        line = " ".join(self.cells)
        if line and self.kind == "heading":
            self.section = line
        elif line and self.kind == "item":
            self.rows.append((self.section, line, self.cells, str(len(self.rows))))
        self.cells = []

    def cell(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.cells.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.nodes += 1
        if self.nodes > self.limit:
            raise TooMuchWork
        given = dict(attrs)
        if tag in HEADINGS or tag in ITEMS:
            self.flush()
            self.kind = "heading" if tag in HEADINGS else "item"
        elif tag in ("td", "th"):
            self.cell()
        if tag not in VOID:
            hidden = tag in UNSEEN or "hidden" in given or HIDDEN_STYLE.search(given.get("style") or "") is not None
            self.open.append((tag, hidden or bool(self.open and self.open[-1][1])))

    def handle_endtag(self, tag):
        if tag in HEADINGS or tag in ITEMS:
            self.flush()
            self.kind = ""
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.kind and not (self.open and self.open[-1][1]):
            self.text.append(data)


def blocks(page: str | None, limit: int = MAX_NODES) -> tuple[list[tuple[str, str, list[str], str]], str | None]:
    """(rows, why there are none)."""
    if page is None or len(page.encode(errors="replace")) > MAX_BYTES:
        return [], "empty" if page is None else "too large"
    reader = Blocks(limit)
    try:
        reader.feed(page)
        reader.close()
    except TooMuchWork:
        return [], "too many nodes"
    reader.flush()
    return reader.rows, None


def html_items(pages: DataFrame) -> DataFrame:
    """(page_id, section, item, locator, reason): list items, paragraphs and rows under the heading
    they follow. Pages beyond the work limits give one row with a reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, page in zip(pdf["page_id"], pdf["html"], strict=True):
                rows, reason = blocks(page)
                out += [(page_id, "", "", "", reason)] if reason else [(page_id, section, text, at, None) for section, text, _, at in rows]
            yield pd.DataFrame(out, columns=["page_id", "section", "item", "locator", "reason"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, section string, item string, locator string, reason string")


def pairs_of_cells(cells: list[str]) -> list[tuple[str, int]]:
    """(name, cents) of a row's cells: a cell of prices alone belongs to the nearest named cell before
    it that none other took; a cell with both is a pair of its own."""
    out, name = [], None
    for cell in cells:
        found = prices(cell) or ([t for t in number_tokens(cell) if t.reason == "no_name"] if name else [])
        own = name_of(cell, found) if found else (cell if named(cell) else None)
        if not found:
            name = own or name
        elif own:
            out.append((own, found[0].cents))
            name = None
        elif name:
            out.append((name, found[0].cents))
            name = None
    return out


def menu_items(pages: DataFrame, least: int = LEAST_ITEMS) -> DataFrame:
    """(page_id, section, name, cents, locator, reason): the priced items of a page's blocks, several of
    a row where it has several names and prices.

    Refused with a reason: blocks of injected text (`spam`), blocks without a price (`no price`), and
    the items of pages with fewer than `least` of them (`too few`); a page beyond the work limits is
    one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, page in zip(pdf["page_id"], pdf["html"], strict=True):
                rows, reason = blocks(page)
                if reason:
                    out.append((page_id, "", "", None, "", reason))
                good: list[tuple] = []
                for section, text, cells, at in rows:
                    spam = len(text) >= SPAM_CHARS and len({m.lower() for m in SPAM.findall(text)}) >= SPAM_WORDS
                    pairs = [] if spam else pairs_of_cells(cells if len(cells) > 1 else [text])
                    if pairs:
                        good += [(page_id, section, name, cents, f"{at}.{i}", None) for i, (name, cents) in enumerate(pairs)]
                    else:
                        out.append((page_id, section, text, None, at, "spam" if spam else "no price"))
                out += good if len(good) >= least else [(*r[:5], "too few") for r in good]
            yield pd.DataFrame(out, columns=["page_id", "section", "name", "cents", "locator", "reason"]).astype({"cents": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, section string, name string, cents long, locator string, reason string")


def strip_tags(text: str) -> str:
    return " ".join(html.unescape(TAG.sub(" ", text)).split())


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) without markup, entities decoded."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "text": [strip_tags(h or "") for h in pdf["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def sections(node: object, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, str | None]]:
    """(path, item, price) of a JSON-LD node, sections nested to any depth."""
    if isinstance(node, list):
        for n in node:
            yield from sections(n, path)
    elif isinstance(node, dict):
        yield from sections(node.get("@graph", []), path)
        name = str(node.get("name") or "").strip()
        if node.get("@type") == "MenuItem":
            offer = node.get("offers") or {}
            offer = offer[0] if isinstance(offer, list) and offer else offer
            spec = offer.get("priceSpecification") if isinstance(offer, dict) else None
            price = (offer.get("price") if isinstance(offer, dict) else None) or (spec or {}).get("price")
            yield path, name, None if price is None else str(price)
        else:
            here = (*path, name) if name else path
            for field in ("hasMenu", "hasMenuSection", "hasMenuItem"):
                yield from sections(node.get(field, []), here)


def context_slugs(names: list[str]) -> list[str]:
    """A slug of small letters for each menu of a page, all different: the context that its name tells,
    else the letters of its name, else `menu` with a letter for its place; a letter more where taken."""
    used: set[str] = set()
    out = []
    for i, name in enumerate(names):
        lower = (name or "").lower()
        base = next((slug for slug, words in CONTEXTS if any(w in lower for w in words.split())), None) or re.sub("[^a-z]", "", lower) or f"menu{chr(97 + i % 26)}"
        slug, n = base, 0
        while slug in used:
            n += 1
            slug = base + chr(97 + n % 26) * (1 + n // 26)
        used.add(slug)
        out.append(slug)
    return out


def jsonld_items(pages: DataFrame) -> DataFrame:
    """(page_id, context, path, item, price) of the menus in a page's JSON-LD; bad JSON is skipped. The
    context is the slug of the item's menu, the first part of its path."""

    def run(batches):
        for pdf in batches:
            out = []
            for page_id, page in zip(pdf["page_id"], pdf["html"], strict=True):
                rows = []
                for block in LD.findall(page or ""):
                    try:
                        rows += list(sections(json.loads(block)))
                    except (ValueError, RecursionError):
                        continue
                menus = list(dict.fromkeys(p[0] if p else "" for p, *_ in rows))
                slug = dict(zip(menus, context_slugs(menus), strict=True))
                out += [(page_id, slug[p[0] if p else ""], " / ".join(p), item, price) for p, item, price in rows]
            yield pd.DataFrame(out, columns=["page_id", "context", "path", "item", "price"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, context string, path string, item string, price string")


TEL = re.compile(r"""<a[^>]+href\s*=\s*["']tel:([^"']+)["'][^>]*>.*?</a>""", re.I | re.S)
ADDRESS = re.compile(r"<address[^>]*>.*?</address>", re.I | re.S)
BUSINESS = ("Restaurant", "FoodEstablishment", "LocalBusiness", "CafeOrCoffeeShop", "BarOrPub", "Bakery", "FastFoodRestaurant", "IceCreamShop")


def business(node: object) -> dict | None:
    """The first node of a JSON-LD document that is a business, at any depth of lists and graphs."""
    if isinstance(node, list):
        return next((found for n in node if (found := business(n))), None)
    if not isinstance(node, dict):
        return None
    kind = node.get("@type")
    return node if any(k in BUSINESS for k in (kind if isinstance(kind, list) else [kind])) else business(node.get("@graph", []))


def fields_of(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(field, value, method, fragment): what JSON-LD says of the business, then what only a tel: link
    or an address element does."""
    found: dict[str, tuple[str, str, str]] = {}
    for m in LD.finditer(page):
        try:
            node = business(json.loads(m[1]))
        except (ValueError, RecursionError):
            continue
        if node is None:
            continue
        kind, place = node.get("@type"), node.get("address")
        if isinstance(place, dict):
            parts = [str(place.get(k) or "").strip() for k in ("streetAddress", "postalCode", "addressLocality")]
            place = ", ".join(x for x in (parts[0], " ".join(p for p in parts[1:] if p)) if x)
        values = {"name": node.get("name"), "category": kind[0] if isinstance(kind, list) else kind, "address": place, "phone": node.get("telephone"), "website": node.get("url")}
        found = {k: (v.strip(), "json_ld", m[0]) for k, v in values.items() if isinstance(v, str) and v.strip()}
        break
    for name, m, value in (("phone", (t := TEL.search(page)), t and t[1].strip()), ("address", (a := ADDRESS.search(page)), a and strip_tags(a[0]))):
        if m and value and name not in found:
            found[name] = (value, "html", m[0])
    for name, rest in found.items():
        yield name, *rest


def restaurant_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, value, method, fragment): a page's facts about its restaurant, with the piece of
    the page that says so. A field that nothing says is missing."""

    def run(batches):
        for pdf in batches:
            out = [(page_id, *row) for page_id, page in zip(pdf["page_id"], pdf["html"], strict=True) for row in fields_of(page or "")]
            yield pd.DataFrame(out, columns=["page_id", "field", "value", "method", "fragment"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, field string, value string, method string, fragment string")


# Words that name a menu, and ones of links that never are a card.
MENU_WORDS = frozenset("menu menus menukaart menukaarten kaart kaarten gerechten eten lunch lunchkaart diner dinerkaart borrel borrelkaart dranken drankenkaart spijskaart carte dishes food".split())
OTHER_LINKS = re.compile(r"cadeaukaart|cadeaubon|geschenk|gift\s?card|voucher|tegoedbon|\b(?:blogs?|nieuws|news|artikel|articles?|events?|vacatures?|privacy|contact)\b", re.I)
ANCHOR = re.compile(r"""<a\b[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a>""", re.I | re.S)


def link_score(text: str, path: str) -> int:
    """0 if a link surely or likely isn't a card; else 2 for its own words, 1 for its path, 1 for a pdf."""
    if OTHER_LINKS.search(text) or OTHER_LINKS.search(path):
        return 0
    holds = [bool(MENU_WORDS & set(plain_words(x).split())) for x in (text, path)]
    return 2 * holds[0] + holds[1] + bool(re.search(r"\.pdf$", path, re.I)) if any(holds) else 0


def menu_links(pages: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, pos, link, matched_on): the links of a page to its own host that may lead to a menu, best
    first, ties in page order; one for each address, never the page itself."""

    def key(url: str) -> tuple[str, str, str]:
        u = urlsplit(url)
        return re.sub(r"^www\.", "", (u.hostname or "").lower()), u.path.rstrip("/") or "/", u.query

    def run(batches):
        for pdf in batches:
            out = []
            for page_id, base, page in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                found = []
                try:
                    seen = {key(base or "")}
                    host = key(base or "")[0]
                except ValueError:
                    continue
                for n, m in enumerate(ANCHOR.finditer(page or "")):
                    try:
                        url = urljoin(base, html.unescape(m[1] or m[2] or m[3] or "").strip())
                        own = key(url)
                    except ValueError:
                        continue
                    text = strip_tags(m[4])
                    score = link_score(text, urlsplit(url).path)
                    if host and own[0] == host and urlsplit(url).scheme in ("http", "https") and own not in seen and score:
                        seen.add(own)
                        found.append((-score, n, url.split("#")[0], text or urlsplit(url).path))
                out += [(page_id, pos, url, text) for pos, (_, _, url, text) in enumerate(sorted(found)[:most], 1)]
            yield pd.DataFrame(out, columns=["page_id", "pos", "link", "matched_on"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, pos long, link string, matched_on string")


def token_reasons(docs: DataFrame) -> DataFrame:
    """How many number tokens were refused, by reason; `price` counts those that weren't."""

    def run(batches):
        for pdf in batches:
            seen = Counter(t.reason or "price" for text in pdf["text"] for line in (text or "").splitlines() for t in number_tokens(line))
            yield pd.DataFrame(list(seen.items()), columns=["reason", "n"])

    return docs.select("text").mapInPandas(run, "reason string, n long").groupBy("reason").agg(F.sum("n").alias("n"))


def text_windows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = [(d, at, part) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for at, part in windows(t or "")]
            yield pd.DataFrame(out, columns=["doc_id", "offset", "part"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, offset long, part string")
