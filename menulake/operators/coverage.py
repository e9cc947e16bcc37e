"""Priced lines of captured sources, and what a menu's evidence says about each of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from menulake.functions.keys import evidence as evidence_key
from menulake.functions.prices import DIGIT, LETTER, Token, prices
from menulake.storage import TEXT_BYTES, fresh_path, saved

#: A longer line is a flattened one, of several printed rows; characters of a name and of a section's
#: name; lines above a price that may name it; uncovered lines that are listed.
LONG, NAME, SECTION, LOOK_BACK, LISTED = 400, 160, 80, 3, 200
#: Lines that a task gives at once.
AT_ONCE = 10_000
#: What stays of a line without its prices that isn't part of a name.
EDGES = " \t.,|·•*–—-"

LINE = "source_id long, line long, page long, segment long, name_line long, section string, name string, cents array<long>, text string, paired boolean, loose boolean, whole boolean"
ENDS = re.compile(r"(\r\n|\r|\n|\f)")
KINDS = dict(x.split() for x in LINE.split(", "))
LINES = list(KINDS)
ARROW = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[kind]) for name, kind in KINDS.items()])
LETTERS = re.compile(rf"{LETTER.pattern}[\W\d_]*{LETTER.pattern}")


def named(text: str) -> bool:
    """Whether a text has two letters or more."""
    return LETTERS.search(text) is not None


def printed_lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(number, page, line) of the lines that print anything, numbered with the empty ones from 1. A
    form feed ends a line and a page."""
    page, number = 1, 0
    for part in ENDS.split(text):
        if part == "\f":
            page += 1
        elif part not in ("\r\n", "\r", "\n"):
            number += 1
            if part.strip():
                yield number, page, part


def is_heading(line: str) -> bool:
    """A short line that reads as the name of a section: no price, no sentence, no address."""
    text = line.strip()
    short = 2 <= len(text) <= SECTION and named(text) and len(text.split()) <= 8
    return short and not re.search(r"[.,;:!?]$|\d\d|[@/\\]", text) and not text[0].islower() and not prices(line)


def without(line: str, found: list[Token]) -> str:
    """The line without its prices."""
    for t in reversed(found):
        line = f"{line[: t.start]} {line[t.end :]}"
    return line


def only_prices(line: str, found: list[Token]) -> bool:
    rest = without(line, found)
    return bool(found) and not named(rest) and not DIGIT.search(rest)


def cells(text: str) -> list[str]:
    """The printed cells of a line: what stands between two or more spaces, or tabs."""
    return [" ".join(c.split()) for c in re.split(r"\s{2,}|\t", text) if c.strip()]


def name_of(line: str, found: list[Token]) -> str | None:
    """The name a line prints beside its prices; of a whole amount, the cell just before it."""
    if len(found) == 1 and found[0].kind == "whole":
        before = cells(line[: found[0].start])
        if before and named(before[-1]):
            return before[-1][:NAME]
    name = " ".join(without(line, found).strip(EDGES).split())
    return name[:NAME] if named(name) else None


def fragments(line: str, section: str | None) -> Iterator[tuple[int, str, Token, str | None]]:
    """(segment, name, price, section) of a flattened line: the cell right before a price is its name,
    a cell before that which reads like a heading is the section from there on."""
    end = 0
    for n, t in enumerate(prices(line), 1):
        before, end = cells(line[end : t.start]), t.end
        section = next((c for c in reversed(before[:-1]) if is_heading(c)), section)
        if before and named(before[-1]):
            yield n, before[-1][:NAME], t, section


def priced_records(text: str) -> list[tuple]:
    """(line, page, segment, name_line, section, name, cents, text, paired, loose, whole) of each priced
    line of one source.

    A price alone on its line takes the nearest line above it, up to LOOK_BACK, if that is a text
    line no other price took; a heading or a priced line in between ends the search, and decorations
    are passed over. Whole amounts count only where their section prints them on two rows or more.
    """
    lines = [(number, page, raw, prices(raw)) for number, page, raw in printed_lines(text)]
    out: list[tuple] = []
    section: str | None = None
    above: list[tuple[str, int, str]] = []  # kind, number and text of the lines that may name a price
    for i, (number, page, raw, found) in enumerate(lines):
        plain = " ".join(raw.split())
        if len(plain) > LONG:
            for segment, name, t, section in fragments(raw, section):  # noqa: B020
                out.append((number, page, segment, None, section, name, [t.cents], f"{name} {raw[t.start : t.end]}", False, False, t.kind == "whole"))
            above = [("priced", number, "")]
            continue
        if not found:
            follows = lines[i + 1] if i + 1 < len(lines) else None
            names_next = follows is not None and len(follows[3]) == 1 and only_prices(follows[2], follows[3])
            if is_heading(raw) and not names_next:
                section, above = plain[:SECTION], [("heading", number, plain)]
            else:
                above.append(("text", number, plain))
            continue
        alone = only_prices(raw, found)
        partner = next((x for x in reversed(above[-LOOK_BACK:]) if x[0] != "text" or named(x[2])), None) if alone and len(found) == 1 else None
        cents, whole = [t.cents for t in found], all(t.kind == "whole" for t in found)
        if partner is not None and partner[0] == "text":
            name = partner[2][:NAME]
            out.append((number, page, 0, partner[1], section, name, cents, f"{partner[2]} {raw[found[0].start : found[0].end]}", True, False, whole))
        else:
            name = None if alone else name_of(raw, found)
            out.append((number, page, 0, None, section, name, cents, plain, False, name is None, whole))
        above.append(("priced", number, ""))
    rows: dict[tuple, set] = {}
    for r in out:
        if r[10]:
            rows.setdefault((r[4], r[1]), set()).add((r[3] or r[0], r[2]))
    return [r for r in out if not r[10] or len(rows[r[4], r[1]]) > 1]


def frames(rows: Iterator[tuple], at_once: int = AT_ONCE, schema: pa.Schema = ARROW) -> Iterator[pa.RecordBatch]:
    """The rows (LINE) as tables of a bounded size."""
    for part in batched(rows, at_once):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def priced_lines(sources: DataFrame, source_id: str = "source_id", text: str = "text") -> DataFrame:
    """The priced lines of each source (LINE), as a saved table. Null and empty texts have none. A source
    is read by one task; it is a single captured page or document. A task holds a few sources' texts and
    AT_ONCE of their lines, and not the many thousands that a usual batch of sources has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from frames((sid.as_py(), *r) for sid, t in zip(*batch.columns, strict=True) for r in priced_records(t.as_py() or ""))

    rows = sources.select(F.col(source_id).cast("long").alias("source_id"), F.col(text).alias("text")).mapInArrow(run, LINE)
    return saved(rows, "lines", TEXT_BYTES)


def holders(texts: list[str], parts: list[str]) -> Iterator[tuple[int, int]]:
    """(text, part) of all texts that hold a part, by numbers, as often as they do; empty ones hold nothing
    and are in nothing. None has a line break, as evidence hasn't. One automaton finds the parts in one
    pass over the texts."""
    import ahocorasick

    where: dict[str, list[int]] = {}
    for i, p in enumerate(parts):
        where.setdefault(p, []).append(i)
    where.pop("", None)
    if where:
        find = ahocorasick.Automaton()
        for p, own in where.items():
            find.add_word(p, own)
        find.make_automaton()
        n, last = -1, -1  # a text, and where it ends
        for at, own in find.iter("\n".join(texts)):
            while at > last:
                n += 1
                last += len(texts[n]) + 1
            for i in own:
                yield n, i


def overlaps(lines: list[str], passages: list[str]) -> list[list[int]]:
    """For each line the passages that it holds, or that hold it, in their order. A text that is shorter
    than all parts holds none, and a part that is longer than all texts is in none: most lines are longer
    than any passage, and are looked for in none."""
    out: list[set[int]] = [set() for _ in lines]
    for n, i in holders(lines, passages):
        out[n].add(i)
    least, most = min(map(len, filter(None, lines)), default=0), max(map(len, passages), default=0)
    long = [i for i, p in enumerate(passages) if p and len(p) >= least]
    short = [n for n, x in enumerate(lines) if x and len(x) <= most]
    if long and short:
        for i, n in holders([passages[i] for i in long], [lines[n] for n in short]):
            out[short[n]].add(long[i])
    return [sorted(x) for x in out]


def strings(column: pa.ChunkedArray) -> list[str | None]:
    return column.to_numpy().tolist()


def amounts(column: pa.ChunkedArray) -> list[list[int]]:
    """The lists of a column, null ones as empty; a whole column at once, as a value at a time is slow."""
    a = column.combine_chunks()
    if a.values.null_count:
        return [x or [] for x in a.to_pylist()]
    values, ends, there = a.values.to_numpy().tolist(), a.offsets.to_numpy().tolist(), a.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [values[i:j] if ok else [] for i, j, ok in zip(ends, ends[1:], there, strict=False)]


def known(rows: Iterator[tuple]) -> list[tuple]:
    """(kind, row_id, text, amounts, line) of the passages that have any text, as they are compared."""
    return [(kind, row, text, cents, at) for kind, row, passage, cents, at in rows if (text := evidence_key(passage))]


def decided(lines: list[tuple[str | None, int | None, list[int]]], passages: list[tuple]) -> list[tuple[str, str | None]]:
    """(tone, row_id) of each line, a text with its number and prices, by the passages (`known`) that hold
    for its source."""
    passages = sorted(passages, key=lambda p: (p[0] != "dish", p[1] or "", p[2])) if lines else []
    out: list[tuple[str, str | None]] = []
    for over, (_, line, cents) in zip(overlaps([evidence_key(x[0]) for x in lines], [p[2] for p in passages]), lines, strict=True):
        first = passages[over[0]] if over else None  # dishes come before other passages
        if first is not None and first[0] == "dish":
            same = not first[3] or not set(first[3]).isdisjoint(cents)
            out.append(("covered" if same else "price_mismatch", first[1]))
        elif any(passages[i][0] == "rejected" or passages[i][0] == "accounted" and passages[i][4] in (None, line) for i in over):
            out.append(("not_dish", None))
        else:
            out.append(("uncovered", None))
    return out


def tones(lines: DataFrame, evidence: DataFrame, accounted: DataFrame) -> DataFrame:
    """lines with tone and row_id: covered (a dish's quote overlaps the line at the same price),
    price_mismatch (at another price), not_dish (a rejected passage, or one a human accounted for), or
    uncovered.

    lines: source_id, line, text, cents, and what else is to stay: all of it goes through the tasks, so
    callers select what they need. evidence: source_id (null: any source), kind ('dish' or 'rejected'),
    row_id, quote, amounts. accounted: source_id (null: any), line (null: any), text. Two texts overlap
    if one contains the other, compared as evidence. Lines meet the evidence of their source; what holds
    for any source is a file in the shared folder, which tasks read.
    """
    none = F.lit(None)
    rows = evidence.select("source_id", "kind", "row_id", F.col("quote").alias("passage"), F.col("amounts").cast("array<long>").alias("amounts"), none.cast("long").alias("at")).unionByName(
        accounted.select("source_id", F.lit("accounted").alias("kind"), none.cast("string").alias("row_id"), F.col("text").alias("passage"), none.cast("array<long>").alias("amounts"), F.col("line").cast("long").alias("at"))
    )
    path = fresh_path(lines.sparkSession, "evidence")
    rows.where("source_id is null").drop("source_id").write.parquet(path)
    schema = StructType([*lines.schema.fields, StructField("tone", StringType()), StructField("row_id", StringType())])
    anywhere: list[list[tuple]] = []  # read once in each task

    def passages_of(rows: pa.Table) -> list[tuple]:
        at = rows.column("at")
        numbers = at.to_pylist() if at.null_count < len(at) else [None] * len(at)
        return known(zip(*(strings(rows.column(c)) for c in ("kind", "row_id", "passage")), amounts(rows.column("amounts")), numbers, strict=True))

    def decide(a: pa.Table, b: pa.Table) -> pa.Table:
        if not anywhere:
            store, root = fs.FileSystem.from_uri(path)
            anywhere.append(passages_of(ds.dataset(root, filesystem=store, format="parquet").to_table()))
        lines = list(zip(strings(a.column("text")), a.column("line").to_pylist(), amounts(a.column("cents")), strict=True))
        out = decided(lines, passages_of(b) + anywhere[0])
        return a.append_column("tone", pa.array([t for t, _ in out], pa.string())).append_column("row_id", pa.array([r for _, r in out], pa.string()))

    placed = rows.where("source_id is not null")
    return lines.groupBy("source_id").cogroup(placed.groupBy("source_id")).applyInArrow(decide, schema)


def lists(column: pa.ListArray) -> list[list[tuple]]:
    """The lists of structs of a column as tuples, null ones as empty; a whole column at once, as in `amounts`."""

    def values(a: pa.Array) -> list:
        if a.null_count == len(a):
            return [None] * len(a)
        return amounts(pa.chunked_array([a])) if pa.types.is_list(a.type) else strings(pa.chunked_array([a])) if pa.types.is_string(a.type) else a.to_pylist()

    ends, there = column.offsets.to_numpy().tolist(), column.is_valid().to_numpy(zero_copy_only=False).tolist()
    rows = list(zip(*map(values, column.values.slice(0, ends[-1]).flatten()), strict=True))
    return [rows[i:j] if ok else [] for i, j, ok in zip(ends, ends[1:], there, strict=False)]


def card_rows(cards: DataFrame) -> DataFrame:
    """The columns of cards (`card_tones`) as tasks read them."""
    return cards.select(
        F.col("source_id").cast("long").alias("source_id"),
        "text",
        F.col("evidence").cast("array<struct<kind:string,row_id:string,quote:string,amounts:array<long>>>").alias("evidence"),
        F.col("accounted").cast("array<struct<line:long,text:string>>").alias("accounted"),
    )


def decided_cards(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[tuple], list[tuple[str, str | None]]]]:
    """(source, its priced lines, tone and row_id of each of them) of some `card_rows`."""
    for source, text, evidence, accounted in zip(batch.column(0).to_pylist(), batch.column(1), lists(batch.column(2)), lists(batch.column(3)), strict=True):
        rows = priced_records(text.as_py() or "")
        passages = known((*e, None) for e in evidence) + known(("accounted", None, passage, [], at) for at, passage in accounted)
        yield source, rows, decided([(r[7], r[0], r[6]) for r in rows], passages)


def card_tones(cards: DataFrame, *columns: str, only: str | None = None) -> DataFrame:
    """The columns (of LINE) that are asked for of each source's priced lines, with tone and row_id as in
    `tones`, as a saved table. only: lines of this tone; all are decided on, but the others leave no task.

    cards: source_id, text, evidence (an array of kind, row_id, quote, amounts) and accounted (one of line,
    text), a row for each source with all that holds for it. A source's lines are read and decided on in
    one task at once, so neither lines nor evidence are stored, dealt out or sorted; a task holds TEXT_BYTES
    of sources and AT_ONCE of their lines.
    """
    names = LINES[1:]
    places, with_source = [names.index(c) for c in columns if c != "source_id"], "source_id" in columns
    asked = [*(["source_id"] if with_source else []), *(c for c in columns if c != "source_id")]
    schema = pa.schema([*(ARROW.field(c) for c in asked), ("tone", pa.string()), ("row_id", pa.string())])

    def toned(batch: pa.RecordBatch) -> Iterator[tuple]:
        for source, rows, own in decided_cards(batch):
            head = (source,) if with_source else ()
            for r, tone in zip(rows, own, strict=True):
                if only in (None, tone[0]):
                    yield (*head, *[r[i] for i in places], *tone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from frames(toned(batch), schema=schema)

    return saved(card_rows(cards).mapInArrow(run, f"{', '.join(f'{c} {KINDS[c]}' for c in asked)}, tone string, row_id string"), "tones", TEXT_BYTES)


def card_counts(cards: DataFrame) -> DataFrame:
    """source_id, lines and uncovered of each source of the cards (as in `card_tones`) that has lines, as a
    saved table: a task counts a source's lines as it decides on them, and no line leaves it."""
    schema = pa.schema([ARROW.field("source_id"), ("lines", pa.int64()), ("uncovered", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from frames(((source, len(own), sum(t == "uncovered" for t, _ in own)) for source, _, own in decided_cards(batch) if own), schema=schema)

    return saved(card_rows(cards).mapInArrow(run, "source_id long, lines long, uncovered long"), "tones", TEXT_BYTES)


def uncovered(toned: DataFrame, limit: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` uncovered lines, in order of source and line; one row with available, total,
    shown and omitted). Without any line at all nothing is available, which isn't the same as none
    uncovered."""
    open_ = toned.where("tone = 'uncovered'")
    listed = open_.orderBy("source_id", "line", "segment").limit(limit)
    return listed, summary(toned.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("tone") == "uncovered").alias("uncovered")), limit)


def summary(counts: DataFrame, limit: int = LISTED) -> DataFrame:
    """One row with available, total, shown and omitted, of counts (lines, uncovered) of any sources."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = counts.agg((total("lines") > 0).alias("available"), total("uncovered").alias("total"))
    return sums.select("available", "total", F.least("total", F.lit(limit)).alias("shown"), F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"))


def diagnosis(toned: DataFrame) -> DataFrame:
    """Per source: its priced lines by tone, those paired with a name above, and loose ones."""
    tone = lambda t: F.count_if(F.col("tone") == t).alias(t)
    return toned.groupBy("source_id").agg(F.count(F.lit(1)).alias("lines"), *map(tone, ("covered", "price_mismatch", "not_dish", "uncovered")), F.count_if("paired").alias("paired"), F.count_if("loose").alias("loose"))


def layout_lines(items: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(page, y, text, runs) of positioned text: runs (page, x, y, seq, str) whose heights round to the
    same multiple of the tolerance are a line, from left to right, as drawn where they begin at one
    place. Lines come from the top, the largest height first."""
    bucket = (F.floor(F.col("y") / tolerance + 0.5) * tolerance).alias("y")
    lines = items.where("str is not null").groupBy("page", bucket).agg(F.sort_array(F.collect_list(F.struct("x", "seq", "str"))).alias("run"))
    return lines.select("page", "y", F.array_join(F.col("run.str"), " ").alias("text"), F.size("run").cast("long").alias("runs"))
