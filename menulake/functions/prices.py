"""Printed prices in a line of text: what is read, and why a number is refused."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

# Units and counting words after a number, words before a number that isn't a price,
# month names, and words of clock times.
UNITS = "gram|grams|gr|g|kg|kilo|cl|ml|dl|l|ltr|liter|liters|litre|litres|mg|oz|lb"
COUNTED = "st|stk|stuks|personen|persoon|pers|pp|gangen|gang|x|×|uur|u|h|hr|min|minuut|minuten|jaar|maanden|mnd|weken|dagen|keer|kazen|glazen|glas|flessen|fles|gerechten|borden|kopjes|bolletjes|sneetjes|plakjes"
NUMBERED = "nummer|nr|nrs|punt|stap|etage|verdieping|keuze|optie|plek|plaats|tafel|kamer|pagina"
VERSIONS = "versie|version|editie|edition|vers|build|release"
MONTHS = "januari|februari|maart|april|mei|juni|juli|augustus|september|oktober|november|december|january|february|march|june|july|august|october|jan|feb|mrt|apr|jun|jul|aug|sep|sept|okt|oct|nov|dec"
HOURS = "vanaf|tot|om|tussen|van|from|until|till|at|aanvang|geopend|open|gesloten|sluit|sluiting|openingstijden"
PHONES = "tel|telefoon|mobiel|gsm|fax"

NUMBER = r"(?<![\d.,])(\d{1,3})"
ENDS = r"(?![\d.,]*\d)(?!\s*%)"
#: Kinds in the order in which they take their places: with a currency sign, two decimals, ",-", one
#: decimal after a point, and whole euros.
KINDS = (
    ("money", re.compile(rf"€\s*{NUMBER}(?:[.,](\d{{2}})|,[-–])?{ENDS}")),
    ("money", re.compile(rf"{NUMBER}(?:[.,](\d{{2}})|,[-–]){ENDS}")),
    ("point", re.compile(rf"{NUMBER}\.(\d){ENDS}")),
    ("whole", re.compile(rf"(?<![\d.,€])(\d{{1,3}})(?![\d.,:]*\d)(?!\s*%)")),
)
CLOCK = r"(?:[01]?\d|2[0-4])[.:][0-5]\d"
#: A range of hours ends in quarters, so that two prices aren't one.
QUARTER = r"(?:[01]?\d|2[0-4])[.:](?:00|15|30|45)"
TIME = re.compile(rf"(?:\b(?:{HOURS})\s+(?:ca\.?\s*)?)?\b{QUARTER}\s*(?:-|–|tot|t/m|to|until)\s*{QUARTER}\b|\b(?:{HOURS})\s+(?:ca\.?\s*)?{CLOCK}(?![\d.,]*\d)|\b{CLOCK}\s*(?:uur|u|h|hrs?|am|pm)\b", re.I)
DATE = re.compile(rf"\b(?:[0-2]?\d|3[01])\s*(?:{MONTHS})\b|\b(?:{MONTHS})\s+(?:[0-2]?\d|3[01])\b|\bop\s+(?:0?[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])(?![\d.,]*\d)", re.I)
CELL = re.compile(r"\t|  |\s*[|·•]|\s*$")
#: The usual line: its only number ends it and has cents after a comma, which nothing refuses.
USUAL = re.compile(r"[^\d€]*(?<![.,])(\d{1,3}),(\d{2})\s*")
LETTER, DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")


class Token(NamedTuple):
    start: int
    end: int
    cents: int
    kind: str
    reason: str | None = None


def _after(pattern: str) -> Callable[[str, Token], bool]:
    compiled = re.compile(pattern, re.I)
    return lambda line, t: compiled.match(line[t.end : t.end + 16]) is not None


def _before(pattern: str) -> Callable[[str, Token], bool]:
    compiled = re.compile(rf"(?:{pattern})$", re.I)
    return lambda line, t: compiled.search(line[max(0, t.start - 24) : t.start]) is not None


def _within(pattern: re.Pattern) -> Callable[[str, Token], bool]:
    """Whether the token lies in a match."""
    return lambda line, t: any(m.start() < t.end and t.start < m.end() for m in pattern.finditer(line))


def _cell(line: str, t: Token) -> tuple[bool, bool]:
    """Whether a printed cell begins before the token, and ends after it."""
    head = line[: t.start]
    return head == "" or head.endswith(("\t", "  ")) or head.rstrip().endswith(("|", "·", "•")), CELL.match(line, t.end) is not None


def _no_name(line: str, t: Token) -> bool:
    return len(LETTER.findall(line[max(0, t.start - 240) : t.start])) < 2


#: Reasons in the order in which they are looked at, the kinds they hold for, and when they do.
REFUSALS: tuple[tuple[str, str, Callable[[str, Token], bool]], ...] = (
    ("leading_zero", "point whole", lambda line, t: line[t.start] == "0"),
    ("glued", "point whole", lambda line, t: t.start > 0 and line[t.start - 1].isalnum()),
    ("ordinal", "point whole", _after(r"\s?e(?![a-zé])")),
    ("unit", "point whole", _after(rf"\s?(?:%|(?:{UNITS}|{COUNTED})(?!\w))")),
    ("unit", "point", _after(r"\s*(?:p\.?\s?p\.?|per\s+(?:persoon|person|personen))(?!\w)")),
    ("unit", "money", lambda line, t: line[t.start] != "€" and _after(rf"\s?(?:{UNITS})(?!\w)")(line, t) and not any(x.end <= t.start for x in _found(line) if x.kind == "money")),
    ("glued", "point whole", lambda line, t: line[t.end : t.end + 1].isalpha()),
    ("counting_word", "point whole", _before(rf"\b(?:{NUMBERED})\s*[.:]?\s*")),
    ("version", "point", _before(rf"\b(?:{VERSIONS})\s*[.:]?\s*")),
    ("time", "point", _before(rf"\b(?:{HOURS})\s+(?:ca\.?\s*)?")),
    ("price_range", "point", _before(r"(?:-|–|tot|t/m)\s*")),
    ("date", "point whole", _within(DATE)),
    ("time", "money point whole", lambda line, t: line[t.start] != "€" and "," not in line[t.start : t.end] and _within(TIME)(line, t)),
    ("phone", "point whole", _before(rf"\b(?:{PHONES})\b[^a-z]*")),
    ("no_boundary", "point", lambda line, t: not _cell(line, t)[1]),
    ("no_boundary", "whole", lambda line, t: not any(_cell(line, t))),
    ("no_name", "point whole", _no_name),
)


def _found(line: str) -> list[Token]:
    """All number tokens, none overlapping another, in order."""
    found: list[Token] = []
    if not DIGIT.search(line):
        return found
    for kind, pattern in KINDS:
        for m in pattern.finditer(line):
            if all(m.end() <= t.start or t.end <= m.start() for t in found):
                part = m[2] if m.lastindex and m.lastindex > 1 else ""
                found.append(Token(m.start(), m.end(), int(m[1]) * 100 + int((part or "0").ljust(2, "0")), kind))
    return sorted(found, key=lambda t: t.start)


def number_tokens(line: str) -> list[Token]:
    """Each number of a line that could be a price, with the reason why it isn't one."""
    return [Token(t.start, t.end, t.cents, t.kind, next((r for r, kinds, holds in REFUSALS if t.kind in kinds.split() and holds(line, t)), None)) for t in _found(line)]


def prices(line: str) -> list[Token]:
    """The printed prices of a line, in order."""
    if m := USUAL.fullmatch(line):
        return [Token(m.start(1), m.end(2), int(m[1]) * 100 + int(m[2]), "money")]
    return [t for t in number_tokens(line) if t.reason is None]


def cents_of(text: str | None) -> int | None:
    """A typed price ("12,50", "€ 12.5", "12") in cents; None if it isn't exactly one."""
    plain = re.sub(r"[€\s]", "", text or "").replace(",", ".", 1)
    m = re.fullmatch(r"(\d{1,5})(?:\.(\d{1,2}))?", plain)
    return int(m[1]) * 100 + int((m[2] or "0").ljust(2, "0")) if m else None
