"""Checks of what people write: texts, phones, addresses of pages, kinds of cooking."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from menulake.functions.keys import bare_letters, menu_key, name_key

#: Emoji that a text may have.
MOST_EMOJI = 3
# Patterns of what a text mustn't hold.
URL = r"(?i)\b(?:https?://|www\.)\S+|\b[a-z0-9-]+\.(?:nl|com|be|de|eu|net|org)\b"
MAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"(?:\+\d{1,3}[\s-]?|0)(?:\d[\s-]?){8,}\d?"
MARKS = r"([!?.,;:])\1\1+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]\x{FE0F}?(?:\x{200D}[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]\x{FE0F}?)*"
# Paths that hint at a menu, and kinds of cooking by the words that name them, in order.
MENU_PATH = r"(?i)(?:^|/)(?:menukaart|menu|menus|kaart|kaarten|gerechten|spijskaart|lunch|diner|carte)(?:/|$|[-_.])"
FAMILIES = (
    ("Biercafé", "biercafé biercafe bierbar bier"), ("Italiaans", "italiaans italian pizza pasta"), ("Grill", "grill steak steakhouse"), ("Mediterraans", "mediterraans mediterraan mediterranean"),
    ("Indonesisch", "indonesisch indonesian moluks"), ("Chinees", "chinees chinese kantonees"), ("Frans", "frans franse french brasserie"), ("Indiaas", "indiaas indian curry"),
    ("Midden-Oosters", "midden-oosters midden-oosten middle-eastern noord-afrikaans halal"), ("Nederlands", "nederlands hollands grand_café grand_cafe"), ("Modern Europees", "modern_europees scandinavisch seizoensgebonden"), ("Fusion", "fusion oosterse"),
)

# An icon for a dish by what its name or category holds, the first that fits.
ICONS = (
    ("🍲", "soep|bouillon|bisque"), ("🍝", "pasta|spaghetti|penne|lasagne|tagliatelle|risotto"), ("🍕", "pizza"), ("🍖", "burger|biefstuk|steak|entrecote|tartaar|spare ?ribs|lams|kalf|varken|kip|eend"),
    ("🐟", "vis|zalm|tonijn|garnalen|kabeljauw|mossel|homard|kreeft|sushi"), ("🥗", "salade|groente|vega"), ("🍰", "taart|gebak|dessert|ijs|chocolade|tiramisu|panna"), ("🥪", "brood|sandwich|toast|bagel"), ("🧀", "kaas"),
)
NO_ICON = "🍽️"


def text_problems(text: Column) -> Column:
    """What is wrong with a text, in a fixed order: a link, an e-mail address, a phone number, nothing
    but capitals (of two letters or more), a mark three times in a row, too many emoji. Null is fine."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    checks = {
        "url": text.rlike(URL), "email": text.rlike(MAIL), "phone": text.rlike(PHONE), "capitals": (F.length(letters) >= 2) & (letters == F.upper(letters)),
        "marks": text.rlike(MARKS), "emoji": F.size(F.regexp_extract_all(text, F.lit(EMOJI), F.lit(0))) > MOST_EMOJI,
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def word_reasons(text: Column, groups: dict[str, list[str]]) -> Column:
    """`group:word` for each word of the groups that stands in a text by itself, accents aside, and
    `reclame:%` for a percent sign; in the order of the groups."""
    plain = bare_letters(text)
    found = [F.when(plain.rlike(rf"(?:^|[^\p{{L}}\p{{N}}]){re.escape(w)}(?:[^\p{{L}}\p{{N}}]|$)"), F.lit(f"{g}:{w}")) for g, words in groups.items() for w in words]
    return F.filter(F.array(*found, F.when(F.contains(plain, F.lit("%")), F.lit("reclame:%"))), lambda x: x.isNotNull())


def phone(text: Column) -> Column:
    """struct(normalized, display, valid) of a Dutch number: +31 and nine digits; shown as 06 and the
    rest, or 0 and the nine digits. What isn't one stays as it is, and invalid."""
    trimmed = F.trim(text)
    nine = F.regexp_extract(F.regexp_replace(trimmed, r"[\s\-().]", ""), r"^(?:\+31|0031|0)([0-9]{9})$", 1)
    valid = F.length(nine) == 9
    shown = F.when(F.startswith(nine, F.lit("6")), F.concat(F.lit("06 "), F.substring(nine, 2, 8))).otherwise(F.concat(F.lit("0"), nine))
    return F.struct(F.when(valid, F.concat(F.lit("+31"), nine)).otherwise(trimmed).alias("normalized"), F.when(valid, shown).otherwise(trimmed).alias("display"), F.coalesce(valid, F.lit(False)).alias("valid"))


def canonical_url(url: Column) -> Column:
    """struct(url, host): scheme and host in lower case, port and path, without query and fragment; null
    for what isn't an http address."""
    text = F.trim(url)
    pattern = r"(?i)^(https?)://(?:[^/?#@\s]*@)?([^/?#:\s]+)(:\d+)?([^?#\s]*)"
    part = lambda n: F.regexp_extract(text, pattern, n)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    port = F.when((scheme == "http") & (part(3) == ":80") | (scheme == "https") & (part(3) == ":443"), "").otherwise(part(3))
    path = F.when(part(4) == "", "/").otherwise(part(4))
    return F.when(F.length(host) > 0, F.struct(F.concat(scheme, F.lit("://"), host, port, path).alias("url"), host.alias("host")))


def menu_hint(path: Column) -> Column:
    return F.coalesce(path.rlike(MENU_PATH), F.lit(False))


def cuisine_family(cuisine: Column) -> Column:
    """The family of a kind of cooking: of the first of its parts (between ·) that names one, the first
    family in order; else the first part as it stands, or Onbekend."""
    parts = F.filter(F.transform(F.split(F.coalesce(cuisine, F.lit("")), "·"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)

    def family(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(FAMILIES):
            found = F.lower(part).rlike("|".join(re.escape(w.replace("_", " ")) for w in words.split()))
            out = F.when(found, F.lit(name)).otherwise(out)
        return out

    known = F.filter(F.transform(parts, family), lambda f: f.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.get(parts, F.lit(0)), F.lit("Onbekend"))


def dish_key(name: Column) -> Column:
    return menu_key(name)


def dish_icon(name: Column, category: Column) -> Column:
    """The icon of the first rule that fits the name and category together; a plate otherwise."""
    text = F.lower(F.concat_ws(" ", name, category))
    out = F.lit(NO_ICON)
    for icon, pattern in reversed(ICONS):
        out = F.when(text.rlike(pattern), F.lit(icon)).otherwise(out)
    return out


def likely_same_name(a: Column, b: Column) -> Column:
    """Whether the keys of two names are equal or one holds the other; null where either is empty."""
    x, y = name_key(a), name_key(b)
    empty = (F.coalesce(F.length(x), F.lit(0)) == 0) | (F.coalesce(F.length(y), F.lit(0)) == 0)
    return F.when(~empty, F.contains(x, y) | F.contains(y, x))


def price_label(price: Column, on_request: Column, value: Column, notes: Column, from_: Column) -> Column:
    """A price as its source names it, with the notes that it doesn't hold already, each once whatever
    its case, and `vanaf` in front where it is the lowest. Null without one sure price."""
    known = F.filter(F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: F.length(n) > 0)
    label = F.aggregate(known, F.trim(price), lambda text, n: F.when(F.contains(F.lower(text), F.lower(n)), text).otherwise(F.concat(text, F.lit(" · "), n)))
    shown = F.when(from_ & ~label.rlike(r"(?i)^vanaf\b"), F.concat(F.lit("vanaf "), label)).otherwise(label)
    return F.when((F.length(F.trim(price)) > 0) & ~F.coalesce(on_request, F.lit(False)) & value.isNotNull(), shown)


def field_confidence(has_hash: Column, status: Column, plausible: Column) -> Column:
    """hoog, middel or laag: only a field that was compared with another sighting, agrees with it and is
    plausible is high; a conflict is low. An unknown status is an error."""
    known = F.when(status.isin("conflict", "unverified", "consistent"), status).otherwise(F.raise_error(F.concat(F.lit("unknown context status: "), F.coalesce(status, F.lit("null")))).cast("string"))
    return F.when(~has_hash & known.isNotNull(), "middel").when(known == "conflict", "laag").when((known == "consistent") & F.coalesce(plausible, F.lit(False)), "hoog").otherwise("middel")


@F.pandas_udf(StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link's address as seen from its page; null if it can't be read, or isn't an http one."""

    def one(b, h):
        try:
            whole = urljoin(b or "", h.strip())
            return whole if urlsplit(whole).scheme in ("http", "https") and urlsplit(whole).hostname else None
        except (ValueError, AttributeError):
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])
