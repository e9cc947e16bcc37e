"""Keys of names, quotes and offers: what counts as the same text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Typographic characters that a quote may print in place of the plain one.
TYPOGRAPHIC = {"‘": "'", "’": "'", "‚": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "–": "-", "—": "-", " ": " "}
PLAIN = str.maketrans(TYPOGRAPHIC)
#: Prefix of an offer's key, and its longest length and that of the restaurant's id in it.
OFFER, OFFER_LENGTH, OWNER_LENGTH = "daghap", 96, 64


def plain_words(text: str | None, ampersand: str = " en ") -> str:
    """Lower case without accents (by compatible decomposition); what is no ASCII letter or digit is a
    space, and & the word that is given for it. Null is empty."""
    decomposed = unicodedata.normalize("NFKD", text or "")
    bare = re.sub("[\u0300-\u036f]", "", decomposed).replace("&", ampersand)
    return " ".join(re.findall("[a-z0-9]+", bare.lower()))


def composed(text: str | None) -> str:
    """Lower case of the compatible composed form, white space as one space."""
    return " ".join(unicodedata.normalize("NFKC", text or "").lower().split())


def evidence(text: str | None) -> str:
    """A quote or a source as they are compared: typographic characters as plain ones, white space as
    one space, lower case."""
    text = text or ""
    return " ".join((text if text.isascii() else text.translate(PLAIN)).split()).lower()


def _column(fn):
    """fn over a column, a batch at a time; null stays null."""

    @F.pandas_udf(StringType())  # a type by name would need a session when this is imported
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))

    return run


def without_accents(text: str | None) -> str:
    """Lower case without accents, white space as one space; other signs stay."""
    decomposed = unicodedata.normalize("NFD", (text or "").lower())
    return " ".join(re.sub("[\u0300-\u036f]", "", decomposed).split())


bare_letters = _column(without_accents)
name_key = _column(plain_words)
menu_key = _column(lambda v: plain_words(v, " "))
composed_key = _column(composed)


def evidence_key(text: Column) -> Column:
    """`evidence` as built-in functions."""
    plain = F.translate(text, "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()))
    return F.lower(F.trim(F.regexp_replace(plain, r"[\s ]+", " ")))


def offer_key(key: Column) -> Column:
    """struct(restaurant_id, offer_id) of `daghap-<restaurant>-<number>`, or null. The restaurant's id
    may hold hyphens."""
    trimmed = F.trim(key)
    owner = F.regexp_extract(trimmed, rf"^{OFFER}-(.+)-([1-9][0-9]*)$", 1)
    number = F.regexp_extract(trimmed, rf"^{OFFER}-(.+)-([1-9][0-9]*)$", 2)
    fits = (F.length(trimmed) <= OFFER_LENGTH) & (F.length(owner) > 0) & (F.length(owner) <= OWNER_LENGTH)
    return F.when(fits, F.struct(owner.alias("restaurant_id"), number.try_cast("long").alias("offer_id")))
