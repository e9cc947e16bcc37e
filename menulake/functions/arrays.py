"""Arrays as values: paths of headings, ordered sets, courses, and what names have in common."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Courses in their order, and what may stand between a shared opening and the rest.
COURSES = ("voor", "hoofd", "na")
SEPARATORS = (" — ", " - ", ": ")


def starts_with(longer: Column, shorter: Column) -> Column:
    """Whether an array of labels begins with another one and goes on."""
    return (F.size(longer) > F.size(shorter)) & (F.slice(longer, 1, F.greatest(F.size(shorter), F.lit(0))) == shorter)


def path_reason(expected: Column, actual: Column) -> Column:
    """Why two paths of headings, given as comparable labels, differ: the menu's title, a level more or
    less, or otherwise; null if they don't."""
    rest = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    level = starts_with(expected, actual) | starts_with(actual, expected) | (F.try_element_at(expected, F.lit(-1)) == F.try_element_at(actual, F.lit(-1)))
    title = (F.size(expected) == F.size(actual)) & (F.size(expected) > 0) & (rest(expected) == rest(actual))
    return F.when(expected == actual, None).when(title, "menu_title").when((F.size(expected) != F.size(actual)) & F.coalesce(level, F.lit(False)), "extra_level").otherwise("other")


def ordered_set(values: Column, limit: int | None = None) -> Column:
    """Values in their order, each once, the first `limit` of them; nulls are left out."""
    once = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    return F.slice(once, 1, limit) if limit else once


def toggled(values: Column, value: Column, limit: int | None = None) -> Column:
    """values without the value if they hold it, else with it at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(ordered_set(F.concat(values, F.array(value)), limit))


def added(values: Column, more: Column, limit: int | None = None) -> Column:
    """struct(entries, added): the ordered union of two arrays up to a limit, and how many are new."""
    union = ordered_set(F.concat(F.coalesce(values, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>"))), limit)
    return F.struct(union.alias("entries"), (F.size(union) - F.size(ordered_set(values, limit))).alias("added"))


def courses(given: Column) -> Column:
    """An array of struct(gang, naam) in the fixed order of courses: the last name given for each;
    courses without a name and unknown ones are left out."""
    named = F.filter(given, lambda c: F.length(F.trim(c["naam"])) > 0)
    of = lambda course: F.try_element_at(F.filter(named, lambda c: c["gang"] == course), F.lit(-1))
    return F.filter(F.array(*[F.when(of(F.lit(c)).isNotNull(), F.struct(F.lit(c).alias("gang"), F.trim(of(F.lit(c))["naam"]).alias("naam"))) for c in COURSES]), lambda c: c.isNotNull())


def openings(name: Column) -> Column:
    """All openings of a name, each up to and with a separator after which something follows; a null
    name has none."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))

    def of(separator: str) -> Column:
        parts = F.split(clean, F.lit(separator.replace("-", r"\-")))
        ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        cut = F.transform(ends, lambda n: F.concat(F.array_join(F.slice(parts, 1, n), separator), F.lit(separator)))
        return F.filter(cut, lambda p: (F.length(p) > len(separator)) & (F.length(F.trim(F.substring(clean, F.length(p) + 1, F.length(clean)))) > 0))

    return F.concat(*map(of, SEPARATORS))


def nested_count(lists: Column, inner: str, innermost: str | None = None) -> Column:
    """How many entries the arrays `inner` (and in them `innermost`) of an array of structs hold; a
    missing one holds none."""
    size = lambda a: F.when(a.isNull(), 0).otherwise(F.size(a))
    one = (lambda x: nested_count(x[inner], innermost)) if innermost else (lambda x: size(x[inner]))
    return F.coalesce(F.aggregate(lists, F.lit(0), lambda n, x: n + F.coalesce(one(x), F.lit(0))), F.lit(0))
