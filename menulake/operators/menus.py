"""Whole menus: is one complete, do its headings fit together, may another replace it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from menulake.functions.arrays import openings
from menulake.functions.content import dish_key

#: Dishes of a complete menu at least, bounds of a price in cents, levels of headings that are sure,
#: and the share of a read menu that another reading must reach.
LEAST_DISHES, LEAST_CENTS, MOST_CENTS, SURE_LEVELS, REPLACING_SHARE = 8, 100, 15_000, 3, 0.8


def completeness(dishes: DataFrame) -> DataFrame:
    """(menu, ok, reasons, dishes, priced) of each menu's rows: menu, category, uncertain, name,
    description, cents (null: no price), supplement.

    Reasons, in a fixed order: no_dishes, uncategorised_dishes, uncertain_sections, unpriced_dishes,
    price_out_of_bounds (supplements aside), duplicate_dishes (one category, name, description and
    price), too_few_dishes. Rows without a name are no dishes."""
    named = F.length(F.trim(F.coalesce("name", F.lit("")))) > 0
    text = lambda c: F.coalesce(dish_key(F.col(c)), F.lit(""))
    rows = dishes.withColumns({"_named": named, "_key": F.concat_ws("|", F.lower(F.trim(F.coalesce("category", F.lit("")))), text("name"), text("description"), F.coalesce(F.col("cents").cast("string"), F.lit("x")))})
    # repeats are counted per key first, so that a menu's rows needn't meet in one task
    each = rows.groupBy("menu", "_named", "_key").agg(
        F.count(F.lit(1)).alias("n"), F.count("cents").alias("priced"), F.count_if(F.length(F.trim(F.coalesce("category", F.lit("")))) == 0).alias("plain"), F.count_if(F.coalesce("uncertain", F.lit(False))).alias("unsure"),
        F.count_if(~F.col("cents").between(LEAST_CENTS, MOST_CENTS) & ~F.coalesce("supplement", F.lit(False))).alias("odd"),
    )
    of = lambda c, named_only=True: F.sum(F.when(F.col("_named") | F.lit(not named_only), F.expr(c)).otherwise(0))
    g = each.groupBy("menu").agg(of("n").alias("dishes"), of("priced").alias("priced"), of("n - 1").alias("repeats"), of("plain", False).alias("plain"), of("unsure", False).alias("unsure"), of("odd").alias("odd"))
    checks = {
        "no_dishes": F.col("dishes") == 0, "uncategorised_dishes": F.col("plain") > 0, "uncertain_sections": F.col("unsure") > 0, "unpriced_dishes": F.col("priced") < F.col("dishes"), "price_out_of_bounds": F.col("odd") > 0,
        "duplicate_dishes": F.col("repeats") > 0, "too_few_dishes": F.col("dishes").between(1, LEAST_DISHES - 1),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return g.select("menu", (F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), "dishes", "priced")


def hierarchy(sections: DataFrame) -> DataFrame:
    """(menu, position, title, path, uncertain) of each section (menu, position, path, untrusted).

    A first label that all sections of a menu share, each with one of its own below it, is lifted to
    the title. A section is uncertain if it has no heading beside headed ones, lies too deep, isn't
    trusted, or its path begins another section's."""
    labels = F.filter(F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    rows = sections.withColumn("_p", labels)
    first = F.get("_p", F.lit(0))
    shared = rows.groupBy("menu").agg((F.min(F.size("_p")) >= 2).alias("_deep"), F.min(first).alias("_low"), F.max(first).alias("_high"), F.max(F.size("_p")).alias("_most"))
    title = F.when(F.col("_deep") & (F.col("_low") == F.col("_high")), F.col("_low"))
    lifted = rows.join(shared, "menu").withColumn("title", title).withColumn("_own", F.when(F.col("title").isNotNull(), F.slice("_p", 2, F.size("_p"))).otherwise(F.col("_p")))
    # a path begins another one if it is one of that one's proper prefixes: an equality, not a pairing
    prefixes = lifted.where(F.size("_own") > 1).select("menu", F.explode(F.transform(F.sequence(F.lit(1), F.size("_own") - 1), lambda n: F.slice("_own", 1, n))).alias("_own")).distinct().withColumn("_begins", F.lit(True))
    unsure = (F.size("_p") == 0) & (F.col("_most") > 0) | (F.size("_p") > SURE_LEVELS) | F.coalesce("untrusted", F.lit(False)) | F.coalesce("_begins", F.lit(False))
    return lifted.join(prefixes, ["menu", "_own"], "left").select("menu", "position", "title", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.array(F.lit("Menu"))).alias("path"), unsure.alias("uncertain"))


def replacement(items: DataFrame, known: DataFrame) -> DataFrame:
    """(menu, reason) of each menu of known (menu, n): whether its newly read items (menu, quote,
    source_ok) may replace it: no_items, coverage_below (under 80 % of n), missing_evidence, or ok."""
    found = items.groupBy("menu").agg(F.count(F.lit(1)).alias("found"), F.count_if((F.length(F.trim(F.coalesce("quote", F.lit("")))) == 0) | ~F.coalesce("source_ok", F.lit(False))).alias("bare"))
    count = F.coalesce("found", F.lit(0))
    reason = F.when(count == 0, "no_items").when(count < F.ceil(F.col("n") * REPLACING_SHARE), "coverage_below").when(F.col("bare") > 0, "missing_evidence").otherwise("ok")
    return known.join(found, "menu", "left").select("menu", reason.alias("reason"))


def removed(live: DataFrame, concept: DataFrame) -> DataFrame:
    """Live lines (menu, path, name) that a concept lacks: a line is there if its name is, in its own
    path, or, for a menu whose concept has no such path at all, anywhere in the menu."""
    key = concept.select("menu", "path", dish_key(F.col("name")).alias("_key")).distinct()
    paths = concept.select("menu", "path").distinct().withColumn("_has_path", F.lit(True))
    rows = live.withColumn("_key", dish_key(F.col("name"))).join(paths, ["menu", "path"], "left")
    scoped = rows.where("_has_path").join(key, ["menu", "path", "_key"], "left_anti")
    loose = rows.where("_has_path IS NULL").join(key.select("menu", "_key").distinct(), ["menu", "_key"], "left_anti")
    return scoped.unionByName(loose).select("menu", "path", "name")


def first_sightings(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Rows of the first page that has their key; repeats on that page stay. Rows meet their first page
    by an aggregate, so a row that all pages have isn't one task's work."""
    first = rows.groupBy(*keys).agg(F.min(page).alias(page))
    return rows.join(first, [*keys, page], "left_semi").select(*rows.columns)


def item_flags(items: DataFrame, gating: tuple[str, ...] = ("section_marker", "long_name", "supplement_as_item", "unresolved_price")) -> DataFrame:
    """(menu, flags, ok) of each menu's rows (menu, category, name, priced): the different flags that its
    items raise, in a fixed order, and whether none of them is a gating one.

    section_marker: // in a name; long_name: over 80 characters or 14 words; supplement_as_item;
    unresolved_price; unheaded_items; duplicate_in_category, by the name's key."""
    name, key = F.trim(F.coalesce("name", F.lit(""))), F.coalesce(dish_key(F.col("name")), F.lit(""))
    rows = items.withColumns({"_name": name, "_key": key, "_plain": F.length(F.trim(F.coalesce("category", F.lit("")))) == 0})
    each = rows.groupBy("menu", F.coalesce("category", F.lit("")).alias("category"), "_key").agg(
        F.bool_or(F.contains("_name", F.lit("//"))).alias("section_marker"), F.bool_or((F.length("_name") > 80) | (F.size(F.split("_name", r"\s+")) > 14)).alias("long_name"),
        F.bool_or(F.col("_name").rlike(r"(?i)^(?:\+|supplement(?:en)?\b)")).alias("supplement_as_item"), F.bool_or(~F.coalesce("priced", F.lit(False))).alias("unresolved_price"),
        F.bool_or("_plain").alias("unheaded_items"), (F.count(F.lit(1)) > 1).alias("_twice"),
    )
    codes = ("section_marker", "long_name", "supplement_as_item", "unresolved_price", "unheaded_items")
    g = each.groupBy("menu").agg(*[F.bool_or(c).alias(c) for c in codes], F.bool_or(F.col("_twice") & (F.col("_key") != "")).alias("duplicate_in_category"))
    flags = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in (*codes, "duplicate_in_category")]), lambda x: x.isNotNull())
    return g.select("menu", flags.alias("flags"), (~F.arrays_overlap(flags, F.array(*map(F.lit, gating)))).alias("ok"))


def overlaid(nested: DataFrame, edits: DataFrame) -> DataFrame:
    """nested (menu_key, categories: array<struct<name, items: array<struct<..., price_cents>>>>) with
    edits by place (menu_key, c, i from 0, price_cents, available): a price that is given replaces the
    item's, and every item gets `available`. Edits of places that aren't there change nothing."""
    place = F.concat_ws("-", "c", "i")
    by = edits.groupBy("menu_key").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.struct("price_cents", "available").alias("v")))).alias("_edits"))
    edit = lambda c, i: F.try_element_at("_edits", F.concat_ws("-", c, i))

    def item(x, c, i):
        return x.withField("price_cents", F.coalesce(edit(c, i)["price_cents"], x["price_cents"])).withField("available", F.coalesce(edit(c, i)["available"], F.lit(True)))

    new = F.transform("categories", lambda cat, c: cat.withField("items", F.transform(cat["items"], lambda x, i: item(x, c, i))))
    return nested.join(by, "menu_key", "left").withColumn("categories", new).drop("_edits")


def shared_opening(names: DataFrame, group: str, name: str) -> DataFrame:
    """(group, opening, n): the opening that most different names of a group share, two at least; of
    equal ones the longest, then the first."""
    each = names.select(group, F.trim(F.regexp_replace(name, r"\s+", " ")).alias("_n")).distinct().select(group, F.explode(openings(F.col("_n"))).alias("opening"))
    counts = each.groupBy(group, "opening").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    best = Window.partitionBy(group).orderBy(F.desc("n"), F.desc(F.length("opening")), F.asc("opening"))
    return counts.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
