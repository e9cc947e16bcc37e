"""Search in the catalogue, by parameters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hits on a page unless asked otherwise, and at most; examples of a group; letters of a query.
PAGE, MOST, EXAMPLES, LEAST_LETTERS = 20, 50, 3, 2


def dutch(text: str) -> Column:
    """A name in the order of a Dutch dictionary."""
    return F.collate(text, "nl")


@dataclass(frozen=True)
class Page:
    """A page of results, and one row with total, has_more and next_cursor."""

    rows: DataFrame
    summary: DataFrame


def tier_of(columns: list[tuple[int, str]], needle: str) -> Column:
    """The lowest tier whose text holds the needle; 0 is for a name that equals it. Null: no hit."""
    exact = F.when(F.lower(columns[0][1]) == needle, 0)
    return reduce(lambda c, x: c.when(F.contains(F.lower(x[1]), F.lit(needle)), x[0]), columns, exact)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def dish_hits(
    dishes: DataFrame,
    restaurants: DataFrame,
    q: str = "",
    meal: str = "",
    meals: tuple[str, ...] = (),
    max_price: int | None = None,
    cuisines: tuple[str, ...] = (),
    buurt: str = "",
    without_allergens: tuple[int, ...] = (),
    open_at: int | None = None,
    offers: DataFrame | None = None,
    edits: DataFrame | None = None,
) -> DataFrame:
    """Dishes that pass the filters and, if the query has two letters or more, hold it; with `tier`.

    dishes: restaurant_id, dish_id, meal, name, category, tag, price_cents, on_request, multiple,
    allergens (an array); restaurants: restaurant_id, restaurant, buurt, cuisine, opens, closes
    (minutes of the day). A meal that isn't among `meals` finds nothing. A dish without one sure
    price passes the price filter. offers: restaurant_id, courses (an array of names); only their
    restaurants are searched, and a course that holds the query is a hit of tier 2. edits: dish_id,
    price_cents, available, applied before the filters; dishes that aren't available stay.
    """
    known = restaurants.select("restaurant_id", "restaurant", "buurt", "cuisine", "opens", "closes")
    if edits is not None:
        new = edits.select("dish_id", F.col("price_cents").alias("_price"), F.col("available").alias("_available"))
        dishes = dishes.join(new, "dish_id", "left").withColumns({"price_cents": F.coalesce("_price", "price_cents"), "available": F.coalesce("_available", F.lit(True))}).drop("_price", "_available")
    if offers is not None:
        known = known.join(offers.groupBy("restaurant_id").agg(F.flatten(F.collect_list("courses")).alias("_courses")), "restaurant_id")
    rows = dishes.join(known, "restaurant_id")
    if meal:
        rows = rows.where((F.col("meal") == meal) & F.lit(meal in meals or not meals))
    if max_price is not None:
        rows = rows.where(F.col("price_cents").isNull() | F.col("on_request") | F.col("multiple") | (F.col("price_cents") <= max_price))
    if cuisines:
        rows = rows.where(any_of([F.contains(F.lower("cuisine"), F.lit(c.lower())) for c in cuisines]))
    if buurt:
        rows = rows.where(F.col("buurt") == buurt)
    if without_allergens:
        rows = rows.where(~F.arrays_overlap("allergens", F.array(*map(F.lit, without_allergens))))
    if open_at is not None:
        rows = rows.where((F.col("opens") <= open_at) & (F.col("closes") > open_at))
    needle = q.strip().lower()
    if len(needle) < LEAST_LETTERS:
        return rows.withColumn("tier", F.lit(0)).drop("_courses")
    tier = tier_of([(1, "name"), (2, "category"), (3, "tag")], needle)
    if offers is not None:
        tier = F.least(tier, F.when(F.exists("_courses", lambda c: F.contains(F.lower(c), F.lit(needle))), 2))
    return rows.withColumn("tier", tier).where("tier is not null").drop("_courses")


def page_of(rows: DataFrame, order: list[Column], cursor: int = 0, limit: int | None = None) -> Page:
    """The page from the cursor on, numbered, in an order without ties. Only the rows up to the page's
    end are sorted at all; the total is an aggregate of its own."""
    limit = min(max(1, limit or PAGE), MOST)
    begin = max(0, cursor)
    first = rows.orderBy(*order).limit(begin + limit)
    numbered = first.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("pos") > begin)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    more = F.col("total") > begin + limit
    return Page(numbered, total.select("total", more.alias("has_more"), F.when(more, F.lit(begin + limit)).alias("next_cursor")))


def dish_search(dishes: DataFrame, restaurants: DataFrame, cursor: int = 0, limit: int | None = None, **filters) -> Page:
    """A page of dishes: by tier, restaurant and name in Dutch order, then dish_id."""
    return page_of(dish_hits(dishes, restaurants, **filters), [F.asc("tier"), dutch("restaurant"), dutch("name"), F.asc("dish_id")], cursor, limit)


def dish_groups(dishes: DataFrame, restaurants: DataFrame, cursor: int = 0, limit: int | None = None, **filters) -> Page:
    """A page of restaurants in the order of their best tier and name, each with its menus (meal, n,
    examples) by the number of hits; the page, its total and its cursor count restaurants. Examples
    are a menu's first hits; a hit on the tag alone is marked as weak."""
    hits = dish_hits(dishes, restaurants, **filters)
    best = [F.asc("tier"), dutch("name"), F.asc("dish_id")]
    ranked = hits.withColumn("k", F.row_number().over(Window.partitionBy("restaurant_id", "meal").orderBy(*best)))
    example = F.struct("k", "dish_id", "name", "price_cents", (F.col("tier") == 3).alias("weak"))
    menus = ranked.groupBy("restaurant_id", "restaurant", "meal").agg(
        F.count(F.lit(1)).alias("n"), F.min("tier").alias("tier"), F.sort_array(F.collect_list(F.when(F.col("k") <= EXAMPLES, example))).alias("examples")
    )
    shown = F.transform("examples", lambda x: x.dropFields("k"))
    menu = F.struct((-F.col("n")).alias("by"), "tier", "meal", "n", shown.alias("examples"))
    groups = menus.groupBy("restaurant_id", "restaurant").agg(F.sum("n").alias("n"), F.min("tier").alias("tier"), F.sort_array(F.collect_list(menu)).alias("menus"))
    rows = groups.withColumn("menus", F.transform("menus", lambda x: x.dropFields("by", "tier")))
    return page_of(rows, [F.asc("tier"), dutch("restaurant"), F.asc("restaurant_id")], cursor, limit)


def restaurant_search(restaurants: DataFrame, q: str, cursor: int = 0, limit: int | None = None) -> Page:
    """A page of restaurants (restaurant_id, restaurant, buurt, address): the exact name, then in the
    name, the neighbourhood, and an address that is none but the name with a place."""
    needle = q.strip().lower()
    real = F.lower(F.trim("address")) != F.lower(F.concat("restaurant", F.lit(" Breda")))
    rows = restaurants.withColumn("_address", F.when(real, F.col("address")))
    hits = rows.withColumn("tier", tier_of([(1, "restaurant"), (2, "buurt"), (3, "_address")], needle)).where("tier is not null").drop("_address")
    return page_of(hits, [F.asc("tier"), dutch("restaurant"), F.asc("restaurant_id")], cursor, limit)


def seeded_day_order(rows: DataFrame, day: str, parts: list[str], salt: str = "", boost: Column | None = None) -> Column:
    """A number in [0, 1), less a boost, that orders rows anew each day: FNV-1a (32 bit) of the day, some
    columns and a salt, joined by |, over 2^32. Characters count by their code, as 16 bits."""
    key = F.concat_ws("|", F.lit(day), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts], F.lit(salt))
    codes = F.transform(F.split(key, ""), lambda c: F.ascii(c).cast("long"))
    rest = F.lit(1 << 32)
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)) % rest)
    return h / rest - (F.lit(0.0) if boost is None else boost)
