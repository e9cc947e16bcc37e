"""The nested catalogue: menus by key, with categories and items, and its flat form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<name:string,desc:string,price:string,priceValue:double,priceOnRequest:boolean,priceIsSupplement:boolean,tags:array<string>,allergens:array<int>>"
MENUS = f"menus map<string,struct<title:string,scraped:string,source:string,categories:array<struct<name:string,path:array<string>,items:array<{ITEM}>>>>>"


def read_menus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {"menus": {"<restaurant>-<meal>": menu}} with an explicit schema."""
    return spark.read.schema(MENUS).json(path, multiLine=True)


def menu_items(menus: DataFrame) -> DataFrame:
    """(menu_key, item_key, category, path, name, price_cents, on_request, tags, allergens) of all menus
    of the document, keys by position from 0; a null menu, category or item list has none."""
    m = menus.select(F.explode("menus").alias("menu_key", "menu"))
    c = m.select("menu_key", F.posexplode("menu.categories").alias("c", "category"))
    i = c.select("menu_key", "c", "category", F.posexplode("category.items").alias("i", "item"))
    cents = F.round(F.col("item.priceValue") * 100).cast("long")
    return i.select("menu_key", F.concat_ws("-", "menu_key", "c", "i").alias("item_key"), F.col("category.name").alias("category"), F.col("category.path").alias("path"), F.col("item.name").alias("name"), cents.alias("price_cents"), F.col("item.priceOnRequest").alias("on_request"), F.col("item.tags").alias("tags"), F.col("item.allergens").alias("allergens"))


def nested(dishes: DataFrame) -> DataFrame:
    """Flat dishes regrouped as (menu_key, categories), in the order of names."""
    items = dishes.groupBy("restaurant_id", "meal", "category").agg(F.sort_array(F.collect_list(F.struct("name", "dish_id", "price_cents"))).alias("items"))
    return items.groupBy(F.concat_ws("-", "restaurant_id", "meal").alias("menu_key")).agg(F.sort_array(F.collect_list(F.struct(F.col("category").alias("name"), "items"))).alias("categories"))


def flat(menus: DataFrame) -> DataFrame:
    """(dish key, category, name, price) with positional keys, menu-category-item from 0."""
    c = menus.select("menu_key", F.posexplode("categories").alias("c", "category"))
    i = c.select("menu_key", "c", F.col("category.name").alias("category"), F.posexplode("category.items").alias("i", "item"))
    return i.select(F.concat_ws("-", "menu_key", "c", "i").alias("dish_key"), "category", F.col("item.name").alias("name"), F.col("item.price_cents").alias("price_cents"))
