"""Places of an open map's answer as rows, and their match with known restaurants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.functions.geo import in_multipolygon, metres
from menulake.functions.keys import name_key

# Kinds of places that serve food, and words of a kind before a name.
KINDS = ("restaurant", "cafe", "bar", "pub", "fast_food", "ice_cream", "biergarten", "food_court")
KIND_WORDS = ("restaurant", "cafe", "bistro", "brasserie", "eetcafe", "grand")
ANSWER = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
MATCH_METRES = 150


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {"elements": [...]} with an explicit schema."""
    return spark.read.schema(ANSWER).json(path, multiLine=True)


def address_of(tags: Column) -> Column:
    """Street and number, then postcode and place; null if there is nothing of it."""
    tag = lambda k: F.nullif(F.trim(F.try_element_at(tags, F.lit(f"addr:{k}"))), F.lit(""))
    lines = [F.nullif(F.concat_ws(" ", tag(a), tag(b)), F.lit("")) for a, b in (("street", "housenumber"), ("postcode", "city"))]
    return F.nullif(F.concat_ws(", ", *lines), F.lit(""))


def places(answer: DataFrame) -> DataFrame:
    """(place_id, name, kind, address, postcode, website, cuisine, lat, lon) of the elements that serve
    food and have a name; of elements that share type and id the first one. Nothing else of the tags
    is kept."""
    e = answer.select(F.posexplode("elements").alias("at", "e")).select("at", "e.*")
    tag = lambda k: F.nullif(F.trim(F.try_element_at("tags", F.lit(k))), F.lit(""))
    rows = e.where(F.col("type").isin("node", "way", "relation") & F.col("id").isNotNull() & tag("amenity").isin(*KINDS) & tag("name").isNotNull())
    address = address_of(F.col("tags"))
    kept = rows.select(
        "at", F.concat_ws("/", "type", F.col("id").cast("string")).alias("place_id"), tag("name").alias("name"), tag("amenity").alias("kind"), address.alias("address"), postcode(address).alias("postcode"),
        F.coalesce(tag("website"), tag("contact:website"), tag("url")).alias("website"), F.substring(tag("cuisine"), 1, 60).alias("cuisine"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
    )
    names = [c for c in kept.columns if c not in ("at", "place_id")]
    return kept.groupBy("place_id").agg(*[F.min_by(F.struct(c), "at")[c].alias(c) for c in names])


def is_chain(tags: Column) -> Column:
    """A brand's tag that isn't empty."""
    return F.exists(F.array(F.lit("brand"), F.lit("brand:wikidata")), lambda k: F.length(F.trim(F.coalesce(F.try_element_at(tags, k), F.lit("")))) > 0)


def is_gone(tags: Column) -> Column:
    """A tag of something that was, or opening hours that say closed."""
    was = F.exists(F.map_keys(tags), lambda k: k.rlike("^(?:disused|abandoned|was|removed|demolished)(?::|$)"))
    return was | F.coalesce(F.try_element_at(tags, F.lit("opening_hours")).rlike("(?i)closed"), F.lit(False))


def classified(features: DataFrame, polygons: Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(ordinal, osm_id, outcome, reason) of each feature (ordinal, osm_id, lat, lon, tags): stored,
    skipped (outside the boundary), or errored with a reason. Of features that share an id the first
    that is sound counts; errored ones don't take an id."""
    kind = F.try_element_at("tags", F.lit("amenity"))
    wrong = (
        F.when(F.coalesce(F.length("osm_id"), F.lit(0)) == 0, "missing-osm-id")
        .when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "amenity-not-allowed")
        .when(F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon"), "non-numeric-coordinates")
    )
    rows = features.withColumn("_wrong", wrong)
    first = rows.where("_wrong IS NULL").groupBy("osm_id").agg(F.min("ordinal").alias("_first"))
    inside = in_multipolygon(F.col("lon"), F.col("lat"), polygons)
    seen = F.when(F.col("ordinal") > F.col("_first"), "duplicate-osm-node-id")
    late = rows.join(first, "osm_id", "left").withColumn("_error", F.when(F.col("_wrong") == "missing-osm-id", F.col("_wrong")).otherwise(F.coalesce(seen, "_wrong")))
    outcome = F.when(F.col("_error").isNotNull(), "errored").when(inside, "stored").otherwise("skipped")
    return late.select("ordinal", "osm_id", outcome.alias("outcome"), F.coalesce("_error", F.when(outcome == "skipped", "outside-boundary")).alias("reason"))


def postcode(address: Column) -> Column:
    """Four digits and two letters without a space, in capitals; null if an address has none."""
    found = F.regexp_extract(address, r"(?i)\b([1-9][0-9]{3})\s?([a-z]{2})\b", 0)
    return F.nullif(F.upper(F.regexp_replace(found, r"\s", "")), F.lit(""))


def comparable(name: Column) -> Column:
    """The name key without words of a kind at its front; all of it if nothing else is left."""
    key = name_key(name)
    short = F.regexp_replace(key, rf"^(?:(?:{'|'.join(KIND_WORDS)}) )+", "")
    return F.when(short.isin("", *KIND_WORDS), key).otherwise(short)


def matched(restaurants: DataFrame, found: DataFrame, most_metres: float = MATCH_METRES) -> DataFrame:
    """(restaurant_id, place_id, reason): restaurants (restaurant_id, name, address, lat, lon) with at
    most one place (place_id, name, postcode, lat, lon).

    Names must be comparable; then the postcodes equal, where the restaurant has one; then the distance
    small enough, where both have coordinates. One place may be left: none is `no_name`,
    `no_name_match`, `postcode_mismatch` or `too_far`, by the step that left none; more are `several`."""
    r = restaurants.select("restaurant_id", comparable(F.col("name")).alias("key"), postcode(F.col("address")).alias("r_post"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    p = found.select("place_id", comparable(F.col("name")).alias("key"), "postcode", "lat", "lon")
    pairs = r.where("key <> ''").join(p, "key")
    same_post = F.col("r_post").isNull() | F.coalesce(F.col("r_post") == F.col("postcode"), F.lit(False))
    near = F.coalesce(metres(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon")) <= most_metres, F.lit(True))
    n = pairs.groupBy("restaurant_id").agg(F.count_if(same_post).alias("posts"), F.count_if(same_post & near).alias("left"), F.min(F.when(same_post & near, F.col("place_id"))).alias("place_id"))
    reason = F.when(F.coalesce(F.col("key"), F.lit("")) == "", "no_name").when(F.col("posts").isNull(), "no_name_match").when(F.col("posts") == 0, "postcode_mismatch").when(F.col("left") == 0, "too_far").when(F.col("left") > 1, "several").otherwise("exact")
    return r.join(n, "restaurant_id", "left").select("restaurant_id", F.when(F.col("left") == 1, F.col("place_id")).alias("place_id"), reason.alias("reason"))


def triage_order(rows: DataFrame) -> DataFrame:
    """rows (next_step, name, ...) in the order of triage: by step, then by name in Dutch order."""
    ranks = {"review_proposal": 0, "proposals_unknown": 0, "add_candidate": 1, "replace_or_mark": 1, "inspect_or_mark": 2, "check_via_onboarding": 3}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("next_step")), F.lit(9))
    return rows.orderBy(rank, F.collate("name", "nl_CI"))


def next_step(source: Column, open_proposal: Column, known_url: Column, proposals_known: Column) -> Column:
    """The one safe next step for a restaurant's source."""
    return (
        F.when(~proposals_known, "proposals_unknown").when(open_proposal, "review_proposal").when(~known_url, "add_candidate")
        .when(source.isin("unreachable", "identity_changed"), "replace_or_mark").when(source == "access_limited", "inspect_or_mark").otherwise("check_via_onboarding")
    )
