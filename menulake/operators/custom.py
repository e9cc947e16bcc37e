"""Queries that SQL alone doesn't express, and DataFrame forms of the engine's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from menulake.functions import arrays, canonical, content, dates, decisions, geo, keys
from menulake.operators import coverage, diagnosis, extract, menus, pick, records, search, state
from menulake.operators.match import staged_bag_match
from menulake.operators.order import global_rank
from menulake.operators.reduce import latest_by
from menulake.plans.dialect import load, run_sql
from menulake.plans.matching import HOLE, RING
from menulake.sources import catalog, checked, places
from menulake.storage import saved
from menulake.streaming import counters


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_items(load(spark, sf_dir, "pages"))


def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.html_text(load(spark, sf_dir, "pages"))


def jsonld_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.jsonld_items(load(spark, sf_dir, "pages"))


def html_menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.menu_items(load(spark, sf_dir, "pages"))


def card_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, item_id, name, category, price of each item on a restaurant's card."""
    return run_sql(spark, sf_dir, "SELECT restaurant_id AS source_id, item_id, name, category, CAST(floor(price_cents / 10) AS BIGINT) AS price FROM dishes")


def label_of(name: Column, item_id: Column) -> Column:
    return F.concat_ws(" ", name, F.translate(F.lpad(item_id.cast("string"), 7, "0"), "0123456789", "abcdefghij"))


def line_of(label: Column, item_id: Column, price: Column) -> Column:
    """An item's line on the card: one of five items has its price on the next line."""
    printed = F.concat(F.floor(price / 100), F.lit(","), F.lpad((price % 100).cast("string"), 2, "0"))
    return F.concat(label, F.when(item_id % 5 == 0, "\n").otherwise("  "), printed)


def printed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, item_id, category, label, price, and the item's line on the restaurant's card."""
    items = card_items(spark, sf_dir).withColumn("label", label_of(F.col("name"), F.col("item_id")))
    return items.withColumn("line", line_of(F.col("label"), F.col("item_id"), F.col("price")))


def card_text(rows: Column) -> Column:
    """The printed card of items in order (structs with category and line), a section for each category."""
    first = lambda x, i: (i == 0) | ~x["category"].eqNullSafe(F.get(rows, i - 1)["category"])
    return F.array_join(F.transform(rows, lambda x, i: F.when(first(x, i), F.concat_ws("\n", x["category"], x["line"])).otherwise(x["line"])), "\n")


def captures(items: DataFrame, *more: Column) -> DataFrame:
    """source_id, text and more aggregates of each restaurant's printed card, a section for each category.
    Items are dealt out to their restaurants once, as they are."""
    cards = items.repartition("source_id").groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("category", "item_id", "line"))).alias("rows"), *more)
    return cards.withColumn("text", card_text(F.col("rows"))).drop("rows")


def price_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = coverage.priced_lines(captures(printed_items(spark, sf_dir)))
    return lines.select("source_id", "section", "name", F.col("cents")[0].alias("price"), "paired", "loose")


def evidenced_cards(items: DataFrame) -> DataFrame:
    """source_id, text, evidence and accounted of each restaurant's card, where three of four items are dishes
    that quote their name, some at another price, and some of the rest are rejected passages or accounted for.

    items: as `card_items`. Only these short rows are dealt out and sorted; a card's texts, several times
    as long, are made of its own rows when these are together. Spark must not merge partitions by the
    bytes of the short rows, so their number is the session's.
    """
    dealt = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id")
    cards = dealt.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("category", "item_id", "name", "price"))).alias("rows"))

    def printed(x: Column) -> Column:
        label = label_of(x["name"], x["item_id"])
        return F.struct(x["category"].alias("category"), x["item_id"].alias("item_id"), x["price"].alias("price"), label.alias("label"), line_of(label, x["item_id"], x["price"]).alias("line"))

    def quote(x: Column) -> Column:
        amount = x["price"] + F.when(x["item_id"] % 7 == 0, 50).otherwise(0)
        return F.struct(F.when(dish(x), "dish").otherwise("rejected").alias("kind"), x["item_id"].cast("string").alias("row_id"), x["label"].alias("quote"), F.array(amount).alias("amounts"))

    dish = lambda x: x["item_id"] % 4 != 0
    quoted = F.transform(F.filter("rows", lambda x: dish(x) | (x["item_id"] % 11 == 0)), quote)
    done = F.transform(F.filter("rows", lambda x: ~dish(x) & (x["item_id"] % 13 == 0)), lambda x: F.struct(F.lit(None).cast("long").alias("line"), F.upper(x["label"]).alias("text")))
    return cards.withColumn("rows", F.transform("rows", printed)).select("source_id", card_text(F.col("rows")).alias("text"), quoted.alias("evidence"), done.alias("accounted"))


def toned_lines(spark: SparkSession, sf_dir: str, *columns: str, only: str | None = None) -> DataFrame:
    """Lines of the cards (`evidenced_cards`), the columns that are asked for; only: of that tone."""
    return coverage.card_tones(evidenced_cards(card_items(spark, sf_dir)), *columns, only=only)


def line_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toned_lines(spark, sf_dir, "source_id", "name").select("source_id", "name", "tone", F.col("row_id").cast("long").alias("item_id"))


def uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 lines that no dish covers, as a review shows them."""
    return coverage.uncovered(toned_lines(spark, sf_dir, "source_id", "line", "segment", "section", "name", "cents", only="uncovered"))[0].select("source_id", "line", "section", "name", F.col("cents")[0].alias("price"))


def uncovered_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"available": "boolean", "total": "long", "shown": "long", "omitted": "long"}
    return coverage.summary(coverage.card_counts(evidenced_cards(card_items(spark, sf_dir)))).select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def coverage_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.diagnosis(toned_lines(spark, sf_dir, "source_id", "paired", "loose"))


def answer_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each quote stands in the document with the window that is most like it."""
    docs, quotes = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")
    near = diagnosis.quote_nearest(docs, quotes, 1)
    asked = quotes.select("item_id", F.col("text").alias("quote")).join(near, "item_id", "left").join(docs, "doc_id", "left")
    return asked.select("item_id", "doc_id", "score", diagnosis.quote_class(F.col("quote"), F.col("text")).alias("class"))


def mismatch_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of what differs between expected and actual rows, the digits of names as letters."""
    rows = run_sql(spark, sf_dir, "SELECT * FROM expected"), run_sql(spark, sf_dir, "SELECT * FROM actual")
    code = F.translate(F.col("name").cast("string"), "0123456789", "abcdefghij")
    e, a = (r.select("source", "line", F.concat(code, F.lit(" "), F.reverse(code)).alias("name"), F.split("path", "").alias("path")) for r in rows)
    found = saved(bag_match(spark, sf_dir), "matched")  # read four times below
    left = e.withColumnsRenamed({"line": "l_line", "name": "e_name", "path": "e_path"})
    right = a.withColumnsRenamed({"line": "r_line", "name": "a_name", "path": "a_path"})
    of = lambda c: found.where(F.col("class") == c)
    both = of("category").select(F.col("l_source").alias("source"), "l_line", "r_line").join(left, ["source", "l_line"]).join(right, ["source", "r_line"])
    price = of("price").select(F.col("l_source").alias("source"), "l_line").join(left, ["source", "l_line"])
    missing = of("missing").select(F.col("l_source").alias("source"), "l_line").join(left, ["source", "l_line"])
    extra = of("extra").select(F.col("r_source").alias("source"), "r_line").join(right, ["source", "r_line"])
    name = lambda df, c: df.select("source", F.col(c).alias("name"))
    return diagnosis.mismatch_rows(both.select("source", F.col("e_name").alias("name"), F.col("e_path").alias("expected_path"), F.col("a_path").alias("actual_path")), name(price, "e_name"), name(missing, "e_name"), name(extra, "a_name")).select(F.col("source").cast("string").alias("source"), "classification", "reason", "expected", "actual")


def token_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.token_reasons(load(spark, sf_dir, "documents"))


def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.text_windows(load(spark, sf_dir, "documents"))


def quote_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.quote_nearest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the smaller parts of a type paired with those of the larger ones."""
    names = load(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), "p_size")
    return diagnosis.name_variants(names.where("p_size <= 25").drop("p_size"), names.where("p_size > 25").drop("p_size"), "kind")


def throttle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return state.throttle(e, ["user_id", "event_type"], "us", "event_id", 3_600_000_000)


def spend_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.floor(F.col("value") * 100).alias("cents"))
    return state.ledger(e, "user_id", "us", "event_id", "cents", 5_000, 100_000)


def call_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views reserve, purchases settle what the user reserved last, errors abandon it."""
    e = load(spark, sf_dir, "events").where("event_type IN ('view', 'purchase', 'error')")
    rows = e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.expr("CASE event_type WHEN 'view' THEN 'reserve' WHEN 'purchase' THEN 'settle' ELSE 'abandon' END").alias("kind"), F.lit("call").alias("ref"), F.floor(F.col("value") * 100).alias("cents"))
    return state.reservations(rows, "user_id", "us", "event_id", "kind", "ref", "cents", 5_000, 100_000, 50)


def diversified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT r.cuisine AS grp, x.item_id AS item, x.restaurant_id AS owner, x.category AS kind, CAST(floor(x.price_cents / 20000) AS BIGINT) AS bucket, x.price_cents * 100000 + x.item_id AS rank, x.allergen_a = 3 AS seasonal FROM dishes x JOIN restaurants r ON r.restaurant_id = x.restaurant_id")
    return pick.diversified_pick(rows, "grp", wanted="seasonal")


def catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dishes = run_sql(spark, sf_dir, "SELECT * FROM dishes").withColumn("allergens", F.array("allergen_a", "allergen_b"))
    return dishes, run_sql(spark, sf_dir, "SELECT restaurant_id, name AS restaurant, buurt, cuisine, address, opens, closes FROM restaurants")


def dish_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten of a filtered search, with its summary."""
    page = search.dish_search(*catalogue(spark, sf_dir), q="ring", meal="N", meals=("N", "A", "R"), max_price=150_000, without_allergens=(1, 7), cursor=10, limit=10)
    return page.rows.select("pos", "dish_id", "name", "restaurant", F.col("tier").cast("long").alias("tier"))


def dish_search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.dish_search(*catalogue(spark, sf_dir), q="ring", meal="N", meals=("N", "A", "R"), max_price=150_000, without_allergens=(1, 7), cursor=10, limit=10)
    return page.summary.select("total", "has_more", F.col("next_cursor").cast("long").alias("next_cursor"))


def dish_group_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.dish_groups(*catalogue(spark, sf_dir), q="gear", cuisines=("asia", "europe"), cursor=1, limit=5)
    return page.rows.select("pos", "restaurant_id", "restaurant", "n")


def restaurant_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.restaurant_search(catalogue(spark, sf_dir)[1], "1", cursor=2, limit=7)
    return page.rows.select("pos", "restaurant_id", "restaurant", F.col("tier").cast("long").alias("tier"))


def daily_seeded_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes of a day in their seeded order; those of one size go a tenth before."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item"), "p_size")
    score = search.seeded_day_order(parts, "2024-01-30", ["item"], "tonight", F.when(F.col("p_size") == 7, 0.1).otherwise(0.0))
    return global_rank(parts.withColumn("score", score), [F.asc("score"), F.asc("item")]).select("item", "pos")


def source_workqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last usable job of each host tells, and the action that follows."""
    jobs = run_sql(spark, sf_dir, "SELECT host, job_id, ts, status, attempts, CASE attempts WHEN 0 THEN 'fetch_failed' WHEN 1 THEN 'robots_disallowed' WHEN 2 THEN 'pdf_extraction_failed' ELSE 'internal_error' END AS reason FROM jobs")
    told = decisions.observe_job(F.col("status"), F.col("reason"), F.col("attempts") < 5, F.col("attempts") % 3, F.col("attempts") > 0)
    usable = jobs.withColumn("told", told).where("told IS NOT NULL")
    last = latest_by(usable, ["host"], [F.desc("ts"), F.desc("job_id")])
    rows = last.withColumn("row", decisions.classify_source(F.col("told.source"), F.col("told.menu"))).select("host", "job_id", "row.*")
    return rows.withColumn("priority", F.col("priority").cast("long"))


def inbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each nation's inbox: customers are candidates, those over a balance pass the filter."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"))
    c = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count_if(F.col("c_acctbal") > 9900).alias("found"), F.count(F.lit(1)).alias("runs"))
    status = F.when(F.col("nation") % 4 == 0, "failed").when(F.col("nation") % 4 == 1, "partial").otherwise("done")
    state_ = decisions.inbox_state(F.coalesce("runs", F.lit(0)), status, F.coalesce("found", F.lit(0)), F.col("nation") % 2 == 0)
    return n.join(c, "nation", "left").select("nation", state_.alias("s")).select("nation", "s.*")


def host_match_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many owners a page's host has: exactly one, none or several.

    Hosts are whole, and owners are all restaurants: a restaurant's host is that of its number among
    the pages' hosts, where two of three restaurants in a row share one. A page without a host has
    no owner."""
    pages = run_sql(spark, sf_dir, "SELECT page_id, host FROM page_urls")
    hosts = global_rank(pages.where("host <> ''").select("host").distinct(), [F.asc("host")], "nr")
    owners = run_sql(spark, sf_dir, "SELECT CASE WHEN restaurant_id % 3 = 2 THEN restaurant_id - 1 ELSE restaurant_id END AS nr FROM restaurants").groupBy("nr").agg(F.count(F.lit(1)).alias("n"))
    found = pages.join(hosts.join(owners, "nr").select("host", "n"), "host", "left")
    return found.select("page_id", F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "exact").otherwise("multiple").alias("class"))


def source_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is surely the source of the restaurant of its number."""
    p = run_sql(spark, sf_dir, "SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN concat('www.', host, '/menu') WHEN page_id % 3 = 1 THEN url ELSE 'other.example/' END AS website FROM page_urls")
    menu = F.when(F.col("page_id") % 5 == 0, "not_assessed").otherwise("ready_for_review")
    return p.select("page_id", decisions.certainty(F.when(F.col("page_id") % 7 != 0, F.col("page_id")), menu, F.col("page_id") % 11 == 0, F.col("url"), F.col("website")).alias("certainty"))


def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asking for each host's address again gives, by the jobs that it has."""
    jobs = run_sql(spark, sf_dir, "SELECT host, count_if(status IN ('pending', 'running')) AS open, count(*) AS used FROM jobs GROUP BY host")
    url = F.concat(F.when(F.col("host") % 5 == 0, "ftp://h").otherwise("https://h"), F.col("host"), F.lit(".example/menu"))
    return jobs.select("host", decisions.retry_outcome(url, F.col("host") % 7 == 0, F.col("open") > 30, F.col("used"), 100).alias("outcome"))


def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), canonical.content_hash(n, ["n_regionkey", "n_name", "n_nationkey"]).alias("content_hash"))


def single_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one nation of a name, which must be one."""
    n = load(spark, sf_dir, "nation").where("n_name = 'NATION_7'")
    return checked.single_row(n).select(F.col("n_nationkey").cast("long").alias("id"), "n_name")


def offer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 4 == 0, "dish").otherwise("daghap"), F.lit("-r"), F.col("user_id"), F.when(F.col("event_id") % 3 == 0, "-west").otherwise(""), F.lit("-"), F.col("event_id") % 6).alias("key"))
    return e.select(F.col("event_id").cast("long").alias("event_id"), keys.offer_key(F.col("key")).alias("k")).select("event_id", "k.*")


def saved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's clicked sizes as an ordered set of twenty, one of them toggled, and the viewed ones
    added."""
    e = load(spark, sf_dir, "events").where("event_type IN ('click', 'view')").withColumn("k", F.get_json_object("props", "$.k"))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", "k")))), lambda x: x["k"])
    lists = e.groupBy("user_id").agg(of("click").alias("clicked"), of("view").alias("viewed"))
    entries = arrays.ordered_set(F.col("clicked"), 20)
    more = arrays.added(entries, F.col("viewed"), 20)
    return lists.select("user_id", F.array_join(arrays.toggled(entries, F.lit("7"), 20), ",").alias("toggled"), F.array_join(more["entries"], ",").alias("entries"), more["added"].cast("long").alias("added"))


def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("event_type = 'view'").orderBy(F.rand(7)).limit(20).select("event_id")


def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes nested into menus and flattened again, with positional keys."""
    return catalog.flat(catalog.nested(run_sql(spark, sf_dir, "SELECT restaurant_id, meal, category, name, dish_id, price_cents FROM dishes")))


def stream_day_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.drain(counters.day_counters(counters.event_stream(spark, sf_dir)), "complete")


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.drain(counters.throttled(counters.event_stream(spark, sf_dir), 3_600_000_000))


def bag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a = (run_sql(spark, sf_dir, f"SELECT * FROM {v}") for v in ("expected", "actual"))
    return staged_bag_match(e, a, ["source", "line"], [("matched", ["source", "name", "price", "path"]), ("category", ["source", "name", "price"]), ("price", ["source", "name", "path"])], repeats=True)


def bag_match_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_match(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def latest_review_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run_sql(spark, sf_dir, "SELECT * FROM reviews WHERE decided_at IS NOT NULL")
    return latest_by(r, ["candidate_id"], [F.desc("decided_at"), F.desc("id")]).select("candidate_id", "id", "status")


def offer_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an offer made at an event's time expires, as text in UTC."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    kind = F.expr("CASE event_type WHEN 'view' THEN 'daghap' WHEN 'click' THEN 'dagmenu' WHEN 'error' THEN 'x' ELSE 'seizoensgerecht' END")
    day = F.date_add(e["ts"].cast("date"), (F.col("event_id") % 100).cast("int"))
    closes = F.when(F.col("event_id") % 3 != 0, 1200 + F.col("event_id") % 200)
    at = dates.expiry(kind, F.col("ts"), closes, day, F.when(F.col("event_id") % 5 == 0, day))
    return e.select(F.col("event_id").cast("long").alias("event_id"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("expires"))


def confirmation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    x = dates.confirmation(F.col("ts"), F.lit("2024-04-15 10:00:00").cast("timestamp"))
    return e.select(F.col("event_id").cast("long").alias("event_id"), x["active"].alias("active"), x["days_left"].cast("long").alias("days_left"), F.array_join(dates.seasons(F.add_months(F.col("ts").cast("date"), (F.col("event_id") % 12).cast("int"))), ",").alias("seasons"))


def text_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(content.text_problems(F.col("text")), ",").alias("problems"))


def menu_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards by restaurant and meal, a tenth of the price; some prices are missing."""
    rows = run_sql(spark, sf_dir, "SELECT concat_ws('-', CAST(restaurant_id AS STRING), meal) AS menu, category, item_id % 97 = 0 AS uncertain, name, CAST(NULL AS STRING) AS description, CASE WHEN item_id % 41 <> 0 THEN CAST(floor(price_cents / 10) AS BIGINT) END AS cents, item_id % 43 = 0 AS supplement FROM dishes")
    return menus.completeness(rows).select("menu", "ok", F.array_join("reasons", ",").alias("reasons"), "dishes", "priced")


def menu_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the actual rows of a source may replace the expected ones."""
    items = run_sql(spark, sf_dir, "SELECT source AS menu, CASE WHEN name % 50 <> 0 THEN 'q' END AS quote, true AS source_ok FROM actual")
    return menus.replacement(items, run_sql(spark, sf_dir, "SELECT source AS menu, count(*) AS n FROM expected GROUP BY source"))


def place_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restaurants with the candidates of their name, postcode and place; the name of a candidate is that
    of one of a hundred restaurants, behind a word of its kind."""
    r = run_sql(spark, sf_dir, "SELECT restaurant_id, concat('Restaurant Nr ', CAST(restaurant_id AS STRING)) AS name, CASE WHEN restaurant_id % 3 <> 0 THEN concat('Straat 1, ', CAST(4800 + restaurant_id % 90 AS STRING), ' AB Breda') END AS address, lat, lon FROM restaurants")
    c = run_sql(spark, sf_dir, "SELECT candidate_id AS place_id, concat('Café nr. ', CAST(candidate_id % 100 AS STRING)) AS name, address, lat, lon FROM candidates").withColumn("postcode", places.postcode(F.col("address")))
    return places.matched(r, c)


def polygon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in a multipolygon: one with a hole, and a triangle beside it."""
    ring = lambda points: F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in points])
    shape = F.array(F.array(ring(RING), ring(HOLE)), F.array(ring(((4.7, 51.5), (4.703, 51.5), (4.7, 51.503)))))
    c = run_sql(spark, sf_dir, "SELECT candidate_id, lat, lon FROM candidates")
    return c.where(geo.in_multipolygon(F.col("lon"), F.col("lat"), shape)).select("candidate_id")


def triage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = source_workqueue(spark, sf_dir)
    step = places.next_step(F.col("source"), F.col("host") % 9 == 0, F.col("host") % 4 != 0, F.col("host") % 50 != 0)
    return w.select("host", step.alias("next_step"))


def period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four totals of a user's last week: viewed, saved, shared, and votes that were yes."""
    week = "CAST(ts AS DATE) > DATE '2024-01-30' - 7"
    return run_sql(spark, sf_dir, f"SELECT user_id, count_if(event_type = 'view') AS viewed, count_if(event_type = 'purchase') AS saved, count_if(event_type = 'click') AS shared, count_if(event_type IN ('click', 'error') AND value > 50) AS favourite FROM events WHERE {week} GROUP BY user_id")


def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By bucket: how many rows there are, the share that is right, the median amount, errors by kind."""
    l, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    errors = rows.where("l_returnflag <> 'N'").groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    kinds = errors.groupBy("o_orderpriority").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_returnflag", "n"))), lambda x: F.concat_ws(":", x["l_returnflag"], x["n"].cast("string"))), ",").alias("errors"))
    score = rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("right"), F.median("l_quantity").alias("median"))
    return score.join(kinds, "o_orderpriority", "left").select(F.col("o_orderpriority").alias("bucket"), "n", (F.floor(F.col("right") / F.col("n") * 10000 + 0.5) / 10000).alias("ratio"), "median", F.coalesce("errors", F.lit("")).alias("errors"))


def restaurant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.restaurant_fields(load(spark, sf_dir, "pages"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = run_sql(spark, sf_dir, "SELECT page_id, CAST(nr AS BIGINT) AS nr, url, href FROM links")
    return links.select("page_id", "nr", content.resolved("url", "href").alias("link"))


def enqueue_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of batches of page addresses without their queries, against jobs of some of them."""
    pages = run_sql(spark, sf_dir, "SELECT page_id, host, path FROM page_urls")
    url = F.when(F.col("page_id") % 17 == 0, F.lit("no address")).otherwise(F.concat(F.lit("https://"), "host"))
    items = pages.select((F.col("page_id") % 3).alias("batch_id"), F.col("page_id").alias("position"), url.alias("url"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    status = F.expr("CASE page_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'succeeded' ELSE 'failed' END")
    jobs = pages.where("page_id % 4 = 1").select(F.col("page_id").alias("job_id"), F.concat(F.lit("https://"), "host").alias("url"), status.alias("status"), F.lit(99).alias("batch_id"), (F.col("page_id") % 10 == 5).alias("expired"), F.timestamp_add("DAY", -(F.col("page_id") % 12).cast("int"), now).alias("finished_at"))
    return records.enqueue(items, jobs, now).select("batch_id", "position", "url", "outcome", "reused_job_id")


def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.quote_contained(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def quote_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How quotes of five words and more stand in their source that were changed in one of seven ways, by
    the item's number; shorter ones are as they were."""
    ways = (
        F.col("text"), F.regexp_replace("text", " ", " \t "), F.regexp_replace("text", " ", ""), F.regexp_replace("text", " ", ", "), F.concat(F.lit("zzqx "), "text"),
        F.regexp_replace("text", r"^(\S+ \S+) ", "$1 | "), F.regexp_replace("text", r"(?s)^(\S+ \S+) (.*)$", "$2 | $1"),
    )
    long = F.col("text").rlike(r"^\S+ \S+ \S+ \S+ \S+")
    quote = F.coalesce(*[F.when(long & (F.col("item_id") % len(ways) == n), way) for n, way in enumerate(ways)], F.col("text"))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), diagnosis.quote_class(quote, F.col("text")).alias("class"))


def paged_scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a week by type, with a column that their file hasn't yet."""
    events = load(spark, sf_dir, "events")
    rows = checked.with_missing(events, StructType([*events.schema, StructField("added_later", StringType())]))
    rows = rows.where("user_id >= 20 AND event_type <> 'error' AND CAST(ts AS DATE) >= DATE '2024-01-24'")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("added_later").alias("added_later"))


def unknown_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose name, comparable name, core name and host no restaurant has; a candidate's
    name is a restaurant's with another kind of word, for those of a hundred that there are."""
    r = run_sql(spark, sf_dir, "SELECT concat('Restaurant Nr ', CAST(restaurant_id AS STRING)) AS name, website FROM restaurants")
    c = run_sql(spark, sf_dir, "SELECT candidate_id, concat(CASE WHEN candidate_id % 2 = 0 THEN 'Café nr. ' ELSE 'Lokaal Nr ' END, CAST(candidate_id % 150 AS STRING)) AS name, CASE WHEN candidate_id % 7 = 0 THEN concat('http://supplier-', lpad(CAST(candidate_id % 200 AS STRING), 9, '0'), '.example/x') END AS website FROM candidates")
    return records.unknown(c, records.baseline(r)).select("candidate_id")


def duplicate_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of the same kind within 400 metres, with a smaller number."""
    c = run_sql(spark, sf_dir, "SELECT candidate_id, name_key AS name, lat, lon FROM candidates")
    d = c.where("candidate_id % 3 = 0").select(F.col("candidate_id").alias("draft_id"), F.col("candidate_id").alias("ordinal"), "name", "lat", "lon")
    return records.first_duplicate_draft(c, d, 400.0)


def nested_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by place on nested menus: the first item of a first category, or the second one's being
    available."""
    dishes = run_sql(spark, sf_dir, "SELECT restaurant_id, meal, category, name, dish_id, price_cents FROM dishes")
    edits = run_sql(spark, sf_dir, "SELECT concat(CAST(restaurant_id AS STRING), '-N') AS menu_key, 0 AS c, restaurant_id % 2 AS i, CASE WHEN restaurant_id % 2 = 0 THEN 12345 END AS price_cents, CASE WHEN restaurant_id % 2 = 1 THEN false END AS available FROM restaurants WHERE restaurant_id % 3 <> 0")
    edited = menus.overlaid(catalog.nested(dishes), edits.withColumn("price_cents", F.col("price_cents").cast("long")))
    return edited.select(F.explode("categories").alias("c")).select(F.explode("c.items").alias("x")).select("x.dish_id", "x.price_cents", "x.available")


def menu_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories under their meal for every other restaurant; some routes aren't trusted."""
    rows = run_sql(spark, sf_dir, "SELECT DISTINCT concat_ws('-', CAST(restaurant_id AS STRING), meal) AS menu, restaurant_id, meal, category FROM dishes")
    path = F.when(F.col("restaurant_id") % 2 == 0, F.array("meal", "category")).otherwise(F.array("category"))
    sections = rows.select("menu", F.col("category").alias("position"), path.alias("path"), ((F.col("restaurant_id") % 5 == 0) & (F.col("category") == "PROMO")).alias("untrusted"))
    return menus.hierarchy(sections).select("menu", F.col("position").alias("category"), "title", F.array_join("path", "/").alias("path"), "uncertain")


def menu_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT restaurant_id AS menu, category, CASE WHEN item_id % 50 = 0 THEN concat('+ ', name) WHEN item_id % 61 = 0 THEN concat(name, ' // ', category) ELSE concat(name, ' ', CAST(item_id AS STRING)) END AS name, item_id % 401 <> 0 AS priced FROM dishes")
    return menus.item_flags(rows).select("menu", F.array_join("flags", ",").alias("flags"), "ok")


def removed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected lines that the actual ones lack, by name in their path, or anywhere where the path is new."""
    of = lambda v: run_sql(spark, sf_dir, f"SELECT source AS menu, path, concat('Dish ', CAST(name AS STRING)) AS name FROM {v}")
    return menus.removed(of("expected"), of("actual"))


def effective_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_sql(spark, sf_dir, "SELECT candidate_id, address, phone, website FROM candidates")
    e = run_sql(spark, sf_dir, "SELECT candidate_id, CASE id % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'website' ELSE 'address' END AS field, concat('new ', CAST(id AS STRING)) AS value, decided_at AS recorded_at, id FROM reviews WHERE status = 'approved'")
    return records.enriched(c, e)


def inbox_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_sql(spark, sf_dir, "SELECT candidate_id, nation_id AS run_id, name_key AS category, name, candidate_id % 2 = 0 AS possible_duplicate, CASE WHEN phone IS NULL THEN 'poor' ELSE 'good' END AS quality, 'new' AS review FROM candidates")
    return records.inbox(c, category="BUILDING", name="CUSTOMER#", duplicate=True, quality="good", review="new").select("candidate_id")


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of asking for a draft of each candidate, and of some unknown ones."""
    c = run_sql(spark, sf_dir, "SELECT candidate_id, name, name_key AS category, address, phone, website FROM candidates")
    reviews = run_sql(spark, sf_dir, "SELECT candidate_id, decided_at, id, CASE status WHEN 'approved' THEN 'approved_internal' ELSE status END AS status FROM reviews")
    drafts = run_sql(spark, sf_dir, "SELECT concat('old', CAST(candidate_id AS STRING)) AS draft_id, candidate_id, CASE WHEN candidate_id % 5 = 0 THEN 'draft' ELSE 'discarded' END AS status FROM candidates WHERE candidate_id % 2 = 0")
    asked = run_sql(spark, sf_dir, "SELECT concat('d', CAST(candidate_id AS STRING)) AS draft_id, CASE WHEN candidate_id % 50 = 0 THEN -candidate_id - 1 ELSE candidate_id END AS candidate_id, CASE WHEN candidate_id % 3 = 0 THEN concat('old', CAST(candidate_id AS STRING)) END AS restarted_from FROM candidates")
    fixes = run_sql(spark, sf_dir, "SELECT candidate_id, 'phone' AS field, 'x' AS value, decided_at AS recorded_at, id FROM reviews")
    return records.promote(c, reviews, drafts, fixes, asked)[0]


def proposal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT id, CASE WHEN id % 3 = 0 THEN 'accepted' ELSE 'open' END AS status, CAST(NULL AS STRING) AS note, CASE id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'maybe' END AS decision, CASE WHEN id % 5 <> 0 THEN ' why ' ELSE ' ' END AS why, decided_at AS at FROM reviews")
    after = records.decide_proposals(rows.select("id", "status", "note"), rows.select("id", "decision", F.col("why").alias("note"), "at"))[0]
    return after.select("id", "status", "note")


def swept_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of a sweep over purchases that were offers of seven days."""
    e = load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("long").alias("offer_id"), F.when(F.col("event_id") % 4 == 0, "draft").otherwise("online").alias("status"), F.timestamp_add("DAY", F.lit(7), F.col("ts").cast("timestamp")).alias("expires_at"))
    return records.sweep(e, F.lit("2024-01-30 00:00:00").cast("timestamp"))[1].select("offer_id", "before", "after")


def idle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs left when the batches of users that were silent for a day are closed."""
    batches = run_sql(spark, sf_dir, "SELECT host AS batch_id, CASE WHEN host % 4 = 0 THEN max(ts) END AS closed_at, CAST(NULL AS STRING) AS close_reason, max(ts) AS last_activity_at FROM jobs GROUP BY host")
    jobs = run_sql(spark, sf_dir, "SELECT job_id, host AS batch_id, status, CAST(NULL AS TIMESTAMP) AS expired_at, ts AS lease_expires_at FROM jobs")
    _, swept = records.close_idle(batches, jobs, F.lit("2024-01-31 12:00:00").cast("timestamp"))
    return swept.select("job_id", F.col("expired_at").isNotNull().alias("expired"), F.col("lease_expires_at").isNotNull().alias("leased"))


def usage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their rows, twenty of them, and the rest as one."""
    rows = run_sql(spark, sf_dir, "SELECT CAST(event_id % 9000 AS STRING) AS id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'ai_read' ELSE 'manual' END AS kind, CASE WHEN user_id % 7 <> 0 THEN concat('user ', CAST(user_id % 40 AS STRING)) END AS name, CAST(NULL AS STRING) AS provider, CAST(NULL AS STRING) AS model, CAST(event_id AS BIGINT) AS cents, CAST(ts AS TIMESTAMP) AS at FROM events")
    return records.usage_export(rows)[0]


def dish_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Icons of parts that got a dish's word by their number."""
    word = F.element_at(F.array(*map(F.lit, ("Uiensoep", "pizza met kaas", "Biefstuk", "zalm", "groentetaart", "Toast", "kaas", "thee"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("item"), content.dish_icon(F.concat_ws(" ", word, "p_brand"), F.lit("")).alias("icon"))


def price_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT dish_id, concat('€ ', CAST(price_cents DIV 100 AS STRING), CASE WHEN size % 3 = 0 THEN ' per stuk' ELSE '' END) AS price, on_request, price_cents, array('per stuk', 'Per Stuk', CASE WHEN size % 2 = 0 THEN ' met friet ' END) AS notes, multiple FROM dishes")
    return rows.select("dish_id", content.price_label(F.col("price"), F.col("on_request"), F.col("price_cents"), F.col("notes"), F.col("multiple")).alias("label"))


def field_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_sql(spark, sf_dir, "SELECT candidate_id, phone, CASE candidate_id % 3 WHEN 0 THEN 'conflict' WHEN 1 THEN 'consistent' ELSE 'unverified' END AS status FROM candidates")
    return c.select("candidate_id", content.field_confidence(F.col("candidate_id") % 10 != 0, F.col("status"), content.phone(F.col("phone"))["valid"]).alias("confidence"))


def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_sql(spark, sf_dir, "SELECT candidate_id, CASE candidate_id % 4 WHEN 0 THEN concat('+31 ', substr(phone, 2)) WHEN 1 THEN concat('0031(', substr(phone, 2, 2), ') ', substr(phone, 4)) WHEN 2 THEN substr(phone, 2) ELSE concat('06-', substr(phone, 3)) END AS phone FROM candidates")
    return c.select("candidate_id", content.phone(F.col("phone")).alias("p")).select("candidate_id", "p.*")


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").select("page_id", content.canonical_url(F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.upper("url"))).alias("u"))
    return p.select("page_id", "u.url", "u.host")


def feature_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as features, of which some share an id, are of another kind, or lack a place."""
    c = run_sql(spark, sf_dir, "SELECT candidate_id AS ordinal, CASE WHEN candidate_id % 31 <> 0 THEN CAST(candidate_id % 1000 AS STRING) END AS osm_id, CASE WHEN candidate_id % 13 <> 0 THEN lat END AS lat, lon, map('amenity', CASE WHEN candidate_id % 7 = 0 THEN 'bank' ELSE 'bar' END) AS tags FROM candidates")
    ring = lambda points: F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in points])
    return places.classified(c, F.array(F.array(ring(RING), ring(HOLE))))


def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"scheldwoord": ["idiot", "moron", "scum"], "reclame": ["gratis", "free", "1+1"]}
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(content.word_reasons(F.col("text"), words), ",").alias("reasons"))


def shared_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening that most names of a type of part share: its brand."""
    p = load(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.concat("p_brand", F.lit(" - "), "p_name").alias("name"))
    return menus.shared_opening(p, "kind", "name")


def stream_session_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.drain(counters.session_firsts(counters.event_stream(spark, sf_dir)))


CUSTOM = (
    html_extract, html_menu_items, html_plain_text, jsonld_items, price_pairing, line_tones, uncovered_lines, uncovered_summary, coverage_diagnosis, token_reasons, text_windows, quote_nearest, answer_diagnosis,
    mismatch_diagnosis, name_variants, throttle_events, spend_ledger, call_reservations, diversified_pick, random_pick, catalog_round_trip, stream_day_counters, stream_throttle,
    stream_session_firsts, bag_match_frames, latest_review_frames, dish_search_page, dish_search_summary, dish_group_page, restaurant_search_page, daily_seeded_rank, source_workqueue, inbox_states,
    nested_overlay, menu_headings, menu_flags, removed_lines, effective_candidates, inbox_page, promotions, proposal_decisions, swept_offers, idle_batches, usage_names, dish_icons, price_labels, field_certainty, phone_numbers, canonical_urls, feature_classes, word_filter, shared_openings,
    restaurant_fields, resolved_links, enqueue_outcome, quote_containment, quote_class, paged_scan_filters, unknown_candidates, duplicate_drafts, offer_expiry, confirmation_days, text_problems, menu_completeness, menu_replacement, place_match, polygon_hits, triage_steps, period_totals, field_accuracy, source_certainty, host_match_cardinality, single_nation, retry_outcomes, record_hashes, offer_keys, saved_lists,
)
