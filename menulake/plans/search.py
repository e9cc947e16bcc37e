"""Search, browsing, projections and overlays over the catalogue."""

from __future__ import annotations

from menulake.plans.dialect import AS_OF, Dialect, half_up, numbered, plan, share

WHITELIST = "dish_id, restaurant_id, name, category, meal, price_cents"


@plan
def dish_flatten(d: Dialect) -> str:
    return f"SELECT {WHITELIST}, tag, on_request FROM dishes JOIN restaurants USING (restaurant_id)".replace("dish_id, restaurant_id, name,", "dish_id, restaurant_id, dishes.name AS name,")


def tiered(q: str) -> str:
    """Tier 0 exact name, 1 in the name, 2 in the category, 3 in the tag; null is no match."""
    return f"CASE WHEN lower(dishes.name) = '{q}' THEN 0 WHEN contains(lower(dishes.name), '{q}') THEN 1 WHEN contains(lower(category), '{q}') THEN 2 WHEN contains(lower(tag), '{q}') THEN 3 END"


def hits(q: str, more: str = "true") -> str:
    return f"""SELECT dish_id, restaurant_id, dishes.name AS name, restaurants.name AS restaurant, category, meal, price_cents, CAST({tiered(q)} AS BIGINT) AS tier
        FROM dishes JOIN restaurants USING (restaurant_id) WHERE {tiered(q)} IS NOT NULL AND {more}"""


@plan
def dish_search_ranked(d: Dialect) -> str:
    """A page of 20 from the 10th hit, with the total and whether more follow.

    Only the first 30 hits are sorted and numbered; the total is an aggregate of its own."""
    return f"""WITH h AS ({hits('ring')}), top AS (SELECT * FROM h ORDER BY tier, restaurant, name, dish_id LIMIT 30), n AS (SELECT CAST(count(*) AS BIGINT) AS total FROM h)
        SELECT CAST(pos AS BIGINT) AS pos, dish_id, name, restaurant, tier, (SELECT total FROM n) AS total, (SELECT total FROM n) > 30 AS has_more
        FROM (SELECT *, row_number() OVER (ORDER BY tier, restaurant, name, dish_id) AS pos FROM top) r WHERE pos > 10"""


@plan
def dish_search_filters(d: Dialect) -> str:
    """Missing, on-request and several prices pass a price filter; allergens are excluded; open now."""
    return """SELECT dish_id, dishes.name AS name, price_cents FROM dishes JOIN restaurants USING (restaurant_id)
        WHERE (price_cents IS NULL OR on_request OR multiple OR price_cents <= 100000) AND allergen_a NOT IN (1, 7) AND allergen_b NOT IN (1, 7)
        AND (contains(lower(category), 'promo') OR contains(lower(tag), '3')) AND opens <= 720 AND 720 < closes AND meal IN ('A', 'N')"""


@numbered("tier, restaurant, first_name, first_dish", "group_pos")
def dish_search_grouped(d: Dialect) -> str:
    """Per restaurant and menu: hits, three examples, groups in the order of their best hit.

    The groups are numbered, and not the hits."""
    return f"""WITH h AS ({hits('gear')}), g AS (SELECT *, row_number() OVER (PARTITION BY restaurant_id, meal ORDER BY tier, restaurant, name, dish_id) AS k FROM h)
        SELECT restaurant_id, meal, min(tier) AS tier, min(restaurant) AS restaurant, max(CASE WHEN k = 1 THEN name END) AS first_name, max(CASE WHEN k = 1 THEN dish_id END) AS first_dish, CAST(count(*) AS BIGINT) AS n,
        concat_ws('|', max(CASE WHEN k = 1 THEN dish_id END), max(CASE WHEN k = 2 THEN dish_id END), max(CASE WHEN k = 3 THEN dish_id END)) AS examples
        FROM g GROUP BY restaurant_id, meal"""


@plan
def dish_search_weak_match(d: Dialect) -> str:
    return f"SELECT restaurant_id, CAST(count(*) AS BIGINT) AS n, bool_and(tier >= 2) AS weak FROM ({hits('small')}) h GROUP BY restaurant_id"


@plan
def dish_overlay_search(d: Dialect) -> str:
    """The last approved edit of a dish, whatever its kind, applies before the price filter."""
    return f"""WITH edits AS (SELECT CAST(l_suppkey AS BIGINT) AS restaurant_id, CAST(l_partkey AS BIGINT) AS item_id, o_orderdate AS changed, CAST(o_orderkey AS BIGINT) AS edit_id,
        CASE WHEN o_orderkey % 2 = 0 THEN {half_up('l_extendedprice')} END AS new_price, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 3 <> 0 END AS available
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber = 1),
        last_edit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id, item_id ORDER BY changed DESC, edit_id DESC) AS k FROM edits) e WHERE k = 1)
        SELECT dish_id, name, coalesce(new_price, price_cents) AS price_cents, coalesce(available, true) AS available
        FROM dishes LEFT JOIN last_edit USING (restaurant_id, item_id) WHERE coalesce(new_price, price_cents) <= 95000 AND coalesce(available, true)"""


@plan
def active_offer_semi(d: Dialect) -> str:
    """Restaurants with an offer online: not expired, on its weekday, not sold out."""
    return f"""SELECT restaurant_id, name FROM restaurants WHERE restaurant_id IN (SELECT CAST(user_id AS BIGINT) FROM events WHERE event_type = 'purchase'
        AND CAST(ts AS DATE) >= {AS_OF} - 6 AND event_id % 7 + 1 <> {d.weekday(AS_OF)} AND value > 1)"""


@plan
def low_coverage_anti(d: Dialect) -> str:
    return """SELECT restaurant_id, name, buurt FROM restaurants r WHERE cuisine IN ('EUROPE', 'ASIA')
        AND NOT EXISTS (SELECT 1 FROM dishes x WHERE x.restaurant_id = r.restaurant_id AND x.price_cents > 185000)"""


@numbered("tier, name, restaurant_id")
def restaurant_search(d: Dialect) -> str:
    """Tier 0 exact, 1 in the name, 2 in the neighbourhood, 3 in an address that is none but the name."""
    valid = "lower(trim(address)) <> lower(concat(name, ' Breda'))"
    tier = f"CASE WHEN lower(name) = 'ch' THEN 0 WHEN contains(lower(name), '00001') THEN 1 WHEN contains(lower(buurt), 'an') THEN 2 WHEN {valid} AND contains(lower(address), '9') THEN 3 END"
    return f"""SELECT restaurant_id, name, buurt, tier FROM (SELECT *, CAST({tier} AS BIGINT) AS tier FROM restaurants) r WHERE tier IS NOT NULL"""


@plan
def restaurant_token_unique(d: Dialect) -> str:
    """Names whose words of three letters and more hold all of the query's; unique ones are flagged."""
    words = d.keep(d.words("lower(name)", "[^a-z0-9]+"), "w", "length(w) >= 3")
    missing = d.size(d.minus(d.array("'supplier'", "'000000007'"), words))
    return f"WITH h AS (SELECT restaurant_id, name FROM restaurants WHERE {missing} = 0), n AS (SELECT count(*) AS n FROM h) SELECT restaurant_id, name, (SELECT n FROM n) = 1 AS is_unique FROM h"


@plan
def claim_search(d: Dialect) -> str:
    return """SELECT restaurant_id, name, tier FROM (SELECT restaurant_id, name, CAST(CASE WHEN contains(name, '12') THEN 1 WHEN contains(address, '12') THEN 2 END AS BIGINT) AS tier FROM restaurants) r
        WHERE tier IS NOT NULL ORDER BY tier, name, restaurant_id LIMIT 20"""


@numbered("has_menu DESC, name, restaurant_id")
def browse_sort(d: Dialect) -> str:
    return """SELECT r.restaurant_id, r.name, m.restaurant_id IS NOT NULL AS has_menu FROM restaurants r LEFT JOIN (SELECT DISTINCT restaurant_id FROM dishes WHERE price_cents > 180000) m ON r.restaurant_id = m.restaurant_id"""


@plan
def cuisine_histogram(d: Dialect) -> str:
    return "SELECT cuisine, n, CAST(row_number() OVER (ORDER BY n DESC, cuisine) AS BIGINT) AS pos FROM (SELECT cuisine, CAST(count(*) AS BIGINT) AS n FROM restaurants GROUP BY cuisine) c"


@plan
def cuisine_family(d: Dialect) -> str:
    """Several families are united; a family is any of its words."""
    return "SELECT dish_id, name FROM dishes WHERE contains(lower(category), 'promo') OR contains(lower(category), 'small') OR contains(lower(category), 'large')"


@plan
def public_projection(d: Dialect) -> str:
    return "SELECT restaurant_id, name, buurt, cuisine, website FROM restaurants"


@plan
def restaurant_index(d: Dialect) -> str:
    return """SELECT r.restaurant_id, r.name, CASE WHEN lower(trim(address)) <> lower(concat(r.name, ' Breda')) THEN address END AS address, m.n IS NOT NULL AS has_menu, coalesce(m.n, 0) AS dishes
        FROM restaurants r LEFT JOIN (SELECT restaurant_id, CAST(count(*) AS BIGINT) AS n FROM dishes GROUP BY restaurant_id) m ON r.restaurant_id = m.restaurant_id"""


@plan
def recognised_lines(d: Dialect) -> str:
    """Positional ids menu.category.item, from 0 in the order of names."""
    return """SELECT concat(CAST(restaurant_id AS STRING), '/', meal, '.', CAST(c AS STRING), '.', CAST(i AS STRING)) AS line_id, dish_id, category FROM (
        SELECT *, dense_rank() OVER (PARTITION BY restaurant_id, meal ORDER BY category) - 1 AS c, row_number() OVER (PARTITION BY restaurant_id, meal, category ORDER BY name, dish_id) - 1 AS i FROM dishes) t"""


@plan
def section_summary(d: Dialect) -> str:
    """Sections by first appearance, with items and those without a sure price."""
    return """SELECT restaurant_id, category, CAST(min(item_id) AS BIGINT) AS first_item, CAST(count(*) AS BIGINT) AS items, CAST(count_if(on_request OR multiple) AS BIGINT) AS uncertain
        FROM dishes GROUP BY restaurant_id, category"""


@plan
def live_lines_prefix(d: Dialect) -> str:
    return "SELECT dish_id, name, price_cents FROM dishes WHERE dish_id LIKE '7-%'"


@plan
def tonight_candidates(d: Dialect) -> str:
    """Main dishes with one real price, their meal moment and whether they are new."""
    no_main = d.matches("lower(category)", "brushed|plated") + " OR " + d.matches("lower(category)", "^small ")
    return f"""SELECT dish_id, name, price_cents, CASE WHEN {d.matches('lower(name)', 'hot|red')} THEN 'grill' WHEN {d.matches('lower(name)', 'green|blue')} THEN 'leaf' ELSE 'plate' END AS icon,
        CASE WHEN size % 24 * 60 < 660 THEN 'breakfast' WHEN size % 24 * 60 < 960 THEN 'lunch' ELSE 'dinner' END AS moment
        FROM dishes WHERE NOT on_request AND NOT multiple AND price_cents > 0 AND NOT ({no_main})"""


@plan
def open_during(d: Dialect) -> str:
    return "SELECT restaurant_id, name FROM restaurants WHERE opens < 1200 AND closes > 1170"


@plan
def opening_state(d: Dialect) -> str:
    return """SELECT restaurant_id, CASE WHEN opens IS NULL THEN 'unknown' WHEN restaurant_id % 9 = 0 THEN 'closed-today' WHEN 700 < opens THEN 'later' WHEN 700 < closes THEN 'open' ELSE 'closed-now' END AS state FROM restaurants"""


@plan
def saved_list_resolve(d: Dialect) -> str:
    """Saved dish ids in order, each once; unknown ones are skipped and counted."""
    return """WITH saved AS (SELECT concat(CAST(event_id % 100 + 1 AS STRING), '-N-', CAST(event_id * 7 % 2000 + 1 AS STRING)) AS dish_id, event_id AS ord FROM events WHERE event_type = 'view'),
        firsts AS (SELECT dish_id, CAST(min(ord) AS BIGINT) AS ord FROM saved GROUP BY dish_id),
        n AS (SELECT CAST(count(*) AS BIGINT) AS skipped FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM dishes x WHERE x.dish_id = f.dish_id))
        SELECT f.dish_id, f.ord, x.name, x.price_cents, (SELECT skipped FROM n) AS skipped, x.dish_id IS NOT NULL AS known FROM firsts f LEFT JOIN dishes x ON f.dish_id = x.dish_id"""


@plan
def dish_key_parts(d: Dialect) -> str:
    key = "^([0-9]+)-([A-Z])-([0-9]+)$"
    return f"SELECT dish_id, CAST({d.extract('dish_id', key, 1)} AS BIGINT) AS restaurant, {d.extract('dish_id', key, 2)} AS meal, CAST({d.extract('dish_id', key, 3)} AS BIGINT) AS item FROM dishes"


@plan
def menu_tabs(d: Dialect) -> str:
    """Tabs in the fixed order N, A, R, then as found."""
    return """SELECT restaurant_id, meal, CAST(row_number() OVER (PARTITION BY restaurant_id ORDER BY CASE meal WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS BIGINT) AS pos
        FROM (SELECT DISTINCT restaurant_id, meal FROM dishes) m"""


@plan
def option_list(d: Dialect) -> str:
    return "SELECT buurt, CAST(row_number() OVER (ORDER BY buurt) AS BIGINT) AS pos FROM (SELECT DISTINCT buurt FROM restaurants) b"


@plan
def money_format(d: Dialect) -> str:
    """Cents as printed, in whole units without decimals, and an honest label."""
    euros = "CAST(floor(price_cents / 100) AS BIGINT)"
    shown = f"CASE WHEN price_cents % 100 = 0 THEN concat(CAST({euros} AS STRING), ',-') ELSE concat(CAST({euros} AS STRING), ',', lpad(CAST(price_cents % 100 AS STRING), 2, '0')) END"
    return f"SELECT dish_id, {shown} AS shown, CASE WHEN on_request THEN 'op aanvraag' WHEN multiple THEN concat('vanaf ', {shown}) ELSE {shown} END AS label FROM dishes"


@plan
def overlay_nested(d: Dialect) -> str:
    """An edit by position inside a menu; other items stay as they are."""
    return """WITH numbered AS (SELECT dish_id, restaurant_id, category, price_cents, row_number() OVER (PARTITION BY restaurant_id, category ORDER BY dish_id) - 1 AS i FROM dishes)
        SELECT dish_id, CASE WHEN i = 0 AND restaurant_id % 3 = 0 THEN price_cents + 100 ELSE price_cents END AS price_cents, NOT (i = 1 AND restaurant_id % 5 = 0) AS available FROM numbered"""


@plan
def hierarchy_prefix(d: Dialect) -> str:
    """A first word that all categories of a menu share is lifted to its title."""
    first = d.extract("category", "^([A-Z]+)", 1)
    return f"""WITH c AS (SELECT DISTINCT restaurant_id, meal, category, {first} AS head FROM dishes), m AS (SELECT restaurant_id, meal, count(DISTINCT head) AS heads, count(*) AS n, min(head) AS head FROM c GROUP BY restaurant_id, meal)
        SELECT c.restaurant_id, c.meal, c.category, CASE WHEN heads = 1 AND n > 1 THEN m.head END AS lifted FROM c JOIN m ON c.restaurant_id = m.restaurant_id AND c.meal = m.meal"""


@plan
def group_headings(d: Dialect) -> str:
    """Head words that change between consecutive categories."""
    first = d.extract("category", "^([A-Z]+)", 1)
    return f"""SELECT restaurant_id, category, head FROM (SELECT *, lag(head) OVER (PARTITION BY restaurant_id ORDER BY category) AS before FROM (SELECT DISTINCT restaurant_id, category, {first} AS head FROM dishes) c) x WHERE before IS NULL OR before <> head"""


@plan
def coverage_hint(d: Dialect) -> str:
    return """SELECT r.cuisine, CAST(count(*) AS BIGINT) AS relevant, CAST(count_if(m.restaurant_id IS NULL) AS BIGINT) AS missing
        FROM restaurants r LEFT JOIN (SELECT DISTINCT restaurant_id FROM dishes WHERE price_cents > 185000) m ON r.restaurant_id = m.restaurant_id GROUP BY r.cuisine"""


@plan
def price_share(d: Dialect) -> str:
    return f"SELECT restaurant_id, {share('count_if(NOT on_request)', 'count(*)')} AS priced_pct FROM dishes GROUP BY restaurant_id"


@numbered("n DESC, dish_key")
def sorted_report(d: Dialect) -> str:
    """A stable sort by one column and direction: ties keep the order of ids."""
    return "SELECT dish_key, CAST(sum(saved) AS BIGINT) AS n FROM counters GROUP BY dish_key"


@plan
def cuisine_tokens(d: Dialect) -> str:
    """Words of a cuisine string without stop words, synonyms mapped, each once."""
    words = d.keep(d.each(d.words("lower(p_type)", "[^a-z]+"), "w", "CASE w WHEN 'plated' THEN 'coated' WHEN 'brushed' THEN 'coated' ELSE w END"), "w", "w NOT IN ('standard', 'small')")
    return f"SELECT p_partkey AS item, {d.join(d.distinct(words) if d.spark else f'list_sort({d.distinct(words)})', ',') if not d.spark else d.join(d.sort(d.distinct(words)), ',')} AS tokens FROM part"
