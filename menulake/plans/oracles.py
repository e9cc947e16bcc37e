"""SQL for DuckDB of queries that Spark builds from DataFrame operators, written apart from them."""

from __future__ import annotations

from menulake.plans.matching import inside

_DISHES = """SELECT dish_id, dishes.name AS name, restaurants.name AS restaurant, restaurant_id, cuisine,
    CASE WHEN lower(dishes.name) = '{q}' THEN 0 WHEN contains(lower(dishes.name), '{q}') THEN 1 WHEN contains(lower(category), '{q}') THEN 2 WHEN contains(lower(tag), '{q}') THEN 3 END AS tier
    FROM dishes JOIN restaurants USING (restaurant_id)"""
_FILTERED = _DISHES.format(q="ring") + " WHERE meal = 'N' AND (price_cents IS NULL OR on_request OR multiple OR price_cents <= 150000) AND allergen_a NOT IN (1, 7) AND allergen_b NOT IN (1, 7)"

_CARDS = "SELECT restaurant_id AS source_id, item_id, name || ' ' || translate(lpad(CAST(item_id AS STRING), 7, '0'), '0123456789', 'abcdefghij') AS label, category AS section, CAST(floor(price_cents / 10) AS BIGINT) AS price FROM dishes"
_TONES = f"""SELECT source_id, label AS name, CASE WHEN item_id % 4 <> 0 THEN CASE WHEN item_id % 7 = 0 THEN 'price_mismatch' ELSE 'covered' END WHEN item_id % 11 = 0 OR item_id % 13 = 0 THEN 'not_dish' ELSE 'uncovered' END AS tone,
    CASE WHEN item_id % 4 <> 0 THEN item_id END AS item_id, item_id % 5 = 0 AS paired FROM ({_CARDS}) c"""

# typographic quotes, dashes and the hard space as plain ones
_EVIDENCE = "trim(regexp_replace(lower(translate(text, chr(8216) || chr(8217) || chr(8218) || chr(8242) || chr(8220) || chr(8221) || chr(8222) || chr(8243) || chr(8211) || chr(8212) || chr(160), repeat(chr(39), 4) || repeat(chr(34), 4) || '-- ')), '\\s+', ' ', 'g'))"
_NOW = "CAST(ts AS TIMESTAMP)"
_TODAY = f"CAST(timezone('Europe/Amsterdam', timezone('UTC', {_NOW})) AS DATE)"
_UNTIL = f"(CAST({_NOW} AS DATE) + CAST(event_id % 100 AS INTEGER))"
_SHUT = "CASE WHEN event_id % 3 <> 0 THEN 1200 + event_id % 200 ELSE 1439 END"


def _instant(day: str, minute: str) -> str:
    return f"strftime(timezone('UTC', timezone('Europe/Amsterdam', CAST({day} AS TIMESTAMP) + to_minutes(CAST({minute} AS BIGINT)))), '%Y-%m-%d %H:%M')"


ORACLES = {
    "offer_expiry": f"""SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN {_UNTIL} - {_TODAY} BETWEEN 0 AND 90 THEN {_instant(_UNTIL, _SHUT)} END WHEN event_type IN ('view', 'click') THEN {_instant(_TODAY, _SHUT)}
        WHEN event_type <> 'error' AND {_UNTIL} - {_TODAY} BETWEEN 0 AND 90 THEN {_instant(_UNTIL, '1439')} END AS expires FROM events""",
    "confirmation_days": """WITH e AS (SELECT CAST(event_id AS BIGINT) AS event_id, epoch_us(CAST(ts AS TIMESTAMP)) + 90 * 86400000000 - epoch_us(TIMESTAMP '2024-04-15 10:00:00') AS rest, month(CAST(CAST(ts AS TIMESTAMP) AS DATE) + to_months(CAST(event_id % 12 AS INTEGER))) AS m FROM events)
        SELECT event_id, rest > 0 AS active, CAST(CASE WHEN rest > 0 THEN ceil(rest / 86400000000) ELSE 0 END AS BIGINT) AS days_left,
        concat_ws(',', CASE WHEN m IN (4, 5, 6) THEN 'asperges' END, CASE WHEN m >= 9 OR m <= 3 THEN 'mosselen' END, CASE WHEN m >= 10 THEN 'wild' END, CASE WHEN m BETWEEN 9 AND 11 THEN 'pompoen' END) AS seasons FROM e""",
    "menu_completeness": """WITH d AS (SELECT restaurant_id || '-' || meal AS menu, item_id, name, category, CASE WHEN item_id % 41 <> 0 THEN floor(price_cents / 10) END AS cents FROM dishes),
        r AS (SELECT menu, category, lower(name) AS k, coalesce(CAST(cents AS STRING), 'x') AS c, count(*) AS n FROM d GROUP BY ALL), x AS (SELECT menu, sum(n - 1) AS repeats FROM r GROUP BY menu),
        g AS (SELECT menu, count(*) AS dishes, count(cents) AS priced, count_if(item_id % 97 = 0) AS unsure, count_if((cents < 100 OR cents > 15000) AND item_id % 43 <> 0) AS odd FROM d GROUP BY menu),
        t AS (SELECT menu, dishes, priced, concat_ws(',', CASE WHEN unsure > 0 THEN 'uncertain_sections' END, CASE WHEN priced < dishes THEN 'unpriced_dishes' END, CASE WHEN odd > 0 THEN 'price_out_of_bounds' END, CASE WHEN repeats > 0 THEN 'duplicate_dishes' END, CASE WHEN dishes < 8 THEN 'too_few_dishes' END) AS reasons FROM g JOIN x USING (menu))
        SELECT menu, reasons = '' AS ok, reasons, CAST(dishes AS BIGINT) AS dishes, CAST(priced AS BIGINT) AS priced FROM t""",
    "menu_replacement": """SELECT e.source AS menu, CASE WHEN coalesce(found, 0) = 0 THEN 'no_items' WHEN found < ceil(n * 0.8) THEN 'coverage_below' WHEN bare > 0 THEN 'missing_evidence' ELSE 'ok' END AS reason
        FROM (SELECT source, count(*) AS n FROM expected GROUP BY source) e LEFT JOIN (SELECT source, count(*) AS found, count_if(name % 50 = 0) AS bare FROM actual GROUP BY source) a ON a.source = e.source""",
    "place_match": """WITH p AS (SELECT r.restaurant_id, r.restaurant_id % 3 = 0 OR regexp_extract(c.address, '([0-9]{4})ab$', 1) = CAST(4800 + r.restaurant_id % 90 AS STRING) AS post, c.candidate_id,
        2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - r.lon) / 2), 2)))) <= 150 AS near FROM restaurants r JOIN candidates c ON c.candidate_id % 100 = r.restaurant_id),
        n AS (SELECT restaurant_id, count_if(coalesce(post, false)) AS posts, count_if(coalesce(post, false) AND near) AS rest, min(CASE WHEN post AND near THEN candidate_id END) AS place FROM p GROUP BY restaurant_id)
        SELECT r.restaurant_id, CASE WHEN rest = 1 THEN place END AS place_id, CASE WHEN posts IS NULL THEN 'no_name_match' WHEN posts = 0 THEN 'postcode_mismatch' WHEN rest = 0 THEN 'too_far' WHEN rest > 1 THEN 'several' ELSE 'exact' END AS reason FROM restaurants r LEFT JOIN n ON n.restaurant_id = r.restaurant_id""",
    "resolved_links": "SELECT page_id, CAST(nr AS BIGINT) AS nr, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS link FROM links",
    "enqueue_outcome": """WITH i AS (SELECT page_id % 3 AS batch_id, page_id AS position, CASE WHEN page_id % 17 <> 0 AND host <> '' THEN 'https://' || host END AS url FROM page_urls), n AS (SELECT *, row_number() OVER (PARTITION BY batch_id, url ORDER BY position) AS k FROM i),
        j AS (SELECT page_id AS job_id, 'https://' || host AS url, page_id % 5 AS s, page_id % 12 AS age, page_id % 10 = 5 AS expired FROM page_urls WHERE page_id % 4 = 1),
        r AS (SELECT url, arg_max(job_id, -age * 1000000 + job_id) AS job FROM j WHERE s = 1 AND age <= 7 GROUP BY url), t AS (SELECT n.*, job, EXISTS (SELECT 1 FROM j WHERE j.url = n.url AND s = 0 AND NOT expired) AS active FROM n LEFT JOIN r ON r.url = n.url),
        o AS (SELECT *, CASE WHEN url IS NULL THEN 'invalid' WHEN k > 1 THEN 'duplicate' WHEN active THEN 'already_active' WHEN job IS NOT NULL THEN 'recent' ELSE 'queued' END AS outcome FROM t)
        SELECT batch_id, position, url, outcome, CASE WHEN outcome = 'recent' THEN job END AS reused_job_id FROM o""",
    "unknown_candidates": """SELECT candidate_id FROM candidates c WHERE NOT (candidate_id % 2 = 0 AND EXISTS (SELECT 1 FROM restaurants r WHERE r.restaurant_id = c.candidate_id % 150))
        AND NOT (candidate_id % 7 = 0 AND EXISTS (SELECT 1 FROM restaurants r WHERE r.website LIKE '%supplier-' || lpad(CAST(c.candidate_id % 200 AS STRING), 9, '0') || '.example'))""",
    "duplicate_drafts": """SELECT a.candidate_id, min(b.candidate_id) AS draft_id FROM candidates a JOIN candidates b ON a.name_key = b.name_key AND b.candidate_id % 3 = 0
        AND 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 400 GROUP BY a.candidate_id""",
    "quote_containment": f"SELECT CAST(item_id AS BIGINT) AS item_id, doc_id FROM (SELECT item_id, {_EVIDENCE} AS quote FROM benchmark) q JOIN (SELECT doc_id, {_EVIDENCE} AS body FROM documents) d ON contains(body, quote) WHERE quote <> ''",
    "quote_class": "SELECT CAST(item_id AS BIGINT) AS item_id, CASE WHEN regexp_matches(text, '^\\S+ \\S+ \\S+ \\S+ \\S+') THEN ['present', 'present', 'whitespace_only', 'changed_characters', 'invented_text', 'added_separator', 'merged_lines'][item_id % 7 + 1] ELSE 'present' END AS class FROM benchmark",
    "paged_scan_filters": "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS STRING) AS added_later FROM events WHERE user_id >= 20 AND event_type <> 'error' AND CAST(ts AS DATE) >= DATE '2024-01-24' GROUP BY event_type",
    "nested_overlay": """WITH p AS (SELECT *, dense_rank() OVER (PARTITION BY restaurant_id, meal ORDER BY category) - 1 AS c, row_number() OVER (PARTITION BY restaurant_id, meal, category ORDER BY name, dish_id, price_cents) - 1 AS i FROM dishes),
        q AS (SELECT *, meal = 'N' AND restaurant_id % 3 <> 0 AND c = 0 AND i = restaurant_id % 2 AS hit FROM p)
        SELECT dish_id, CAST(CASE WHEN hit AND i = 0 THEN 12345 ELSE price_cents END AS BIGINT) AS price_cents, NOT (hit AND i = 1) AS available FROM q""",
    "menu_headings": """SELECT DISTINCT restaurant_id || '-' || meal AS menu, category, CASE WHEN restaurant_id % 2 = 0 THEN meal END AS title, category AS path, restaurant_id % 5 = 0 AND category = 'PROMO' AS uncertain FROM dishes""",
    "menu_flags": """SELECT restaurant_id AS menu, concat_ws(',', CASE WHEN count_if(item_id % 50 <> 0 AND item_id % 61 = 0) > 0 THEN 'section_marker' END, CASE WHEN count_if(item_id % 50 = 0) > 0 THEN 'supplement_as_item' END, CASE WHEN count_if(item_id % 401 = 0) > 0 THEN 'unresolved_price' END,
        CASE WHEN bool_or(twice) THEN 'duplicate_in_category' END) AS flags, count_if(item_id % 50 = 0 OR item_id % 61 = 0 OR item_id % 401 = 0) = 0 AS ok
        FROM (SELECT *, count(*) OVER (PARTITION BY restaurant_id, category, CASE WHEN item_id % 50 = 0 OR item_id % 61 = 0 THEN lower(name) || CASE WHEN item_id % 50 <> 0 THEN lower(category) ELSE '' END ELSE name || item_id END) > 1 AS twice FROM dishes) x GROUP BY restaurant_id""",
    "removed_lines": """SELECT source AS menu, path, 'Dish ' || name AS name FROM expected e WHERE CASE WHEN EXISTS (SELECT 1 FROM actual a WHERE a.source = e.source AND a.path = e.path) THEN NOT EXISTS (SELECT 1 FROM actual a WHERE a.source = e.source AND a.path = e.path AND a.name = e.name)
        ELSE NOT EXISTS (SELECT 1 FROM actual a WHERE a.source = e.source AND a.name = e.name) END""",
    "effective_candidates": """WITH l AS (SELECT candidate_id, id % 3 AS f, arg_max(id, CAST(epoch_us(decided_at) AS HUGEINT) * 1000000 + id) AS id FROM reviews WHERE status = 'approved' GROUP BY ALL)
        SELECT c.candidate_id, coalesce('new ' || a.id, address) AS address, coalesce('new ' || p.id, phone) AS phone, coalesce('new ' || w.id, website) AS website FROM candidates c LEFT JOIN l a ON a.candidate_id = c.candidate_id AND a.f = 2 LEFT JOIN l p ON p.candidate_id = c.candidate_id AND p.f = 0 LEFT JOIN l w ON w.candidate_id = c.candidate_id AND w.f = 1""",
    "inbox_page": "SELECT candidate_id FROM candidates WHERE name_key = 'BUILDING' AND name ILIKE '%customer#%' AND candidate_id % 2 = 0 AND phone IS NOT NULL",
    "promotions": """WITH s AS (SELECT candidate_id, arg_max(status, CAST(epoch_us(decided_at) AS HUGEINT) * 1000000 + id) AS status FROM reviews GROUP BY candidate_id)
        SELECT 'd' || c.candidate_id AS draft_id, CASE WHEN c.candidate_id % 50 = 0 THEN -c.candidate_id - 1 ELSE c.candidate_id END AS candidate_id, CASE WHEN c.candidate_id % 50 = 0 THEN 'not_found' WHEN coalesce(status, '') <> 'approved' THEN 'not_approved'
        WHEN c.candidate_id % 10 = 0 THEN 'already_active' WHEN c.candidate_id % 3 = 0 AND c.candidate_id % 2 = 1 THEN 'bad_restart' ELSE 'promoted' END AS outcome FROM candidates c LEFT JOIN s ON s.candidate_id = c.candidate_id""",
    "proposal_decisions": """SELECT id, CASE WHEN id % 3 = 0 THEN 'accepted' WHEN id % 4 = 0 THEN 'accepted' WHEN id % 4 = 1 AND id % 5 <> 0 THEN 'rejected' ELSE 'open' END AS status, CASE WHEN id % 3 <> 0 AND id % 4 < 2 AND id % 5 <> 0 THEN 'why' END AS note FROM reviews""",
    "swept_offers": "SELECT CAST(event_id AS BIGINT) AS offer_id, 'online' AS before, 'expired' AS after FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0 AND CAST(ts AS TIMESTAMP) <= TIMESTAMP '2024-01-23 00:00:00'",
    "idle_batches": """SELECT job_id, hit AS expired, NOT hit AS leased FROM (SELECT job_id, host % 4 <> 0 AND status IN ('pending', 'running') AND max(ts) OVER (PARTITION BY host) < TIMESTAMP '2024-01-30 12:00:00' AS hit FROM jobs) x""",
    "usage_names": """WITH u AS (SELECT event_id % 9000 AS id, CASE event_type WHEN 'view' THEN 'ai_read' ELSE 'manual' END AS kind, CASE WHEN user_id % 7 <> 0 THEN 'user ' || user_id % 40 END AS name, event_id, ts FROM events WHERE event_type <> 'error'),
        f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, kind, name NULLS FIRST, event_id) AS k FROM u), n AS (SELECT name, count(*) AS concepts FROM f WHERE k = 1 AND name IS NOT NULL GROUP BY name), r AS (SELECT *, row_number() OVER (ORDER BY concepts DESC, name) AS pos FROM n)
        SELECT CASE WHEN pos <= 20 THEN name END AS name, CAST(sum(concepts) AS BIGINT) AS concepts, CAST(count(*) AS BIGINT) AS names FROM r GROUP BY CASE WHEN pos <= 20 THEN name END""",
    "dish_icons": "SELECT CAST(p_partkey AS BIGINT) AS item, ['🍲', '🍕', '🍖', '🐟', '🥗', '🥪', '🧀', '🍽️'][p_partkey % 8 + 1] AS icon FROM part",
    "price_labels": """SELECT dish_id, CASE WHEN NOT on_request THEN CASE WHEN multiple THEN 'vanaf ' ELSE '' END || '€ ' || (price_cents // 100) || CASE WHEN size % 3 = 0 THEN ' per stuk' ELSE ' · per stuk' END || CASE WHEN size % 2 = 0 THEN ' · met friet' ELSE '' END END AS label FROM dishes""",
    "field_certainty": "SELECT candidate_id, CASE WHEN candidate_id % 10 = 0 THEN 'middel' WHEN candidate_id % 3 = 0 THEN 'laag' WHEN candidate_id % 3 = 1 AND phone IS NOT NULL THEN 'hoog' ELSE 'middel' END AS confidence FROM candidates",
    "phone_numbers": """WITH n AS (SELECT candidate_id, substr(phone, 2) AS nine, candidate_id % 4 AS w FROM candidates), m AS (SELECT candidate_id, nine, w, CASE w WHEN 3 THEN '6' || substr(nine, 2) ELSE nine END AS own FROM n)
        SELECT candidate_id, CASE WHEN w = 2 THEN nine ELSE '+31' || own END AS normalized, CASE WHEN w = 2 THEN nine WHEN own LIKE '6%' THEN '06 ' || substr(own, 2) ELSE '0' || own END AS display, nine IS NOT NULL AND w <> 2 AS valid FROM m""",
    "canonical_urls": """WITH u AS (SELECT page_id, upper(url) AS u FROM pages WHERE page_id % 9 <> 0), x AS (SELECT page_id, regexp_extract(u, '^(HTTPS?)://', 1) AS s, lower(regexp_extract(u, '^HTTPS?://([^/?#:]+)', 1)) AS h, regexp_extract(u, '^HTTPS?://[^/?#]+([^?#]*)', 1) AS p FROM u)
        SELECT p.page_id, lower(s) || '://' || h || CASE WHEN x.p = '' THEN '/' ELSE x.p END AS url, h AS host FROM pages p LEFT JOIN x ON x.page_id = p.page_id""",
    "feature_classes": f"""WITH f AS (SELECT candidate_id AS ordinal, CASE WHEN candidate_id % 31 <> 0 THEN CAST(candidate_id % 1000 AS STRING) END AS osm_id, candidate_id % 7 <> 0 AND candidate_id % 13 <> 0 AS sound, lat, lon FROM candidates), m AS (SELECT *, min(CASE WHEN sound THEN ordinal END) OVER (PARTITION BY osm_id) AS first_ FROM f),
        r AS (SELECT *, CASE WHEN osm_id IS NULL THEN 'missing-osm-id' WHEN ordinal > first_ THEN 'duplicate-osm-node-id' WHEN ordinal % 7 = 0 THEN 'amenity-not-allowed' WHEN ordinal % 13 = 0 THEN 'non-numeric-coordinates' END AS error, {inside('lon', 'lat')} AS within FROM m)
        SELECT ordinal, osm_id, CASE WHEN error IS NOT NULL THEN 'errored' WHEN within THEN 'stored' ELSE 'skipped' END AS outcome, CASE WHEN error IS NOT NULL THEN error WHEN NOT within THEN 'outside-boundary' END AS reason FROM r""",
    "word_filter": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(strip_accents(lower(text)), '(^|[^\\p{{L}}\\p{{N}}]){w.replace('+', '[+]')}([^\\p{{L}}\\p{{N}}]|$)') THEN '{g}:{w}' END" for g, w in (("scheldwoord", "idiot"), ("scheldwoord", "moron"), ("scheldwoord", "scum"), ("reclame", "gratis"), ("reclame", "free"), ("reclame", "1+1"))) + ", CASE WHEN contains(text, '%') THEN 'reclame:%' END) AS reasons FROM documents",
    "shared_openings": """WITH n AS (SELECT p_type AS kind, p_brand || ' - ' AS opening, count(DISTINCT p_name) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_name) > 1)
        SELECT kind, opening, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, length(opening) DESC, opening) AS k FROM n) r WHERE k = 1""",
    "polygon_hits": f"SELECT candidate_id FROM candidates WHERE {inside('lon', 'lat')} OR (lon >= 4.7 AND lat >= 51.5 AND (lon - 4.7) + (lat - 51.5) < 0.003)",
    "period_totals": """SELECT user_id, CAST(count_if(event_type = 'view') AS BIGINT) AS viewed, CAST(count_if(event_type = 'purchase') AS BIGINT) AS saved, CAST(count_if(event_type = 'click') AS BIGINT) AS shared,
        CAST(count_if(event_type IN ('click', 'error') AND value > 50) AS BIGINT) AS favourite FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-24' GROUP BY user_id""",
    "field_accuracy": """WITH j AS (SELECT o_orderpriority AS bucket, l_returnflag AS flag, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT bucket, string_agg(flag || ':' || n, ',' ORDER BY flag) AS errors FROM (SELECT bucket, flag, count(*) AS n FROM j WHERE flag <> 'N' GROUP BY ALL) x GROUP BY bucket)
        SELECT j.bucket, CAST(count(*) AS BIGINT) AS n, floor(CAST(count_if(flag = 'N') AS DOUBLE) / count(*) * 10000 + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS ratio, median(l_quantity) AS median, coalesce(any_value(errors), '') AS errors FROM j LEFT JOIN e ON e.bucket = j.bucket GROUP BY j.bucket""",
    "price_pairing": f"SELECT source_id, section, label AS name, price, item_id % 5 = 0 AS paired, false AS loose FROM ({_CARDS}) c",
    "line_tones": f"SELECT source_id, name, tone, item_id FROM ({_TONES}) t",
    "uncovered_summary": f"SELECT count(*) > 0 AS available, CAST(count_if(tone = 'uncovered') AS BIGINT) AS total, CAST(least(count_if(tone = 'uncovered'), 200) AS BIGINT) AS shown, CAST(greatest(count_if(tone = 'uncovered') - 200, 0) AS BIGINT) AS omitted FROM ({_TONES}) t",
    "coverage_diagnosis": f"""SELECT source_id, CAST(count(*) AS BIGINT) AS lines, CAST(count_if(tone = 'covered') AS BIGINT) AS covered, CAST(count_if(tone = 'price_mismatch') AS BIGINT) AS price_mismatch, CAST(count_if(tone = 'not_dish') AS BIGINT) AS not_dish,
        CAST(count_if(tone = 'uncovered') AS BIGINT) AS uncovered, CAST(count_if(paired) AS BIGINT) AS paired, CAST(0 AS BIGINT) AS loose FROM ({_TONES}) t GROUP BY source_id""",
    "dish_search_page": f"""WITH h AS ({_FILTERED}), r AS (SELECT *, row_number() OVER (ORDER BY tier, restaurant, name, dish_id) AS pos FROM h WHERE tier IS NOT NULL)
        SELECT CAST(pos AS BIGINT) AS pos, dish_id, name, restaurant, CAST(tier AS BIGINT) AS tier FROM r WHERE pos BETWEEN 11 AND 20""",
    "dish_search_summary": f"""WITH h AS ({_FILTERED}), n AS (SELECT count(*) AS total FROM h WHERE tier IS NOT NULL)
        SELECT CAST(total AS BIGINT) AS total, total > 20 AS has_more, CAST(CASE WHEN total > 20 THEN 20 END AS BIGINT) AS next_cursor FROM n""",
    "dish_group_page": f"""WITH h AS ({_DISHES.format(q='gear')} WHERE contains(lower(cuisine), 'asia') OR contains(lower(cuisine), 'europe')),
        g AS (SELECT restaurant_id, restaurant, count(*) AS n, min(tier) AS tier FROM h WHERE tier IS NOT NULL GROUP BY restaurant_id, restaurant), r AS (SELECT *, row_number() OVER (ORDER BY tier, restaurant, restaurant_id) AS pos FROM g)
        SELECT CAST(pos AS BIGINT) AS pos, restaurant_id, restaurant, CAST(n AS BIGINT) AS n FROM r WHERE pos BETWEEN 2 AND 6""",
    "restaurant_search_page": """WITH t AS (SELECT restaurant_id, name AS restaurant, CASE WHEN lower(name) = '1' THEN 0 WHEN contains(lower(name), '1') THEN 1 WHEN contains(lower(buurt), '1') THEN 2
        WHEN lower(trim(address)) <> lower(concat(name, ' Breda')) AND contains(lower(address), '1') THEN 3 END AS tier FROM restaurants),
        r AS (SELECT *, row_number() OVER (ORDER BY tier, restaurant, restaurant_id) AS pos FROM t WHERE tier IS NOT NULL) SELECT CAST(pos AS BIGINT) AS pos, restaurant_id, restaurant, CAST(tier AS BIGINT) AS tier FROM r WHERE pos BETWEEN 3 AND 9""",
    "daily_seeded_rank": """WITH k AS (SELECT CAST(p_partkey AS BIGINT) AS item, p_size, '2024-01-30|' || p_partkey || '|tonight' AS key FROM part),
        h AS (SELECT item, p_size, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM k)
        SELECT item, CAST(row_number() OVER (ORDER BY CAST(h AS DOUBLE) / 4294967296 - CASE WHEN p_size = 7 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, item) AS BIGINT) AS pos FROM h""",
    "source_workqueue": """WITH told AS (SELECT host, job_id, ts,
        CASE WHEN status = 'succeeded' AND attempts < 5 THEN 'reachable' WHEN status = 'failed' AND attempts = 0 THEN 'unreachable' WHEN status = 'failed' AND attempts = 1 THEN 'access_limited' WHEN status = 'failed' AND attempts = 2 THEN 'reachable' END AS source,
        CASE WHEN status = 'succeeded' AND attempts IN (1, 2, 4) THEN 'ready_for_review' WHEN status = 'succeeded' AND attempts = 3 THEN 'structure_not_recognized' ELSE 'not_assessed' END AS menu FROM jobs),
        last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, job_id DESC) AS k FROM told WHERE source IS NOT NULL) t WHERE k = 1),
        acted AS (SELECT host, job_id, source, CASE WHEN source = 'reachable' THEN menu ELSE 'not_assessed' END AS menu,
        CASE WHEN source = 'unreachable' THEN 'check_source' WHEN source = 'access_limited' THEN 'check_access' WHEN menu = 'ready_for_review' THEN 'review' ELSE 'review_manually' END AS action FROM last)
        SELECT *, CASE WHEN action LIKE 'review%' THEN 'review' ELSE 'source' END AS queue, CAST(CASE action WHEN 'review' THEN 3 WHEN 'review_manually' THEN 2 ELSE 1 END AS BIGINT) AS priority FROM acted""",
    "inbox_states": """SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE WHEN coalesce(runs, 0) = 0 THEN 'no-runs' WHEN coalesce(found, 0) > 0 THEN 'has-candidates' WHEN n_nationkey % 2 = 0 THEN 'no-filter-matches' ELSE 'run-has-no-candidates' END AS state,
        coalesce(runs, 0) > 0 AND n_nationkey % 4 < 2 AS show_error FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS runs, count_if(c_acctbal > 9900) AS found FROM customer GROUP BY c_nationkey) c ON c_nationkey = n_nationkey""",
    "source_certainty": """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'unknown_restaurant' WHEN page_id % 5 = 0 THEN 'no_recognised_menu' WHEN page_id % 11 = 0 THEN 'structure_uncertain' WHEN host NOT LIKE '%.%' OR page_id % 3 = 2 THEN 'other_host'
        WHEN page_id % 3 = 1 OR regexp_replace(path, '/+$', '') = '/menu' THEN 'already_known_source' ELSE 'high' END AS certainty FROM page_urls""",
    "retry_outcomes": """SELECT host, CASE WHEN host % 5 = 0 THEN 'invalid' WHEN host % 7 = 0 THEN 'open_batch' WHEN count_if(status IN ('pending', 'running')) > 30 THEN 'already_active' WHEN count(*) >= 100 THEN 'quota_reached' ELSE 'queued' END AS outcome FROM jobs GROUP BY host""",
    "record_hashes": """SELECT CAST(n_nationkey AS BIGINT) AS id, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS content_hash FROM nation""",
    "host_match_cardinality": """WITH hosts AS (SELECT host, row_number() OVER (ORDER BY host) AS nr FROM (SELECT DISTINCT host FROM page_urls WHERE host <> '') h),
        owners AS (SELECT nr, count(*) AS n FROM (SELECT CASE WHEN restaurant_id % 3 = 2 THEN restaurant_id - 1 ELSE restaurant_id END AS nr FROM restaurants) r GROUP BY nr)
        SELECT p.page_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'exact' ELSE 'multiple' END AS class FROM page_urls p LEFT JOIN (SELECT host, n FROM hosts JOIN owners ON owners.nr = hosts.nr) o ON o.host = p.host""",
    "single_nation": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name FROM nation WHERE n_name = 'NATION_7'",
    "offer_keys": """SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 6 <> 0 THEN 'r' || user_id || CASE WHEN event_id % 3 = 0 THEN '-west' ELSE '' END END AS restaurant_id,
        CAST(CASE WHEN event_id % 4 <> 0 AND event_id % 6 <> 0 THEN event_id % 6 END AS BIGINT) AS offer_id FROM events""",
    "catalog_round_trip": """SELECT concat_ws('-', restaurant_id, meal, dense_rank() OVER (PARTITION BY restaurant_id, meal ORDER BY category) - 1, row_number() OVER (PARTITION BY restaurant_id, meal, category ORDER BY name, dish_id, price_cents) - 1) AS dish_key,
        category, name, price_cents FROM dishes""",
    "text_windows": "SELECT doc_id, CAST(at_ AS BIGINT) AS \"offset\", substring(text, CAST(at_ + 1 AS BIGINT), 240) AS part FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) - 80), 160)) AS at_ FROM documents) w",
    "stream_session_firsts": "SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view'",
}
ORACLES["triage_steps"] = f"""SELECT host, CASE WHEN host % 50 = 0 THEN 'proposals_unknown' WHEN host % 9 = 0 THEN 'review_proposal' WHEN host % 4 = 0 THEN 'add_candidate' WHEN source = 'unreachable' THEN 'replace_or_mark'
    WHEN source = 'access_limited' THEN 'inspect_or_mark' ELSE 'check_via_onboarding' END AS next_step FROM ({ORACLES['source_workqueue']}) w"""
