"""Event counters, reports, polls, coverage and evaluation metrics."""

from __future__ import annotations

from menulake.plans.dialect import AS_OF, Dialect, half_up, plan, share

SMALL = 5


@plan
def counters_period(d: Dialect) -> str:
    return f"""SELECT dish_key, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(reservations) AS BIGINT) AS reservations
        FROM counters WHERE day >= {AS_OF} - 6 AND day <= {AS_OF} GROUP BY dish_key"""


@plan
def counters_report_resolved(d: Dialect) -> str:
    """Names looked up, unknown keys kept; totals over all keys, the list capped at 500."""
    return f"""WITH g AS (SELECT dish_key, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(saved) AS BIGINT) AS saved FROM counters WHERE day >= {AS_OF} - 29 GROUP BY dish_key),
        top AS (SELECT * FROM g ORDER BY saved DESC, dish_key LIMIT 500), t AS (SELECT CAST(sum(saved) AS BIGINT) AS total_saved FROM g)
        SELECT dish_key, coalesce(c_name, 'unknown') AS name, shared, saved, (SELECT total_saved FROM t) AS total_saved, CAST(row_number() OVER (ORDER BY saved DESC, dish_key) AS BIGINT) AS pos
        FROM top LEFT JOIN customer ON c_custkey = dish_key"""


def buckets(x: str) -> str:
    week, before, month = f"day > {AS_OF} - 7 AND day <= {AS_OF}", f"day > {AS_OF} - 14 AND day <= {AS_OF} - 7", f"day > {AS_OF} - 30 AND day <= {AS_OF}"
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {w} THEN {x} END), 0) AS BIGINT) AS {n}" for w, n in ((week, "week"), (before, "week_before"), (month, "month")))


@plan
def week_over_week(d: Dialect) -> str:
    """Three windows in one pass; small counts are hidden and no change is told from them."""
    return f"""SELECT dish_key, CASE WHEN week >= {SMALL} THEN CAST(week AS STRING) ELSE '< {SMALL}' END AS week_shown, month,
        CASE WHEN week >= {SMALL} AND week_before >= {SMALL} THEN {half_up('100 * CAST(week - week_before AS DOUBLE) / week_before')} END AS change_pct
        FROM (SELECT dish_key, {buckets('shared + saved')} FROM counters GROUP BY dish_key) t"""


@plan
def top_keys_bar(d: Dialect) -> str:
    """The four largest, with bars in percent of the first."""
    return f"""SELECT dish_key, n, CAST(pos AS BIGINT) AS pos, {half_up('100 * CAST(n AS DOUBLE) / top')} AS bar FROM (
        SELECT dish_key, n, max(n) OVER () AS top, row_number() OVER (ORDER BY n DESC, dish_key) AS pos FROM
        (SELECT dish_key, CAST(sum(shared + saved + reservations) AS BIGINT) AS n FROM counters GROUP BY dish_key ORDER BY n DESC, dish_key LIMIT 4) c) t"""


@plan
def event_day_rollup(d: Dialect) -> str:
    return "SELECT dish_key, CAST(day AS STRING) AS day, shared, saved, reservations FROM counters"


@plan
def event_pivot(d: Dialect) -> str:
    """Events by key since local midnight of the report's day, one column for each action."""
    day = d.local_day("ts")
    counts = ", ".join(f"CAST(count_if(event_type = '{t}') AS BIGINT) AS n_{t}" for t in ("click", "view", "purchase"))
    return f"SELECT user_id, {counts} FROM events WHERE {day} >= {AS_OF} - 1 GROUP BY user_id"


@plan
def view_counter(d: Dialect) -> str:
    return "SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, CAST(count(*) AS BIGINT) AS viewed FROM events WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE)"


@plan
def event_gate(d: Dialect) -> str:
    """Events of known kinds, of known keys, with small payloads."""
    return "SELECT CAST(event_id AS BIGINT) AS event_id FROM events WHERE event_type IN ('click', 'view') AND length(props) <= 9 AND user_id IN (SELECT c_custkey FROM customer)"


@plan
def event_split(d: Dialect) -> str:
    return "SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 10 = 0 THEN 'offer-log' ELSE 'counter' END AS route FROM events WHERE event_type <> 'error'"


@plan
def session_first(d: Dialect) -> str:
    """The first event of each session of a user; 30 minutes of silence end one."""
    return f"""SELECT CAST(event_id AS BIGINT) AS event_id, user_id FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before
        FROM (SELECT event_id, user_id, {d.micros('ts')} AS us FROM events) e) t WHERE before IS NULL OR us - before > 1800000000"""


@plan
def coverage_totals(d: Dialect) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(website) AS BIGINT) AS with_site, {share('count(website)', 'count(*)')} AS site_pct,
        CAST(count(m.restaurant_id) AS BIGINT) AS with_menu, {share('count(m.restaurant_id)', 'count(*)')} AS menu_pct
        FROM restaurants r LEFT JOIN (SELECT DISTINCT restaurant_id FROM dishes WHERE price_cents > 185000) m ON r.restaurant_id = m.restaurant_id"""


@plan
def coverage_breakdown(d: Dialect) -> str:
    """Percentages of groups under three are hidden."""
    return f"""SELECT coalesce(buurt, 'Onbekend') AS buurt, CAST(count(*) AS BIGINT) AS total, CAST(count(website) AS BIGINT) AS with_data,
        CASE WHEN count(*) >= 3 THEN {share('count(website)', 'count(*)')} END AS pct FROM restaurants GROUP BY coalesce(buurt, 'Onbekend')"""


@plan
def gap_ranking(d: Dialect) -> str:
    return """SELECT buurt, missing, CAST(pos AS BIGINT) AS pos, CAST(greatest(n - 3, 0) AS BIGINT) AS hidden FROM (SELECT *, row_number() OVER (ORDER BY missing DESC, total DESC, buurt) AS pos, count(*) OVER () AS n
        FROM (SELECT buurt, CAST(count(*) AS BIGINT) AS total, CAST(count_if(website IS NULL) AS BIGINT) AS missing FROM restaurants GROUP BY buurt) g) t WHERE pos <= 3"""


@plan
def compliance_view(d: Dialect) -> str:
    """Distinct dishes and those with allergens; an empty menu complies, and has no percentage."""
    return f"""SELECT r.restaurant_id, CAST(count(DISTINCT item_id) AS BIGINT) AS items, CAST(count(DISTINCT CASE WHEN allergen_a <= 7 THEN item_id END) AS BIGINT) AS labelled,
        CASE WHEN count(DISTINCT item_id) > 0 THEN {share('count(DISTINCT CASE WHEN allergen_a <= 7 THEN item_id END)', 'count(DISTINCT item_id)')} END AS pct,
        count(DISTINCT item_id) = count(DISTINCT CASE WHEN allergen_a <= 7 THEN item_id END) AS complies
        FROM restaurants r LEFT JOIN dishes x ON r.restaurant_id = x.restaurant_id AND x.price_cents > 150000 GROUP BY r.restaurant_id"""


@plan
def item_search_view(d: Dialect) -> str:
    allergens = f"{d.joined('CAST(a AS STRING)', 'a')}" if not d.spark else "nullif(array_join(transform(array_sort(collect_set(a)), x -> CAST(x AS STRING)), ','), '')"
    source = "SELECT DISTINCT item_id, a FROM" if not d.spark else "SELECT item_id, a FROM"
    return f"SELECT item_id, {allergens} AS allergens FROM ({source} (SELECT item_id, allergen_a AS a FROM dishes UNION ALL SELECT item_id, allergen_b AS a FROM dishes) u) t GROUP BY item_id"


@plan
def poll_result(d: Dialect) -> str:
    """The last vote of a voter counts; sorted by yes, then fewest no."""
    return f"""WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY voter, dish ORDER BY ts DESC, vote_id DESC) AS k FROM votes) t WHERE k = 1),
        g AS (SELECT dish, CAST(count_if(yes) AS BIGINT) AS n_yes, CAST(count_if(NOT yes) AS BIGINT) AS n_no, CAST(count(DISTINCT voter) AS BIGINT) AS voters FROM v GROUP BY dish)
        SELECT dish, n_yes, n_no, voters, {half_up('100 * CAST(n_yes AS DOUBLE) / (n_yes + n_no)')} AS pct, CAST(row_number() OVER (ORDER BY n_yes DESC, n_no, dish) AS BIGINT) AS pos FROM g"""


@plan
def poll_last_vote(d: Dialect) -> str:
    return "SELECT voter, dish, yes FROM (SELECT *, row_number() OVER (PARTITION BY voter, dish ORDER BY ts DESC, vote_id DESC) AS k FROM votes) t WHERE k = 1"


@plan
def review_status_counts(d: Dialect) -> str:
    """A fixed vocabulary; statuses nobody has are zero."""
    return """SELECT v.status, CAST(count(l.candidate_id) AS BIGINT) AS n FROM (SELECT 'new' AS status UNION ALL SELECT 'approved' UNION ALL SELECT 'rejected' UNION ALL SELECT 'deferred' UNION ALL SELECT 'merged') v
        LEFT JOIN (SELECT c.candidate_id, coalesce(r.status, 'new') AS status FROM candidates c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY decided_at DESC, id DESC) AS k FROM reviews) t WHERE k = 1) r
        ON c.candidate_id = r.candidate_id) l ON v.status = l.status GROUP BY v.status"""


@plan
def workqueue_counts(d: Dialect) -> str:
    return "SELECT coalesce(status, 'all') AS status, CAST(count(*) AS BIGINT) AS n FROM jobs GROUP BY ROLLUP (status)"


@plan
def triage_counts(d: Dialect) -> str:
    """Overlapping counts: a row counts in several."""
    return """SELECT CAST(count_if(status = 'deferred') AS BIGINT) AS deferred, CAST(count_if(status <> 'approved') AS BIGINT) AS unsettled, CAST(count_if(reason LIKE '1%') AS BIGINT) AS urgent,
        CAST(count_if(status = 'deferred' AND reason LIKE '1%') AS BIGINT) AS both_of_them FROM reviews"""


@plan
def usage_rollup(d: Dialect) -> str:
    """Counts and cost by kind; unknown costs are counted apart; kinds beyond the top three are summed."""
    return """WITH g AS (SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count_if(value > 50) AS BIGINT) AS unknown, CAST(sum(CASE WHEN value <= 50 THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents FROM events GROUP BY event_type),
        r AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS pos FROM g)
        SELECT CASE WHEN pos <= 3 THEN kind ELSE 'other' END AS kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(unknown) AS BIGINT) AS unknown, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY CASE WHEN pos <= 3 THEN kind ELSE 'other' END"""


@plan
def action_explode(d: Dialect) -> str:
    """Per action of an array field: how many rows hold it."""
    actions = d.array("event_type", "CASE WHEN value > 50 THEN 'large' ELSE 'small' END", "CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END")
    source = d.unnest(f"SELECT event_id, {actions} AS actions FROM events", "actions", "event_id", "action")
    return f"SELECT action, CAST(count(*) AS BIGINT) AS n FROM {source} t GROUP BY action"


@plan
def offer_counts(d: Dialect) -> str:
    return f"SELECT user_id, CAST(count_if(event_id % 3 = 0) AS BIGINT) AS deals, CAST(count_if(event_id % 3 <> 0) AS BIGINT) AS dishes FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) > {AS_OF} - 14 GROUP BY user_id"


@plan
def origin_counts(d: Dialect) -> str:
    return "SELECT k.kind, CAST(count(e.event_id) AS BIGINT) AS n FROM (SELECT 'signup' AS kind UNION ALL SELECT 'click' UNION ALL SELECT 'import') k LEFT JOIN events e ON e.event_type = k.kind GROUP BY k.kind"


@plan
def bucket_scores(d: Dialect) -> str:
    """Precision by bucket, and the median of the found amounts."""
    return f"""SELECT o_orderpriority AS bucket, CAST(count(*) AS BIGINT) AS n, {share("count_if(l_returnflag = 'N')", 'count(*)', 10000)} AS pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"""


@plan
def exact_median(d: Dialect) -> str:
    return "SELECT l_returnflag AS bucket, CAST(median(CAST(l_quantity AS DOUBLE)) AS DOUBLE) AS mid FROM lineitem GROUP BY l_returnflag"


@plan
def quota_daily(d: Dialect) -> str:
    day = d.local_day("ts")
    return f"SELECT host, CAST(count(*) AS BIGINT) AS used, count(*) >= 2 AS full FROM jobs WHERE {day} = {AS_OF} - 1 GROUP BY host"


@plan
def device_report_threshold(d: Dialect) -> str:
    return "SELECT CAST(event_id % 200 AS BIGINT) AS offer, CAST(count(DISTINCT user_id) AS BIGINT) AS devices, count(DISTINCT user_id) >= 5 AS under_review FROM events WHERE event_type = 'error' GROUP BY event_id % 200"


@plan
def tone_counts(d: Dialect) -> str:
    """Lines by tone: blank, priced, shouting, plain."""
    priced, caps = d.matches("line", "[0-9]+[.,][0-9]{2}"), "line = upper(line) AND length(line) > 10"
    return f"""SELECT doc_id, CAST(count_if(trim(line) = '') AS BIGINT) AS blank, CAST(count_if({priced}) AS BIGINT) AS priced, CAST(count_if(NOT {priced} AND {caps}) AS BIGINT) AS shouting, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY doc_id"""


@plan
def null_propagating_sum(d: Dialect) -> str:
    return "SELECT o_custkey AS customer, CAST(CASE WHEN count(*) = count(v) THEN sum(v) END AS BIGINT) AS total FROM (SELECT o_custkey, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS v FROM orders) t GROUP BY o_custkey"


@plan
def run_summary(d: Dialect) -> str:
    """Outcome counts with names looked up; stored rows beyond a cap are skipped ones."""
    return """SELECT o_custkey AS customer, coalesce(c_name, 'unknown') AS name, CAST(count(*) AS BIGINT) AS fetched, CAST(count_if(status = 'F' AND k <= 5) AS BIGINT) AS stored, CAST(count_if(status = 'F' AND k > 5) AS BIGINT) AS skipped, CAST(count_if(status <> 'F') AS BIGINT) AS errored
        FROM (SELECT o_custkey, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders) t LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, coalesce(c_name, 'unknown')"""


@plan
def props_gate(d: Dialect) -> str:
    """A typed value out of JSON, gated by its kind; how complete the metric is."""
    k = d.json_int("props", "k")
    return f"""SELECT event_type, CAST(sum({k}) AS BIGINT) AS k, CASE WHEN count({k}) = 0 THEN 'empty' WHEN count({k}) < count(*) THEN 'partial' ELSE 'complete' END AS state FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type"""


@plan
def completeness_gate(d: Dialect) -> str:
    """Reasons why a menu isn't complete: too few dishes, odd prices, repeats, too few priced."""
    priced = "count_if(price_cents BETWEEN 10000 AND 150000)"
    return f"""SELECT restaurant_id, concat_ws(',', CASE WHEN count(*) < 8 THEN 'few' END, CASE WHEN {priced} < count(*) THEN 'price' END, CASE WHEN count(DISTINCT name) < count(*) THEN 'repeat' END,
        CASE WHEN {priced} * 10 < count(*) * 9 THEN 'share' END) AS reasons FROM dishes GROUP BY restaurant_id"""


@plan
def quality_flags(d: Dialect) -> str:
    return """SELECT restaurant_id, bool_or(length(name) > 30) AS long_names, bool_or(contains(name, '*')) AS markers, bool_and(price_cents > 0) AS all_priced,
        CASE WHEN count_if(price_cents > 0) * 10 >= count(*) * 8 AND bool_and(length(name) <= 60) THEN 'replace' ELSE 'keep' END AS gate FROM dishes GROUP BY restaurant_id"""


@plan
def price_outlier(d: Dialect) -> str:
    """Offers dearer than three times the dearest dish of the menu, and changes by more than half."""
    return """SELECT CAST(l_orderkey AS BIGINT) AS offer, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice > 3 * top AS outlier, abs(l_extendedprice - p_retailprice) / p_retailprice > 0.5 AS big_change
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT restaurant_id, max(price_cents) / 100 AS top FROM dishes GROUP BY restaurant_id) m ON m.restaurant_id = l_suppkey"""


@plan
def section_confirmation(d: Dialect) -> str:
    """Whole amounts count only where a section has two rows with them."""
    return """SELECT source, line, path FROM (SELECT *, count(*) OVER (PARTITION BY source, path) AS n FROM expected WHERE price % 100 = 0 OR line <= 2) t WHERE n >= 2"""
