"""Latest-state reduction over append-only logs, lineages, timelines, queues and constraints."""

from __future__ import annotations

from menulake.plans.dialect import AS_OF, Dialect, half_up, numbered, plan


def latest(rows: str, keys: str, order: str, columns: str = "*") -> str:
    """The first row of each key in an order that has no ties."""
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k_ FROM ({rows}) r_) l_ WHERE k_ = 1"


LATEST_REVIEW = latest("SELECT * FROM reviews WHERE decided_at IS NOT NULL", "candidate_id", "decided_at DESC, id DESC")


@plan
def latest_review(d: Dialect) -> str:
    return f"SELECT candidate_id, id, status FROM ({LATEST_REVIEW}) t"


@plan
def latest_with_condition(d: Dialect) -> str:
    """The reason only where the latest status is deferred; new where there is no review."""
    return f"SELECT c.candidate_id, coalesce(status, 'new') AS status, CASE WHEN status = 'deferred' THEN reason END AS reason FROM candidates c LEFT JOIN ({LATEST_REVIEW}) r ON c.candidate_id = r.candidate_id"


@plan
def latest_per_two_keys(d: Dialect) -> str:
    return latest("SELECT CAST(l_suppkey AS BIGINT) AS supplier, l_returnflag AS field, l_shipdate, CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS line FROM lineitem", "supplier, field", "l_shipdate DESC, id DESC, line DESC", "supplier, field, id, line")


@plan
def active_and_discarded(d: Dialect) -> str:
    """The last active draft by order of entry; the last discarded one by time, then id as text."""
    active = latest("SELECT * FROM reviews WHERE status = 'approved'", "candidate_id", "id DESC")
    gone = latest("SELECT * FROM reviews WHERE status = 'rejected'", "candidate_id", "decided_at DESC, CAST(id AS STRING) DESC")
    return f"SELECT c.candidate_id, a.id AS active_id, g.id AS discarded_id FROM candidates c LEFT JOIN ({active}) a ON a.candidate_id = c.candidate_id LEFT JOIN ({gone}) g ON g.candidate_id = c.candidate_id"


@plan
def version_lineage_open(d: Dialect) -> str:
    last = latest("SELECT * FROM reviews", "candidate_id % 100", "id DESC")
    return f"SELECT candidate_id % 100 AS lineage, id, status FROM ({last}) t WHERE status NOT IN ('approved', 'rejected')"


@plan
def snapshot_review(d: Dialect) -> str:
    return f"SELECT id, status, reason FROM ({latest('SELECT * FROM reviews', 'candidate_id, status', 'decided_at DESC, id DESC')}) t"


@plan
def recent_success(d: Dialect) -> str:
    return f"SELECT host, job_id FROM ({latest(f'''SELECT * FROM jobs WHERE status = 'succeeded' AND CAST(ts AS DATE) > {AS_OF} - 7''', 'host', 'ts DESC, job_id DESC')}) t"


@plan
def timeline_union(d: Dialect) -> str:
    return """SELECT kind, id, CAST(row_number() OVER (PARTITION BY owner ORDER BY at_ DESC, kind, id DESC) AS BIGINT) AS pos, owner FROM (
        SELECT 'order' AS kind, CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS owner, o_orderdate AS at_ FROM orders UNION ALL SELECT 'event', CAST(event_id AS BIGINT), CAST(user_id AS BIGINT), ts FROM events) t"""


@plan
def price_change_log(d: Dialect) -> str:
    """A row wherever an item's price differs from the one before; nulls are values too."""
    return f"""SELECT item, id, line, price FROM (SELECT *, lag(price) OVER (PARTITION BY item ORDER BY l_shipdate, id, line) AS old, row_number() OVER (PARTITION BY item ORDER BY l_shipdate, id, line) AS k
        FROM (SELECT CAST(l_partkey AS BIGINT) AS item, l_shipdate, CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_orderkey % 19 <> 0 THEN {half_up('l_extendedprice / l_quantity')} END AS price FROM lineitem) s) t
        WHERE k > 1 AND price IS DISTINCT FROM old"""


@plan
def candidate_enrich_filter(d: Dialect) -> str:
    """Raw fields overridden by the latest enrichment; completeness first, filters last."""
    fix = latest("SELECT candidate_id, concat('0', CAST(600000000 + id AS STRING)) AS new_phone, decided_at, id FROM reviews WHERE status = 'approved'", "candidate_id", "decided_at DESC, id DESC")
    return f"""SELECT candidate_id, name, phone, concat_ws(',', CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN website IS NULL THEN 'website' END, CASE WHEN address IS NULL THEN 'address' END) AS missing
        FROM (SELECT c.candidate_id, c.name, coalesce(f.new_phone, c.phone) AS phone, c.website, c.address FROM candidates c LEFT JOIN ({fix}) f ON f.candidate_id = c.candidate_id) t WHERE phone IS NULL OR website IS NULL"""


@plan
def inbox_filters(d: Dialect) -> str:
    return f"""SELECT c.candidate_id, CASE WHEN r.status IS NULL THEN 'new' WHEN r.status = 'deferred' THEN 'later' ELSE 'done' END AS bucket FROM candidates c LEFT JOIN ({LATEST_REVIEW}) r ON r.candidate_id = c.candidate_id
        WHERE name_key IN ('BUILDING', 'MACHINERY') AND (contains(lower(name), '9') OR contains(lower(website), 'site4'))"""


@plan
def triage_filters(d: Dialect) -> str:
    return "SELECT id, candidate_id FROM reviews WHERE status = 'deferred' AND reason LIKE '2%'"


@numbered("prio, ts, host")
def workqueue_rows(d: Dialect) -> str:
    """The latest usable observation decides; ordered by priority, oldest check, name."""
    last = latest("SELECT * FROM jobs WHERE status IN ('succeeded', 'failed')", "host", "ts DESC, job_id DESC")
    return f"""SELECT host, job_id, action, CAST(prio AS BIGINT) AS prio, ts FROM (SELECT host, job_id, ts, CASE WHEN status = 'failed' AND attempts >= 3 THEN 'find source' WHEN status = 'failed' THEN 'retry' WHEN attempts = 0 THEN 'review' ELSE 'none' END AS action,
        CASE WHEN status = 'failed' AND attempts >= 3 THEN 0 WHEN status = 'failed' THEN 1 WHEN attempts = 0 THEN 2 ELSE 3 END AS prio FROM ({last}) t) u"""


@plan
def workqueue_filters(d: Dialect) -> str:
    return f"SELECT job_id, host, status FROM jobs WHERE status IN ('failed', 'pending') AND attempts < 4 AND CAST(ts AS DATE) >= {AS_OF} - 13"


@plan
def task_union(d: Dialect) -> str:
    """An open proposal beats a result for the same owner."""
    return """WITH p AS (SELECT DISTINCT candidate_id AS owner FROM reviews WHERE status = 'deferred'), r AS (SELECT DISTINCT host AS owner FROM jobs WHERE status = 'succeeded')
        SELECT 'proposal' AS kind, owner FROM p UNION ALL SELECT 'result', owner FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.owner = r.owner)"""


@plan
def task_counts(d: Dialect) -> str:
    return "SELECT coalesce(status, 'all') AS kind, CAST(count(DISTINCT candidate_id) AS BIGINT) AS n FROM reviews GROUP BY ROLLUP (status)"


@plan
def newest_batch(d: Dialect) -> str:
    """All rows of the newest batch of an owner, and how many older rows there are."""
    return """SELECT candidate_id, id, CAST(total - in_batch AS BIGINT) AS older FROM (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS total, count(*) OVER (PARTITION BY candidate_id, reason) AS in_batch,
        first_value(reason) OVER (PARTITION BY candidate_id ORDER BY decided_at DESC, id DESC) AS newest FROM reviews) t WHERE reason = newest"""


@plan
def coverage_rows(d: Dialect) -> str:
    return latest("SELECT candidate_id AS owner, 0 AS src, id FROM reviews WHERE status = 'approved' UNION ALL SELECT host, 1, job_id FROM jobs WHERE status = 'failed'", "owner", "src, id", "owner, CAST(src AS BIGINT) AS src, id")


@plan
def confirm_after(d: Dialect) -> str:
    """The first line shipped at or after its order's date, by line number."""
    return "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(min(l_linenumber) AS BIGINT) AS first_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate OR o_orderdate IS NULL GROUP BY o_orderkey"


@plan
def expiry_sweep(d: Dialect) -> str:
    """Expired offers with the audit row that the sweep writes; the row has the new status."""
    return f"SELECT CAST(event_id AS BIGINT) AS offer, 'expired' AS status, 'online' AS before FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) + 7 <= {AS_OF}"


@plan
def retention(d: Dialect) -> str:
    return f"SELECT v.vote_id, v.voter FROM votes v WHERE v.dish IN (SELECT dish FROM votes GROUP BY dish HAVING max(CAST(ts AS DATE)) >= {AS_OF} - 14) AND CAST(v.ts AS DATE) >= {AS_OF} - 20"


@plan
def queue_claim(d: Dialect) -> str:
    """The next job of each host: under five attempts, its back-off of 2, 10, then 30 minutes over,
    none running on the host under a lease of 3 minutes, none of its jobs finished in the minute
    before the claim, which is made 50 minutes after the last event."""
    t = d.seconds("ts")
    wait = "CASE WHEN attempts <= 0 THEN 0 WHEN attempts = 1 THEN 120 WHEN attempts = 2 THEN 600 ELSE 1800 END"
    now = "(SELECT s FROM now_)"
    claimable = f"SELECT * FROM jobs j WHERE status IN ('pending', 'queued') AND attempts < 5 AND {t} + {wait} <= {now} AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.host = j.host)"
    return f"""WITH now_ AS (SELECT max({t}) + 3000 AS s FROM jobs),
        busy AS (SELECT DISTINCT host FROM jobs WHERE (status = 'running' AND {t} + 180 > {now}) OR (status IN ('succeeded', 'failed') AND {t} + 60 > {now}))
        SELECT host, job_id FROM ({latest(claimable, 'host', 'ts, job_id')}) t"""


@plan
def requeue(d: Dialect) -> str:
    """A failed job is tried again after 2, 10, then 30 minutes, five times at most."""
    return "SELECT job_id, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS status, CAST(CASE WHEN attempts >= 5 THEN NULL WHEN attempts <= 1 THEN 120 WHEN attempts = 2 THEN 600 ELSE 1800 END AS BIGINT) AS wait_s FROM jobs WHERE status = 'failed'"


@plan
def constraint_violations(d: Dialect) -> str:
    return """SELECT 'open per owner' AS rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT candidate_id FROM reviews WHERE status = 'deferred' GROUP BY candidate_id HAVING count(*) > 1) a
        UNION ALL SELECT 'active per candidate', CAST(count(*) AS BIGINT) FROM (SELECT candidate_id FROM reviews WHERE status = 'approved' GROUP BY candidate_id HAVING count(*) > 1) b
        UNION ALL SELECT 'status and fields', CAST(count(*) AS BIGINT) FROM reviews WHERE NOT (status <> 'deferred' OR reason IS NOT NULL)
        UNION ALL SELECT 'line versions', CAST(count(*) AS BIGINT) FROM (SELECT l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS step FROM lineitem) c WHERE step <> 1"""


@plan
def promote(d: Dialect) -> str:
    """May be promoted: latest status approved, no later draft of its lineage."""
    return f"SELECT t.candidate_id, status = 'approved' AND j.host IS NULL AS may FROM ({LATEST_REVIEW}) t LEFT JOIN (SELECT DISTINCT host FROM jobs WHERE status = 'running') j ON j.host = t.candidate_id"


@plan
def approve(d: Dialect) -> str:
    return latest("SELECT candidate_id, 'raw' AS origin, 0 AS src, CAST(0 AS BIGINT) AS id FROM candidates UNION ALL SELECT candidate_id, 'approved', 1, id FROM reviews WHERE status = 'approved'", "candidate_id", "src DESC, id DESC", "candidate_id, origin, id")


@plan
def redeem(d: Dialect) -> str:
    return latest(f"SELECT * FROM jobs WHERE status = 'succeeded' AND CAST(ts AS DATE) >= {AS_OF} - 2", "host, attempts", "ts, job_id", "host, attempts, job_id")


@plan
def decide(d: Dialect) -> str:
    return "SELECT id, CASE WHEN status = 'deferred' AND reason LIKE '1%' THEN 'ask' WHEN status = 'deferred' THEN 'wait' WHEN status = 'rejected' THEN 'close' ELSE 'publish' END AS next_step FROM reviews"


@plan
def idempotent_insert(d: Dialect) -> str:
    return "SELECT candidate_id, CAST(min(id) AS BIGINT) AS id FROM reviews GROUP BY candidate_id, status"


@plan
def secured_rows(d: Dialect) -> str:
    """Rows an owner may see: their own, and those of approved claims."""
    return "SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


@plan
def owner_union(d: Dialect) -> str:
    return "SELECT owner, c_name AS name FROM (SELECT CAST(o_custkey AS BIGINT) AS owner FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT CAST(c_custkey AS BIGINT) FROM customer WHERE c_acctbal > 9000) u JOIN customer ON c_custkey = owner"


@plan
def job_attribution(d: Dialect) -> str:
    """A job belongs to the one candidate with its host; with several or none it stays open.

    Of three candidates in a row two share a host, which leaves one number without a candidate."""
    return """SELECT j.job_id, CASE WHEN h.n = 1 THEN h.candidate_id END AS candidate_id FROM jobs j LEFT JOIN (SELECT host, min(candidate_id) AS candidate_id, count(*) AS n FROM (SELECT candidate_id, CASE WHEN candidate_id % 3 = 2 THEN candidate_id - 1 ELSE candidate_id END AS host FROM candidates) c GROUP BY host) h ON h.host = j.host"""


@plan
def proposal_orphans(d: Dialect) -> str:
    return "SELECT CAST(count(*) AS BIGINT) AS orphans, CAST(count(DISTINCT user_id) AS BIGINT) AS keys FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_custkey % 3 = 0)"


@plan
def update_from(d: Dialect) -> str:
    """Orders without a late line are closed; others keep their status."""
    return "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN late.l_orderkey IS NULL THEN 'closed' ELSE o_orderstatus END AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) late ON late.l_orderkey = o_orderkey"


@numbered("n DESC, id")
def correlated_order(d: Dialect) -> str:
    """Orders by their number of lines; one without lines has none."""
    return "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(coalesce(l.n, 0) AS BIGINT) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey"


@plan
def local_calendar(d: Dialect) -> str:
    """Day, weekday, minute and season in Amsterdam; whether a confirmation of that day still holds."""
    day = d.local_day("ts")
    return f"""SELECT CAST(event_id AS BIGINT) AS event_id, CAST({day} AS STRING) AS day, {d.weekday(day)} AS weekday, {d.local_minute('ts')} AS minute,
        CASE WHEN month({day}) IN (12, 1, 2) THEN 'winter' ELSE 'other' END AS season, {d.days(AS_OF, day)} < 20 AS holds FROM events"""


@plan
def run_duration(d: Dialect) -> str:
    s = d.seconds("l_shipdate") + " - " + d.seconds("o_orderdate")
    return f"SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN {s} >= 0 THEN {s} END AS seconds FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@plan
def array_validate(d: Dialect) -> str:
    """Weekdays of an offer: 1 to 7, each once, in order; how many entries were dropped."""
    raw = d.array("o_orderkey % 9", "o_custkey % 9", "o_orderkey % 5")
    ok = d.sort(d.distinct(d.keep(raw, "w", "w BETWEEN 1 AND 7")))
    return f"SELECT CAST(o_orderkey AS BIGINT) AS id, {d.join(d.each(ok, 'w', 'CAST(w AS STRING)'), ',')} AS days, 3 - {d.size(ok)} AS dropped FROM orders"


@plan
def single_feature_assert(d: Dialect) -> str:
    """The one row that a rule selects, with a hash of its canonical form."""
    form = "concat('{\"key\":', CAST(n_nationkey AS STRING), ',\"name\":\"', n_name, '\"}')"
    return f"WITH n AS (SELECT * FROM nation WHERE n_name = 'NATION_7'), c AS (SELECT count(*) AS n FROM n) SELECT CAST(n_nationkey AS BIGINT) AS id, {d.sha(form)} AS content_hash, (SELECT n FROM c) = 1 AS single FROM n"


@plan
def export_replace(d: Dialect) -> str:
    """All rows of one owner replaced, the rest untouched."""
    return """SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS line, 'old' AS origin FROM lineitem WHERE l_suppkey <> 7 UNION ALL SELECT CAST(o_orderkey AS BIGINT), CAST(0 AS BIGINT), 'new' FROM orders WHERE o_custkey = 7"""


@plan
def scope_check(d: Dialect) -> str:
    """Rows outside the exported scope that changed: keys on one side only, or other prices."""
    return "SELECT coalesce(e.source, a.source) AS source, coalesce(e.line, a.line) AS line FROM expected e FULL OUTER JOIN actual a ON e.source = a.source AND e.line = a.line WHERE (e.price IS DISTINCT FROM a.price) AND coalesce(e.source, a.source) % 11 <> 0"
