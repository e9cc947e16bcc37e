"""Changes to tables of records: what a batch, a decision or a sweep adds, and what it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menulake.functions.content import likely_same_name
from menulake.functions.decisions import host_of
from menulake.functions.geo import metres
from menulake.functions.keys import name_key
from menulake.operators.reduce import latest_by
from menulake.sources.places import comparable

#: Days for which a result is used again, hours after which an idle batch is closed, and metres within
#: which equal names are one place.
RECENT_DAYS, IDLE_HOURS, SAME_METRES = 7, 24, 100
URL_PATTERN = r"(?i)^https?://[a-z0-9.-]{1,253}(?::\d+)?(?:/[^?#\s]*)?$"


def enqueue(items: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(batch_id, position, url, outcome, reused_job_id) of each item (batch_id, position, url) by the
    first rule that holds: invalid (no plain http address), duplicate (of an earlier item of the
    batch), already_active (an open job of another batch), recent (a success of at most seven days,
    the last of which is used again), queued. jobs: job_id, url, status, batch_id, expired,
    finished_at."""
    text = F.trim("url")
    valid = F.coalesce((F.length(text) <= 2048) & text.rlike(URL_PATTERN), F.lit(False))
    order = Window.partitionBy("batch_id", "_url").orderBy("position")
    rows = items.withColumn("_url", F.when(valid, text)).withColumn("_nr", F.row_number().over(order))
    active = jobs.where("status IN ('pending', 'running') AND batch_id IS NOT NULL AND NOT expired").select(F.col("url").alias("_url")).distinct().withColumn("_active", F.lit(True))
    fresh = jobs.where((F.col("status") == "succeeded") & (F.col("finished_at") >= F.timestamp_add("DAY", F.lit(-RECENT_DAYS), now)))
    recent = latest_by(fresh, ["url"], [F.desc("finished_at"), F.desc("job_id")]).select(F.col("url").alias("_url"), F.col("job_id").alias("_recent"))
    found = rows.join(active, "_url", "left").join(recent, "_url", "left")
    outcome = F.when(F.col("_url").isNull(), "invalid").when(F.col("_nr") > 1, "duplicate").when(F.col("_active"), "already_active").when(F.col("_recent").isNotNull(), "recent").otherwise("queued")
    return found.select("batch_id", "position", F.col("_url").alias("url"), outcome.alias("outcome"), F.when(outcome == "recent", F.col("_recent")).alias("reused_job_id"))


def close_idle(batches: DataFrame, jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(batches with those closed that were idle for a day, jobs with the open ones of those expired)."""
    idle = F.col("closed_at").isNull() & (F.col("last_activity_at") < F.timestamp_add("HOUR", F.lit(-IDLE_HOURS), now))
    closed = batches.withColumns({"close_reason": F.when(idle, "expired").otherwise(F.col("close_reason")), "closed_at": F.when(idle, now).otherwise(F.col("closed_at"))})
    gone = batches.where(idle).select("batch_id", F.lit(True).alias("_idle"))
    hit = F.coalesce("_idle", F.lit(False)) & F.col("status").isin("pending", "running") & F.col("expired_at").isNull()
    swept = jobs.join(gone, "batch_id", "left").withColumns({"expired_at": F.when(hit, now).otherwise(F.col("expired_at")), "lease_expires_at": F.when(hit, None).otherwise(F.col("lease_expires_at"))}).select(*jobs.columns)
    return closed, swept


def sweep(offers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(offers with the status `expired` where they are online and past their time; an audit row for
    each of those: offer_id, before, after, at)."""
    over = (F.col("status") == "online") & (F.col("expires_at") <= now)
    audit = offers.where(over).select("offer_id", F.col("status").alias("before"), F.lit("expired").alias("after"), now.alias("at"))
    return offers.withColumn("status", F.when(over, "expired").otherwise(F.col("status"))), audit


def approve_changes(pending: DataFrame, provenance: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending with those approved, provenance with their values, approvals that found nothing).

    pending: id, status, and the key restaurant_id, field, ref with a value; provenance: key, value,
    origin, updated_at; approvals: id, at. Of several changes of a key the last approved one counts,
    and any of them replaces what the key had. Only pending ones can be approved."""
    key = ["restaurant_id", "field", "ref"]
    asked = approvals.groupBy("id").agg(F.min("at").alias("at"))
    hit = pending.where("status = 'pending'").join(asked, "id")
    new = latest_by(hit, key, [F.desc("at"), F.desc("id")]).select(*key, "value", F.lit("editor").alias("origin"), F.col("at").alias("updated_at"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    kept = provenance.alias("p").join(new.alias("n"), same, "left_anti").select(*key, "value", "origin", "updated_at")
    done = pending.join(hit.select("id", F.lit("approved").alias("_new")), "id", "left").withColumn("status", F.coalesce("_new", "status")).select(*pending.columns)
    return done, kept.unionByName(new), asked.join(hit.select("id"), "id", "left_anti").select("id")


def approve_claims(claims: DataFrame, roles: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with the pending ones of ids approved, roles with their owners, each once)."""
    hit = claims.where("status = 'pending'").join(ids.select("id").distinct(), "id")
    owners = hit.select("user_id", F.lit("owner").alias("role"), "restaurant_id").distinct()
    new = owners.join(roles, ["user_id", "role", "restaurant_id"], "left_anti").select("user_id", "role", "restaurant_id")
    done = claims.join(hit.select("id", F.lit("approved").alias("_new")), "id", "left").withColumn("status", F.coalesce("_new", "status")).select(*claims.columns)
    return done, roles.select("user_id", "role", "restaurant_id").unionByName(new)


def baseline(restaurants: DataFrame) -> DataFrame:
    """(kind, key): the names, comparable names, core names and hosts of known restaurants (name,
    website), each once."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in _keys("name", "website").items()])
    return restaurants.select(F.explode(keys).alias("x")).select("x.*").where("key <> ''").distinct()


def _keys(name: str, website: str) -> dict[str, Column]:
    key = name_key(F.col(name))
    core = F.array_join(F.array_sort(F.filter(F.split(comparable(F.col(name)), " "), lambda w: ~w.isin("de", "het", "een", "la", "le", "van", "en", ""))), " ")
    return {"name": key, "comparable": comparable(F.col(name)), "core": core, "host": host_of(F.col(website))}


def unknown(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (name, website, ...) of which no key is in the baseline; an anti join for each kind."""
    keys = _keys("name", "website")
    rows = candidates.withColumns({f"_{k}": v for k, v in keys.items()})
    for kind in keys:
        rows = rows.join(known.where(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}")), f"_{kind}", "left_anti")
    return rows.select(*candidates.columns)


def first_duplicate_draft(candidates: DataFrame, drafts: DataFrame, within: float = SAME_METRES) -> DataFrame:
    """(candidate_id, draft_id): the first draft (by ordinal) with a candidate's name, within 100 metres.

    Without a name or a place nothing is compared. Candidates of one name and place are compared once,
    and of the drafts there only the first is looked at. Places meet by their name and grid cells that
    are larger than the distance, so a frequent name isn't paired with all its drafts. No side is small
    whatever its file's size says, so none is sent to the driver."""
    cell = within / 111_000 * 2  # degrees; east-west ones are shorter, by less than 2 up to 60 degrees
    at = lambda c: F.floor(F.col(c) / cell)
    near = F.sequence(F.lit(-1), F.lit(1))
    c = candidates.select("candidate_id", name_key(F.col("name")).alias("key"), "lat", "lon").where("key <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
    d = drafts.select(F.struct("ordinal", "draft_id").alias("first"), name_key(F.col("name")).alias("key"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).where("key <> '' AND lat2 IS NOT NULL AND lon2 IS NOT NULL")
    firsts = d.groupBy("key", "lat2", "lon2").agg(F.min("first").alias("first")).withColumns({"cy": at("lat2"), "cx": at("lon2")})
    places = c.select("key", "lat", "lon").distinct().withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)).withColumns({"cy": at("lat") + F.col("dy"), "cx": at("lon") + F.col("dx")})
    pairs = places.join(firsts.hint("merge"), ["key", "cy", "cx"]).where(metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= within)
    found = pairs.groupBy("key", "lat", "lon").agg(F.min("first").alias("first"))
    return c.join(found.hint("merge"), ["key", "lat", "lon"]).groupBy("candidate_id").agg(F.min("first").alias("first")).select("candidate_id", F.col("first.draft_id").alias("draft_id"))


def unsure_names(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with same: whether the names may be one business, null if either is empty."""
    return pairs.withColumn("same", likely_same_name(F.col("a"), F.col("b")))


def enriched(candidates: DataFrame, enrichments: DataFrame, fields: tuple[str, ...] = ("address", "phone", "website")) -> DataFrame:
    """candidates (candidate_id, ...) whose fields have the value of their last enrichment (candidate_id,
    field, value, recorded_at, id), where there is one; the raw table stays as it is."""
    last = latest_by(enrichments.where(F.col("field").isin(*fields)), ["candidate_id", "field"], [F.desc("recorded_at"), F.desc("id")])
    by = last.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"))
    new = {f: F.coalesce(F.try_element_at("_new", F.lit(f)), F.col(f)) for f in fields}
    return candidates.join(by, "candidate_id", "left").withColumns(new).select(*candidates.columns)


def inbox(candidates: DataFrame, run_id=None, category: str | None = None, name: str | None = None, duplicate: bool | None = None, quality: str | None = None, review: str | None = None) -> DataFrame:
    """Candidates that pass all filters that are given; filters look at enriched rows (run_id, category,
    name, possible_duplicate, quality, review)."""
    conditions = []
    if name:
        conditions.append(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(name.lower())))
    if duplicate is not None:
        conditions.append(F.coalesce("possible_duplicate", F.lit(False)) == duplicate)
    for column, wanted in (("run_id", run_id), ("category", category), ("quality", quality), ("review", review)):
        if wanted:
            conditions.append(F.col(column) == wanted)
    for c in conditions:
        candidates = candidates.where(c)
    return candidates


def promote(candidates: DataFrame, reviews: DataFrame, drafts: DataFrame, enrichments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcome of each request (draft_id, candidate_id, restarted_from); the facts of the new drafts).

    A candidate (candidate_id, name, category, address, phone, website) may become a draft if its last
    review (candidate_id, decided_at, id, status) is approved_internal, no draft of it (draft_id,
    candidate_id, status) is active, and a draft that it restarts from is a discarded one of its own.
    Of several requests for a candidate the smallest draft_id counts. A fact is a field's value, with
    its origin: `enrichment` where one was recorded, else `import`."""
    status = latest_by(reviews, ["candidate_id"], [F.desc("decided_at"), F.desc("id")]).select("candidate_id", F.col("status").alias("_status"))
    active = drafts.where("status = 'draft'").select("candidate_id").distinct().withColumn("_active", F.lit(True))
    gone = drafts.where("status = 'discarded'").select(F.col("draft_id").alias("restarted_from"), "candidate_id").distinct().withColumn("_gone", F.lit(True))
    first = Window.partitionBy("candidate_id").orderBy("draft_id")
    rows = requests.withColumn("_nr", F.row_number().over(first)).join(candidates.select("candidate_id", F.lit(True).alias("_known")), "candidate_id", "left")
    rows = rows.join(status, "candidate_id", "left").join(active, "candidate_id", "left").join(gone, ["restarted_from", "candidate_id"], "left")
    outcome = (
        F.when(F.col("_known").isNull(), "not_found").when(~F.col("_status").eqNullSafe("approved_internal"), "not_approved").when(F.col("_active") | (F.col("_nr") > 1), "already_active")
        .when(F.col("restarted_from").isNotNull() & F.col("_gone").isNull(), "bad_restart").otherwise("promoted")
    )
    told = rows.select("draft_id", "candidate_id", outcome.alias("outcome"))
    fixed = latest_by(enrichments, ["candidate_id", "field"], [F.desc("recorded_at"), F.desc("id")]).select("candidate_id", "field", F.col("value").alias("_new"))
    names = ("name", "category", "address", "phone", "website")
    raw = candidates.select("candidate_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])).alias("x")).select("candidate_id", "x.*")
    facts = told.where("outcome = 'promoted'").join(raw, "candidate_id").join(fixed, ["candidate_id", "field"], "left")
    return told, facts.select("draft_id", "field", F.coalesce("_new", "value").alias("value"), F.when(F.col("_new").isNotNull(), "enrichment").otherwise("import").alias("origin")).where("value IS NOT NULL")


def decide_proposals(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals (id, status, note) with the open ones decided; an event for each; refused decisions
    (id, reason)). A decision (id, decision, note, at) is accepted or rejected, a rejection needs a note,
    and of several for a proposal the first in time counts."""
    note = F.nullif(F.trim("note"), F.lit(""))
    rows = decisions.withColumn("note", note).join(proposals.select("id", F.col("status").alias("_was")), "id", "left")
    good = F.when(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False)), "unknown_decision").when((F.col("decision") == "rejected") & F.col("note").isNull(), "reason_needed").when(~F.col("_was").eqNullSafe("open"), "not_open")
    judged = rows.withColumn("reason", good)
    first = Window.partitionBy("id", F.col("reason").isNull()).orderBy("at", "decision")
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(first) > 1), "not_open").otherwise(F.col("reason")))
    done = judged.where("reason IS NULL").select("id", F.col("decision").alias("event"), "note", "at")
    new = proposals.join(done.select("id", F.col("event").alias("_new"), F.col("note").alias("_note")), "id", "left")
    after = new.withColumns({"status": F.coalesce("_new", "status"), "note": F.coalesce("_note", "note")}).select(*proposals.columns)
    return after, done, judged.where("reason IS NOT NULL").select("id", "reason")


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with the rows whose key it hasn't; of new rows that share a key any one. Inserting again
    changes nothing."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti").select(*table.columns))


def usage_export(rows: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names with their concepts, models with concepts, cost and unknown costs, one row of totals) of
    usage rows (id, kind, name, provider, model, cents, at); rows without a kind, and repeats of an id,
    are ignored. Names beyond the first `most` are one row without a name, with how many they are."""
    used = rows.where("kind IS NOT NULL")
    seen = used.where("id IS NOT NULL").groupBy("id").agg(*[F.min_by(c, F.struct("at", "kind", "name", "cents")).alias(c) for c in ("kind", "name", "provider", "model", "cents", "at")])
    used = seen.unionByName(used.where("id IS NULL").select(*seen.columns))
    names = used.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("concepts"))
    top = names.orderBy(F.desc("concepts"), F.asc("name")).limit(most)
    rest = names.join(top.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("names"), F.sum("concepts").alias("concepts")).where("names > 0")
    per_name = top.select("name", "concepts", F.lit(1).cast("long").alias("names")).unionByName(rest.select(F.lit(None).cast("string").alias("name"), "concepts", "names"))
    unknown = F.lit("onbekend")
    models = used.where("kind = 'ai_read'").groupBy(F.coalesce("provider", unknown).alias("provider"), F.coalesce("model", unknown).alias("model")).agg(F.count(F.lit(1)).alias("concepts"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.count_if(F.col("cents").isNull()).alias("unknown_costs"))
    totals = used.agg(F.count(F.lit(1)).alias("used"), F.count_if(F.col("name").isNull()).alias("unattributed"), F.count_if(F.col("at").isNull()).alias("timestamps_missing"), F.min("at").alias("from_at"), F.max("at").alias("to_at"))
    return per_name, models, totals
