"""Decisions as columns: from what is known of a source, a job or a page to what is done next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statuses of sources and menus, actions with their queues and priorities, and what
# a failed job tells of its source.
SOURCES = ("reachable", "unreachable", "access_limited", "identity_changed")
MENUS = ("ready_for_review", "structure_not_recognized", "no_menu_found", "not_assessed")
QUEUES = {"review": "review", "review_manually": "review", "check_source": "source", "check_access": "source", "check_identity": "identity"}
PRIORITIES = {"check_identity": 0, "check_source": 1, "check_access": 1, "review_manually": 2, "review": 3}
FAILURES = {"fetch_failed": "unreachable", "robots_disallowed": "access_limited", "unsupported_content_type": "reachable", "pdf_extraction_failed": "reachable"}


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def known(status: Column, values: tuple[str, ...], what: str) -> Column:
    """The status; an unknown or missing one is an error, never a default."""
    message = F.concat(F.lit(f"unknown {what} status: "), F.coalesce(status, F.lit("null")))
    return F.when(status.isin(*values), status).otherwise(F.raise_error(message).cast("string"))


def classify_source(source: Column, menu: Column) -> Column:
    """struct(source, menu, action, queue, priority) for all pairs of statuses. The menu of a source
    that can't be reached is not assessed."""
    of_source = {"identity_changed": "check_identity", "unreachable": "check_source", "access_limited": "check_access"}
    of_menu = {"ready_for_review": "review", "no_menu_found": "check_source", "structure_not_recognized": "review_manually", "not_assessed": "review_manually"}
    s, given = known(source, SOURCES, "source"), known(menu, MENUS, "menu")
    m = F.when(s == "reachable", given).when(given.isNotNull(), F.lit("not_assessed"))
    action = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in of_source.items() for x in p]), s), _lookup(m, of_menu))
    return F.struct(s.alias("source"), m.alias("menu"), action.alias("action"), _lookup(action, QUEUES).alias("queue"), _lookup(action, PRIORITIES).alias("priority"))


def observe_job(status: Column, reason: Column, has_receipt: Column, items: Column, found_any: Column) -> Column:
    """struct(source, menu) that a finished job tells, or null if it tells nothing: items are the menu
    items it recognised, found_any whether it saw anything like a menu."""
    told = F.try_element_at(F.create_map(*[F.lit(x) for p in FAILURES.items() for x in p]), reason)
    menu = F.when(items > 0, "ready_for_review").when(found_any, "structure_not_recognized").otherwise("not_assessed")
    return F.when((status == "succeeded") & has_receipt, F.struct(F.lit("reachable").alias("source"), menu.alias("menu"))).when(
        (status == "failed") & told.isNotNull(), F.struct(told.alias("source"), F.lit("not_assessed").alias("menu"))
    )


def inbox_state(runs: Column, run_status: Column, candidates: Column, filtered: Column) -> Column:
    """struct(state, show_error) of an inbox: no run at all, nothing in this run, nothing that the
    filters leave, or candidates. A failed or partial run says so beside its candidates."""
    state = F.when(F.coalesce(runs, F.lit(0)) == 0, "no-runs").when((candidates == 0) & filtered, "no-filter-matches").when(candidates == 0, "run-has-no-candidates").otherwise("has-candidates")
    return F.struct(state.alias("state"), ((F.coalesce(runs, F.lit(0)) > 0) & F.coalesce(run_status.isin("failed", "partial"), F.lit(False))).alias("show_error"))


def host_of(url: Column) -> Column:
    """The host of a web address in lower case, without www. and a last dot; an address without a
    scheme is read as https. Null for other schemes, white space, and hosts without a dot."""
    text = F.trim(url)
    whole = F.when(F.startswith(text, F.lit("//")), F.concat(F.lit("https:"), text)).when(text.rlike("(?i)^[a-z][a-z0-9+.-]*:"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.|\.$", "")
    return F.when(~text.rlike(r"\s") & F.contains(host, F.lit(".")), host)


def path_of(url: Column) -> Column:
    """The path of a web address without slashes at its end."""
    return F.regexp_replace(F.regexp_extract(F.trim(url), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)", 1), "/+$", "")


def same_address(a: Column, b: Column) -> Column:
    """Equal hosts and paths; false where a host can't be read."""
    return F.coalesce((host_of(a) == host_of(b)) & (path_of(a) == path_of(b)), F.lit(False))


def certainty(restaurant: Column, menu: Column, uncertain: Column, found_url: Column, website: Column) -> Column:
    """'high', or the first reason why a found source isn't certain: the restaurant isn't known, no
    menu was recognised, its structure is uncertain, the host is another, the address is known."""
    return (
        F.when(restaurant.isNull(), "unknown_restaurant")
        .when(F.coalesce(menu != "ready_for_review", F.lit(True)), "no_recognised_menu")
        .when(F.coalesce(uncertain, F.lit(False)), "structure_uncertain")
        .when(F.coalesce(host_of(found_url) != host_of(website), F.lit(True)), "other_host")
        .when(same_address(found_url, website), "already_known_source")
        .otherwise("high")
    )


def retry_outcome(url: Column, open_batch: Column, open_job: Column, used_today: Column, quota: int = 25) -> Column:
    """What asking for one address again gives: the address must be a plain http one of up to 2048
    characters, its account must have no open batch, an open job isn't queued twice, and a day (in
    Amsterdam) has a quota."""
    plain = (F.length(F.trim(url)) <= 2048) & F.trim(url).rlike(r"(?i)^https?://[a-z0-9.-]{1,253}(?::\d+)?(?:/[^?#\s]*)?$")
    return F.when(~F.coalesce(plain, F.lit(False)), "invalid").when(open_batch, "open_batch").when(open_job, "already_active").when(F.coalesce(used_today, F.lit(0)) >= quota, "quota_reached").otherwise("queued")
