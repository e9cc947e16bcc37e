"""Batches, sweeps, approvals and identities on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from menulake.functions import content
from menulake.operators import extract, menus, records
from menulake.sources import places

NOW = dt.datetime(2024, 2, 1, 12)


def now():
    return F.lit(NOW)


def ago(**x):
    return NOW - dt.timedelta(**x)


def test_enqueue(spark):
    items = [(1, 1, " https://a.nl/x "), (1, 2, "https://a.nl/x"), (1, 3, "https://a.nl/x?y"), (1, 4, None), (1, 5, "https://b.nl"), (1, 6, "https://c.nl"), (1, 7, "https://d.nl"), (2, 1, "https://a.nl/x"), (2, 2, "https://e.nl"), (2, 3, "ftp://f.nl")]
    jobs = [(1, "https://b.nl", "running", 9, False, None), (2, "https://c.nl", "succeeded", 9, False, ago(days=7)), (3, "https://c.nl", "succeeded", 9, False, ago(days=6)), (4, "https://d.nl", "succeeded", 9, False, ago(days=8)), (5, "https://e.nl", "pending", 9, True, None), (6, "https://e.nl", "pending", None, False, None)]
    got = records.enqueue(spark.createDataFrame(items, "batch_id long, position long, url string"), spark.createDataFrame(jobs, "job_id long, url string, status string, batch_id long, expired boolean, finished_at timestamp"), now()).collect()
    assert {(r.batch_id, r.position): (r.outcome, r.reused_job_id) for r in got} == {(1, 1): ("queued", None), (1, 2): ("duplicate", None), (1, 3): ("invalid", None), (1, 4): ("invalid", None), (1, 5): ("already_active", None), (1, 6): ("recent", 3), (1, 7): ("queued", None), (2, 1): ("queued", None), (2, 2): ("queued", None), (2, 3): ("invalid", None)}


def test_idle_batches_and_sweeps(spark):
    batches = spark.createDataFrame([(1, None, None, ago(hours=25)), (2, None, None, ago(hours=24)), (3, ago(days=3), "completed", ago(days=3))], "batch_id long, closed_at timestamp, close_reason string, last_activity_at timestamp")
    jobs = spark.createDataFrame([(1, 1, "running", None, NOW), (2, 1, "failed", None, None), (3, 1, "pending", ago(days=1), None), (4, 2, "pending", None, None), (5, None, "pending", None, None)], "job_id long, batch_id long, status string, expired_at timestamp, lease_expires_at timestamp")
    closed, swept = records.close_idle(batches, jobs, now())
    assert {r.batch_id: (r.closed_at, r.close_reason) for r in closed.collect()} == {1: (NOW, "expired"), 2: (None, None), 3: (ago(days=3), "completed")}
    assert swept.columns == jobs.columns and {r.job_id: (r.expired_at, r.lease_expires_at) for r in swept.collect()} == {1: (NOW, None), 2: (None, None), 3: (ago(days=1), None), 4: (None, None), 5: (None, None)}
    offers = spark.createDataFrame([(1, "online", NOW), (2, "online", NOW + dt.timedelta(seconds=1)), (3, "draft", ago(days=1)), (4, "online", None)], "offer_id long, status string, expires_at timestamp")
    left, audit = records.sweep(offers, now())
    assert {r.offer_id: r.status for r in left.collect()} == {1: "expired", 2: "online", 3: "draft", 4: "online"} and [tuple(r) for r in audit.collect()] == [(1, "online", "expired", NOW)]


def test_approvals(spark):
    pending = spark.createDataFrame([(1, "pending", 7, "phone", None, "a"), (2, "pending", 7, "phone", None, "b"), (3, "approved", 7, "phone", None, "c"), (4, "pending", 8, "dish", "x", "d"), (5, "pending", 9, "dish", "x", "e")], "id long, status string, restaurant_id long, field string, ref string, value string")
    provenance = spark.createDataFrame([(7, "phone", None, "old", "site", ago(days=9)), (7, "name", None, "n", "site", ago(days=9))], "restaurant_id long, field string, ref string, value string, origin string, updated_at timestamp")
    asked = spark.createDataFrame([(1, ago(hours=2)), (2, ago(hours=1)), (3, NOW), (4, NOW), (4, ago(hours=1)), (99, NOW)], "id long, at timestamp")
    done, facts, missing = records.approve_changes(pending, provenance, asked)
    assert {r.id: r.status for r in done.collect()} == {1: "approved", 2: "approved", 3: "approved", 4: "approved", 5: "pending"}
    assert sorted((r.restaurant_id, r.field, r.value, r.origin) for r in facts.collect()) == [(7, "name", "n", "site"), (7, "phone", "b", "editor"), (8, "dish", "d", "editor")] and sorted(r.id for r in missing.collect()) == [3, 99]
    claims = spark.createDataFrame([(1, "pending", 10, 7), (2, "pending", 10, 7), (3, "rejected", 11, 7), (4, "pending", 12, 8)], "id long, status string, user_id long, restaurant_id long")
    roles = spark.createDataFrame([(12, "owner", 8)], "user_id long, role string, restaurant_id long")
    done, after = records.approve_claims(claims, roles, spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "id long"))
    assert {r.id: r.status for r in done.collect()} == {1: "approved", 2: "approved", 3: "rejected", 4: "approved"} and sorted(tuple(r) for r in after.collect()) == [(10, "owner", 7), (12, "owner", 8)]


def test_drafts_of_one_place_are_compared_once_and_not_sent_to_the_driver(spark, tmp_path):
    spark.range(3000).selectExpr("id AS candidate_id", "'De Zon' AS name", "51.5 + id % 3 * 0.0005 AS lat", "4.7D AS lon").write.parquet(f"{tmp_path}/c")
    crowd = spark.read.parquet(f"{tmp_path}/c")  # a file that looks small
    found = records.first_duplicate_draft(crowd, crowd.selectExpr("candidate_id AS draft_id", "-candidate_id AS ordinal", "name", "lat", "lon"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.candidate_id % 3, r.draft_id) for r in found.collect()} == {(0, 2998), (1, 2999), (2, 2999)} and found.count() == 3000


def test_known_candidates_and_drafts(spark):
    known = records.baseline(spark.createDataFrame([("Restaurant De Zon", "https://www.zon.nl/menu"), ("Café Maan & Ster", None), (None, "x")], "name string, website string"))
    assert {(r.kind, r.key) for r in known.collect()} == {("name", "restaurant de zon"), ("comparable", "de zon"), ("core", "zon"), ("host", "zon.nl"), ("name", "cafe maan en ster"), ("comparable", "maan en ster"), ("core", "maan ster")}
    rows = [(1, "restaurant de zon", None), (2, "De Zon", None), (3, "Zon", None), (4, "Anders", "zon.nl"), (5, "Ster Maan", None), (6, "Nieuw", "nieuw.nl"), (7, None, None)]
    got = records.unknown(spark.createDataFrame(rows, "id long, name string, website string"), known).collect()
    assert sorted(r.id for r in got) == [6, 7]
    cands = spark.createDataFrame([(1, "De Zon", 51.5, 4.7), (2, "de zón", 51.5005, 4.7), (3, "De Zon", 51.6, 4.7), (4, "", 51.5, 4.7), (5, "De Zon", None, 4.7)], "candidate_id long, name string, lat double, lon double")
    drafts = spark.createDataFrame([("b", 2, "DE ZON", 51.5, 4.7), ("a", 1, "De Zon", 51.5008, 4.7), ("c", 0, "Anders", 51.5, 4.7)], "draft_id string, ordinal int, name string, lat double, lon double")
    assert {r.candidate_id: r.draft_id for r in records.first_duplicate_draft(cands, drafts).collect()} == {1: "a", 2: "a"}
    pairs = spark.createDataFrame([("De Kroeg", "Café De Kroeg"), ("a", "b"), ("", "b"), (None, "b")], "a string, b string")
    assert [r.same for r in records.unsure_names(pairs).collect()] == [True, False, None, None]


def test_features_are_classified(spark):
    square = F.array(F.array(F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])))
    bar = {"amenity": "bar"}
    rows = [(1, "a", None, 1.0, bar), (2, "a", 1.0, 1.0, bar), (3, "a", 1.0, 1.0, bar), (4, None, 1.0, 1.0, bar), (5, "b", 1.0, 1.0, {"amenity": "bank"}), (6, "c", 5.0, 1.0, bar), (7, "d", float("nan"), 1.0, bar), (8, "", 1.0, 1.0, None), (9, "c", 1.0, 1.0, bar)]
    got = places.classified(spark.createDataFrame(rows, "ordinal long, osm_id string, lat double, lon double, tags map<string,string>"), square).collect()
    assert {r.ordinal: (r.outcome, r.reason) for r in got} == {1: ("errored", "non-numeric-coordinates"), 2: ("stored", None), 3: ("errored", "duplicate-osm-node-id"), 4: ("errored", "missing-osm-id"), 5: ("errored", "amenity-not-allowed"), 6: ("skipped", "outside-boundary"), 7: ("errored", "non-numeric-coordinates"), 8: ("errored", "missing-osm-id"), 9: ("errored", "duplicate-osm-node-id")}
    tags = [({"brand": " "}, False, False), ({"brand:wikidata": "Q1"}, True, False), ({"disused:amenity": "bar"}, False, True), ({"opening_hours": "Closed"}, False, True), ({"wash": "x"}, False, False), ({}, False, False)]
    df = spark.createDataFrame(tags, "t map<string,string>, c boolean, g boolean")
    assert all(r.c == r.chain and r.g == r.gone for r in df.select("c", "g", places.is_chain(F.col("t")).alias("chain"), places.is_gone(F.col("t")).alias("gone")).collect())


def test_labels_confidence_and_links(spark):
    rows = [("€ 12", False, 12.0, ["per persoon", "PER PERSOON", " ", None], False, "€ 12 · per persoon"), ("€ 12 per stuk", None, 12.0, ["per stuk"], True, "vanaf € 12 per stuk"), ("vanaf € 9", False, 9.0, None, True, "vanaf € 9"), ("€ 9", True, 9.0, None, False, None), (" ", False, 9.0, None, False, None), ("€ 9", False, None, None, False, None)]
    df = spark.createDataFrame(rows, "p string, r boolean, v double, n array<string>, f boolean, want string")
    assert all(r.got == r.want for r in df.select("want", content.price_label(*map(F.col, "prvnf")).alias("got")).collect())
    rows = [(False, "conflict", True, "middel"), (True, "conflict", True, "laag"), (True, "unverified", True, "middel"), (True, "consistent", True, "hoog"), (True, "consistent", None, "middel")]
    df = spark.createDataFrame(rows, "h boolean, s string, p boolean, want string")
    assert all(r.got == r.want for r in df.select("want", content.field_confidence(*map(F.col, "hsp")).alias("got")).collect())
    with pytest.raises(Exception, match="unknown context status"):
        spark.createDataFrame([(False, "x", True)], "h boolean, s string, p boolean").select(content.field_confidence(*map(F.col, "hsp")).alias("c")).collect()
    links = [("https://a.nl/x/y", "../z?q", "https://a.nl/z?q"), ("https://a.nl/x", "//b.nl", "https://b.nl"), ("https://a.nl/x", "mailto:a@b.nl", None), ("https://a.nl", " /m ", "https://a.nl/m"), (None, "/m", None), ("https://a.nl", None, None), ("https://[bad", "x", None)]
    df = spark.createDataFrame(links, "b string, h string, want string")
    assert all(r.got == r.want for r in df.select("want", content.resolved("b", "h").alias("got")).collect())


def test_overlay_on_a_nested_menu(spark):
    nested = spark.createDataFrame([("1-N", [("Vooraf", [("Soep", 500), ("Vis", 900)]), ("Hoofd", [("Kip", None)])]), ("2-N", [("Leeg", [])]), ("3-N", None)], "menu_key string, categories array<struct<name:string,items:array<struct<name:string,price_cents:long>>>>")
    edits = spark.createDataFrame([("1-N", 0, 1, 950, None), ("1-N", 1, 0, None, False), ("1-N", 9, 9, 1, True), ("2-N", 0, 0, 1, True)], "menu_key string, c int, i int, price_cents long, available boolean")
    got = {r.menu_key: r.categories and [(c.name, [tuple(x) for x in c["items"]]) for c in r.categories] for r in menus.overlaid(nested, edits).collect()}
    assert got == {"1-N": [("Vooraf", [("Soep", 500, True), ("Vis", 950, True)]), ("Hoofd", [("Kip", None, False)])], "2-N": [("Leeg", [])], "3-N": None}


def test_restaurant_fields(spark):
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["CafeOrCoffeeShop"],"name":" Zon ","address":{"streetAddress":"Markt 1","postalCode":"4811 AB","addressLocality":"Breda"},"url":"https://zon.nl"}]}</script>'
    rest = '<a class=x href="tel:+31761234567"><b>Bel</b></a><address>Markt&nbsp;2<br>Breda</address>'
    rows = [(1, ld + rest), (2, rest), (3, "<p>076 1234567</p>"), (4, None), (5, '<script type="application/ld+json">{bad</script>' + ld.replace("CafeOrCoffeeShop", "Person"))]
    got = [(r.page_id, r.field, r.value, r.method) for r in extract.restaurant_fields(spark.createDataFrame(rows, "page_id long, html string")).collect()]
    assert sorted(got) == [(1, "address", "Markt 1, 4811 AB Breda", "json_ld"), (1, "category", "CafeOrCoffeeShop", "json_ld"), (1, "name", "Zon", "json_ld"), (1, "phone", "+31761234567", "html"), (1, "website", "https://zon.nl", "json_ld"), (2, "address", "Markt 2 Breda", "html"), (2, "phone", "+31761234567", "html")]


def test_promotion(spark):
    cands = spark.createDataFrame([(1, "Zon", "bar", "a", None, "w"), (2, "Maan", None, None, None, None), (3, "Ster", None, None, None, None), (4, "Mars", None, None, None, None)], "candidate_id long, name string, category string, address string, phone string, website string")
    reviews = spark.createDataFrame([(1, ago(days=2), 1, "rejected"), (1, ago(days=1), 2, "approved_internal"), (2, ago(days=1), 3, "approved_internal"), (2, ago(days=1), 4, "deferred"), (3, NOW, 5, "approved_internal"), (4, NOW, 6, "approved_internal")], "candidate_id long, decided_at timestamp, id long, status string")
    drafts = spark.createDataFrame([("x", 1, "discarded"), ("y", 3, "draft"), ("z", 4, "draft2")], "draft_id string, candidate_id long, status string")
    fixes = spark.createDataFrame([(1, "phone", "old", ago(days=3), 1), (1, "phone", "new", ago(days=1), 2), (1, "address", "b", NOW, 3)], "candidate_id long, field string, value string, recorded_at timestamp, id long")
    asked = spark.createDataFrame([("d1", 1, "x"), ("d2", 1, None), ("d3", 2, None), ("d4", 3, None), ("d5", 4, "z"), ("d6", 99, None)], "draft_id string, candidate_id long, restarted_from string")
    told, facts = records.promote(cands, reviews, drafts, fixes, asked)
    assert {r.draft_id: r.outcome for r in told.collect()} == {"d1": "promoted", "d2": "already_active", "d3": "not_approved", "d4": "already_active", "d5": "bad_restart", "d6": "not_found"}
    assert sorted(tuple(r) for r in facts.collect()) == [("d1", "address", "b", "enrichment"), ("d1", "category", "bar", "import"), ("d1", "name", "Zon", "import"), ("d1", "phone", "new", "enrichment"), ("d1", "website", "w", "import")]
    got = records.enriched(cands, fixes)
    assert got.columns == cands.columns and {r.candidate_id: (r.address, r.phone, r.website) for r in got.collect()} == {1: ("b", "new", "w"), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None)}


def test_inbox_filters(spark):
    rows = [(1, "r1", "bar", "De Zon", True, "ok", "new"), (2, "r1", "cafe", None, None, "bad", "new"), (3, "r2", "bar", "Zonnig", False, "ok", "later")]
    df = spark.createDataFrame(rows, "id long, run_id string, category string, name string, possible_duplicate boolean, quality string, review string")
    found = lambda **x: sorted(r.id for r in records.inbox(df, **x).collect())
    assert found() == [1, 2, 3] and found(name="ZON") == [1, 3] and found(duplicate=False) == [2, 3] and found(duplicate=True) == [1] and found(run_id="r1", category="bar") == [1] and found(quality="ok", review="later") == [3]


def test_proposals_and_inserts(spark):
    proposals = spark.createDataFrame([(1, "open", None), (2, "open", None), (3, "accepted", "x"), (4, "open", None)], "id long, status string, note string")
    asked = spark.createDataFrame([(1, "accepted", " ", NOW), (1, "rejected", "late", NOW + dt.timedelta(seconds=1)), (2, "rejected", " ", NOW), (3, "rejected", "n", NOW), (4, "maybe", "n", NOW), (4, "rejected", "bad", NOW), (9, "accepted", None, NOW)], "id long, decision string, note string, at timestamp")
    after, events, refused = records.decide_proposals(proposals, asked)
    assert {r.id: (r.status, r.note) for r in after.collect()} == {1: ("accepted", None), 2: ("open", None), 3: ("accepted", "x"), 4: ("rejected", "bad")}
    assert sorted((r.id, r.event, r.note) for r in events.collect()) == [(1, "accepted", None), (4, "rejected", "bad")] or sorted((r.id, r.event) for r in events.collect()) == [(1, "accepted"), (4, "rejected")]
    assert sorted((r.id, r.reason) for r in refused.collect()) == [(1, "not_open"), (2, "reason_needed"), (3, "not_open"), (4, "unknown_decision"), (9, "not_open")]
    table, rows = spark.createDataFrame([(1, "a")], "id long, v string"), spark.createDataFrame([("b", 1), ("c", 2), ("c", 2)], "v string, id long")
    once = records.inserted(table, rows, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c")] and sorted(map(tuple, records.inserted(once, rows, ["id"]).collect())) == [(1, "a"), (2, "c")]


def test_usage_export(spark):
    rows = [("1", "ai_read", "Aad", "p", "m", 5, ago(days=1)), ("1", "ai_read", "Aad", "p", "m", 5, NOW), ("2", "ai_read", None, "p", "m", None, None), ("3", "manual", "Bo", None, None, None, ago(days=2)), (None, "manual", "Bo", None, None, None, NOW), ("4", None, "x", None, None, 9, NOW), ("5", "ai_read", "Zed", None, None, 7, NOW)]
    df = spark.createDataFrame(rows, "id string, kind string, name string, provider string, model string, cents long, at timestamp")
    names, models, totals = records.usage_export(df, 1)
    assert sorted(map(tuple, names.collect()), key=str) == sorted([("Bo", 2, 1), (None, 2, 2)], key=str)
    assert sorted(map(tuple, models.collect())) == [("onbekend", "onbekend", 1, 7, 0), ("p", "m", 2, 5, 1)] and totals.first()[:] == (5, 1, 1, ago(days=2), NOW)


def test_menu_links_icons_and_flags(spark):
    html = "<a href='/menu'>Onze <b>menukaart</b></a><a href=/x/menu.pdf>Kaart (pdf)</a><a href='/menu/'>nog eens</a><a href='https://www.h.nl/lunch?x=1#a'>eten</a><a href='/cadeaukaart'>menu cadeaukaart</a><a href='https://andere.nl/menu'>menu</a><a href='/over'>over ons</a><a href='/kaart'>hier</a><a href='/start'>menu</a><a href='mailto:menu@h.nl'>menu</a>"
    got = extract.menu_links(spark.createDataFrame([(1, "https://h.nl/start", html), (2, None, html), (3, "https://[bad", html), (4, "https://h.nl", None)], "page_id long, url string, html string"), 4).collect()
    assert [(r.page_id, r.pos, r.link, r.matched_on) for r in got] == [(1, 1, "https://h.nl/x/menu.pdf", "Kaart (pdf)"), (1, 2, "https://h.nl/menu", "Onze menukaart"), (1, 3, "https://www.h.nl/lunch?x=1", "eten"), (1, 4, "https://h.nl/kaart", "hier")]
    icons = [("Uiensoep met kaas", None, "🍲"), ("Planken", "Kaas", "🧀"), ("Bier", "", content.NO_ICON), (None, None, content.NO_ICON)]
    assert all(r.i == r.w for r in spark.createDataFrame(icons, "n string, c string, w string").select("w", content.dish_icon(F.col("n"), F.col("c")).alias("i")).collect())
    rows = [("a", "Vooraf", "Soep", True), ("a", "Hoofd", "soep!", True), ("b", "Vooraf", "Soep", True), ("b", "Vooraf", "SOEP", True), ("c", None, "+ Friet", False), ("c", "X", "A // B", True), ("c", "X", "w " * 15, True), ("d", "X", None, True), ("d", "X", "", True)]
    got = {r.menu: (r.flags, r.ok) for r in menus.item_flags(spark.createDataFrame(rows, "menu string, category string, name string, priced boolean")).collect()}
    assert got == {"a": ([], True), "b": (["duplicate_in_category"], True), "c": (["section_marker", "long_name", "supplement_as_item", "unresolved_price", "unheaded_items"], False), "d": ([], True)}
