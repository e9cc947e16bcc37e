"""Rules about places, days, texts and menus, on small rows."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from menulake.functions import content, dates, geo
from menulake.operators import menus
from menulake.sources import places

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
FAR = [(10.0, 0.0), (12.0, 0.0), (11.0, 2.0)]
SHAPE = "array<array<array<struct<lon:double,lat:double>>>>"


def test_multipolygons(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-1, 13), rng.uniform(-1, 5)) for _ in range(300)] + [(2.0, 2.0), (0.5, 0.5), (11.0, 1.0)]
    df = spark.createDataFrame([(x, y, [[SQUARE, HOLE], [FAR]]) for x, y in points], f"x double, y double, shape {SHAPE}")

    def ring(x, y, r):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:] + r[:1], strict=True)) % 2 == 1

    got = {(r.x, r.y): r.i for r in df.select("x", "y", geo.in_multipolygon(F.col("x"), F.col("y"), F.col("shape")).alias("i")).collect()}
    assert got == {(x, y): ring(x, y, SQUARE) and not ring(x, y, HOLE) or ring(x, y, FAR) for x, y in points} and set(got.values()) == {True, False}
    assert df.select(geo.bounding_box(F.col("shape"), 0.5).alias("b")).first().b[:] == (-0.5, -0.5, 12.5, 4.5)
    one = spark.createDataFrame([(51.5, 4.7, 51.6, 4.8)], "a double, b double, c double, d double").select(geo.metres(*map(F.col, "abcd")).alias("m")).first().m
    assert math.isclose(one, 13083, rel_tol=0.01)


def at(*x):
    return dt.datetime(*x)


def test_days_in_amsterdam(spark):
    df = spark.createDataFrame([(at(2024, 3, 31, 12),), (at(2024, 1, 1, 23, 30),), (at(2024, 7, 1, 21, 59),), (None,)], "t timestamp")
    got = [r.b for r in df.select(dates.day_begin(F.col("t")).alias("b")).collect()]
    assert got == [at(2024, 3, 30, 23), at(2024, 1, 1, 23), at(2024, 6, 30, 22), None]  # the day that has 23 hours begins in winter time
    now = at(2024, 7, 1, 10)
    rows = [("daghap", 1320, None, None), ("dagmenu", None, None, None), ("seizoensgerecht", 1200, dt.date(2024, 12, 1), None), ("seizoensgerecht", None, dt.date(2024, 9, 29), None), ("seizoensgerecht", None, None, None), ("daghap", 1200, None, dt.date(2024, 7, 8)), ("daghap", None, None, dt.date(2024, 6, 30)), ("x", None, None, None)]
    df = spark.createDataFrame([(k, now, c, e, r) for k, c, e, r in rows], "k string, n timestamp, c int, e date, r date").select(dates.expiry(*map(F.col, "kncer")).alias("x"))
    assert [r.x for r in df.collect()] == [at(2024, 7, 1, 20), at(2024, 7, 1, 21, 59), None, at(2024, 9, 29, 21, 59), None, at(2024, 7, 8, 18), None, None]
    rows = [(at(2024, 7, 1, 9), None, None, None), (at(2024, 7, 9), [1, 3], dt.date(2024, 6, 30), None), (at(2024, 7, 9), [2], None, None), (at(2024, 7, 9), [1], dt.date(2024, 7, 1), at(2024, 7, 1, 8)), (at(2024, 7, 9), [], None, at(2024, 6, 30, 21)), (None, None, None, None)]
    df = spark.createDataFrame([(e, now, w, u, s) for e, w, u, s in rows], "e timestamp, n timestamp, w array<int>, u date, s timestamp").select(dates.online(*map(F.col, "enwus")).alias("o"))
    assert [tuple(r.o) for r in df.collect()] == [(False, False, "expired"), (False, False, "past"), (False, False, "other_day"), (True, True, "sold_out"), (True, False, None), (False, False, "expired")]
    df = spark.createDataFrame([(at(2024, 7, 1),), (at(2024, 4, 2, 10),), (at(2024, 4, 2, 9, 59),), (None,)], "c timestamp").select(dates.confirmation(F.col("c"), F.lit(now)).alias("x"))
    assert [(r.x.active, r.x.days_left) for r in df.collect()] == [(True, 90), (False, 0), (False, 0), (False, 0)]
    assert [r.s for r in spark.createDataFrame([(dt.date(2024, 10, 1),), (dt.date(2024, 7, 1),), (None,)], "d date").select(dates.seasons(F.col("d")).alias("s")).collect()] == [["mosselen", "wild", "pompoen"], [], []]


@pytest.mark.parametrize(
    "text, problems",
    [("Soep van de dag", []), ("kijk op www.x.nl", ["url"]), ("mail a@b.nl", ["url", "email"]), ("bel 06 1234 5678", ["phone"]), ("SOEP 12,50", ["capitals"]), ("A 12", []), ("lekker!!!", ["marks"]), ("🍕🍝🥗", []), ("🍕🍝🥗🍔 ja", ["emoji"]), (None, []), ("", [])],
)
def test_text_problems(spark, text, problems):
    assert spark.createDataFrame([(text,)], "t string").select(content.text_problems(F.col("t")).alias("p")).first().p == problems


def test_words_phones_urls_and_kinds(spark):
    words = {"reclame": ["korting", "1+1"], "scheldwoord": ["sukkel"]}
    rows = [("Nu  KÓRTING!", ["reclame:korting"]), ("kortingen", []), ("1+1 gratis, sukkel 50%", ["reclame:1+1", "scheldwoord:sukkel", "reclame:%"]), (None, []), ("", [])]
    got = spark.createDataFrame(rows, "t string, w array<string>").select("w", content.word_reasons(F.col("t"), words).alias("r")).collect()
    assert all(r.r == r.w for r in got)
    phones = [("06-12 34 56 78", "+31612345678", "06 12345678", True), ("0031 (76) 1234567", "+31761234567", "0761234567", True), ("+31 761234567", "+31761234567", "0761234567", True), (" 12345 ", "12345", "12345", False), ("076-12345678", "076-12345678", "076-12345678", False), ("bel ons", "bel ons", "bel ons", False), (None, None, None, False)]
    got = spark.createDataFrame([(p[0],) for p in phones], "t string").select(content.phone(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [p[1:] for p in phones]
    urls = [(" HTTP://WWW.A.nl:80/Menu?x=1#y", ("http://www.a.nl/Menu", "www.a.nl")), ("https://a.nl", ("https://a.nl/", "a.nl")), ("https://u:p@a.nl:8443/x", ("https://a.nl:8443/x", "a.nl")), ("ftp://a.nl", None), ("a.nl", None), (None, None)]
    got = spark.createDataFrame([(u[0],) for u in urls], "u string").select(content.canonical_url(F.col("u")).alias("c")).collect()
    assert [tuple(r.c) if r.c else None for r in got] == [u[1] for u in urls]
    hints = [("/menu", True), ("/onze-menukaart", False), ("/lunch-2024", True), ("/x/kaart/", True), ("/kaarten.html", True), ("/menuet", False), (None, False)]
    assert all(r.h == r.w for r in spark.createDataFrame(hints, "p string, w boolean").select("w", content.menu_hint(F.col("p")).alias("h")).collect())
    kinds = [("Biercafé · Amerikaans", "Biercafé"), ("Baskisch · Grill", "Grill"), ("Baskisch", "Baskisch"), ("Grand Café", "Nederlands"), ("", "Onbekend"), (None, "Onbekend"), (" · Pizzeria", "Pizzeria"), ("pizza & pasta", "Italiaans")]
    assert all(r.k == r.w for r in spark.createDataFrame(kinds, "c string, w string").select("w", content.cuisine_family(F.col("c")).alias("k")).collect())


def test_completeness(spark):
    good = [("a", "Vooraf", False, f"Gerecht {c}", None, 100 + i, False) for i, c in enumerate("abcdefgh")]
    rows = good + [("b", "Vooraf", False, "Soep", None, 500, False), ("b", "vooraf ", False, "SOEP", "", 500, False), ("b", " ", True, "Vis", None, None, None), ("b", "Vooraf", None, "Kaas", None, 16_000, None), ("b", "Vooraf", False, "Extra", None, 20_000, True), ("c", "Leeg", False, " ", None, 1, False)]
    got = {r.menu: (r.ok, r.reasons, r.dishes, r.priced) for r in menus.completeness(spark.createDataFrame(rows, "menu string, category string, uncertain boolean, name string, description string, cents long, supplement boolean")).collect()}
    assert got == {"a": (True, [], 8, 8), "b": (False, ["uncategorised_dishes", "uncertain_sections", "unpriced_dishes", "price_out_of_bounds", "duplicate_dishes", "too_few_dishes"], 5, 4), "c": (False, ["no_dishes"], 0, 0)}


def test_hierarchy_replacement_and_removed(spark):
    rows = [("a", 0, ["Kaart", "Vooraf"], False), ("a", 1, ["Kaart", "Hoofd", "Vis"], False), ("a", 2, ["Kaart", "Hoofd"], True), ("b", 0, [], False), ("b", 1, ["X"], False), ("b", 2, ["X", "Y"], False), ("c", 0, None, False), ("d", 0, ["a", "b", "c", "e", " "], False), ("e", 0, ["T", "1"], False), ("e", 1, ["T"], False)]
    got = {(r.menu, r.position): (r.title, r.path, r.uncertain) for r in menus.hierarchy(spark.createDataFrame(rows, "menu string, position int, path array<string>, untrusted boolean")).collect()}
    assert got == {
        ("a", 0): ("Kaart", ["Vooraf"], False), ("a", 1): ("Kaart", ["Hoofd", "Vis"], False), ("a", 2): ("Kaart", ["Hoofd"], True), ("b", 0): (None, ["Menu"], True), ("b", 1): (None, ["X"], True), ("b", 2): (None, ["X", "Y"], False),
        ("c", 0): (None, ["Menu"], False), ("d", 0): ("a", ["b", "c", "e"], True), ("e", 0): (None, ["T", "1"], False), ("e", 1): (None, ["T"], True),
    }
    items = spark.createDataFrame([("a", "q", True)] * 4 + [("b", "q", True)] * 8 + [("c", "q", True)] * 4 + [("c", " ", True)] + [("d", "q", None)], "menu string, quote string, source_ok boolean")
    known = spark.createDataFrame([("a", 6), ("b", 10), ("c", 5), ("d", 1), ("e", 3)], "menu string, n int")
    assert {r.menu: r.reason for r in menus.replacement(items, known).collect()} == {"a": "coverage_below", "b": "ok", "c": "missing_evidence", "d": "missing_evidence", "e": "no_items"}
    of = lambda rows: spark.createDataFrame(rows, "menu string, path string, name string")
    gone = menus.removed(of([("a", "x", "Café"), ("a", "x", "Vis"), ("a", "old", "Vis"), ("a", "old", "Kip"), ("b", "x", "Vis")]), of([("a", "x", "cafe"), ("a", "y", "vis")]))
    assert sorted(map(tuple, gone.collect())) == [("a", "old", "Kip"), ("a", "x", "Vis"), ("b", "x", "Vis")]


def test_shared_openings_and_first_sightings(spark):
    rows = [("a", "PROEF — VOOR"), ("a", "PROEF  — HOOFD"), ("a", "PROEF — HOOFD"), ("a", "Wijn: rood"), ("b", "X - Y - 1"), ("b", "X - Y - 2"), ("b", "Z"), ("c", "Y: 1"), ("c", "Y: 1")]
    got = {r.g: (r.opening, r.n) for r in menus.shared_opening(spark.createDataFrame(rows, "g string, n_ string"), "g", "n_").collect()}
    assert got == {"a": ("PROEF — ", 2), "b": ("X - Y - ", 2)}
    rows = [(1, "m", "soep"), (1, "m", "soep"), (2, "m", "soep"), (2, "n", "soep"), (3, "m", "vis")]
    got = menus.first_sightings(spark.createDataFrame(rows, "page int, menu string, dish string"), ["menu", "dish"], "page").collect()
    assert sorted(map(tuple, got)) == [(1, "m", "soep"), (1, "m", "soep"), (2, "n", "soep"), (3, "m", "vis")]


def test_places_of_an_answer(spark, tmp_path):
    tags = lambda **x: {"amenity": "restaurant", "name": "Zon", **{k.replace("__", ":"): v for k, v in x.items()}}
    elements = [
        {"type": "node", "id": 1, "lat": 51.5, "lon": 4.7, "tags": tags(addr__street="Markt", addr__housenumber="1", addr__postcode="4811 ab", addr__city="Breda", contact__website="https://zon.invalid", cuisine="x" * 80, phone="1")},
        {"type": "node", "id": 1, "lat": 0, "lon": 0, "tags": tags(name="Twee")}, {"type": "way", "id": 1, "center": {"lat": 51.6, "lon": 4.8}, "tags": tags(name="Café  Maan", amenity="cafe")},
        {"type": "node", "id": 2, "tags": tags(amenity="bank")}, {"type": "node", "id": 3, "tags": {"amenity": "bar", "name": " "}}, {"type": "area", "id": 4, "tags": tags()}, {"type": "node", "tags": tags()}, {"type": "node", "id": 5},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"elements": elements}))
    got = {r.place_id: r for r in places.places(places.read_answer(spark, f"{tmp_path}/a.json")).collect()}
    assert set(got) == {"node/1", "way/1"} and got["node/1"].address == "Markt 1, 4811 ab Breda" and got["node/1"].postcode == "4811AB" and got["node/1"].website == "https://zon.invalid" and len(got["node/1"].cuisine) == 60
    assert (got["way/1"].lat, got["way/1"].lon, got["way/1"].address, got["way/1"].kind) == (51.6, 4.8, None, "cafe")


def test_matched_places(spark):
    found = [("p1", "Restaurant De Zon", "4811AB", 51.5, 4.7), ("p2", "Zon", "4811AB", 51.5, 4.7), ("p3", "Café Maan", None, 51.6, 4.8), ("p4", "maan", "4812CD", 51.7, 4.9), ("p5", "Ster", "4813EF", None, None), ("p6", "Bar", "4814GH", 51.5, 4.7), ("p7", "Restaurant", None, 51.5, 4.7)]
    p = spark.createDataFrame(found, "place_id string, name string, postcode string, lat double, lon double")
    rows = [(1, "de zon", "Markt 1, 4811 AB", 51.5, 4.7), (2, "Eetcafé Zon", None, 51.5, 4.7), (3, "Maan", None, 51.6, 4.8), (4, "Maan", "x 4899ZZ", 51.6, 4.8), (5, "STER", "4813ef", 51.5, 4.7), (6, "Mars", None, 51.5, 4.7), (7, None, None, None, None), (8, "Bar", None, 52.5, 4.7), (9, "Restaurant", None, 51.5, 4.7), (10, "maan", None, None, None)]
    r = spark.createDataFrame(rows, "restaurant_id long, name string, address string, lat double, lon double")
    got = {x.restaurant_id: (x.place_id, x.reason) for x in places.matched(r, p).collect()}
    assert got == {1: ("p1", "exact"), 2: ("p2", "exact"), 3: ("p3", "exact"), 4: (None, "postcode_mismatch"), 5: ("p5", "exact"), 6: (None, "no_name_match"), 7: (None, "no_name"), 8: (None, "too_far"), 9: ("p7", "exact"), 10: (None, "several")}


def test_triage(spark):
    rows = [("reachable", False, True, True), ("unreachable", False, True, True), ("access_limited", False, True, True), (None, True, True, True), ("reachable", False, False, True), ("reachable", True, True, False)]
    steps = [r.s for r in spark.createDataFrame(rows, "s string, o boolean, k boolean, p boolean").select(places.next_step(*map(F.col, "sokp")).alias("s")).collect()]
    assert steps == ["check_via_onboarding", "replace_or_mark", "inspect_or_mark", "review_proposal", "add_candidate", "proposals_unknown"]
    names = ["b", "Éa", "a", "c", "Z", "x"]
    got = places.triage_order(spark.createDataFrame(list(zip(steps, names, strict=True)), "next_step string, name string")).collect()
    assert [r.name for r in got] == ["c", "x", "Éa", "Z", "a", "b"]
