"""Operators and functions on fixtures, against loops, and on odd rows."""

import datetime as dt
import hashlib
import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from menulake.functions import arrays, canonical, decisions, keys, robots
from menulake.functions.prices import USUAL, cents_of, number_tokens, prices
from menulake.operators import coverage, diagnosis, extract, pick, search, state
from menulake.operators.order import global_rank
from menulake.sinks import report
from menulake.sources import catalog, checked
from menulake.storage import TEXT_BYTES, saved
from menulake.streaming import counters


@pytest.mark.parametrize(
    "line, want",
    [
        ("Soep 6,50 / groot 8,- ", [(650, "money"), (800, "money")]),
        ("Friet met mayonaise  4.5", [(450, "point")]),
        ("Zeebaars 34    geschroeid", [(3400, "whole")]),
        ("€ 1250", []),
        ("€ 12", [(1200, "money")]),
        ("open 17.30 - 22.30", []),
        ("Menu 22,50 - 27,50", [(2250, "money"), (2750, "money")]),
        ("biefstuk 200 gram", []),
        ("0,75 l huiswijn 18,50", [(1850, "money")]),
        ("", []),
    ],
)
def test_prices(line, want):
    assert [(t.cents, t.kind) for t in prices(line)] == want


@pytest.mark.parametrize(
    "line, reason",
    [
        ("Kaas 007", "leading_zero"), ("Kaas A12", "glued"), ("Kaas 12foo", "glued"), ("Kaas 12stuks", "unit"), ("Kaas 1e gang", "ordinal"), ("Kaas 6 stuks", "unit"), ("diner 42.0 p.p.", "unit"), ("tafel 12", "counting_word"), ("versie 4.5", "version"),
        ("wijn 4.5 - 6.0", "price_range"), ("vanaf 12.5", "time"), ("kerst 25 december", "date"), ("bel tel 123", "phone"), ("een 12 twee", "no_boundary"), ("12", "no_name"), ("sluit 21.45", "time"),
    ],
)
def test_refused_numbers(line, reason):
    assert reason in [t.reason for t in number_tokens(line)]


def test_typed_prices():
    assert [cents_of(x) for x in ("12,50", "€ 12.5", "12", "12,505", "", None, "a", "123456")] == [1250, 1250, 1200, None, None, None, None, None]


def test_name_and_evidence_keys(spark):
    assert keys.plain_words("Café d’Été & Zn. ﬁjn") == "cafe d ete en zn fijn" and keys.plain_words("A & B", " ") == "a b" and keys.plain_words(None) == ""
    assert keys.composed("Ｃａｆé  \tX") == "café x" and keys.evidence("“Soep”\n– 5") == '"soep" - 5'
    df = spark.createDataFrame([("Café & Bar",), (None,), ("‘Één’   —  Twee\n",)], "s string")
    got = df.select(keys.name_key("s").alias("n"), keys.composed_key("s").alias("c"), keys.evidence_key(F.col("s")).alias("e")).collect()
    assert got[0][:2] == ("cafe en bar", "café & bar") and got[1][:] == (None, None, None) and got[2].e == "'één' - twee"


def test_offer_keys(spark):
    rows = ["daghap-6-12", "daghap-de-kroeg-3", "daghap--1", "daghap-6-012", "6-diner-0-0", "daghap-6", None, "daghap-" + "x" * 65 + "-1", "daghap-6-99999999999999999999"]
    got = spark.createDataFrame([(r,) for r in rows], "k string").select(keys.offer_key(F.col("k")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got[:4]] == [("6", 12), ("de-kroeg", 3), None, None] and all(r.x is None or r.x.offer_id is None for r in got[4:])


def test_path_reasons_and_sets(spark):
    rows = [(["a", "b"], ["x", "b"]), (["a"], ["a", "b"]), (["q", "b"], ["b"]), (["a"], ["b", "c"]), (["a", "b"], ["a", "c"]), (["a"], ["a"]), ([], ["a"])]
    got = spark.createDataFrame(rows, "e array<string>, a array<string>").select(arrays.path_reason(F.col("e"), F.col("a")).alias("r")).collect()
    assert [r.r for r in got] == ["menu_title", "extra_level", "extra_level", "other", "other", None, "extra_level"]
    df = spark.createDataFrame([(["b", "a", "b", None, "c"], ["c", "d", "e"])], "v array<string>, w array<string>")
    one = df.select(arrays.ordered_set(F.col("v"), 2).alias("o"), arrays.toggled(F.col("v"), F.lit("a")).alias("off"), arrays.toggled(F.col("w"), F.lit("z"), 3).alias("on"), arrays.added(F.col("v"), F.col("w"), 4).alias("add")).first()
    assert one.o == ["b", "a"] and one.off == ["b", "b", None, "c"] and one.on == ["c", "d", "e"] and one["add"].entries == ["b", "a", "c", "d"] and one["add"].added == 1


def test_courses_openings_and_counts(spark):
    c = spark.createDataFrame([([("na", "taart"), ("voor", " soep "), ("na", "ijs"), ("x", "y"), ("hoofd", " ")],), ([],)], "c array<struct<gang:string,naam:string>>")
    assert [[tuple(x) for x in r.k] for r in c.select(arrays.courses(F.col("c")).alias("k")).collect()] == [[("voor", "soep"), ("na", "ijs")], []]
    n = spark.createDataFrame([("PROEF  — VOOR — koud",), ("Wijn: rood",), ("Soep",), ("A - ",), (None,)], "n string")
    assert [r.o for r in n.select(arrays.openings(F.col("n")).alias("o")).collect()] == [["PROEF — ", "PROEF — VOOR — "], ["Wijn: "], [], [], []]
    m = spark.createDataFrame([([([([1, 2],), ([3],), (None,)],), (None,)],), (None,)], "m array<struct<categories:array<struct<items:array<int>>>>>")
    assert [r.n for r in m.select(arrays.nested_count(F.col("m"), "categories", "items").alias("n")).collect()] == [3, 0]


def test_canonical_json_has_one_form(spark):
    a = spark.createDataFrame([({"b": 1, "a": 2}, (1, None), [("x", 2)])], "m map<string,int>, s struct<z:int,y:string>, l array<struct<q:string,p:int>>")
    b = spark.createDataFrame([([(2, "x")], (None, 1), {"a": 2, "b": 1})], "l array<struct<p:int,q:string>>, s struct<y:string,z:int>, m map<string,int>")
    texts = [d.select(canonical.canonical_json(d, ["m", "l", "s"]).alias("j"), canonical.content_hash(d, ["s", "m", "l"]).alias("h")).first() for d in (a, b)]
    assert texts[0] == texts[1] and json.loads(texts[0].j) == {"l": [{"p": 2, "q": "x"}], "m": {"a": 2, "b": 1}, "s": {"y": None, "z": 1}} and texts[0].h == hashlib.sha256(texts[0].j.encode()).hexdigest()


def test_robots(spark):
    text = "Disallow: /before\nUser-agent: other\nDisallow: /no\nUSER-AGENT: *\r\nDisallow: /menu # why\nDisallow:\nAllow: /x\ndisallow: /a:b\nUser-agent: *\nDisallow: /late"
    df = spark.createDataFrame([(text, "/menu/1"), (text, "/other"), ("", "/x"), (None, ""), ("User-agent: *\nDisallow: /", "")], "t string, p string")
    got = df.select(robots.disallowed(F.col("t")).alias("r"), robots.allowed(robots.disallowed(F.col("t")), F.col("p")).alias("ok")).collect()
    assert got[0].r == ["/menu", "/a:b", "/late"] and [g.ok for g in got] == [False, True, True, True, False]


def test_decision_table_is_whole_and_refuses_the_unknown(spark):
    rows = [(s, m) for s in decisions.SOURCES for m in decisions.MENUS]
    got = spark.createDataFrame(rows, "s string, m string").select("s", "m", decisions.classify_source(F.col("s"), F.col("m")).alias("x")).collect()
    assert len(got) == 16
    for r in got:
        action = {"identity_changed": "check_identity", "unreachable": "check_source", "access_limited": "check_access"}.get(r.s) or {"ready_for_review": "review", "no_menu_found": "check_source"}.get(r.m, "review_manually")
        assert (r.x.action, r.x.queue, r.x.priority) == (action, decisions.QUEUES[action], decisions.PRIORITIES[action]) and r.x.menu == (r.m if r.s == "reachable" else "not_assessed")
    for bad in (("gone", "not_assessed"), ("reachable", "x"), (None, "not_assessed")):
        with pytest.raises(Exception, match="unknown (source|menu) status"):
            spark.createDataFrame([bad], "s string, m string").select(decisions.classify_source(F.col("s"), F.col("m")).alias("x")).collect()


def test_jobs_inbox_certainty_and_retry(spark):
    jobs = [("succeeded", None, True, 3, True), ("succeeded", None, True, 0, True), ("succeeded", None, True, 0, False), ("succeeded", None, False, 3, True), ("failed", "fetch_failed", False, 0, False), ("failed", "toString", False, 0, False), ("running", None, False, 0, False), ("failed", None, False, 0, False)]
    df = spark.createDataFrame(jobs, "s string, r string, h boolean, i int, f boolean").select(decisions.observe_job(*map(F.col, "srhif")).alias("o"))
    assert [tuple(r.o) if r.o else None for r in df.collect()] == [("reachable", "ready_for_review"), ("reachable", "structure_not_recognized"), ("reachable", "not_assessed"), None, ("unreachable", "not_assessed"), None, None, None]
    inbox = [(0, None, 0, False), (None, "failed", 0, False), (1, "partial", 2, False), (1, "done", 0, True), (1, "failed", 0, False), (1, None, None, True)]
    df = spark.createDataFrame(inbox, "n int, s string, c int, f boolean").select(decisions.inbox_state(*map(F.col, "nscf")).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [("no-runs", False), ("no-runs", False), ("has-candidates", True), ("no-filter-matches", False), ("run-has-no-candidates", True), ("has-candidates", False)]
    urls = [("https://WWW.a.nl/menu/", "a.nl/menu", True), ("http://a.nl/x", "//a.nl./x", True), ("a.nl", "b.nl", False), ("ftp://a.nl", "a.nl", False), (None, "a.nl", False), ("a b.nl", "a b.nl", False), ("localhost", "localhost", False), ("https://u@a.nl:80/q?x#y", "a.nl/q", True)]
    df = spark.createDataFrame(urls, "a string, b string, w boolean")
    assert all(r.got == r.w for r in df.select("w", decisions.same_address(F.col("a"), F.col("b")).alias("got")).collect())
    sure = [(1, "ready_for_review", False, "a.nl/x", "a.nl/"), (None, "ready_for_review", False, "a.nl/x", "a.nl"), (1, None, False, "a.nl/x", "a.nl"), (1, "ready_for_review", True, "a.nl/x", "a.nl"), (1, "ready_for_review", False, "b.nl/x", "a.nl"), (1, "ready_for_review", None, "a.nl/x/", "a.nl/x"), (1, "ready_for_review", False, "a.nl/x", None)]
    df = spark.createDataFrame(sure, "r int, m string, u boolean, f string, w string").select(decisions.certainty(*map(F.col, "rmufw")).alias("c"))
    assert [r.c for r in df.collect()] == ["high", "unknown_restaurant", "no_recognised_menu", "structure_uncertain", "other_host", "already_known_source", "other_host"]
    asks = [("https://a.nl/x", False, False, 3), ("https://a.nl/x?y", False, False, 0), (None, False, False, 0), ("https://a.nl", True, True, 0), ("https://a.nl", False, True, 99), ("https://a.nl", False, False, 25), ("https://a.nl", False, False, None)]
    df = spark.createDataFrame(asks, "u string, b boolean, j boolean, n int").select(decisions.retry_outcome(*map(F.col, "ubjn")).alias("o"))
    assert [r.o for r in df.collect()] == ["queued", "invalid", "invalid", "open_batch", "already_active", "quota_reached", "queued"]


CARD = "LUNCH\nUiensoep met kaas  6,50\nCarpaccio van rund\n11,00\n—\n12,50\nSmall bites\n\n9,00\nFriet  4.5\fDINER\nZeebaars  34    geschroeid\nTarbot  41\nOssenhaas\nprosecco 5,00 per glas\n28,00"


def test_priced_lines_of_a_card():
    got = [(line, page, name_line, section, name, cents, paired, loose) for line, page, _, name_line, section, name, cents, _, paired, loose, _ in coverage.priced_records(CARD)]
    assert got == [
        (2, 1, None, "LUNCH", "Uiensoep met kaas", [650], False, False),
        (4, 1, 3, "LUNCH", "Carpaccio van rund", [1100], True, False),
        (6, 1, None, "LUNCH", None, [1250], False, True),  # the nearest line above is priced, past a decoration
        (9, 1, 7, "LUNCH", "Small bites", [900], True, False),  # before a price alone it's a name, not a section
        (10, 1, None, "LUNCH", "Friet", [450], False, False),
        (12, 2, None, "DINER", "Zeebaars", [3400], False, False),
        (13, 2, None, "DINER", "Tarbot", [4100], False, False),
        (15, 2, None, "Ossenhaas", "prosecco per glas", [500], False, False),
        (16, 2, None, "Ossenhaas", None, [2800], False, True),
    ]
    assert coverage.priced_records("Kok 12") == [] and coverage.priced_records("") == []  # one whole amount proves nothing
    long = "VOORAF    " + "    ".join(f"Gerecht {c}{c}  {n},50" for n, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 2, 1))
    rows = coverage.priced_records(long)
    assert len(rows) == 52 and rows[3][2] == 4 and rows[3][5] == "Gerecht dd" and rows[3][6] == [450]


def test_priced_lines_are_given_in_bounded_tables(spark):
    rows = ((1, n, 1, 0, None, "Soep", "ui", [450], "ui 4,50", False, False, False) for n in range(25))
    assert [len(x) for x in coverage.frames(rows, 10)] == [10, 10, 5]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("x"), 1_000_000).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(b)]})

    assert max(r.n for r in saved(texts.mapInPandas(sizes, "n long"), "sizes", TEXT_BYTES).collect()) <= 6
    assert spark.conf.get(key) == before
    lines = coverage.priced_lines(spark.createDataFrame([(i, "Soep\nUi  4,50\n") for i in range(7)], "source_id long, text string"))
    assert lines.count() == 7 and "MapInPandas" not in lines._jdf.queryExecution().toString()


def test_tones_and_uncovered(spark):
    sources = spark.createDataFrame([(1, CARD), (2, None), (3, "Soep van de dag  6,50\nBrood  3,00")], "source_id long, text string")
    lines = coverage.priced_lines(sources)
    evidence = spark.createDataFrame([(1, "dish", "0.0.0", "uiensoep met KAAS 6,50", [650]), (1, "dish", "0.0.1", "Friet", [400]), (None, "rejected", None, "Tarbot", None), (None, "dish", "9.9.9", "Brood", None), (3, "dish", "8", " ", [1])], "source_id long, kind string, row_id string, quote string, amounts array<int>")
    accounted = spark.createDataFrame([(1, 12, "Zeebaars"), (1, 13, "Carpaccio van rund"), (None, None, "Small bites 9,00")], "source_id long, line long, text string")
    toned = coverage.tones(lines, evidence, accounted)
    got = {(r.source_id, r.line): (r.tone, r.row_id) for r in toned.collect()}
    assert got == {
        (1, 2): ("covered", "0.0.0"), (1, 4): ("uncovered", None), (1, 6): ("uncovered", None), (1, 9): ("not_dish", None), (1, 10): ("price_mismatch", "0.0.1"), (1, 12): ("not_dish", None),
        (1, 13): ("not_dish", None), (1, 15): ("uncovered", None), (1, 16): ("uncovered", None), (3, 1): ("uncovered", None), (3, 2): ("covered", "9.9.9"),
    }
    listed, counts = coverage.uncovered(toned, 3)
    assert [(r.source_id, r.line) for r in listed.collect()] == [(1, 4), (1, 6), (1, 15)] and counts.first()[:] == (True, 5, 3, 2)
    assert coverage.uncovered(toned.limit(0))[1].first()[:] == (False, 0, 0, 0)
    assert {r.source_id: (r.lines, r.uncovered, r.paired, r.loose) for r in coverage.diagnosis(toned).collect()} == {1: (9, 4, 2, 2), 3: (2, 1, 0, 0)}


def test_tones_pass_on_the_columns_they_get(spark):
    lines = coverage.priced_lines(spark.createDataFrame([(i, "Soep  6,50\nBrood  3,00\n“Vis”  9,00") for i in range(3)], "source_id long, text string"))
    evidence = spark.createDataFrame([(1, "dish", "a", "soep", [650, None]), (1, "dish", "b", "brood", [1]), (1, "rejected", None, '"VIS" 9,00', None), (2, "dish", "c", "SOEP", None), (7, "dish", "d", "soep", [650])], "source_id long, kind string, row_id string, quote string, amounts array<int>")
    accounted = spark.createDataFrame([(0, 2, "Brood"), (0, 2, "Soep")], "source_id long, line long, text string")
    toned = coverage.tones(lines.select("source_id", "line", "text", "cents", "paired"), evidence, accounted)
    assert toned.columns == ["source_id", "line", "text", "cents", "paired", "tone", "row_id"]
    assert {(r.source_id, r.line): (r.cents, r.tone, r.row_id) for r in toned.collect()} == {
        (0, 1): ([650], "uncovered", None), (0, 2): ([300], "not_dish", None), (0, 3): ([900], "uncovered", None), (1, 1): ([650], "covered", "a"), (1, 2): ([300], "price_mismatch", "b"),
        (1, 3): ([900], "not_dish", None), (2, 1): ([650], "covered", "c"), (2, 2): ([300], "uncovered", None), (2, 3): ([900], "uncovered", None),
    }
    assert "name_line" not in toned._jdf.queryExecution().executedPlan().toString()


def test_card_tones_are_the_tones_of_the_lines(spark):
    sources = spark.createDataFrame([(1, CARD), (2, None), (3, "Soep van de dag  6,50\nBrood  3,00"), (None, "Friet  4,00")], "source_id long, text string")
    evidence = [(1, "dish", "0.0.0", "uiensoep met KAAS 6,50", [650]), (1, "dish", "0.0.1", "Friet", [400]), (1, "rejected", None, "Tarbot", None), (3, "dish", "9.9.9", "Brood", [None, 300]), (3, "dish", "8", " ", [1])]
    accounted = [(1, 12, "Zeebaars"), (1, 13, "Carpaccio van rund"), (1, None, "Small bites 9,00")]
    kinds = "source_id long, kind string, row_id string, quote string, amounts array<int>", "source_id long, line long, text string"
    toned = coverage.tones(coverage.priced_lines(sources), spark.createDataFrame(evidence, kinds[0]), spark.createDataFrame(accounted, kinds[1]))
    own = [(sid, text, [e[1:] for e in evidence if e[0] == sid] or None, [a[1:] for a in accounted if a[0] == sid]) for sid, text in sources.collect()]
    cards = spark.createDataFrame(own, "source_id long, text string, evidence array<struct<kind:string,row_id:string,quote:string,amounts:array<int>>>, accounted array<struct<line:int,text:string>>")
    asked = ["source_id", "line", "cents", "name", "paired", "tone", "row_id"]
    got = coverage.card_tones(cards.repartition(1), *asked[:5])
    in_order = lambda df: sorted(map(str, df.select(*asked).collect()))
    assert got.columns == asked and in_order(got) == in_order(toned) and got.count() == 12
    assert {r.tone for r in got.collect()} == {"covered", "price_mismatch", "not_dish", "uncovered"}
    assert coverage.card_tones(cards, "segment").columns == ["segment", "tone", "row_id"]


def test_card_counts_are_those_of_the_tones(spark):
    done = [(12, "Zeebaars"), (13, "Carpaccio van rund"), (None, "Small bites 9,00")]
    own = [(1, CARD, [("dish", "0.0.0", "uiensoep met KAAS 6,50", [650]), ("dish", "0.0.1", "Friet", [400])], done), (2, None, None, None), (3, "Soep van de dag  6,50\nBrood  3,00", [], None), (None, "Friet  4,00", None, [(None, "FRIET")])]
    cards = spark.createDataFrame(own, "source_id long, text string, evidence array<struct<kind:string,row_id:string,quote:string,amounts:array<int>>>, accounted array<struct<line:int,text:string>>").repartition(1)
    toned, counts = coverage.card_tones(cards, "source_id", "line", "segment"), coverage.card_counts(cards)
    want = {sid: (0, 0) for sid in (1, 3, None)}
    for r in toned.collect():
        want[r.source_id] = want[r.source_id][0] + 1, want[r.source_id][1] + (r.tone == "uncovered")
    assert {r.source_id: (r.lines, r.uncovered) for r in counts.collect()} == want and want[3] == (2, 2) and want[None] == (1, 0)
    for limit in (3, 200):
        assert coverage.summary(counts, limit).first() == coverage.uncovered(toned, limit)[1].first()
    assert coverage.summary(counts.limit(0)).first()[:] == (False, 0, 0, 0)


def test_usual_prices_equal_all_tokens():
    rng = random.Random(21)
    parts = ["Soep", "ui", " ", "  ", "\t", "1", "12", "1234", ",", ".", ",50", "12,50", "4,5", "€", "€ 4", "uur", "gram", "%", "–", "-", "tot", "12.30", "|", "٣", "_"]
    for _ in range(5000):
        line = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        assert prices(line) == [t for t in number_tokens(line) if t.reason is None]
    assert USUAL.fullmatch("Soep van de dag  6,50") and not USUAL.fullmatch("Soep 2 6,50")


def test_overlaps_equal_all_pairs():
    rng = random.Random(15)
    texts = lambda n: ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    for _ in range(30):
        lines, passages = texts(20), texts(20)
        assert coverage.overlaps(lines, passages) == [[i for i, p in enumerate(passages) if x and p and (x in p or p in x)] for x in lines]


def test_layout_lines(spark):
    items = [(1, 10.0, 700.4, 2, "6,50"), (1, 5.0, 699.6, 1, "Soep"), (1, 5.0, 650.0, 3, "Brood"), (1, 1.0, 1.0, 4, None)]
    got = coverage.layout_lines(spark.createDataFrame(items, "page int, x double, y double, seq int, str string")).orderBy(F.desc("y")).collect()
    assert [(r.text, r.runs) for r in got] == [("Soep 6,50", 2), ("Brood", 1)]


def test_quote_classes(spark):
    source = "Uiensoep met kaas\nGerookte zalm en dille\nverse   munt, limoen"
    rows = [("uiensoep MET kaas", "present"), ("Uiensoep met kaas | Gerookte zalm", "added_separator"), ("Uiensoep met kaas\nverse munt", "merged_lines"), ("Gerooktezalm en dille", "whitespace_only"), ("verse munt; limoen!", "changed_characters"), ("biefstuk", "invented_text"), ("", "missing"), (None, "missing")]
    df = spark.createDataFrame(rows, "q string, want string").withColumn("s", F.lit(source))
    assert all(r.got == r.want for r in df.select("want", diagnosis.quote_class(F.col("q"), F.col("s")).alias("got")).collect())
    assert spark.createDataFrame([("x", None)], "q string, s string").select(diagnosis.quote_class(F.col("q"), F.col("s")).alias("c")).first().c == "invented_text"


def test_quote_nearest_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé ") for _ in range(6)) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(30)] + [(99, None)]
    quotes = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(12)] + [(50, "x"), (51, None), (52, "的話")]
    got = sorted((r.item_id, r.doc_id, r.offset, round(r.score, 9)) for r in diagnosis.quote_nearest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(quotes, "item_id long, text string"), block=5).collect())
    want = []
    for item, q in quotes:
        scored = sorted((-round(diagnosis.dice(keys.evidence(q), keys.evidence(part)), 9), d, at, keys.evidence(part)) for d, t in docs if t for at, part in diagnosis.windows(t)) if q else []
        seen = set()
        for s, d, at, part in scored:
            if s < 0 and part not in seen and len(seen) < 3:
                seen.add(part)
                want.append((item, d, at, -s))
    assert got == sorted(want)


def test_quotes_in_documents_equal_all_pairs(spark):
    rng = random.Random(12)
    words = ["soep", "“Vis”", "kaas–ui", "a", "Brood"]
    docs = [(i, "  ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(40)] + [(99, None)]
    quotes = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(20)] + [(50, None), (51, " "), (52, "oep"), (53, '"vis"')]
    got = diagnosis.quote_contained(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(quotes, "item_id long, text string"), block=7).collect()
    assert sorted(map(tuple, got)) == sorted((i, d) for i, q in quotes for d, t in docs if t and keys.evidence(q) and keys.evidence(q) in keys.evidence(t))


def test_name_variants_equal_all_pairs(spark):
    rng = random.Random(6)
    names = lambda n: [(rng.choice("xy"), "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9)))) for _ in range(n)]
    left, right = names(60), names(60)
    a, b = (spark.createDataFrame(x, "g string, name string") for x in (left, right))
    want = {(g, x, y) for g, x in left for h, y in right if g == h and x != y and diagnosis.dice(x, y) >= 0.75}
    assert {(r.g, r.l, r.r) for r in diagnosis.variant_candidates(a, b, "g", 0.75).collect()} == want and want
    got = diagnosis.name_variants(a, b, "g").collect()
    assert all(max(Counter((r.g, r[side]) for r in got).values()) == 1 for side in ("l", "r"))
    for g, x, y in want:  # greedy: a pair is left out only for one at least as good
        assert (g, x, y) in {(r.g, r.l, r.r) for r in got} or any(r.g == g and (r.l == x or r.r == y) and r.score >= diagnosis.dice(x, y) - 1e-12 for r in got)


def test_mismatch_rows(spark):
    paths = spark.createDataFrame([(1, "Soep", ["Lunch", "Vooraf"], ["LUNCHKAART", "vooraf"])], "source int, name string, expected_path array<string>, actual_path array<string>")
    of = lambda *names: spark.createDataFrame([(1, n) for n in names], "source int, name string")
    got = diagnosis.mismatch_rows(paths, of("Brood"), of("Uiensoep", "Tarbot"), of("Uiensoepje", "Bier")).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter([("category_path", "menu_title", "Soep", "Soep"), ("price", None, "Brood", "Brood"), ("name_variant", None, "Uiensoep", "Uiensoepje"), ("not_extracted", None, "Tarbot", None), ("not_in_reference", None, None, "Bier")])


def test_html_menus(spark):
    table = "<h2>Kaart</h2><table><tr><td>Soep</td><td>6,50</td><td>Brood</td><td>3,00</td></tr></table><ul><li>Zalm &amp; dille 14,50</li><li style='display: none'>Geheim 9,00</li><li hidden><b>Weg</b> 9,00</li><li>zonder prijs</li></ul>"
    spam = "<p>casino betting bonus " + "x" * 80 + " 5,00</p><li>a b 1,00</li>"
    pages = spark.createDataFrame([(1, table), (2, spam), (3, None), (4, "<p>" * 60_000), (5, "<li>alpha 1,00</li><li>beta 2,00</li>"), (6, "")], "page_id long, html string")
    got = sorted((r.page_id, r.name, r.cents, r.reason) for r in extract.menu_items(pages).where("page_id <> 2").collect())
    assert [g for g in got if g[0] == 1] == [(1, "Brood", 300, None), (1, "Soep", 650, None), (1, "Zalm & dille", 1450, None), (1, "zonder prijs", None, "no price")]
    assert [g[3] for g in got if g[0] > 1] == ["empty", "too many nodes", "too few", "too few"]
    assert sorted(r.reason for r in extract.menu_items(pages).where("page_id = 2").collect()) == ["spam", "too few"]
    assert "Geheim 9,00" not in [r.item for r in extract.html_items(pages).collect()]
    assert extract.context_slugs(["Lunchkaart", "Lunch 2", "", "Wijnen & bier", "", "Lunch 3"]) == ["lunch", "lunchb", "menuc", "dranken", "menue", "lunchc"]


def accepted(rows, gap):
    want, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= gap:
            want.add(i)
            last[k] = t
    return want


@pytest.mark.parametrize("keys_, span, gap", [(3, 4000, 50), (1, 300, 7), (2, 300, 1000), (40, 100, 5)])
def test_throttle_equals_a_loop(spark, keys_, span, gap):
    """Also one busy key whose bursts run through all tasks."""
    rng = random.Random(5)
    rows = [(i, rng.randint(1, keys_), rng.randint(0, span)) for i in range(300)]
    got = state.throttle(spark.createDataFrame(rows, "id long, k long, t long").repartition(5), ["k"], "t", "id", gap)
    assert got.columns == ["id", "k", "t"] and sorted(r.id for r in got.collect()) == sorted(accepted(rows, gap))
    assert state.throttle(spark.createDataFrame([], "id long, k long, t long"), ["k"], "t", "id", gap).count() == 0


def test_ledgers_equal_loops(spark):
    rng = random.Random(8)
    calls = [(i, rng.choice("ab"), i * 10 + rng.randint(0, 5), rng.randint(0, 120)) for i in range(200)]
    spent, want = Counter(), {}
    for i, a, _, c in sorted(calls, key=lambda r: (r[2], r[0])):
        ok = c <= 100 and spent[a] + c <= 2000
        spent[a] += c * ok
        want[i] = (ok, spent[a])
    got = state.ledger(spark.createDataFrame(calls, "id long, a string, t long, c long").repartition(4), "a", "t", "id", "c", 100, 2000)
    assert {r.id: (r.accepted, r.spent) for r in got.collect()} == want
    entries = [(1, "reserve", "r1", 80), (2, "reserve", "r2", 101), (3, "settle", "r1", 50), (4, "reserve", "r3", 60), (5, "settle", "r3", None), (6, "settle", "r3", 5), (7, "reserve", "r4", 90), (8, "abandon", "r4", None), (9, "reserve", "r5", 60), (10, "reserve", "r6", 40), (11, "reserve", "r7", 1)]
    df = spark.createDataFrame([("x", *e) for e in entries], "acc string, at long, kind string, ref string, cents long")
    got = [(r.outcome, r.spent, r.reserved, r.unknown) for r in state.reservations(df, "acc", "at", "at", "kind", "ref", "cents", 100, 250, 5).orderBy("at").collect()]
    assert got == [("reserved", 0, 80, 0), ("over_call_cap", 0, 80, 0), ("settled", 50, 0, 0), ("reserved", 50, 60, 0), ("cost_unknown", 110, 0, 1), ("no_reservation", 110, 0, 1), ("reserved", 110, 90, 1), ("abandoned", 200, 0, 2), ("over_total_cap", 200, 0, 2), ("reserved", 200, 40, 2), ("reserved", 200, 41, 2)]


def slow_pick(rows, size, wanted):
    rows = sorted(rows, key=lambda r: (r["rank"], r["item"]))
    taken, owners, kinds = [], set(), set()
    for b in sorted({r["bucket"] for r in rows}):
        free = [r for r in rows if r["bucket"] == b and r["owner"] not in owners]
        if free and len(taken) < size:
            r = next((r for r in free if r["kind"] not in kinds), free[0])
            taken.append(r)
            owners.add(r["owner"])
            kinds.add(r["kind"])
    for r in rows:
        if len(taken) < size and r["owner"] not in owners:
            taken.append(r)
            owners.add(r["owner"])
    if wanted and taken and not any(r["w"] for r in taken):
        swap = next((r for r in rows if r["w"] and r["owner"] not in {t["owner"] for t in taken[:-1]}), None)
        taken[-1] = swap or taken[-1]
    return sorted(r["item"] for r in taken)


def test_diversified_pick_equals_a_loop_over_all_rows(spark):
    rng = random.Random(4)
    for trial in range(4):
        rows = [{"g": rng.choice("ab"), "item": i, "owner": rng.randint(0, 9), "kind": rng.choice("xyz"), "bucket": rng.randint(0, 3 + trial), "rank": rng.randint(0, 80), "w": rng.random() < 0.05} for i in range(150)]
        df = spark.createDataFrame(rows, "g string, item long, owner long, kind string, bucket long, rank long, w boolean")
        for wanted in (None, "w"):
            got = pick.diversified_pick(df, "g", 5, wanted).collect()
            assert all(sorted(r.item for r in got if r.g == g) == slow_pick([r for r in rows if r["g"] == g], 5, wanted) for g in "ab")


@pytest.fixture(scope="module")
def menu(spark):
    dishes = [
        (1, "1-d-1", "diner", "Brood", "Vooraf", "t", 500, False, False, [1]), (1, "1-d-2", "diner", "Kip met brood", "Hoofd", "t", 1500, False, False, [2]), (1, "1-l-1", "lunch", "Broodje", "Lunch", "t", None, True, False, []),
        (2, "2-d-1", "diner", "Soep", "Brood en boter", "t", 700, False, False, [7]), (3, "3-d-1", "diner", "Vis", "Hoofd", "met brood", 2500, False, True, []), (3, "3-l-1", "lunch", "Ei", "Lunch", "x", 900, False, False, []),
    ]
    restaurants = [(1, "Éclair", "Centrum", "Frans", "Straat 1", 600, 1300), (2, "Anker", "Haven", "Grieks", "Anker Breda", 700, 900), (3, "Zon", "Centrum", "Thais", "Brood 9", 1000, 1400)]
    return spark.createDataFrame(dishes, "restaurant_id long, dish_id string, meal string, name string, category string, tag string, price_cents long, on_request boolean, multiple boolean, allergens array<int>"), spark.createDataFrame(restaurants, "restaurant_id long, restaurant string, buurt string, cuisine string, address string, opens int, closes int")


def test_dish_search(spark, menu):
    found = lambda **x: [r.dish_id for r in search.dish_search(*menu, **x).rows.orderBy("pos").collect()]
    assert found(q=" BROOD ") == ["1-d-1", "1-l-1", "1-d-2", "2-d-1", "3-d-1"]
    assert found(q="brood", max_price=600) == ["1-d-1", "1-l-1", "3-d-1"] and found(q="brood", without_allergens=(1, 7)) == ["1-l-1", "1-d-2", "3-d-1"]
    assert found(q="brood", meal="lunch", meals=("lunch", "diner")) == ["1-l-1"] and found(q="brood", meal="x", meals=("lunch",)) == [] and found(q="brood", cuisines=("FRA", "grie")) == ["1-d-1", "1-l-1", "1-d-2", "2-d-1"]
    assert found(q="brood", open_at=950) == ["1-d-1", "1-l-1", "1-d-2"] and found(q="brood", buurt="Haven") == ["2-d-1"]
    assert found(q="b")[:2] == ["2-d-1", "1-d-1"] and found(q="nergens") == []  # Dutch order: Anker, Éclair, Zon
    page = search.dish_search(*menu, q="brood", cursor=2, limit=2)
    assert [(r.pos, r.dish_id) for r in page.rows.orderBy("pos").collect()] == [(3, "1-d-2"), (4, "2-d-1")] and page.summary.first()[:] == (5, True, 4)
    assert search.dish_search(*menu, q="brood", cursor=4).summary.first()[:] == (5, False, None)
    offers = spark.createDataFrame([(3, ["Pompoensoep", "IJs"]), (2, ["Taart"])], "restaurant_id long, courses array<string>")
    assert found(q="pompoen", offers=offers) == ["3-l-1", "3-d-1"] and found(q="brood", offers=offers) == ["2-d-1", "3-d-1"]
    edits = spark.createDataFrame([("1-d-2", 400, False), ("1-d-1", None, None)], "dish_id string, price_cents long, available boolean")
    rows = {r.dish_id: (r.price_cents, r.available) for r in search.dish_search(*menu, q="brood", max_price=600, edits=edits).rows.collect()}
    assert rows["1-d-2"] == (400, False) and rows["1-d-1"] == (500, True)


def test_dish_groups_and_restaurants(spark, menu):
    page = search.dish_groups(*menu, q="brood", limit=2)
    got = page.rows.orderBy("pos").collect()
    assert [(r.restaurant, r.n, [(m.meal, m.n, [e.dish_id for e in m.examples]) for m in r.menus]) for r in got] == [("Éclair", 3, [("diner", 2, ["1-d-1", "1-d-2"]), ("lunch", 1, ["1-l-1"])]), ("Anker", 1, [("diner", 1, ["2-d-1"])])]
    assert page.summary.first()[:] == (3, True, 2) and search.dish_groups(*menu, q="brood", cursor=2).rows.first().menus[0].examples[0].weak
    found = lambda q: [(r.restaurant, r.tier) for r in search.restaurant_search(menu[1], q).rows.orderBy("pos").collect()]
    assert found("anker") == [("Anker", 0)] and found("centrum") == [("Éclair", 2), ("Zon", 2)] and found("breda") == [] and found("brood") == [("Zon", 3)]


def test_seeded_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, n string").withColumn("s", search.seeded_day_order(None, "2024-01-30", ["id", "n"], "x"))

    def fnv(text):
        h = 0x811C9DC5
        for c in text:
            h = (h ^ ord(c)) * 0x01000193 % (1 << 32)
        return h / (1 << 32)

    assert [r.s for r in df.orderBy("id").collect()] == [fnv("2024-01-30|1|a|x"), fnv("2024-01-30|2||x")]


def test_global_rank(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 5)) for i in range(500)]
    got = global_rank(spark.createDataFrame(rows, "id long, v long").repartition(7), [F.desc("v"), F.asc("id")]).collect()
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r.pos)] == sorted(rows, key=lambda r: (-r[1], r[0])) and sorted(r.pos for r in got) == list(range(1, 501))
    assert global_rank(spark.createDataFrame([], "v long"), [F.asc("v")]).count() == 0


def test_reports_and_nested_catalogue(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    report.write_markdown(df, f"{tmp_path}/md", "Title", {"rows": 2})
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.splitlines() == ["# Title", "", "- rows: 2", "", "| name | n |", "| --- | --- |", "| a\\|b | 1 |", "|  | 2 |"]
    report.write_json(df, f"{tmp_path}/json")
    rows = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(rows, key=lambda r: r["n"]) == [{"name": "a|b", "n": 1}, {"name": None, "n": 2}]
    menus = {"menus": {"6-lunch": {"title": "Lunch", "scraped": "2024-01-01", "source": "x", "categories": [{"name": "Soep", "path": ["Soep"], "items": [{"name": "Ui", "price": "6,50", "priceValue": 6.5, "tags": ["vega"], "allergens": [1]}, {"name": None}]}]}, "7-diner": None}}
    (tmp_path / "menus.json").write_text(json.dumps(menus, indent=1))
    got = catalog.menu_items(catalog.read_menus(spark, f"{tmp_path}/menus.json")).collect()
    assert [(r.menu_key, r.item_key, r.category, r.name, r.price_cents, r.tags) for r in got] == [("6-lunch", "6-lunch-0-0", "Soep", "Ui", 650, ["vega"]), ("6-lunch", "6-lunch-0-1", "Soep", None, None, None)]


def test_sources_are_checked(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, g string")
    assert checked.single_row(df.where("id = 2")).first()[:] == (2, "b")
    for bad in (df, df.where("id = 3")):
        with pytest.raises(Exception, match="expected one row, found"):
            checked.single_row(bad).collect()
    own = df.where("id = 1").select(canonical.content_hash(df, ["g"]).alias("h")).first().h
    assert checked.with_hash(df.where("id = 1"), ["g"], own).count() == 1
    with pytest.raises(Exception, match="unexpected content"):
        checked.with_hash(df, ["g"], own).collect()
    wide = spark.createDataFrame([], "g string, added date, id long").schema
    assert checked.with_missing(df, wide).collect()[0][:] == ("a", None, 1)


def test_streams_write_files_and_forget_keys(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, at(t), u, "view", 1.0, '{"k": 1}') for i, (t, u) in enumerate([(0, 1), (1, 1), (5, 1), (9, 1), (3, 2)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events.parquet").schema).parquet(f"{tmp_path}/events.parquet")
    got = counters.drain(counters.throttled(stream, 5_000_000))
    assert sorted(r.event_id for r in got.collect()) == [0, 2, 4]
    assert counters.drain(counters.session_firsts(stream)).count() == 2
    assert [(r.user_id, r.views) for r in counters.drain(counters.day_counters(stream), "complete").orderBy("user_id").collect()] == [(1, 4), (2, 1)]


def test_lines_keep_their_numbers():
    assert [(n, p) for n, p, _ in coverage.printed_lines("a\r\n\r\nb\fc\n")] == [(1, 1), (3, 1), (4, 2)]
