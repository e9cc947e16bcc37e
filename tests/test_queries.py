"""Queries against their SQL, plans, and the operators' own rules on small rows."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from menulake import queries as core
from menulake import storage
from menulake.operators import custom, extract, state
from menulake.operators.match import staged_bag_match
from menulake.operators.reduce import changes, latest_by
from menulake.plans.dialect import DUCK, PLANS, SPARK, TABLES, run_sql, with_views
from menulake.sources import catalog

SF = "/root/testdata/sf0.001"
KEYS = "dish_search_ranked dish_search_grouped dish_overlay_search counters_period week_over_week poll_result latest_with_condition active_and_discarded price_change_log near_duplicates staged_match point_in_polygon bag_match_3pass menu_diff local_calendar name_keys phone_address_url url_canonical heading_fill quote_containment daily_seeded_rank constraint_violations latest_review_frames strict_dates queue_claim promote task_union proposal_orphans unknown_anti reference_precision_recall browse_sort workqueue_rows correlated_order restaurant_search saved_list_resolve counters_report_resolved top_keys_bar price_pairing line_tones uncovered_summary coverage_diagnosis dish_search_page dish_search_summary dish_group_page restaurant_search_page enqueue_outcome quote_class unknown_candidates duplicate_drafts place_match menu_completeness offer_expiry source_workqueue inbox_states source_certainty retry_outcomes record_hashes offer_keys catalog_round_trip text_windows stream_session_firsts stream_day_counters".split()



@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = core.queries()[key](spark, SF).toPandas()
    want = con.sql(core.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a, b = got[order].astype(object), want[order].astype(object)
    norm = lambda df: sorted(tuple("null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v) for v in r) for r in df.itertuples(index=False))
    assert norm(a) == norm(b)


def test_every_plan_has_sql_for_both():
    assert len(PLANS) > 150
    assert all("SELECT" in with_views(f(DUCK), DUCK) for f in PLANS.values())


def test_filters_and_columns_reach_the_scan(spark):
    plan = core.queries()["paged_scan_filters"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id)" in plan.replace("\n", " ") or "GreaterThanOrEqual(user_id,20)" in plan
    assert "props" not in plan.split("ReadSchema")[-1][:200]


def bad_nodes(text):
    """Nested loops, null-aware joins, and rows that all go to one task without a limit or an aggregate
    that each task begins by itself."""
    lines = text.splitlines()
    found = [x.strip() for x in lines if "CartesianProduct" in x or "BroadcastNestedLoopJoin" in x or "true, isNullAware" in x or "null-aware" in x.lower() or x.rstrip().endswith("BuildRight, true")]
    for i, x in enumerate(lines):
        if "Exchange SinglePartition" in x and not any(w in lines[i + 1] for w in ("partial_", "LocalLimit", "TakeOrderedAndProject", "GlobalLimit")):
            found.append(lines[i + 1].strip()[:120])
    return found


#: Numbers over rows that a limit or an aggregate to a fixed vocabulary has made few.
FEW = {"usage_rollup", "poll_result", "gap_ranking", "cuisine_histogram", "option_list"}


def test_no_plan_meets_all_rows_in_one_task(spark):
    bad = {}
    for key, fn in PLANS.items():
        text = run_sql(spark, SF, fn(SPARK))._jdf.queryExecution().executedPlan().toString()
        if (found := bad_nodes(text)) and key not in FEW:
            bad[key] = found
    assert not bad


def test_bag_match_shuffles_once(spark):
    text = core.queries()["bag_match_3pass"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_latest_by_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, None, 3), (2, 1, 4)], "k int, t int, id int")
    got = {r.k: r.id for r in latest_by(df, ["k"], [F.desc_nulls_last("t"), F.desc("id")]).collect()}
    assert got == {1: 2, 2: 4}
    log = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, None), (1, 4, None), (1, 5, 6)], "k int, t int, v int")
    assert sorted(r.t for r in changes(log, ["k"], [F.col("t")], "v").collect()) == [3, 5]


def test_staged_match_uses_each_row_once(spark):
    rng = random.Random(3)
    make = lambda n: [(i, rng.choice("abc"), rng.randint(1, 3)) for i in range(n)]
    left, right = make(40), make(35)
    a, b = (spark.createDataFrame(x, "id int, name string, price int") for x in (left, right))
    got = staged_bag_match(a, b, ["id"], [("exact", ["name", "price"]), ("name", ["name"])]).collect()
    assert sorted(r.l_id for r in got if r.l_id is not None) == list(range(40))
    assert sorted(r.r_id for r in got if r.r_id is not None) == list(range(35))
    count = lambda rows, k: {x: sum(r[k:] == x for r in rows) for x in {r[k:] for r in rows}}
    l, r = count(left, 1), count(right, 1)
    assert sum(x["class"] == "exact" for x in got) == sum(min(l[k], r.get(k, 0)) for k in l)


@pytest.mark.parametrize("key", ["bag_match_3pass", "bag_match_frames", "reference_precision_recall"])
def test_bag_match_with_repeated_lines_equals_sql(spark, key, tmp_path):
    """Rows of one source that share a line number go together once one of them is paired."""
    rng = random.Random(7)
    rows = [(rng.choice((11, 13, 22, 26, 143, 5)) + 286 * rng.randint(0, 3), rng.randint(1, 6), rng.choice((1, 2, 3, None)), rng.choice((1.0, 1.5, 2.0)), rng.choice("NR"), "O") for _ in range(600)]
    names = "l_orderkey l_linenumber l_partkey l_extendedprice l_returnflag l_linestatus".split()
    pd.DataFrame(rows, columns=names).astype({"l_partkey": "Int64"}).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = sorted(map(str, map(tuple, core.queries()[key](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, con.execute(core.oracle_sql()[key]).fetchall()))


def test_throttle_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 3), rng.randint(0, 4000)) for i in range(300)]
    got = {r.id for r in state.throttle(spark.createDataFrame(rows, "id long, k long, t long"), ["k"], "t", "id", 50).collect()}
    want, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= 50:
            want.add(i)
            last[k] = t
    assert got == want


def test_jsonld_and_html(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Menu","name":"Lunch","hasMenuSection":{"name":"Soep","hasMenuItem":[{"@type":"MenuItem","name":"Ui","offers":{"price":"6.5"}}]}}]}</script><h2>Vis</h2><li>Zalm &amp; dille</li>'
    df = spark.createDataFrame([(1, page), (2, None), (3, '<script type="application/ld+json">{bad</script>')], "page_id long, html string")
    assert [tuple(r) for r in extract.jsonld_items(df).collect()] == [(1, "lunch", "Lunch / Soep", "Ui", "6.5")]
    assert [(r.section, r.item) for r in extract.html_items(df).where("page_id = 1").collect()] == [("Vis", "Zalm & dille")]


def test_catalogue_round_trip(spark):
    df = spark.createDataFrame([(1, "N", "b", "x", "1-N-1", 5), (1, "N", "a", "y", "1-N-2", 6)], "restaurant_id long, meal string, category string, name string, dish_id string, price_cents long")
    assert sorted((r.dish_key, r.name) for r in catalog.flat(catalog.nested(df)).collect()) == [("1-N-0-0", "y"), ("1-N-1-0", "x")]


def test_page_merge_reads_all_documents(spark, tmp_path):
    docs = [(d, f"all\nten {d % 10}\nown {d}\nown {d}") for d in range(150, 450)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = {}, []
    for d, text in docs:
        for nr, line in enumerate(text.split("\n")):
            if seen.setdefault((d % 10, line), d) == d:
                want.append((d, nr, line))
    assert sorted(tuple(r) for r in core.queries()["page_merge"](spark, str(tmp_path)).collect()) == want


def test_unique_lookup_counts_all_candidates(spark, tmp_path):
    rows = [(1, "a", 1, 1.0, "X"), (90, "b", 1, 1.0, "X"), (11, "c", 1, 1.0, "X"), (22, "d", 2, 1.0, "X"), (111, "e", 2, 1.0, "X"), (3, "f", 3, 1.0, "Y")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    # 1 and 90, and 22 and 111, are 89 apart: the same distance east
    assert sorted(r.candidate_id for r in core.queries()["unique_lookup"](spark, str(tmp_path)).collect()) == [3, 11]


def test_attribution_and_saved_lists_read_all_rows(spark):
    sf = SF.replace("0.001", "0.1")  # hosts up to 1499
    read = lambda name: pd.read_parquet(f"{sf}/{name}.parquet")
    events, owners = read("events"), {}
    for c in read("customer").c_custkey:
        owners.setdefault(c - (c % 3 == 2), []).append(c)
    want = {(e, owners[u][0] if len(owners.get(u, [])) == 1 else None) for e, u in zip(events.event_id, events.user_id, strict=True)}
    got = {(r.job_id, r.candidate_id) for r in core.queries()["job_attribution"](spark, sf).collect()}
    assert got == want and {c for _, c in got if c is not None and c >= 200}
    views = events[events.event_type == "view"].event_id
    firsts = {}
    for e in sorted(views):
        firsts.setdefault(f"{e % 100 + 1}-N-{e * 7 % 2000 + 1}", e)
    assert {r.dish_id: r.ord for r in core.queries()["saved_list_resolve"](spark, sf).collect()} == firsts


def test_host_match_counts_all_restaurants(spark):
    sf = SF.replace("0.001", "0.01")
    read = lambda name: pd.read_parquet(f"{sf}/{name}.parquet")
    pages = read("pages")
    hosts = pages.url.str.extract(r"^https?://([^/?#:]+)")[0].fillna("").str.lower().str.replace(r"^www[.]", "", regex=True)
    number = {h: i for i, h in enumerate(sorted(set(hosts) - {""}), 1)}
    owners = [i - (i % 3 == 2) for i in read("supplier").s_suppkey]
    name = lambda n: "none" if n == 0 else "exact" if n == 1 else "multiple"
    want = {p: name(owners.count(number[h]) if h else 0) for p, h in zip(pages.page_id, hosts, strict=True)}
    got = {r.page_id: r["class"] for r in core.queries()["host_match_cardinality"](spark, sf).collect()}
    assert got == want and set(got.values()) == {"none", "exact", "multiple"}


def test_listed_lines_are_the_first_that_are_uncovered(spark):
    got = core.queries()["uncovered_lines"](spark, SF).collect()
    tones = core.queries()["line_tones"](spark, SF).where("tone = 'uncovered'").collect()
    at = [(r.source_id, r.line) for r in got]
    assert len(got) == min(len(tones), 200) == core.queries()["uncovered_summary"](spark, SF).first().shown and at == sorted(set(at))
    assert {(r.source_id, r.name) for r in got} <= {(r.source_id, r.name) for r in tones}


def test_toned_lines_store_tones_only_and_deal_items_out_once(spark):
    for q in ("line_tones", "uncovered_lines", "uncovered_summary", "coverage_diagnosis"):
        before = len(storage._made)
        core.queries()[q](spark, SF)
        assert [path.rsplit("menulake-", 1)[1].split("-")[0] for path in storage._made[before:]] == ["tones"]
    items = run_sql(spark, SF, "SELECT l_suppkey AS source_id, l_partkey AS item_id, l_shipdate AS category, l_returnflag AS line FROM lineitem")
    assert custom.captures(items, F.count("line").alias("n"))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(source_id") == 1


def test_uncovered_lines_store_their_tone_only(spark):
    before = len(storage._made)
    core.queries()["uncovered_lines"](spark, SF)
    (path,) = storage._made[before:]
    stored = spark.read.parquet(path)
    assert {r.tone for r in stored.select("tone").distinct().collect()} == {"uncovered"}
    assert stored.count() == core.queries()["line_tones"](spark, SF).where("tone = 'uncovered'").count()


def test_cards_are_dealt_out_as_short_rows(spark):
    rows = [(1, 12, "Zalm", "VIS", 850), (1, 3, "Tarbot", "VIS", 900), (1, 5, None, "VLEES", 705), (1, 52, "Brood", None, 100), (2, 44, "Friet", "BIJ", None), (None, 13, "Soep", "VOOR", 5)]
    cards = custom.evidenced_cards(spark.createDataFrame(rows, "source_id long, item_id long, name string, category string, price long"))
    got = {r.source_id: r for r in cards.collect()}
    assert got[1].text == "Brood aaaaafc  1,00\nVIS\nTarbot aaaaaad  9,00\nZalm aaaaabc  8,50\nVLEES\naaaaaaf\n7,05" and (got[2].text, got[None].text) == ("BIJ", "VOOR\nSoep aaaaabd  0,05")
    assert [tuple(e) for e in got[1].evidence] == [("dish", "3", "Tarbot aaaaaad", [900]), ("dish", "5", "aaaaaaf", [705])] and [tuple(a) for a in got[1].accounted] == [(None, "BROOD AAAAAFC")]
    assert [tuple(e) for e in got[2].evidence] == [("rejected", "44", "Friet aaaaaee", [None])] and got[2].accounted == got[None].accounted == []
    above, *_, below = cards._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")
    assert "Project" in above and "source_id#" in below and "Project" not in below


def test_captured_cards_have_a_section_for_each_category(spark):
    items = [(1, 7, "VIS", "Tarbot  9,00"), (1, 3, "VIS", "Zalm  8,00"), (1, 5, "VLEES", "Biefstuk\n7,50"), (1, 2, None, "Brood  1,00"), (1, 8, "VIS", None), (None, 1, "VIS", "Haring  2,00")]
    got = custom.captures(spark.createDataFrame(items, "source_id long, item_id long, category string, line string")).collect()
    assert {r.source_id: r.text for r in got} == {1: "Brood  1,00\nVIS\nZalm  8,00\nTarbot  9,00\nVLEES\nBiefstuk\n7,50", None: "VIS\nHaring  2,00"}
