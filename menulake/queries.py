"""Query key to builder, and query key to SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.operators.custom import CUSTOM
from menulake.operators.order import global_rank
from menulake.plans import counters, logs, matching, search, text  # noqa: F401
from menulake.plans.dialect import DUCK, ORDERED, PLANS, SPARK, run_sql, with_views
from menulake.plans.oracles import ORACLES


def _order(order: str) -> list:
    parts = [x.strip().split(" ") for x in order.split(",")]
    return [F.desc(x[0]) if x[-1] == "DESC" else F.asc(x[0]) for x in parts]


def _builder(name: str, fn) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = run_sql(spark, sf_dir, fn(SPARK))
        return global_rank(rows, _order(ORDERED[name][0]), ORDERED[name][1]) if name in ORDERED else rows

    return build


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _builder(name, fn) for name, fn in PLANS.items()} | {fn.__name__: fn for fn in CUSTOM}


def oracle_sql() -> dict[str, str]:
    sql = {name: fn(DUCK) for name, fn in PLANS.items()}
    sql["latest_review_frames"] = sql["latest_review"]
    sql["bag_match_frames"] = f"SELECT class, count(*) AS n FROM ({sql['bag_match_3pass']}) t GROUP BY class"
    sql["stream_day_counters"] = "SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks, CAST(count_if(event_type = 'view') AS BIGINT) AS views FROM events GROUP BY user_id, CAST(ts AS DATE)"
    return {name: with_views(text, DUCK) for name, text in (sql | ORACLES).items()}
