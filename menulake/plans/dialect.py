"""One SQL text for Spark and DuckDB: the few expressions that differ, and the views they read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def gsub(self, x: str, pattern: str, to: str) -> str:
        """x with every match replaced."""
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(to)})" if self.spark else f"regexp_replace({x}, {self.text(pattern)}, {self.text(to)}, 'g')"

    def text(self, s: str) -> str:
        """A string literal; Spark's is raw, so that patterns read the same in both."""
        return ("r" if self.spark and "\\" in s else "") + "'" + s.replace("'", "''") + "'"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.text(pattern)})" if self.spark else f"regexp_matches({x}, {self.text(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def words(self, x: str, pattern: str) -> str:
        """x split at matches of pattern."""
        return f"split({x}, {self.text(pattern)})" if self.spark else f"regexp_split_to_array({x}, {self.text(pattern)})"

    def unnest(self, query: str, array: str, columns: str, value: str, at: str | None = None) -> str:
        """(columns, value[, at]) for each entry of array in the rows of query; at counts from 0."""
        if self.spark:
            return f"(SELECT {columns}, {f'{at}, ' if at else ''}{value} FROM ({query}) q_ LATERAL VIEW {'posexplode' if at else 'explode'}({array}) e_ AS {f'{at}, ' if at else ''}{value})"
        number = f", unnest(range(len({array}))) AS {at}" if at else ""
        return f"(SELECT {columns}, unnest({array}) AS {value}{number} FROM ({query}) q_)"

    def keep(self, array: str, x: str, condition: str) -> str:
        return f"filter({array}, {x} -> {condition})" if self.spark else f"list_filter({array}, lambda {x}: {condition})"

    def each(self, array: str, x: str, value: str) -> str:
        return f"transform({array}, {x} -> {value})" if self.spark else f"list_transform({array}, lambda {x}: {value})"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)" if self.spark else f"CAST(len({array}) AS BIGINT)"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})" if self.spark else f"list_distinct({array})"

    def sort(self, array: str) -> str:
        return f"array_sort({array})" if self.spark else f"list_sort({array})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')" if self.spark else f"array_to_string({array}, '{by}')"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def joined(self, value: str, order: str, by: str = ",") -> str:
        """An aggregate: values in an order, as one string. order is a column of the group."""
        if self.spark:
            return f"listagg({value}, '{by}') WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({value}, '{by}' ORDER BY {order})"

    def local_day(self, ts: str) -> str:
        """The calendar day of a UTC instant in Amsterdam."""
        if self.spark:
            return f"CAST(from_utc_timestamp({ts}, 'Europe/Amsterdam') AS DATE)"
        return f"CAST(timezone('Europe/Amsterdam', timezone('UTC', CAST({ts} AS TIMESTAMP))) AS DATE)"

    def local_minute(self, ts: str) -> str:
        local = f"from_utc_timestamp({ts}, 'Europe/Amsterdam')" if self.spark else f"timezone('Europe/Amsterdam', timezone('UTC', CAST({ts} AS TIMESTAMP)))"
        return f"CAST(hour({local}) * 60 + minute({local}) AS BIGINT)"

    def seconds(self, ts: str) -> str:
        return f"CAST(unix_timestamp(CAST({ts} AS TIMESTAMP)) AS BIGINT)" if self.spark else f"CAST(floor(epoch(CAST({ts} AS TIMESTAMP))) AS BIGINT)"

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))" if self.spark else f"epoch_us(CAST({ts} AS TIMESTAMP))"

    def weekday(self, day: str) -> str:
        """ISO: Monday is 1."""
        return f"CAST(weekday({day}) + 1 AS BIGINT)" if self.spark else f"CAST(isodow({day}) AS BIGINT)"

    def days(self, a: str, b: str) -> str:
        return f"CAST(datediff({a}, {b}) AS BIGINT)" if self.spark else f"CAST(date_diff('day', {b}, {a}) AS BIGINT)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def json_int(self, x: str, field: str) -> str:
        return f"CAST(get_json_object({x}, '$.{field}') AS BIGINT)" if self.spark else f"CAST(json_extract_string({x}, '$.{field}') AS BIGINT)"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})" if self.spark else f"list_has_any({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})" if self.spark else f"list_filter({a}, lambda z_: NOT list_contains({b}, z_))"

    def at(self, array: str, i: int) -> str:
        return f"get({array}, {i})" if self.spark else f"({array})[{i + 1}]"


SPARK, DUCK = Dialect(True), Dialect(False)

#: Day of the last event at every scale.
AS_OF = "DATE '2024-01-30'"


def half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def share(n: str, of: str, scale: int = 1000) -> str:
    """n of `of` in percent, one decimal at scale 1000; halves round up; 0 of nothing is 0."""
    return f"(CASE WHEN {of} > 0 THEN floor(CAST({n} AS DOUBLE) / {of} * {scale} + CAST(0.5 AS DOUBLE)) / CAST({scale // 100} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


def metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance, rounded."""
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"CAST(floor(2 * 6371000 * asin(least(CAST(1 AS DOUBLE), sqrt({h}))) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def views(d: Dialect) -> dict[str, str]:
    """The engine's relations over the driver's tables."""
    return {
        "restaurants": """SELECT CAST(s_suppkey AS BIGINT) AS restaurant_id, s_name AS name, n_name AS buurt, r_name AS cuisine,
            CAST(600 + (s_suppkey % 6) * 60 AS BIGINT) AS opens, CAST(1080 + (s_suppkey % 6) * 60 AS BIGINT) AS closes,
            CASE WHEN s_suppkey % 7 = 0 THEN concat(s_name, ' Breda') ELSE concat(n_name, 'straat ', CAST(s_suppkey AS STRING)) END AS address,
            CASE WHEN s_suppkey % 5 <> 0 THEN concat('https://www.', lower(replace(s_name, '#', '-')), '.example') END AS website,
            CAST(51.5 + (s_suppkey % 97) * 0.0004 AS DOUBLE) AS lat, CAST(4.7 + (s_suppkey % 89) * 0.0004 AS DOUBLE) AS lon
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        # lines are reduced to dishes on their keys and one number, before the parts' texts join
        "dishes": f"""SELECT CAST(l_suppkey AS BIGINT) AS restaurant_id, CAST(l_partkey AS BIGINT) AS item_id, concat(CAST(l_suppkey AS STRING), '-', chr(flag), '-', CAST(l_partkey AS STRING)) AS dish_id,
            chr(flag) AS meal, p_name AS name, p_type AS category, p_brand AS tag, CAST(p_size AS BIGINT) AS size, {half_up('p_retailprice * 100')} AS price_cents, l_partkey % 13 = 0 AS on_request,
            l_partkey % 17 = 0 AS multiple, CAST(l_partkey % 14 + 1 AS BIGINT) AS allergen_a, CAST(p_size % 14 + 1 AS BIGINT) AS allergen_b
            FROM (SELECT l_suppkey, l_partkey, min(ascii(l_returnflag)) AS flag FROM lineitem GROUP BY l_suppkey, l_partkey) l JOIN part ON l_partkey = p_partkey WHERE p_size % 10 <> 0""",
        "counters": """SELECT user_id AS dish_key, CAST(ts AS DATE) AS day, CAST(count_if(event_type = 'click') AS BIGINT) AS shared,
            CAST(count_if(event_type = 'view') AS BIGINT) AS saved, CAST(count_if(event_type = 'purchase') AS BIGINT) AS reservations
            FROM events GROUP BY user_id, CAST(ts AS DATE)""",
        "reviews": "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS candidate_id, o_orderdate AS decided_at, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'deferred' ELSE 'rejected' END AS status, o_orderpriority AS reason FROM orders",
        "candidates": """SELECT CAST(c_custkey AS BIGINT) AS candidate_id, c_name AS name, c_mktsegment AS name_key, CAST(c_nationkey AS BIGINT) AS nation_id,
            CAST(51.5 + (c_custkey % 97) * 0.0004 AS DOUBLE) AS lat, CAST(4.7 + (c_custkey % 89) * 0.0004 AS DOUBLE) AS lon,
            CASE WHEN c_custkey % 4 <> 0 THEN concat('0', CAST(700000000 + c_custkey AS STRING)) END AS phone,
            CASE WHEN c_custkey % 3 <> 0 THEN concat('HTTPS://WWW.Site', CAST(c_custkey % 50 AS STRING), '.example/Menu/') END AS website,
            CASE WHEN c_custkey % 6 <> 0 THEN concat('Straat  ', CAST(c_custkey AS STRING), ' ', CAST(4800 + c_custkey % 90 AS STRING), 'ab') END AS address FROM customer""",
        "votes": """SELECT CAST(event_id AS BIGINT) AS vote_id, ts, CAST(user_id AS BIGINT) AS voter, CAST(event_id % 12 AS BIGINT) AS dish, event_type = 'click' AS yes
            FROM events WHERE event_type IN ('click', 'error')""",
        "jobs": """SELECT CAST(event_id AS BIGINT) AS job_id, CAST(user_id AS BIGINT) AS host, ts,
            CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status,
            CAST(event_id % 6 AS BIGINT) AS attempts FROM events""",
        "expected": f"SELECT CAST(l_orderkey AS BIGINT) AS source, CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS name, {half_up('l_extendedprice * 100')} AS price, l_shipmode_ AS path FROM (SELECT *, concat(l_returnflag, l_linestatus) AS l_shipmode_ FROM lineitem) t",
        "actual": f"""SELECT CAST(l_orderkey AS BIGINT) AS source, CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS name,
            CASE WHEN l_orderkey % 11 = 0 THEN {half_up('l_extendedprice * 100')} + 50 ELSE {half_up('l_extendedprice * 100')} END AS price,
            CASE WHEN l_orderkey % 13 = 0 THEN 'X' ELSE concat(l_returnflag, l_linestatus) END AS path FROM lineitem WHERE (l_orderkey + l_linenumber) % 17 <> 0""",
        "links": f"SELECT page_id, nr, {d.extract('tag', 'href=\"([^\"]*)\"', 1)} AS href, {d.extract('tag', '>([^<]*)<', 1)} AS label, url FROM {d.unnest('SELECT page_id, url, ' + d.extract_all('html', '<a [^>]*>[^<]*</a>') + ' AS tags FROM pages', 'tags', 'page_id, url', 'tag', 'nr')} x",
        "page_urls": f"SELECT page_id, url, {d.gsub('lower(' + d.extract('url', '^https?://([^/?#:]+)', 1) + ')', '^www[.]', '')} AS host, {d.extract('url', '^https?://[^/?#]+([^?#]*)', 1)} AS path FROM pages",
        "lines": f"SELECT doc_id, nr, line FROM {d.unnest('SELECT doc_id, ' + d.words('text', chr(92) + 'r' + chr(92) + 'n|' + chr(92) + 'r|' + chr(92) + 'n') + ' AS all_lines FROM documents', 'all_lines', 'doc_id', 'line', 'nr')} x",
    }


def with_views(sql: str, d: Dialect) -> str:
    """sql with the views it names, and those they name, as common table expressions."""
    known, needed = views(d), []

    def add(text: str) -> None:
        for name, body in known.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(body)
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS ({known[n]})" for n in needed)
    body = sql.strip()
    return f"WITH {ctes}, {body[4:].strip()}" if body[:4].upper() == "WITH" else f"WITH {ctes} {body}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Only the named tables are opened; temporary views are resolved at once, so that later calls
    with other folders don't affect the result."""
    text = with_views(sql, SPARK)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


#: Query key to a function of the dialect that gives the SQL.
PLANS: dict[str, Callable[[Dialect], str]] = {}


#: Of plans whose rows are numbered over the whole table: the order, and the number's name.
ORDERED: dict[str, tuple[str, str]] = {}


def plan(fn: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    PLANS[fn.__name__] = fn
    return fn


def numbered(order: str, name: str = "pos") -> Callable:
    """A plan whose rows get their number in an order of the whole table, which leaves no ties: a range
    partitioned rank in Spark, a window in the other dialect. The order's columns are the plan's."""

    def wrap(fn: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        ORDERED[fn.__name__] = (order, name)
        PLANS[fn.__name__] = lambda d: fn(d) if d.spark else f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS {name} FROM ({fn(d)}) rows_"
        return fn

    return wrap
