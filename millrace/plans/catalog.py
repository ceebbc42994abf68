"""Named queries, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import streaming
from millrace.functions import absolute_deviation, composed, dot, exact_sum, initials, json_totals, naive, register_divisors, spread
from millrace.operators import as_of_join, extraction, overlap_join, quantiles, range_join, sessions, sketches, theta_join, top_per_group
from millrace.operators.neighbours import nearest
from millrace.scratch import scratch_path
from millrace.streaming.funnel import funnel

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` is its equivalent."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT l_returnflag, l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
       CAST(count(*) AS BIGINT) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: exact_sum(F.col(c))
    return (
        _t(spark, sf_dir, "lineitem")
        .where("l_shipdate <= timestamp_ntz '1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_base_price"), F.count("*").alias("count_order"))
    )


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 10")
def scan_filter_project(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz '1996-01-01' AND l_quantity > 10").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("""
SELECT c_mktsegment, n_name, CAST(count(*) AS BIGINT) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""")
def inner_joins(spark, sf_dir):
    o, c, n = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("orders"), exact_sum(F.col("o_totalprice")).alias("revenue"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
def left_join(spark, sf_dir):
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").where("l_quantity > 45")  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select("o_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT a.s_suppkey AS rich, b.s_suppkey AS poor FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) a
FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 8000) b ON a.s_suppkey = b.s_suppkey
""")
def full_join(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    a, b = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("rich")), s.where("s_acctbal < 8000").select(F.col("s_suppkey").alias("poor"))
    return a.join(b, F.col("rich") == F.col("poor"), "full")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark, sf_dir):
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_anti").select("o_orderkey")


@query("""
SELECT p_partkey, r.lo FROM part JOIN (SELECT CAST(900 + 10 * i AS DOUBLE) AS lo, CAST(904 + 10 * i AS DOUBLE) AS hi FROM range(10) t(i)) r
ON p_retailprice >= r.lo AND p_retailprice < r.hi
""")
def interval_join(spark, sf_dir):
    ranges = spark.range(10).select((F.lit(900.0) + F.col("id") * 10).alias("lo"), (F.lit(904.0) + F.col("id") * 10).alias("hi"))
    return range_join(_t(spark, sf_dir, "part"), ranges, "p_retailprice", "lo", "hi", 10.0).select("p_partkey", "lo")


@query("""
SELECT p.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS last_event_id, max(v.ts) AS last_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY 1
""")
def as_of(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.struct("ts", "event_id").alias("seen"))
    return as_of_join(buys, views, "user_id", "ts", ["seen"], slices=F.date_trunc("week", "ts")).select("event_id", F.col("last_seen.event_id").alias("last_event_id"), F.col("last_seen.ts").alias("last_ts"))


@query("""
SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
""")
def subqueries(spark, sf_dir):
    c, o, n = (_t(spark, sf_dir, x) for x in ("customer", "orders", "nation"))
    largest = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("largest"))
    return c.join(n.where("n_regionkey = 1"), c.c_nationkey == n.n_nationkey, "left_semi").join(largest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "largest")


def _grouped(kind: str) -> str:
    return f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS INTEGER) AS level,
    CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY {kind}"""


def _levels(df):
    return df.agg((F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("int").alias("level"), F.count("*").alias("n"))


@query(_grouped("ROLLUP (l_returnflag, l_linestatus)"))
def rollup(spark, sf_dir):
    return _levels(_t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(_grouped("CUBE (l_returnflag, l_linestatus)"))
def cube(spark, sf_dir):
    return _levels(_t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


@query(_grouped("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    return _levels(l.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], F.col("l_returnflag"), F.col("l_linestatus")))


@query("""
SELECT l_shipdate AS day, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS large
FROM lineitem GROUP BY 1
""")
def distinct_and_filtered(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("""
SELECT p_brand, round(stddev_samp(p_size), 6) AS sd, round(var_pop(p_size), 6) AS var, median(p_size) AS mid,
round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(corr(p_size, p_retailprice), 6) AS r FROM part GROUP BY 1
""")
def statistics(spark, sf_dir):
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.round(F.stddev_samp("p_size"), 6).alias("sd"), F.round(F.var_pop("p_size"), 6).alias("var"), F.median("p_size").alias("mid"), F.round(F.percentile("p_retailprice", F.lit(0.9)), 6).alias("p90"),
        F.round(F.corr("p_size", "p_retailprice"), 6).alias("r"),
    )


@query("""
SELECT o_orderpriority, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS top_order,
CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS "F", CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS "O" FROM orders GROUP BY 1
""")
def arg_max_and_pivot(spark, sf_dir):
    top = F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order")
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(top, *[F.count_if(F.col("o_orderstatus") == k).alias(k) for k in ("F", "O")])


@query("""
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER d AS INTEGER) AS rk, CAST(dense_rank() OVER d AS INTEGER) AS dr,
CAST(ntile(4) OVER w AS INTEGER) AS quarter, percent_rank() OVER d AS pr, cume_dist() OVER d AS cd FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), d AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def ranking(spark, sf_dir):
    w, d = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(d).alias("rk"), F.dense_rank().over(d).alias("dr"), F.ntile(4).over(w).alias("quarter"), F.percent_rank().over(d).alias("pr"), F.cume_dist().over(d).alias("cd"))


@query("""
SELECT event_id, lag(value, 1, 0.0) OVER w AS before, lead(event_id) OVER w AS next_id, first_value(event_type) OVER w AS first_type,
CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last3,
CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS day_n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def offsets_and_frames(spark, sf_dir):
    return spark.sql("""
        SELECT event_id, lag(value, 1, 0.0D) OVER w AS before, lead(event_id) OVER w AS next_id, first_value(event_type) OVER w AS first_type,
        count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3,
        count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n
        FROM {e} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", e=_t(spark, sf_dir, "events"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def top_k(spark, sf_dir):
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").offset(5).limit(20)


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2
""")
def top_per_customer(spark, sf_dir):
    return top_per_group(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query("""
(SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
UNION ALL (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
UNION ALL (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
""")
def set_operations(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersectAll(s).union(c.exceptAll(s)).union(c.union(s).distinct())


_THREADS = """
WITH RECURSIVE t(conv_id, turn, roles) AS (
  SELECT conv_id, turn, role FROM {c} WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, concat(t.roles, '>', c.role) FROM t JOIN {c} c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
SELECT conv_id, turn, roles FROM t
"""


@query(_THREADS.format(c="conversations"))
def recursive(spark, sf_dir):
    """Every turn with the roles of the conversation up to it, by following each turn to the next. Spark ends recursions of over 100 levels or a million rows with an error; settings raise both."""
    return spark.sql(_THREADS, c=_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_trunc('hour', ts) AS hour, CAST(dayofweek(ts) AS INTEGER) AS dow,
CAST(quarter(ts) AS INTEGER) AS quarter, CAST(week(ts) AS INTEGER) AS week, CAST(year(ts) AS INTEGER) AS year, CAST(dayofyear(ts) AS INTEGER) AS doy,
CAST(date_diff('day', TIMESTAMP '2023-12-25', ts) AS INTEGER) AS since FROM events
""")
def json_and_dates(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), naive(F.date_trunc("hour", "ts")).alias("hour"), (F.dayofweek("ts") - 1).alias("dow"), F.quarter("ts").alias("quarter"), F.weekofyear("ts").alias("week"), F.year("ts").alias("year"), F.dayofyear("ts").alias("doy"), F.datediff("ts", F.lit("2023-12-25").cast("date")).alias("since"))


@query(r"""
SELECT doc_id, md5(lower(text)) AS low, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n, substring(text, 3, 5) AS part, reverse(source) AS back, lpad(source, 8, '*') AS padded, upper(source) AS loud,
md5(regexp_replace(text, '[aeiou]+', '_', 'g')) AS masked, CAST(instr(text, 'the') AS INTEGER) AS at, CAST(len(string_split(text, ' ')) AS INTEGER) AS pieces FROM documents
""")
def string_functions(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.lower("text")).alias("low"), F.md5("text").alias("digest"), F.length("text").alias("n"), F.substring("text", 3, 5).alias("part"), F.reverse("source").alias("back"), F.lpad("source", 8, "*").alias("padded"),
        F.upper("source").alias("loud"), F.md5(F.regexp_replace("text", "[aeiou]+", "_")).alias("masked"), F.instr("text", "the").alias("at"), F.size(F.split("text", " ", -1)).alias("pieces"),
    )


@query("SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def ordered_strings(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(rows, lambda r: r["o_orderstatus"]), ",").alias("statuses"), F.count("*").alias("n"))


@query("""
SELECT label, round(avg(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE)))), 9) AS norm2,
CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1
""")
def vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(dot(F.col("embedding"), F.col("embedding"))), 9).alias("norm2"), F.count("*").alias("n"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2
""")
def tumbling_windows(spark, sf_dir):
    w = _t(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), exact_sum(F.col("value")).alias("total"))
    return w.select(naive(F.col("w.start")).alias("start"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k
""")
def session_windows(spark, sf_dir):
    return sessions(_t(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("""
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, min(ts) AS low, max(ts) AS high FROM k GROUP BY user_id, k)
SELECT a.user_id, b.user_id AS other_id, a.low AS start, b.low AS other_start FROM s a JOIN s b ON a.user_id < b.user_id AND a.low <= b.high AND b.low <= a.high
""")
def overlapping_sessions(spark, sf_dir):
    """Sessions (gaps of at most half an hour) of different users that overlap in time."""
    s = sessions(_t(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")
    s = s.select("user_id", F.col("start").alias("begin"), *[F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("start", "low"), ("end", "high"))])
    met = overlap_join(s, s, "low", "high", 1.8e9).where("l.user_id < r.user_id")
    return met.select("l.user_id", F.col("r.user_id").alias("other_id"), F.col("l.begin").alias("start"), F.col("r.begin").alias("other_start"))


@query("""
SELECT start, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS start FROM events, (SELECT unnest(range(2)) AS i)) GROUP BY 1
""")
def sliding_windows(spark, sf_dir):
    """Two hours wide, every hour; each event is in two, summed map-side."""
    w = _t(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select(naive(F.col("w.start")).alias("start"), "n")


@query("SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def exploded_words(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ", -1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_acctbal, c_custkey) AS customers FROM customer GROUP BY 1")
def listed_strings(spark, sf_dir):
    return spark.sql("SELECT c_nationkey, listagg(cast(c_custkey AS string), '|') WITHIN GROUP (ORDER BY c_acctbal, c_custkey) AS customers FROM {c} GROUP BY 1", c=_t(spark, sf_dir, "customer"))


@query("""
SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey <> n_nationkey AND s_acctbal > 400 * n_nationkey AND s_suppkey % 25 >= n_nationkey
""")
def inequality_join(spark, sf_dir):
    """Any condition, against a side that is counted before it is broadcast."""
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    return theta_join(s, n, (s.s_nationkey != n.n_nationkey) & (s.s_acctbal > 400 * n.n_nationkey) & (s.s_suppkey % 25 >= n.n_nationkey)).select("s_suppkey", "n_nationkey")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '') AS letters FROM part")
def vectorised_function(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", initials(F.col("p_name")).alias("letters"))


@query("SELECT user_id, max(value) - min(value) AS width FROM events GROUP BY 1")
def vectorised_aggregate(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(spread(F.col("value")).alias("width"))


@query("SELECT p_partkey, CAST(n AS INTEGER) AS n FROM part JOIN range(1, 51) t(n) ON p_size % n = 0")
def table_function(spark, sf_dir):
    register_divisors(spark, "millrace_divisors")
    return spark.sql("SELECT p_partkey, d.n FROM {p}, LATERAL millrace_divisors(p_size) AS d", p=_t(spark, sf_dir, "part").select("p_partkey", "p_size"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS composed FROM documents")
def composed_texts(spark, sf_dir):
    """Whole texts in composed normal form."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(composed(F.col("text"))).alias("composed"))


@query("SELECT user_id, round(mad(value), 9) AS deviation FROM events GROUP BY 1")
def absolute_deviations(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(absolute_deviation(F.col("value")), 9).alias("deviation"))


@query("""
WITH f AS (SELECT user_id, unnest(json_keys(props)) AS key, props FROM events),
t AS (SELECT user_id, key, CAST(sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total FROM f GROUP BY 1, 2),
m AS (SELECT user_id, '{' || string_agg('"' || key || '":' || total, ',' ORDER BY key) || '}' AS totals FROM t GROUP BY 1)
SELECT m.user_id, m.totals, n FROM m JOIN (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) c ON m.user_id = c.user_id
""")
def json_maps(spark, sf_dir):
    """Sums of whatever numbers the events' properties hold, by user, as a map."""
    found = json_totals(_t(spark, sf_dir, "events"), "user_id", "props")
    return found.select("user_id", F.to_json("totals").alias("totals"), "n")


@query("""
SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1
""")
def grouped_map(spark, sf_dir):
    """A pandas function per user; a user's events are in one task."""

    def ends(rows):
        rows = rows.sort_values(["ts", "event_id"])
        return rows.head(1)[["user_id"]].assign(first_type=rows["event_type"].iloc[0], last_type=rows["event_type"].iloc[-1], n=len(rows))

    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return e.groupBy("user_id").applyInPandas(ends, "user_id long, first_type string, last_type string, n long")


@query("SELECT event_id, value * 2 AS twice FROM events WHERE value > 100")
def arrow_map(spark, sf_dir):
    def doubled(batches):
        for batch in batches:
            some = batch.filter(pc.greater(batch.column(1), 100.0))
            yield pa.RecordBatch.from_arrays([some.column(0), pc.multiply(some.column(1), 2.0)], names=["event_id", "twice"])

    return _t(spark, sf_dir, "events").select("event_id", "value").mapInArrow(doubled, "event_id long, twice double")


def _events(spark, sf_dir, pattern="events.parquet"):
    return streaming.event_stream(spark, sf_dir, _t(spark, sf_dir, "events").schema, pattern=pattern)


def _streamed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that the stream gives for what is there now."""
    spark, sink = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    streaming.run_once(stream, f"{sink}/out", f"{sink}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{sink}/out") if mode == "append" else streaming.latest(spark, f"{sink}/out", stream.schema)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def stream_windows_complete(spark, sf_dir):
    return _streamed(streaming.tumbling(_events(spark, sf_dir), "1 hour"), "complete").select(naive(F.col("start")).alias("start"), "n")


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def stream_windows_append(spark, sf_dir):
    """Windows that the watermark, ten minutes behind the latest event, has closed."""
    return _streamed(streaming.tumbling(_events(spark, sf_dir), "1 hour", ("event_type",))).select(naive(F.col("start")).alias("start"), "event_type", "n")


@query("SELECT event_id, user_id, ts FROM events")
def stream_without_repeats(spark, sf_dir):
    """Every event comes twice and leaves once."""
    e = _events(spark, sf_dir)
    return _streamed(streaming.without_repeats(e.union(e), "event_id").select("event_id", "user_id", naive(F.col("ts")).alias("ts")))


@query("SELECT event_id, c_name, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, sf_dir):
    return _streamed(streaming.with_static(_events(spark, sf_dir), _t(spark, sf_dir, "customer"), "user_id", "c_custkey").select("event_id", "c_name", "c_mktsegment"))


_FUNNEL_SECONDS = 172_800


@query(f"""
WITH e AS (SELECT * FROM events WHERE event_type IN ('view', 'click', 'purchase')),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS w FROM events),
sure AS (SELECT e.* FROM e, w WHERE ts < w),
v AS (SELECT * FROM sure WHERE event_type = 'view'),
c AS (SELECT v.event_id AS start_id, arg_min(c.event_id, (c.ts, c.event_id)) AS click, min(c.ts) AS click_ts FROM v JOIN sure c ON c.user_id = v.user_id AND c.event_type = 'click'
  AND (c.ts > v.ts OR (c.ts = v.ts AND c.event_id > v.event_id)) AND c.ts <= v.ts + INTERVAL {_FUNNEL_SECONDS} SECOND GROUP BY 1),
p AS (SELECT v.event_id AS start_id, arg_min(p.event_id, (p.ts, p.event_id)) AS purchase FROM v JOIN c ON c.start_id = v.event_id JOIN sure p ON p.user_id = v.user_id AND p.event_type = 'purchase'
  AND (p.ts > c.click_ts OR (p.ts = c.click_ts AND p.event_id > c.click)) AND p.ts <= v.ts + INTERVAL {_FUNNEL_SECONDS} SECOND GROUP BY 1)
SELECT v.user_id, v.event_id AS start_id, v.ts AS start_ts, CAST(1 + CAST(click IS NOT NULL AS INTEGER) + CAST(purchase IS NOT NULL AS INTEGER) AS INTEGER) AS reached, c.click AS click_id, p.purchase AS purchase_id
FROM v LEFT JOIN c ON c.start_id = v.event_id LEFT JOIN p ON p.start_id = v.event_id, w WHERE p.purchase IS NOT NULL OR v.ts + INTERVAL {_FUNNEL_SECONDS} SECOND < w
""")
def stream_funnel(spark, sf_dir):
    """From view to click to purchase within two days, a row for each view that the watermark has settled."""
    told = _streamed(funnel(_events(spark, sf_dir), "user_id", ("view", "click", "purchase"), _FUNNEL_SECONDS))
    return told.select("user_id", "start_id", naive(F.col("start_ts")).alias("start_ts"), "reached", F.get("ids", 1).alias("click_id"), F.get("ids", 2).alias("purchase_id"))


@query("""
WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS w FROM events)
SELECT v.event_id, v.user_id, p.event_id AS next_event_id FROM v LEFT JOIN p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR, w
WHERE p.event_id IS NOT NULL OR v.ts < w - INTERVAL 6 HOUR
""")
def stream_outer_join(spark, sf_dir):
    """Views with the purchases of the next six hours; those without any once the watermark says that none can come."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    views, buys = e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type")
    return _streamed(streaming.matched_within(views, buys, "user_id", "ts", "6 hours", "leftOuter").select("event_id", "user_id", "next_event_id"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE
""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed, from a stream."""
    return _streamed(streaming.session_counts(_events(spark, sf_dir), "user_id", "30 minutes")).select("user_id", naive(F.col("start")).alias("start"), "n")


@query("""
SELECT l_returnflag, q, CAST(count(*) AS BIGINT) AS n, round(CASE q WHEN 0.01 THEN quantile_cont(l_extendedprice, 0.01) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.99) END, 6) AS quantile
FROM (SELECT l_returnflag, l_extendedprice FROM lineitem UNION ALL SELECT '*', l_extendedprice FROM lineitem), (SELECT unnest([0.01::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]) AS q) GROUP BY 1, 2
""")
def exact_quantiles(spark, sf_dir):
    """Prices by return flag, and of all line items as one group (*), no group in one task."""
    l = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")  # noqa: E741
    every = l.union(l.withColumn("l_returnflag", F.lit("*")))
    return quantiles.exact_quantiles(every, ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.99]).withColumn("quantile", F.round("quantile", 6))


@query()
def sketched_weeks(spark, sf_dir):
    """Rows, users and quantiles of values by week, from daily sketches that were added in two parts."""
    e, table = _t(spark, sf_dir, "events"), scratch_path(spark, "sketches")
    sketches.add_days(e.where("event_type = 'view'"), table, "views", "ts", "user_id", "value")
    sketches.add_days(e.where("event_type <> 'view'"), table, "others", "ts", "user_id", "value")
    return sketches.span_totals(sketches.sketched(spark, table), "2024-01-01", "2024-12-31", [0.1, 0.5, 0.9], by=F.date_trunc("week", "day").cast("date"))


@query()
def page_text(spark, sf_dir):
    """Main text of every page, without blocks that the pages of its host share."""
    return extraction.page_text(_t(spark, sf_dir, "pages"))


@query()
def nearest_vectors(spark, sf_dir):
    """The ten nearest of every embedding."""
    return nearest(_t(spark, sf_dir, "embeddings"))


@query()
def approximate_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))
