"""Queries over event logs, numbers and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import islands, match, validate
from .adapters import INTERVALS, LOG_EVENTS, SESSIONS, intervals_customers, log_events, table

_LOG = f"{LOG_EVENTS}, {SESSIONS}"


def sessions_per_user(s, d):
    return islands.sessions(log_events(s, d))


def session_cell_deltas(s, d):
    return islands.session_deltas(log_events(s, d))


def active_seconds_pace(s, d):
    return islands.pace(session_cell_deltas(s, d))


def interval_overlap_sum(s, d):
    return islands.overlap_seconds(sessions_per_user(s, d), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))


def _numbers(s, d):
    return table(s, d, "orders").select((F.col("o_custkey") % 50).alias("key"), (F.col("o_orderkey") % 9973).alias("n"))


def gaps_and_ranges(s, d):
    return islands.ranges(_numbers(s, d), ["key"], "n")


def range_texts(s, d):
    return islands.range_text(gaps_and_ranges(s, d), ["key"])


def missing_rows(s, d):
    return islands.missing(_numbers(s, d), ["key"], "n")


def dup_rows(s, d):
    return islands.repeated(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def interval_tiling_problems(s, d):
    return validate.tiling_problems(intervals_customers(s, d), ["c_nationkey"])


def take_while_tiles(s, d):
    e = intervals_customers(s, d).select("c_nationkey", "from_", "to_")
    return islands.take_while_consecutive(e, ["c_nationkey"], "from_", "to_")


def first_last_event(s, d):
    e = table(s, d, "events")
    o = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.min_by("event_type", o).alias("first_type"), F.max_by("event_type", o).alias("last_type"))


def upsert_last_wins(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", F.lit(0).cast("long").alias("seq"))
    new = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_name"), F.col("o_orderkey").alias("seq"))
    return match.upsert(c, new, ["c_custkey"], "seq")


def first_printing_wins(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return match.first_wins(li, ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_suppkey")])


def enrich_non_empty_wins(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("other"))
    return match.enrich(table(s, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("name")), n, "c_nationkey", "name", "other")


def k_to_k_pairing(s, d):
    p = table(s, d, "part").select((F.col("p_size") % 25).alias("key"), "p_partkey", "p_retailprice")
    u = table(s, d, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey")
    return match.kth_to_kth(p, u, ["key"], ["p_retailprice", "p_partkey"], ["s_suppkey"]).select("key", "k", "p_partkey", "s_suppkey")


def merged_near_lines(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    m = islands.merge_near(li, ["l_suppkey"], "l_partkey", "w", 8)
    return m.select("l_suppkey", F.bround("at", 4).alias("at"), "weight")


def section_split(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return islands.sections(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_linenumber")


def total_problems(s, d):
    """Orders whose rounded price is not the rounded sum of their lines."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("printed"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).cast("long").alias("one"))
    return validate.total_problems(o, li, ["o_orderkey"], "printed", "one")


def palette_closure(s, d):
    """Customers that order but are not in the customer table's first nations."""
    c = table(s, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return validate.closure(table(s, d, "orders"), c, ["o_custkey"])


def json_props(s, d):
    e = table(s, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"))


QUERIES = {f.__name__: f for f in (sessions_per_user, session_cell_deltas, active_seconds_pace, interval_overlap_sum, gaps_and_ranges, range_texts, missing_rows, dup_rows, interval_tiling_problems, take_while_tiles, first_last_event, upsert_last_wins, first_printing_wins, enrich_non_empty_wins, k_to_k_pairing, merged_near_lines, section_split, total_problems, palette_closure, json_props)}

_NUM = 'num AS (SELECT DISTINCT o_custkey % 50 AS key, o_orderkey % 9973 AS n FROM orders), rng AS (SELECT key, min(n) AS "start", max(n) AS "end", count(*)::BIGINT AS size FROM (SELECT *, n - row_number() OVER (PARTITION BY key ORDER BY n) AS i FROM num) GROUP BY key, i)'
ORACLE = {
    "sessions_per_user": f'WITH {_LOG} SELECT project, "start", "end", n_events, active_seconds FROM sessions',
    "session_cell_deltas": f'WITH {_LOG} SELECT project, "start", "end", cells, active_seconds FROM sessions',
    "active_seconds_pace": f"WITH {_LOG} SELECT project, count(*)::BIGINT AS n_sessions, sum(cells)::BIGINT AS cells, sum(active_seconds)::BIGINT AS active_seconds, CASE WHEN sum(active_seconds) > 0 THEN round_even(sum(cells) / (sum(active_seconds) / 3600.0::DOUBLE), 1) END AS cells_per_hour FROM sessions GROUP BY 1",
    "interval_overlap_sum": f"WITH {_LOG} SELECT project, sum(greatest(0, datesub('second', greatest(\"start\", TIMESTAMP '2024-01-10 00:00:00'), least(\"end\", TIMESTAMP '2024-01-20 12:00:00'))))::BIGINT AS seconds FROM sessions GROUP BY 1",
    "gaps_and_ranges": f"WITH {_NUM} SELECT * FROM rng",
    "range_texts": f"""WITH {_NUM} SELECT key, string_agg(CASE WHEN "start" = "end" THEN "start"::VARCHAR ELSE "start" || '-' || "end" END, ', ' ORDER BY "start") AS ranges FROM rng GROUP BY 1""",
    "missing_rows": f'WITH {_NUM}, nx AS (SELECT *, lead(n) OVER (PARTITION BY key ORDER BY n) AS m FROM num) SELECT key, n + 1 AS "start", m - 1 AS "end" FROM nx WHERE m > n + 1',
    "dup_rows": "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "interval_tiling_problems": f"""WITH {INTERVALS}, p AS (SELECT *, lag(to_) OVER w AS prev, lag(from_) OVER w AS pf FROM intervals WINDOW w AS (PARTITION BY c_nationkey ORDER BY from_, to_)),
q AS (SELECT c_nationkey, from_, CASE WHEN pf IS NOT NULL AND prev IS NULL THEN 'open' WHEN from_ > prev + 1 THEN 'gap' WHEN from_ <= prev THEN 'overlap' END AS kind FROM p) SELECT * FROM q WHERE kind IS NOT NULL""",
    "take_while_tiles": f"""WITH {INTERVALS}, p AS (SELECT *, CASE WHEN from_ <> lag(to_) OVER (PARTITION BY c_nationkey ORDER BY from_, to_) + 1 THEN 1 ELSE 0 END AS g FROM intervals),
q AS (SELECT *, max(g) OVER (PARTITION BY c_nationkey ORDER BY from_, to_ ROWS UNBOUNDED PRECEDING) AS m FROM p) SELECT c_nationkey, from_, to_ FROM q WHERE m = 0""",
    "first_last_event": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1",
    "upsert_last_wins": """WITH u AS (SELECT c_custkey, c_name, 0::BIGINT AS seq, 0 AS nw FROM customer UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, 1 FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY nw DESC, seq DESC) AS k FROM u) SELECT c_custkey, c_name, seq FROM r WHERE k = 1""",
    "first_printing_wins": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1",
    "enrich_non_empty_wins": "SELECT c_custkey, c_nationkey, coalesce(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, c_mktsegment) AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "k_to_k_pairing": """WITH p AS (SELECT p_size % 25 AS key, p_partkey, row_number() OVER (PARTITION BY p_size % 25 ORDER BY p_retailprice, p_partkey) AS k FROM part),
u AS (SELECT s_nationkey AS key, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) SELECT key, k, p_partkey, s_suppkey FROM p JOIN u USING (key, k)""",
    "merged_near_lines": """WITH g AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) <= 8 THEN 0 ELSE 1 END AS nw FROM g),
i AS (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey ORDER BY l_partkey ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT l_suppkey, round_even(sum(l_partkey * w) / sum(w), 4) AS at, sum(w) AS weight FROM i GROUP BY l_suppkey, i""",
    "section_split": "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, greatest(1, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING))::BIGINT AS section FROM lineitem",
    "total_problems": "SELECT o_orderkey, o_orderkey % 6 AS printed, coalesce(n, 0)::BIGINT AS summed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 6 <> coalesce(n, 0)",
    "palette_closure": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
}
