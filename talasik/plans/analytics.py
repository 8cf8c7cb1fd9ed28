"""Counts, cross-tabs, hotspots, lists and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from talasik.operators import analytics as A
from talasik.session import table

QUERIES, SQL = {}, {}


def _placed_orders(spark, d):
    """Orders with the customer's nation as place and the order priority as category."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
        .selectExpr("o_orderkey AS id", "n_name AS place", "o_orderpriority AS category", "CAST(o_orderdate AS STRING) AS day")
    )


_PLACED = """(SELECT o_orderkey AS id, n_name AS place, o_orderpriority AS category, CAST(o_orderdate AS VARCHAR) AS day
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _b(s, d):
    return table(s, d, "scan_blotter")


_add("hotspots", lambda s, d: A.hotspots(_placed_orders(s, d), "place", "category"), f"""
WITH c AS (SELECT place, category, count(*) AS n FROM {_PLACED} GROUP BY ALL),
p AS (SELECT place, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY place),
t AS (SELECT place, category, row_number() OVER (PARTITION BY place ORDER BY n DESC, category) AS k FROM c)
SELECT p.place, n_rows, round(n_rows / max(n_rows) OVER () * 100, 1) AS pct_of_max,
CASE WHEN n_rows / max(n_rows) OVER () >= 0.66 THEN 'high' WHEN n_rows / max(n_rows) OVER () >= 0.33 THEN 'medium' ELSE 'low' END AS severity,
category AS top_category FROM p JOIN t ON p.place = t.place AND k = 1""")
_add("blotter_hotspots", lambda s, d: A.hotspots(_b(s, d), "location_purok", "incident_type"), """
WITH c AS (SELECT coalesce(nullif(location_purok, ''), 'Unknown') AS place, nullif(incident_type, '') AS category, count(*) AS n FROM scan_blotter GROUP BY ALL),
p AS (SELECT place, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY place),
t AS (SELECT place, category, row_number() OVER (PARTITION BY place ORDER BY n DESC, category) AS k FROM c WHERE category IS NOT NULL)
SELECT p.place, n_rows, round(n_rows / max(n_rows) OVER () * 100, 1) AS pct_of_max,
CASE WHEN n_rows / max(n_rows) OVER () >= 0.66 THEN 'high' WHEN n_rows / max(n_rows) OVER () >= 0.33 THEN 'medium' ELSE 'low' END AS severity,
coalesce(category, '—') AS top_category FROM p LEFT JOIN t ON p.place = t.place AND k = 1""")
_add("summary_cards", lambda s, d: table(s, d, "incident_record").agg(
    F.count("*").alias("total"), F.count_if(F.col("review_status") == "needs_review").alias("needs_review"), F.count_if(F.col("review_status") == "accepted").alias("accepted"),
    F.count_if(F.col("review_status") == "corrected").alias("corrected"), F.count_if(A.blank("incident_type_primary").isNotNull()).alias("categorized")), """
SELECT count(*) AS total, count(*) FILTER (review_status = 'needs_review') AS needs_review, count(*) FILTER (review_status = 'accepted') AS accepted,
count(*) FILTER (review_status = 'corrected') AS corrected, count(*) FILTER (incident_type_primary <> '') AS categorized FROM incident_record""")
_add("category_counts", lambda s, d: A.counts(_b(s, d), "incident_type", "Uncategorized"), "SELECT coalesce(nullif(incident_type, ''), 'Uncategorized') AS value, count(*) AS n FROM scan_blotter GROUP BY 1")
_add("place_counts", lambda s, d: A.counts(_placed_orders(s, d), "place", "Unknown"), f"SELECT coalesce(nullif(place, ''), 'Unknown') AS value, count(*) AS n FROM {_PLACED} GROUP BY 1")
_STATUSES = ["Filed", "Settled", "For Hearing", "Dismissed", "Escalated"]
_add("vocab_counts", lambda s, d: A.vocabulary_counts(_b(s, d), "status", _STATUSES), """
SELECT v AS value, count(status) AS n FROM (SELECT unnest(['Filed', 'Settled', 'For Hearing', 'Dismissed', 'Escalated']) AS v) LEFT JOIN scan_blotter ON status = v GROUP BY v""")
_add("group_counts", lambda s, d: (
    table(s, d, "incident_record").filter(A.blank("incident_type_primary").isNotNull())
    .join(F.broadcast(table(s, d, "incident_type_ref").select(F.col("type_name"), F.col("category_group").alias("derived"))), F.col("incident_type_primary") == F.col("type_name"), "left")
    .groupBy(F.coalesce(A.blank("category_group"), "derived", F.lit("Catch-all")).alias("value")).agg(F.count("*").alias("n"))), """
SELECT coalesce(nullif(r.category_group, ''), t.category_group, 'Catch-all') AS value, count(*) AS n
FROM incident_record r LEFT JOIN incident_type_ref t ON incident_type_primary = type_name WHERE incident_type_primary <> '' GROUP BY 1""")
_add("trend_monthly", lambda s, d: A.trend(_b(s, d), "incident_date"), "SELECT incident_date[1:7] AS period, count(*) AS n FROM scan_blotter WHERE incident_date <> '' GROUP BY 1")
_add("trend_yearly", lambda s, d: A.trend(_placed_orders(s, d), "day", "year"), f"SELECT day[1:4] AS period, count(*) AS n FROM {_PLACED} GROUP BY 1")
_add("distinct_dropdown", lambda s, d: A.choices(table(s, d, "part"), "p_type"), "SELECT DISTINCT p_type AS value FROM part WHERE p_type <> ''")
_add("crosstab_cat_place", lambda s, d: A.cross_tab(_placed_orders(s, d), A.filled("category", "Uncategorized"), A.filled("place", "Unknown")), f"SELECT category AS row, place AS col, count(*) AS n FROM {_PLACED} GROUP BY ALL")
_add("crosstab_cat_month", lambda s, d: A.cross_tab(_b(s, d).filter(A.blank("incident_date").isNotNull()), A.filled("incident_type", "Uncategorized"), F.substring("incident_date", 1, 7)), """
SELECT coalesce(nullif(incident_type, ''), 'Uncategorized') AS row, incident_date[1:7] AS col, count(*) AS n FROM scan_blotter WHERE incident_date <> '' GROUP BY ALL""")
_add("crosstab_totals", lambda s, d: A.cross_tab_totals(_placed_orders(s, d), F.col("category"), F.col("place")), f"""
SELECT coalesce(category, '(all)') AS row, coalesce(place, '(all)') AS col, count(*) AS n FROM {_PLACED} GROUP BY CUBE (category, place)""")
_add("crosstab_dense_tiers", lambda s, d: A.dense_tiers(table(s, d, "events"), F.col("event_type"), F.substring(F.col("ts").cast("string"), 1, 10)), """
WITH c AS (SELECT event_type AS row, CAST(ts AS VARCHAR)[1:10] AS col, count(*) AS n FROM events GROUP BY ALL)
SELECT r.row, k.col, coalesce(c.n, 0) AS n, CASE WHEN coalesce(c.n, 0) >= 10 THEN 'high' WHEN coalesce(c.n, 0) >= 5 THEN 'mid' WHEN coalesce(c.n, 0) = 0 THEN 'zero' ELSE 'none' END AS tier
FROM (SELECT DISTINCT row FROM c) r CROSS JOIN (SELECT DISTINCT col FROM c) k LEFT JOIN c ON c.row = r.row AND c.col = k.col""")
_RISK = """
WITH r AS (SELECT nullif({cat}, '') AS category, {day}[1:7] AS month FROM {src} WHERE {cat} <> ''),
m AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k FROM (SELECT DISTINCT month FROM r WHERE month <> '') ORDER BY month DESC LIMIT 2),
c AS (SELECT category, count(*) FILTER (k = 1) AS last, count(*) FILTER (k = 2) AS previous FROM r LEFT JOIN m USING (month) GROUP BY category)
SELECT category, last, previous, CASE WHEN (SELECT count(*) FROM m) < 2 THEN 'stable' WHEN last > previous THEN 'up' WHEN last < previous THEN 'down' ELSE 'stable' END AS direction
FROM c WHERE (SELECT count(*) FROM m) > {least}"""
_add("risk_indicators", lambda s, d: A.risk(_b(s, d), "incident_date", "incident_type"), _RISK.format(cat="incident_type", day="incident_date", src="scan_blotter", least=1))
_EVENTS = "(SELECT event_type, CAST(ts AS VARCHAR) AS day FROM events)"
_add("risk_stable_variant", lambda s, d: A.risk(table(s, d, "events").withColumn("day", F.col("ts").cast("string")), "day", "event_type", True), _RISK.format(cat="event_type", day="day", src=_EVENTS, least=0))
_add("filtered_list", lambda s, d: A.filtered(_b(s, d), {"incident_type": "Theft", "location_purok": None}, "incident_date", "2024-01-01", "2024-12-31").select("record_id", "incident_date", "incident_type", "location_purok"), """
SELECT record_id, incident_date, incident_type, location_purok FROM scan_blotter WHERE incident_type = 'Theft' AND incident_date >= '2024-01-01' AND incident_date <= '2024-12-31'""")
_add("paged_list", lambda s, d: A.page(table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3), """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50""")
_add("recent_top20", lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20), "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
_add("text_search", lambda s, d: A.containing(table(s, d, "documents").select("doc_id", "text"), "text", "MEDIATION").select("doc_id"), "SELECT doc_id FROM documents WHERE contains(lower(text), 'mediation')")
_add("audit_day_filter", lambda s, d: A.on_day(table(s, d, "audit_log").filter("action_name IS NOT NULL"), "audit_ts", "2024-03-05").select("audit_id", "action_name", "outcome").distinct(), """
SELECT DISTINCT audit_id, action_name, outcome FROM audit_log WHERE action_name IS NOT NULL AND audit_ts >= TIMESTAMP '2024-03-05' AND audit_ts < TIMESTAMP '2024-03-06'""")
_add("audit_latest_200", lambda s, d: table(s, d, "audit_log").dropDuplicates(["audit_id"]).orderBy(F.desc("audit_id")).limit(200).select("audit_id", "outcome"), """
SELECT DISTINCT ON (audit_id) audit_id, outcome FROM audit_log ORDER BY audit_id DESC LIMIT 200""")
_add("dashboard_counts_by_encoder", lambda s, d: _b(s, d).join(F.broadcast(table(s, d, "encoder").select(F.col("encoder_code").alias("encoded_by"), "desk")), "encoded_by", "left").groupBy(F.coalesce("desk", F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n")), """
SELECT coalesce(desk, 'Unknown') AS value, count(*) AS n FROM scan_blotter LEFT JOIN encoder ON encoder_code = encoded_by GROUP BY 1""")
_add("masked_projection", lambda s, d: _b(s, d).select("record_id", F.substring("narrative_summary", 1, 90).alias("shown")), "SELECT record_id, narrative_summary[1:90] AS shown FROM scan_blotter")
_add("visible_narrative", lambda s, d: _b(s, d).select("record_id", F.when(F.col("encoded_by") == "ENC-01", F.col("narrative_summary")).otherwise(F.lit("[REDACTED]")).alias("shown")), """
SELECT record_id, CASE WHEN encoded_by = 'ENC-01' THEN narrative_summary ELSE '[REDACTED]' END AS shown FROM scan_blotter""")
