"""Table maintenance, samples, windows and word accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talasik.functions import places as P
from talasik.operators import evaluation as E
from talasik.operators import matching as M
from talasik.session import table

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_add("upserted", lambda s, d: M.upsert(table(s, d, "encoder").select("user_id", "encoder_code", "desk"), table(s, d, "encoder").filter("user_id % 2 = 0").select(F.when(F.col("user_id") == 102, 999).otherwise(F.col("user_id")).cast("bigint").alias("user_id"), "encoder_code", F.lit("Desk 9").alias("desk")), "user_id", "encoder_code"), """
WITH c AS (SELECT CASE WHEN user_id = 102 THEN 999 ELSE user_id END AS user_id, encoder_code, 'Desk 9' AS desk FROM encoder WHERE user_id % 2 = 0)
SELECT user_id, encoder_code, desk FROM encoder WHERE user_id NOT IN (SELECT user_id FROM c) UNION ALL SELECT * FROM c""")
_add("fixed_up", lambda s, d: M.fixed_up(table(s, d, "scan_blotter").select("record_id", "status"), table(s, d, "scan_blotter").filter("record_id % 7 = 0").select("record_id", F.when(F.col("record_id") % 2 == 0, "none").otherwise("Settled").alias("status")), "record_id", ["status"]), """
SELECT record_id, CASE WHEN record_id % 14 = 0 THEN '' WHEN record_id % 7 = 0 THEN 'Settled' ELSE status END AS status FROM scan_blotter""")
_add("schema_evolved", lambda s, d: M.evolved(table(s, d, "status_ref"), {"status_id": "bigint", "status_name": "string", "note": "string"}), "SELECT CAST(status_id AS BIGINT) AS status_id, status_name, CAST(NULL AS VARCHAR) AS note FROM status_ref")
_add("seeded_sample", lambda s, d: M.sample_by_hash(table(s, d, "scan_blotter").select("record_id", "incident_type"), "record_id", 50, 42))
_add("windowed_events", lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("start"), "event_type", "n"), """
SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
_add("late_entries", lambda s, d: table(s, d, "scan_blotter").select("record_id", F.datediff(F.try_to_timestamp("date_encoded", F.lit("yyyy-MM-dd")), F.try_to_timestamp("incident_date", F.lit("yyyy-MM-dd"))).alias("days")).filter("days > 30"), """
SELECT record_id, CAST(try_strptime(date_encoded, '%Y-%m-%d')::DATE - try_strptime(incident_date, '%Y-%m-%d')::DATE AS INT) AS days FROM scan_blotter WHERE try_strptime(date_encoded, '%Y-%m-%d')::DATE - try_strptime(incident_date, '%Y-%m-%d')::DATE > 30""")
_add("token_account", lambda s, d: E.token_account(table(s, d, "ocr_calibration").filter("gold_text IS NOT NULL AND ocr_text IS NOT NULL"), "source_file", "ocr_text", "gold_text"), r"""
WITH w AS (SELECT source_file, regexp_extract_all(upper(gold_text), '([\p{L}\d]{3,})', 1) AS g, regexp_extract_all(upper(ocr_text), '([\p{L}\d]{3,})', 1) AS s FROM ocr_calibration WHERE gold_text IS NOT NULL AND ocr_text IS NOT NULL)
SELECT source_file, CAST(len(list_filter(g, lambda x: list_contains(s, x))) AS INT) AS exact, CAST(len(g) - len(list_filter(g, lambda x: list_contains(s, x))) AS INT) AS absent FROM w""")
_add("group_probabilities", lambda s, d: E.group_probabilities(table(s, d, "scan_blotter").filter("qa_mean_conf IS NOT NULL").select("record_id", F.array("qa_mean_conf", 1 - F.col("qa_mean_conf"), F.lit(0.0)).alias("p")), "record_id", "p", s.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "index int, group string")).withColumn("p", F.round("p", 9)), """
SELECT record_id, 'a' AS "group", round(qa_mean_conf, 9) AS p FROM scan_blotter WHERE qa_mean_conf IS NOT NULL UNION ALL SELECT record_id, 'b', round(1 - qa_mean_conf, 9) FROM scan_blotter WHERE qa_mean_conf IS NOT NULL""")
_add("migration_counts", lambda s, d: P.canonical_places(table(s, d, "incident_record").select("incident_id", "location_purok"), "location_purok", table(s, d, "place_ref").select(P.place_key(F.col("place_name")).alias("key"), F.col("place_name").alias("target"))).groupBy("location_purok", "canonical_place").agg(F.count("*").alias("n")))
_add("audit_by_user_hour", lambda s, d: table(s, d, "audit_log").dropDuplicates().groupBy("user_id", "outcome").agg(F.count("*").alias("n"), F.countDistinct("ip").alias("ips")), """
SELECT user_id, outcome, count(*) AS n, count(DISTINCT ip) AS ips FROM (SELECT DISTINCT * FROM audit_log) GROUP BY ALL""")
