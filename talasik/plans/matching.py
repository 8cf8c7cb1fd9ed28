"""Lookups, containment, drift, deduplication, replay and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talasik.operators import matching as M
from talasik.operators.skew import broadcast_if_small
from talasik.session import table

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


#: Keywords of incident types in three languages, most specific first; an input of the operator.
KEYWORDS = [
    ("Robbery", ["robbery", "hold-up", "pinasok ng hindi"]), ("Theft", ["theft", "nakaw", "stolen", "kinuha ng"]), ("Physical Injury", ["physical injury", "sinaktan", "struck on the arm"]),
    ("Oral Defamation", ["slander", "minura", "insulting words"]), ("Noise Complaint", ["noise", "ingay", "videoke"]), ("Animal-Related Incident", ["aso", "hayop", "dog bit"]),
    ("Boundary Dispute", ["boundary", "hangganan"]), ("Collection of Sum of Money", ["utang", "loan of"]), ("Grave Threats", ["banta", "threatened to hurt"]),
]
_add("taxonomy_lookup", lambda s, d: M.lookup(table(s, d, "scan_blotter").select("record_id", F.lower(F.trim("incident_type")).alias("type")), "type", table(s, d, "incident_type_ref").select(F.lower("type_name").alias("name"), "category_group"), "name", {"category_group": "Catch-all"}), """
SELECT record_id, lower(trim(incident_type)) AS type, coalesce(category_group, 'Catch-all') AS category_group FROM scan_blotter LEFT JOIN incident_type_ref ON lower(type_name) = lower(trim(incident_type))""")


def _keywords(s, d):
    first, second = M.keyword_categories(F.col("text"), KEYWORDS, "Others / Miscellaneous")
    return table(s, d, "documents").select("doc_id", first.alias("first"), second.alias("second"))


_HITS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) + f" THEN '{n}' END" for n, ks in KEYWORDS) + "], lambda x: x IS NOT NULL)"
_add("keyword_category", _keywords, f"SELECT doc_id, coalesce({_HITS}[1], 'Others / Miscellaneous') AS \"first\", {_HITS}[2] AS second FROM documents")
_add("longest_containment", lambda s, d: M.longest_inside(table(s, d, "scan_blotter"), "record_id", "narrative_summary", table(s, d, "place_ref").select(F.col("place_name").alias("entry"))), r"""
WITH w AS (SELECT record_id, lower(narrative_summary) AS low, ' ' || regexp_replace(lower(narrative_summary), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' AS words FROM scan_blotter),
p AS (SELECT DISTINCT place_name, lower(place_name) AS low, ' ' || trim(regexp_replace(lower(place_name), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ' AS words FROM place_ref),
h AS (SELECT record_id, place_name AS entry, row_number() OVER (PARTITION BY record_id ORDER BY length(place_name) DESC, place_name) AS k FROM w JOIN p ON contains(w.words, p.words) AND contains(w.low, p.low))
SELECT b.record_id, entry FROM scan_blotter b LEFT JOIN h ON h.record_id = b.record_id AND k = 1""")
_add("reference_drift", lambda s, d: M.drift(table(s, d, "nation"), table(s, d, "nation").filter("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") == 7, F.lit("ELSEWHERE")).otherwise(F.col("n_name"))), "n_nationkey", ["n_name", "n_regionkey"]), """
WITH b AS (SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'ELSEWHERE' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 3),
f AS (SELECT n_nationkey, 'n_name' AS field, a.n_name AS "left", b.n_name AS "right" FROM nation a FULL JOIN b USING (n_nationkey) UNION ALL SELECT n_nationkey, 'n_regionkey', a.n_regionkey::VARCHAR, b.n_regionkey::VARCHAR FROM nation a FULL JOIN b USING (n_nationkey))
SELECT n_nationkey, field, "left", "right" FROM f WHERE "left" IS DISTINCT FROM "right" """)
_digest = lambda c: F.sha2(F.lower(F.trim(c)), 256)
_add("dedupe_first", lambda s, d: M.keep_first(table(s, d, "incident_record").select("incident_id", "narrative", "created_at"), _digest("narrative"), ["created_at", "incident_id"]).select("incident_id", F.length("narrative").alias("chars")).distinct(), """
SELECT DISTINCT incident_id, length(narrative) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(narrative)) ORDER BY created_at NULLS FIRST, incident_id) AS k FROM incident_record) WHERE k = 1""")


def _import_stats(s, d):
    rows = table(s, d, "scan_blotter").select("record_id", F.nullif(F.trim("narrative_summary"), F.lit("")).alias("n"), "readability")
    first = rows.filter("n IS NOT NULL").groupBy(_digest("n").alias("k")).agg(F.min("record_id").alias("record_id")).select("record_id", F.lit(True).alias("kept"))
    state = F.when(F.col("n").isNull(), "skipped_blank").when(F.col("kept").isNull(), "skipped_existing").when(F.col("readability") == "unreadable", "saved_excluded").otherwise("saved")
    return rows.join(first, "record_id", "left").groupBy(state.alias("disposition")).agg(F.count("*").alias("n"))


_add("import_stats", _import_stats, """
WITH r AS (SELECT record_id, nullif(trim(narrative_summary), '') AS n, readability FROM scan_blotter), k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(n)) ORDER BY record_id) AS k FROM r)
SELECT CASE WHEN n IS NULL THEN 'skipped_blank' WHEN k > 1 THEN 'skipped_existing' WHEN readability = 'unreadable' THEN 'saved_excluded' ELSE 'saved' END AS disposition, count(*) AS n FROM k GROUP BY 1""")
_add("replay_guard", lambda s, d: M.replays(table(s, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 60).filter("replay").select("event_id"), """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
kept AS (SELECT user_id, event_type, k, ts FROM e WHERE k = 1 UNION ALL
  SELECT s.user_id, s.event_type, min(e.k) AS k, min(e.ts) AS ts FROM kept s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.k > s.k AND e.ts > s.ts + INTERVAL 60 SECOND GROUP BY s.user_id, s.event_type, s.k)
SELECT event_id FROM e ANTI JOIN kept USING (user_id, event_type, k)""")
_add("unseen_records", lambda s, d: M.unseen(table(s, d, "scan_blotter").select("record_id"), table(s, d, "encoder_label"), "record_id"), "SELECT record_id FROM scan_blotter WHERE record_id NOT IN (SELECT record_id FROM encoder_label WHERE record_id IS NOT NULL)")
_add("union_dev_holdout", lambda s, d: table(s, d, "scan_blotter").filter("fold = 'train'").select("record_id", "fold").unionByName(table(s, d, "scan_blotter").filter("fold = 'test'").select("record_id", "fold")), "SELECT record_id, fold FROM scan_blotter WHERE fold IN ('train', 'test')")
_add("set_equality", lambda s, d: M.same_set(table(s, d, "scan_blotter").filter("encoded_by IS NOT NULL").select("encoded_by"), table(s, d, "encoder").select(F.col("encoder_code").alias("encoded_by"))), """
WITH a AS (SELECT DISTINCT encoded_by FROM scan_blotter WHERE encoded_by IS NOT NULL), b AS (SELECT DISTINCT encoder_code FROM encoder)
SELECT count(*) FILTER (b.encoder_code IS NULL) AS only_left, count(*) FILTER (a.encoded_by IS NULL) AS only_right, count(*) FILTER (b.encoder_code IS NULL) = 0 AND count(*) FILTER (a.encoded_by IS NULL) = 0 AS equal FROM a FULL JOIN b ON encoded_by = encoder_code""")
_add("labels_unknown", lambda s, d: table(s, d, "scan_blotter").select(F.lower(F.trim("incident_type")).alias("label")).filter("label IS NOT NULL").distinct().join(broadcast_if_small(table(s, d, "incident_type_ref").select(F.lower("type_name").alias("label"))), "label", "left_anti"), """
SELECT DISTINCT lower(trim(incident_type)) AS label FROM scan_blotter WHERE incident_type IS NOT NULL AND lower(trim(incident_type)) NOT IN (SELECT lower(type_name) FROM incident_type_ref)""")
_add("latest_label", lambda s, d: table(s, d, "encoder_label").groupBy("record_id", "encoder_code").agg(F.max_by("incident_type", F.struct("labelled_at", "incident_type")).alias("incident_type")), """
SELECT record_id, encoder_code, incident_type FROM (SELECT *, row_number() OVER (PARTITION BY record_id, encoder_code ORDER BY labelled_at DESC, incident_type DESC) AS k FROM encoder_label) WHERE k = 1""")


def _reconcile(s, d):
    rows = table(s, d, "scan_blotter").select("record_id", F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in (("type", "incident_type", "second_encoder_label"), ("day", "incident_date", "date_as_written"))])).alias("x")).select("record_id", "x.*")
    a, b = F.nullif(F.trim("a"), F.lit("")), F.nullif(F.trim("b"), F.lit(""))
    same = F.upper(a) == F.upper(b)
    source = F.when(a.isNull() & b.isNull(), "none").when(b.isNull(), "first").when(a.isNull(), "second").when(same, "both").otherwise("first")
    return rows.select("record_id", "slot", F.coalesce(a, b).alias("value"), source.alias("source"), F.coalesce(same, F.lit(False)).alias("agree"))


_REC = """(SELECT record_id, slot, coalesce(a, b) AS value, CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN b IS NULL THEN 'first' WHEN a IS NULL THEN 'second' WHEN upper(a) = upper(b) THEN 'both' ELSE 'first' END AS source,
coalesce(upper(a) = upper(b), false) AS agree FROM (SELECT record_id, 'type' AS slot, nullif(trim(incident_type), '') AS a, nullif(trim(second_encoder_label), '') AS b FROM scan_blotter
UNION ALL SELECT record_id, 'day', nullif(trim(incident_date), ''), nullif(trim(date_as_written), '') FROM scan_blotter))"""
_add("reconcile_slots", _reconcile, f"SELECT record_id, slot, value, source, agree FROM {_REC}")
_add("reconcile_accuracy", lambda s, d: _reconcile(s, d).filter("value IS NOT NULL").rollup("slot").agg(F.count("*").alias("n"), F.count_if("agree").alias("agreed")).select(F.coalesce("slot", F.lit("(all)")).alias("slot"), "n", "agreed"), f"""
SELECT coalesce(slot, '(all)') AS slot, count(*) AS n, count(*) FILTER (agree) AS agreed FROM {_REC} WHERE value IS NOT NULL GROUP BY ROLLUP (slot)""")


def _grounding(s, d):
    rows = table(s, d, "incident_record").select("incident_id", F.regexp_extract_all("action_taken", F.lit(r"(\d[\d,]*)"), F.lit(1)).alias("told"), F.regexp_extract_all("narrative", F.lit(r"(\d[\d,]*)"), F.lit(1)).alias("page"))
    return rows.select("incident_id", F.coalesce(F.size(F.array_except(F.transform("told", lambda x: F.replace(x, F.lit(","), F.lit(""))), F.transform("page", lambda x: F.replace(x, F.lit(","), F.lit(""))))), F.lit(0)).alias("ungrounded")).distinct()


_add("grounding_check", _grounding, r"""
SELECT DISTINCT incident_id, CAST(coalesce(len(list_distinct(list_filter(list_transform(regexp_extract_all(action_taken, '(\d[\d,]*)', 1), lambda x: replace(x, ',', '')), lambda x: NOT list_contains(list_transform(regexp_extract_all(narrative, '(\d[\d,]*)', 1), lambda y: replace(y, ',', '')), x)))), 0) AS INT) AS ungrounded FROM incident_record""")
_add("revenue_by_nation", lambda s, d: (
    table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    .join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    .join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "revenue")), """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
