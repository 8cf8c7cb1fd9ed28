"""Records on their way in, pooled predictions and the account of what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from talasik.functions import text as T
from talasik.operators import correction as C
from talasik.operators import evaluation as E
from talasik.operators import intake as I
from talasik.operators import matching as M
from talasik.plans import normalise as N
from talasik.plans.matching import KEYWORDS
from talasik.session import table

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _b(s, d):
    return table(s, d, "scan_blotter")


_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_strip = lambda x: _STRIP.format(x=x)
_hits = lambda x: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({x}), '{k}')" for k in ks) + f" THEN '{n}' END" for n, ks in KEYWORDS) + "], lambda x: x IS NOT NULL)"


def _cleaned(s, d):
    raw = _b(s, d).select("record_id", F.col("date_as_written").alias("date"), F.col("incident_time").alias("time"), "location_purok", "batch_number", "readability", "incident_type", F.col("narrative_summary").alias("narrative"))
    return I.clean_records(raw, KEYWORDS, "Others / Miscellaneous")


_add("clean_records", lambda s, d: _cleaned(s, d).select("record_id", "date", "time", "batch_number", "readability", "incident_type_primary", "incident_type_secondary", "incident_type"), f"""
WITH d AS ({N.SQL['normalise_dates']}), t AS ({N.SQL['normalise_times']}), r AS ({N.SQL['readability']}), b AS ({N.SQL['normalise_batch']}),
k AS (SELECT record_id, coalesce({_hits('incident_type')}[1], 'Others / Miscellaneous') AS one, {_hits('incident_type')}[2] AS two FROM scan_blotter)
SELECT record_id, d.day AS date, t.time, b.batch AS batch_number, r.grade AS readability, one AS incident_type_primary, two AS incident_type_secondary, concat_ws('|', one, two) AS incident_type
FROM d JOIN t USING (record_id) JOIN r USING (record_id) JOIN b USING (record_id) JOIN k USING (record_id)""")
_add("import_rows", lambda s, d: I.import_rows(_b(s, d).select("record_id", "reporting_party", "narrative_summary", "action_taken", "status")).select("record_id", "incident_summary", "status", "action_taken"), f"""
SELECT record_id, coalesce({_strip('narrative_summary')}, '') AS incident_summary, nullif({_strip('status')}, '') AS status, nullif({_strip('action_taken')}, '') AS action_taken FROM scan_blotter""")


def _slots():
    return {"date_reported": F.col("date_encoded"), "date": F.col("incident_date"), "location_purok": F.col("location_purok"), "complainant_address": F.col("narrative_summary"), "incident_summary": F.col("action_taken")}


def _record_columns(s, d):
    day, place = I.record_columns(_slots())
    return _b(s, d).select("record_id", day.alias("date"), place.alias("place"))


_zone = lambda x: N._ZONE.format(x=x)
_add("record_columns", _record_columns, f"""
SELECT record_id, coalesce(nullif({_strip('date_encoded')}, ''), nullif({_strip('incident_date')}, ''), '') AS date,
coalesce({_zone('location_purok')}, {_zone('narrative_summary')}, {_strip("coalesce(location_purok, '')")}) AS place FROM scan_blotter""")
_add("missing_slots", lambda s, d: _b(s, d).select("record_id", F.array_join(I.missing_slots(_slots()), ",").alias("missing")), f"""
SELECT record_id, concat_ws(',', CASE WHEN coalesce({_strip('date_encoded')}, '') = '' AND coalesce({_strip('incident_date')}, '') = '' THEN 'date' END,
CASE WHEN {_zone('location_purok')} IS NULL AND {_zone('narrative_summary')} IS NULL AND coalesce({_strip('location_purok')}, '') = '' THEN 'location_purok' END,
CASE WHEN coalesce({_strip('action_taken')}, '') = '' THEN 'incident_summary' END) AS missing FROM scan_blotter""")


def _backfilled(s, d):
    out = I.backfilled({"status": F.col("status"), "date": F.col("incident_date")}, {"status": F.col("readability"), "date": F.col("date_as_written")})
    return _b(s, d).select("record_id", *[c.alias(k) for k, c in out.items()])


_add("backfilled_slots", _backfilled, f"""
SELECT record_id, CASE WHEN {_strip('readability')} <> '' THEN readability ELSE status END AS status,
CASE WHEN {_strip('date_as_written')} <> '' AND coalesce({_strip('incident_date')}, '') = '' THEN date_as_written ELSE incident_date END AS date FROM scan_blotter""")
_add("guessed_fields", lambda s, d: table(s, d, "ocr_calibration").filter("ocr_text IS NOT NULL").select("source_file", *[c.alias(k) for k, c in I.guessed_slots(F.col("ocr_text")).items()]))
_add("quality_buckets", lambda s, d: table(s, d, "ocr_calibration").select("source_file", I.quality_bucket(F.col("quality")).alias("bucket")), r"""
WITH h AS (SELECT source_file, regexp_extract(lower(trim(quality)), '^([a-z]+)', 1) AS h FROM ocr_calibration)
SELECT source_file, CASE WHEN h IN ('good', 'clear', 'readable', 'high', 'excellent', 'legible') THEN 'clean' WHEN h IN ('fair', 'moderate', 'partial', 'poor', 'low', 'unreadable', 'illegible', 'bad', 'faint') THEN 'degraded' ELSE 'unknown' END AS bucket FROM h""")
_add("confidence_labels", lambda s, d: _b(s, d).select("record_id", I.confidence_label(F.col("qa_mean_conf")).alias("label"), I.label_confidence(F.col("label_confidence")).alias("confidence")), """
SELECT record_id, CASE WHEN qa_mean_conf >= 0.6 THEN 'agree' WHEN qa_mean_conf >= 0.4 THEN 'unverified' ELSE 'disagree' END AS label,
CAST(CASE lower(trim(label_confidence)) WHEN 'high' THEN 0.8 WHEN 'low' THEN 0.3 ELSE 0.5 END AS DOUBLE) AS confidence FROM scan_blotter""")
#: Two types under other names, an input of the operator.
_BRIDGE = {"Theft": "Property Taken", "Robbery": "Property Taken"}
_add("bridged_accuracy", lambda s, d: _b(s, d).filter("incident_type IS NOT NULL").select(I.bridged(F.col("incident_type"), _BRIDGE).alias("gold"), F.col("incident_type").alias("raw"), I.bridged(F.col("second_encoder_label"), _BRIDGE).alias("said"))
     .agg(F.count("*").alias("n"), F.count_if(F.col("raw") == F.col("said")).alias("raw_right"), F.count_if(F.col("gold") == F.col("said")).alias("right")), """
WITH b AS (SELECT incident_type AS raw, CASE WHEN incident_type IN ('Theft', 'Robbery') THEN 'Property Taken' ELSE incident_type END AS gold,
CASE WHEN second_encoder_label IN ('Theft', 'Robbery') THEN 'Property Taken' ELSE second_encoder_label END AS said FROM scan_blotter WHERE incident_type IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (raw = said) AS raw_right, count(*) FILTER (gold = said) AS "right" FROM b""")
_add("files_of_pages", lambda s, d: _b(s, d).select("record_id", I.file_of_page(F.col("source_file_page")).alias("file")), rf"""
SELECT record_id, {_strip(r"regexp_replace(source_file_page, '(?i)\s*\(page\s+\d+\)\s*$', '')")} AS file FROM scan_blotter""")


def _keys():
    key = lambda c: F.coalesce(F.upper(F.trim(c)), F.lit(""))
    return {"type": (key("second_encoder_label"), key("incident_type")), "encoder": (key("second_encoder"), key("encoded_by"))}


_add("zero_edit_rate", lambda s, d: I.zero_edit(_b(s, d), _keys()), """
WITH k AS (SELECT coalesce(upper(trim(second_encoder_label)), '') AS a, coalesce(upper(trim(incident_type)), '') AS b, coalesce(upper(trim(second_encoder)), '') AS c, coalesce(upper(trim(encoded_by)), '') AS e FROM scan_blotter)
SELECT count(*) AS n, round(avg(CASE WHEN (b <> '' OR e <> '') AND (b = '' OR a = b) AND (e = '' OR c = e) THEN 1.0::DOUBLE ELSE 0 END), 9) AS zero_edit FROM k""")


def _pooled(s, d):
    gold = _b(s, d).filter("fold IS NOT NULL AND incident_type IS NOT NULL").select("record_id", F.lower(F.trim("incident_type")).alias("gold_type"), "fold", "second_encoder_label", "incident_type_secondary")
    said = lambda c: gold.select("record_id", F.lower(F.trim(c)).alias("pred_type"))
    groups = table(s, d, "incident_type_ref").select(F.lower("type_name").alias("type"), F.col("category_group").alias("group"))
    return M.pooled(gold, gold.select("record_id", F.col("fold").alias("split")), {"second": said("second_encoder_label"), "other": said("incident_type_secondary")}, "record_id", groups)


_add("pooled_predictions", _pooled, """
WITH g AS (SELECT record_id, fold AS split, lower(trim(incident_type)) AS gold_type, lower(trim(second_encoder_label)) AS second_type, lower(trim(incident_type_secondary)) AS other_type FROM scan_blotter WHERE fold IS NOT NULL AND incident_type IS NOT NULL)
SELECT record_id, split, gold_type, a.category_group AS gold_group, second_type, coalesce(second_type = gold_type, false) AS second_right, b.category_group AS second_group, coalesce(b.category_group = a.category_group, false) AS second_group_right,
other_type, coalesce(other_type = gold_type, false) AS other_right, c.category_group AS other_group, coalesce(c.category_group = a.category_group, false) AS other_group_right
FROM g LEFT JOIN incident_type_ref a ON lower(a.type_name) = gold_type LEFT JOIN incident_type_ref b ON lower(b.type_name) = second_type LEFT JOIN incident_type_ref c ON lower(c.type_name) = other_type""")
_SCORES = {"purchase": "value", "view": "mirrored"}
_AUC = """SELECT round(sum(fp * (ctp - tp / 2)) / nullif(sum(tp) * sum(fp), 0), 9) AS auc, CAST(sum(tp) AS BIGINT) AS positives FROM (SELECT *, sum(tp) OVER (ORDER BY v DESC) AS ctp FROM (SELECT v, count(*) FILTER (y) AS tp, count(*) FILTER (NOT y) AS fp FROM {src} WHERE v IS NOT NULL GROUP BY 1))"""
_CELLS = "(SELECT value AS v, event_type = 'purchase' AS y FROM events UNION ALL SELECT 500 - value, event_type = 'view' FROM events)"
_add("ovr_auc", lambda s, d: E.one_against_rest(table(s, d, "events").withColumn("mirrored", 500 - F.col("value")), "event_type", _SCORES), f"""
WITH a AS (SELECT 'purchase' AS class, * FROM ({_AUC.format(src="(SELECT value AS v, event_type = 'purchase' AS y FROM events)")}) UNION ALL SELECT 'view', * FROM ({_AUC.format(src="(SELECT 500 - value AS v, event_type = 'view' AS y FROM events)")}))
SELECT * FROM a UNION ALL SELECT '(micro)', * FROM ({_AUC.format(src=_CELLS)}) UNION ALL SELECT '(macro)', round(avg(auc), 9), CAST(sum(positives) AS BIGINT) FROM a""")
_add("roc_curve", lambda s, d: E.roc_points(table(s, d, "events"), "value", F.col("event_type") == "purchase"), """
WITH p AS (SELECT value AS threshold, count(*) FILTER (event_type = 'purchase') AS tp, count(*) FILTER (event_type <> 'purchase') AS fp FROM events WHERE value IS NOT NULL GROUP BY 1),
r AS (SELECT threshold, row_number() OVER (ORDER BY threshold DESC) - 1 AS i, sum(tp) OVER (ORDER BY threshold DESC) AS ctp, sum(fp) OVER (ORDER BY threshold DESC) AS cfp, count(*) OVER () AS k, sum(tp) OVER () AS p, sum(fp) OVER () AS q FROM p)
SELECT threshold, round(ctp / p, 9) AS tpr, round(cfp / q, 9) AS fpr FROM r WHERE i % CAST(greatest(ceil(k / 250), 1) AS BIGINT) = 0 OR i = k - 1""")
_add("paired_difference", lambda s, d: E.paired_bootstrap(_pooled(s, d), "second_right", "other_right"))
_add("switch_accuracy", lambda s, d: _b(s, d).filter("incident_type IS NOT NULL AND second_encoder_label IS NOT NULL").groupBy(T.code_switch(F.col("narrative_summary")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("incident_type") == F.col("second_encoder_label")).alias("right")), f"""
WITH w AS (SELECT {N._TOKENS.format(x='narrative_summary')} AS w, incident_type = second_encoder_label AS ok FROM scan_blotter WHERE incident_type IS NOT NULL AND second_encoder_label IS NOT NULL),
h AS (SELECT ok, coalesce(len(list_filter(w, lambda x: x IN ({N._TL}))), 0) AS tl, coalesce(len(list_filter(w, lambda x: x IN ({N._EN}))), 0) AS en FROM w)
SELECT CASE WHEN tl >= 2 AND en >= 2 THEN 'mixed' WHEN tl >= 2 THEN 'tagalog' WHEN en >= 2 THEN 'english' ELSE 'other' END AS bucket, count(*) AS n, count(*) FILTER (ok) AS "right" FROM h GROUP BY 1""")


def _account(s, d):
    return E.token_account(table(s, d, "ocr_calibration").filter("gold_text IS NOT NULL AND ocr_text IS NOT NULL"), "source_file", "ocr_text", "gold_text")


_add("worst_pages", lambda s, d: _account(s, d).withColumn("share", F.round(F.col("absent") / F.nullif(F.col("exact") + F.col("absent"), F.lit(0)), 9)).filter("share > 0.3").orderBy(F.desc("share"), "source_file").limit(5).select("source_file", "share"), r"""
WITH w AS (SELECT source_file, regexp_extract_all(upper(gold_text), '([\p{L}\d]{3,})', 1) AS g, regexp_extract_all(upper(ocr_text), '([\p{L}\d]{3,})', 1) AS s FROM ocr_calibration WHERE gold_text IS NOT NULL AND ocr_text IS NOT NULL)
SELECT source_file, round(len(list_filter(g, lambda x: NOT list_contains(s, x))) / nullif(len(g), 0), 9) AS share FROM w WHERE share > 0.3 ORDER BY share DESC, source_file LIMIT 5""")
_GOLD = lambda s, d: table(s, d, "ocr_calibration").filter("gold_text IS NOT NULL AND ocr_text IS NOT NULL")
_add("corrector_account", lambda s, d: C.corrector_account(_GOLD(s, d), "ocr_text", "gold_text", C.corrections(_GOLD(s, d), "ocr_text", C.lexicon(table(s, d, "incident_record"), "narrative"))))
_add("errors_by_stratum", lambda s, d: _GOLD(s, d).select(I.quality_bucket(F.col("quality")).alias("bucket"), T.character_error(T.squeeze(F.col("ocr_text")), T.squeeze(F.col("gold_text"))).alias("c"), T.word_error("ocr_text", "gold_text").alias("w"), (F.length("ocr_text") / F.nullif(F.length("gold_text"), F.lit(0))).alias("r"))
     .groupBy("bucket").agg(F.count("*").alias("pages"), F.round(F.avg("c"), 6).alias("cer"), F.round(F.avg("w"), 6).alias("wer"), F.round(F.avg("r"), 6).alias("length_ratio")))
