"""Masking, forms, correction and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from talasik.operators import correction as C
from talasik.operators import forms, privacy
from talasik.session import table

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _remarks(s, d):
    return table(s, d, "scan_blotter").select("record_id", "narrative_summary", F.concat_ws("; ", F.concat(F.lit("Complainant: "), "reporting_party"), F.concat(F.lit("Respondent: "), "respondent")).alias("remarks"))


_add("names_in_remarks", lambda s, d: _remarks(s, d).select("record_id", F.explode(privacy.names_in(F.col("remarks"))).alias("name")))
_add("mask_tokens", lambda s, d: _remarks(s, d).select("record_id", privacy.masked(F.col("narrative_summary"), privacy.names_in(F.col("remarks"))).alias("text")))
_FORM = {"reporting_party": "reporting_party", "respondent": "respondent", "date": "incident_date", "time": "incident_time", "location_purok": "location_purok", "status": "status", "incident_summary": "narrative_summary", "action_taken": "action_taken"}
_add("redacted_forms", lambda s, d: table(s, d, "scan_blotter").select("record_id", privacy.redact_names(forms.rendered({k: F.col(c) for k, c in _FORM.items()})).alias("shown")))
_add("digests", lambda s, d: table(s, d, "scan_blotter").select("record_id", privacy.digest(F.col("narrative_summary"), b"k" * 32).alias("digest")))
_KEY = b"0123456789abcdef0123456789abcdef"


def _sealed(s, d):
    rows = table(s, d, "scan_blotter").select("record_id", "remarks", privacy.encrypted(F.col("remarks"), _KEY, "remarks").alias("sealed"))
    return rows.select("record_id", privacy.decrypted(F.col("sealed"), _KEY, "remarks").alias("remarks"), F.coalesce(F.col("sealed").startswith("v1:"), F.lit(False)).alias("hidden"))


_add("encrypted_column", _sealed, "SELECT record_id, remarks, remarks IS NOT NULL AS hidden FROM scan_blotter")


def _round_trip(s, d):
    rows = table(s, d, "scan_blotter")
    slots = {"reporting_party": F.col("reporting_party"), "respondent": F.col("respondent"), "date": F.col("incident_date"), "time": F.col("incident_time"), "location_purok": F.col("location_purok"), "status": F.col("status"), "action_taken": F.col("action_taken"), "incident_summary": F.regexp_replace("action_taken", "e", "E")}
    return forms.parsed(rows.select("record_id", forms.rendered(slots).alias("text")), "record_id", "text").select("record_id", "entry_no", "date", "time", "reporting_party", "status", "action_taken", "incident_summary")


_add("forms_round_trip", _round_trip, r"""
SELECT record_id, CAST(1 AS INT) AS entry_no, coalesce(trim(incident_date), '') AS date, coalesce(trim(incident_time), '') AS time, coalesce(trim(reporting_party), '') AS reporting_party, coalesce(trim(status), '') AS status,
coalesce(trim(action_taken), '') AS action_taken, coalesce(replace(trim(action_taken), 'e', 'E'), '') AS incident_summary FROM scan_blotter""")
_add("word_lexicon", lambda s, d: C.lexicon(table(s, d, "incident_record"), "narrative"), r"""
SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(upper(narrative), '([\p{L}\d]{2,})', 1)) AS token FROM incident_record) GROUP BY token HAVING count(*) >= 2""")
_add("lexicon_corrections", lambda s, d: C.corrections(table(s, d, "ocr_calibration"), "ocr_text", C.lexicon(table(s, d, "incident_record"), "narrative")))
_GOLD = lambda s, d: table(s, d, "ocr_calibration").filter("gold_text IS NOT NULL AND ocr_text IS NOT NULL")
_add("glyph_confusions", lambda s, d: C.confusions(_GOLD(s, d), "ocr_text", "gold_text"))
_add("rewrite_fidelity", lambda s, d: _GOLD(s, d).select("source_file", C.fidelity("gold_text", "ocr_text").alias("f")).select("source_file", "f.*"))
_add("narrative_recall", lambda s, d: _GOLD(s, d).select(C.recall("ocr_text", "gold_text").alias("r")).agg(F.round(F.sum(F.col("r.exact") * F.col("r.words")) / F.sum("r.words"), 6).alias("exact"), F.round(F.sum(F.col("r.fuzzy") * F.col("r.words")) / F.sum("r.words"), 6).alias("fuzzy")))
_add("corrupted_text", lambda s, d: C.corrupted(table(s, d, "incident_record").select("incident_id", "narrative").distinct(), "incident_id", "narrative", 0.02, 7))
