"""Normalisation of dates, times, places, labels and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from talasik.functions import dates as D
from talasik.functions import places as P
from talasik.functions import text as T
from talasik.session import table

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _blotter(s, d, *columns):
    return table(s, d, "scan_blotter").select("record_id", *columns)


_add("normalise_dates", lambda s, d: _blotter(s, d, "date_as_written").select("record_id", D.normalize_date(F.col("date_as_written")).alias("day")), r"""
WITH t AS (SELECT record_id, replace(trim(date_as_written), '.', '') AS x FROM scan_blotter)
SELECT record_id, strftime(coalesce(try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%m/%d/%y'), try_strptime(x, '%m-%d-%y'), try_strptime(x, '%m/%d/%Y'), try_strptime(x, '%m-%d-%Y'),
 try_strptime(x, '%b-%d-%Y'), try_strptime(x, '%B-%d-%Y'), try_strptime(x, '%b %d, %Y'), try_strptime(x, '%B %d, %Y'), try_strptime(x, '%d %B %Y'), try_strptime(x, '%d %b %Y'), try_strptime(x, '%d/%m/%Y'), try_strptime(x, '%d-%m-%Y')), '%Y-%m-%d') AS day FROM t""")
_add("normalise_times", lambda s, d: _blotter(s, d, "incident_time").select("record_id", D.normalize_time(F.col("incident_time")).alias("time")), r"""
WITH t AS (SELECT record_id, trim(incident_time) AS x FROM scan_blotter),
p AS (SELECT *, try_cast(regexp_extract(x, '^(\d{1,2}):', 1) AS INT) AS h, upper(regexp_extract(x, '(?i)(AM|PM)$', 1)) AS half FROM t)
SELECT record_id, CASE WHEN regexp_matches(x, '^\d{2}:\d{2}$') THEN x
WHEN regexp_matches(x, '(?i)^(\d{1,2}):(\d{2})\s*(AM|PM)?$') THEN lpad(CAST(CASE WHEN half = 'PM' AND h <> 12 THEN h + 12 WHEN half = 'AM' AND h = 12 THEN 0 ELSE h END AS VARCHAR), 2, '0') || ':' || regexp_extract(x, ':(\d{2})', 1)
WHEN regexp_matches(x, '^\d{4}$') THEN x[1:2] || ':' || x[3:4] END AS time FROM p""")
_add("normalise_batch", lambda s, d: _blotter(s, d, "batch_number").select("record_id", F.nullif(F.upper(T.strip(F.col("batch_number"))), F.lit("")).alias("batch")), "SELECT record_id, nullif(upper(trim(batch_number)), '') AS batch FROM scan_blotter")
_ROMAN = "MAP {" + ", ".join(f"'{r}': '{i}'" for i, r in enumerate(P.ROMAN, 1)) + "}"
_ZONE = r"""list_filter(list_transform(regexp_extract_all(upper({x}), '(?:PUROK|\bPRK\b\.?|\bP-)[\s#]*([0-9A-Z]+(?:\s+[A-Z]\b)?)', 1),
 lambda z: 'Purok ' || coalesce(nullif(regexp_extract(z, '^(\d+)\s*[A-Z]?$', 1), ''), """ + _ROMAN.replace("{", "{{").replace("}", "}}") + r"""[regexp_extract(z, '^([IVX]+)(?:\s+[A-Z])?$', 1)]) || regexp_extract(z, '^(?:\d+\s*|[IVX]+\s+)([A-Z])$', 1)), lambda z: z IS NOT NULL)[1]"""
_add("zone_numbers", lambda s, d: _blotter(s, d, "location_purok").select("record_id", P.zone_number(F.col("location_purok")).alias("zone")), f"SELECT record_id, {_ZONE.format(x='location_purok')} AS zone FROM scan_blotter")
_add("zone_or_segment", lambda s, d: _blotter(s, d, "location_purok").select("record_id", P.zone_or_segment(F.col("location_purok")).alias("place")))
_add("place_keys", lambda s, d: table(s, d, "place_ref").select("place_id", P.place_key(F.col("place_name")).alias("key")), r"""
SELECT place_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(place_name), '[^\p{L}\p{N}]+', ' ', 'g'), '\bstreet\b', 'st', 'g'), '\bavenue\b', 'ave', 'g'), '\bsubdivision\b', 'subd', 'g'), '\bbarangay\b', 'brgy', 'g'), '\bcompound\b', 'comp', 'g')) AS key FROM place_ref""")


def _canonical(s, d):
    gazetteer = table(s, d, "place_ref").select(P.place_key(F.col("place_name")).alias("key"), F.col("place_name").alias("target"))
    return P.canonical_places(_blotter(s, d, "location_purok"), "location_purok", gazetteer).select("record_id", "canonical_place")


_add("canonical_places", _canonical)
_RING = [(123.105, 11.503), (123.125, 11.501), (123.132, 11.512), (123.118, 11.519), (123.108, 11.513)]
_EDGES = " UNION ALL ".join(f"SELECT {a[0]}::DOUBLE AS x1, {a[1]}::DOUBLE AS y1, {b[0]}::DOUBLE AS x2, {b[1]}::DOUBLE AS y2" for a, b in zip(_RING, [*_RING[1:], _RING[0]]))
_add("point_in_polygon", lambda s, d: table(s, d, "place_ref").select("place_id", P.inside_polygon(None, "lon", "lat", _RING).alias("inside")), f"""
WITH e AS ({_EDGES}) SELECT place_id, coalesce(count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1) % 2 = 1, false) AS inside FROM place_ref CROSS JOIN e GROUP BY place_id""")
_add("readability", lambda s, d: _blotter(s, d, "readability").select("record_id", F.when(F.lower("readability").rlike("unreadable|illegible"), "unreadable").when(F.lower("readability").rlike("partial|moderate"), "partial").otherwise("readable").alias("grade")), """
SELECT record_id, CASE WHEN regexp_matches(lower(readability), 'unreadable|illegible') THEN 'unreadable' WHEN regexp_matches(lower(readability), 'partial|moderate') THEN 'partial' ELSE 'readable' END AS grade FROM scan_blotter""")
_add("label_lists", lambda s, d: _blotter(s, d, "incident_type", "incident_type_secondary").select("record_id", T.join_labels(T.split_labels(F.concat_ws(" | ", "incident_type", "incident_type_secondary"))).alias("labels")), """
SELECT record_id, array_to_string(list_filter(list_transform(string_split(concat_ws(' | ', incident_type, incident_type_secondary), '|'), lambda x: trim(x)), lambda x: x <> ''), '|') AS labels FROM scan_blotter""")
_add("day_features", lambda s, d: _blotter(s, d, "incident_date", "incident_time").select("record_id", D.month_of(F.col("incident_date")).alias("month"), D.weekday_of(F.col("incident_date")).alias("weekday"), D.period_of(F.col("incident_time")).alias("period")), r"""
SELECT record_id, coalesce(CAST(month(try_strptime(incident_date, '%Y-%m-%d')) AS INT), 0) AS month, coalesce(CAST(isodow(try_strptime(incident_date, '%Y-%m-%d')) AS INT) - 1, -1) AS weekday,
CASE WHEN try_strptime(incident_time[1:5], '%H:%M') IS NULL THEN 'Unknown' WHEN hour(try_strptime(incident_time[1:5], '%H:%M')) >= 22 OR hour(try_strptime(incident_time[1:5], '%H:%M')) < 6 THEN 'Late Night'
WHEN hour(try_strptime(incident_time[1:5], '%H:%M')) < 12 THEN 'Morning' WHEN hour(try_strptime(incident_time[1:5], '%H:%M')) < 18 THEN 'Afternoon' ELSE 'Evening' END AS period FROM scan_blotter""")
_add("mojibake", lambda s, d: table(s, d, "documents").select("doc_id", T.fix_mojibake(F.col("text")).alias("text")).filter("text IS NOT NULL"))
_add("citations", lambda s, d: _blotter(s, d, "remarks").select("record_id", T.strip_citations(F.col("remarks")).alias("remarks")), r"""
SELECT record_id, trim(regexp_replace(regexp_replace(remarks, '(?i)\[cite:[^\]]*\]', '', 'g'), '\s+', ' ', 'g')) AS remarks FROM scan_blotter""")
_STOPS = ", ".join(f"'{w}'" for w in sorted({*T.TAGALOG_STOPS, *T.ENGLISH_STOPS}))
_TOKENS = r"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_add("stopword_clean", lambda s, d: _blotter(s, d, "narrative_summary").select("record_id", T.clean(F.col("narrative_summary")).alias("words")), f"""
SELECT record_id, coalesce(array_to_string(list_filter({_TOKENS.format(x='narrative_summary')}, lambda w: w NOT IN ({_STOPS})), ' '), '') AS words FROM scan_blotter""")
_add("token_lexicon", lambda s, d: table(s, d, "incident_record").select(F.explode(T.tokens(F.col("narrative"))).alias("token")).filter("length(token) >= 2").groupBy("token").agg(F.count("*").alias("n")).filter("n >= 2"), f"""
SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format(x='narrative')}) AS token FROM incident_record) WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 2""")
_TL, _EN = (", ".join(f"'{w}'" for w in x) for x in (T.TAGALOG_STOPS, T.ENGLISH_STOPS))
_add("code_switch_buckets", lambda s, d: table(s, d, "incident_record").groupBy(T.code_switch(F.col("narrative")).alias("bucket")).agg(F.count("*").alias("n")), f"""
WITH w AS (SELECT {_TOKENS.format(x='narrative')} AS w FROM incident_record), h AS (SELECT len(list_filter(w, lambda x: x IN ({_TL}))) AS tl, len(list_filter(w, lambda x: x IN ({_EN}))) AS en FROM w)
SELECT CASE WHEN tl >= 2 AND en >= 2 THEN 'mixed' WHEN tl >= 2 THEN 'tagalog' WHEN en >= 2 THEN 'english' ELSE 'other' END AS bucket, count(*) AS n FROM h GROUP BY 1""")
_add("unwrapped_lines", lambda s, d: table(s, d, "ocr_calibration").select("source_file", T.unwrap_lines(F.col("ocr_text")).alias("text")))
_add("folded_text", lambda s, d: table(s, d, "ocr_calibration").select("source_file", T.folded(F.col("ocr_text")).alias("text")))
_add("cer_pages", lambda s, d: table(s, d, "ocr_calibration").filter("gold_text IS NOT NULL AND ocr_text IS NOT NULL").select("source_file", F.round(T.character_error(T.squeeze(F.col("ocr_text")), T.squeeze(F.col("gold_text"))), 9).alias("cer")))
_add("wer_pages", lambda s, d: table(s, d, "ocr_calibration").filter("gold_text IS NOT NULL AND ocr_text IS NOT NULL").select("source_file", T.word_error("ocr_text", "gold_text").alias("wer")))
_add("error_by_quality", lambda s, d: table(s, d, "ocr_calibration").filter("gold_text IS NOT NULL AND ocr_text IS NOT NULL")
     .groupBy(F.coalesce(F.nullif("quality", F.lit("")), F.lit("unknown")).alias("quality")).agg(F.count("*").alias("pages"), F.round(F.avg(F.length("ocr_text") / F.length("gold_text")), 6).alias("length_ratio")), """
SELECT coalesce(nullif(quality, ''), 'unknown') AS quality, count(*) AS pages, round(avg(length(ocr_text) / length(gold_text)), 6) AS length_ratio FROM ocr_calibration WHERE gold_text IS NOT NULL AND ocr_text IS NOT NULL GROUP BY 1""")
