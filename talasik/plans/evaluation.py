"""Evaluation statistics: accuracy, agreement, tests, per-class scores, calibration, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from talasik.operators import evaluation as E
from talasik.session import table

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _labels(s, d):
    """Two encoders' types of a record: the first counts as gold, the second as prediction."""
    return table(s, d, "scan_blotter").select("record_id", F.lower(F.trim("incident_type")).alias("gold"), F.lower(F.trim("second_encoder_label")).alias("pred"), "label_confidence", "qa_mean_conf", "fold", "encoded_by").filter("gold IS NOT NULL")


_L = "(SELECT record_id, lower(trim(incident_type)) AS gold, lower(trim(second_encoder_label)) AS pred, label_confidence, qa_mean_conf, fold, encoded_by FROM scan_blotter WHERE incident_type IS NOT NULL)"
_WILSON = """round(greatest(((k / n) + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n), 0.0), 9) AS low,
round(least(((k / n) + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) + 1.959963984540054 * sqrt((k / n) * (1 - k / n) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n), 1.0), 9) AS high"""
_right = lambda: F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
_rated = lambda s, d: _labels(s, d).filter("pred IS NOT NULL")
_add("pooled_accuracy", lambda s, d: E.accuracy(_rated(s, d).withColumn("split", F.coalesce("fold", F.lit("none"))), ["split"], _right()), f"""
SELECT split, k, n, round(k / n, 9) AS accuracy, {_WILSON} FROM (SELECT coalesce(fold, 'none') AS split, count(*) FILTER (gold = pred) AS k, count(*) AS n FROM {_L} WHERE pred IS NOT NULL GROUP BY 1)""")
_add("wilson_ci", lambda s, d: E.accuracy(_labels(s, d), ["encoded_by"], _right()), f"""
SELECT encoded_by, k, n, round(k / n, 9) AS accuracy, {_WILSON} FROM (SELECT encoded_by, count(*) FILTER (gold = pred) AS k, count(*) AS n FROM {_L} GROUP BY 1)""")
_add("agreement_confusion", lambda s, d: E.agreement(_labels(s, d).withColumn("other", F.when(F.col("label_confidence").isNotNull(), F.col("gold"))), "pred", "other", "gold"), f"""
SELECT coalesce(pred = CASE WHEN label_confidence IS NOT NULL THEN gold END, false) AS agree, count(*) AS n, count(*) FILTER (pred = gold) AS "right" FROM {_L} GROUP BY 1""")
_pairs = lambda s, d: E.discordance(_labels(s, d), F.col("pred") == F.col("gold"), F.col("label_confidence") == "High")
_add("mcnemar_pairs", _pairs, f"""
SELECT count(*) FILTER (coalesce(pred = gold, false) AND NOT coalesce(label_confidence = 'High', false)) AS only_a, count(*) FILTER (NOT coalesce(pred = gold, false) AND coalesce(label_confidence = 'High', false)) AS only_b,
count(*) FILTER (coalesce(pred = gold, false) AND coalesce(label_confidence = 'High', false)) AS "both", count(*) FILTER (NOT coalesce(pred = gold, false) AND NOT coalesce(label_confidence = 'High', false)) AS neither FROM {_L}""")
_add("mcnemar_tests", lambda s, d: _pairs(s, d).select(E.mcnemar_exact("only_a", "only_b").alias("exact"), E.mcnemar_corrected(F.col("only_a"), F.col("only_b"))[0].alias("chi"), E.mcnemar_corrected(F.col("only_a"), F.col("only_b"))[1].alias("p")))
_P = lambda s, d: table(s, d, "encoder_label").filter("encoder_code IS NOT NULL").groupBy("encoder_code").agg(F.round(1 / F.count("*"), 9).alias("p"))
_add("holm_adjust", lambda s, d: E.holm(_P(s, d), "p", "encoder_code").withColumn("holm", F.round("holm", 9)), """
WITH p AS (SELECT encoder_code, round(1 / count(*), 9) AS p FROM encoder_label WHERE encoder_code IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, encoder_code) AS k, count(*) OVER () AS m FROM p)
SELECT encoder_code, p, round(least(max((m - k + 1) * p) OVER (ORDER BY p, encoder_code ROWS UNBOUNDED PRECEDING), 1.0), 9) AS holm FROM r""")
_PRF = f"""WITH c AS (SELECT gold AS g, pred AS p, count(*) AS n FROM {_L} GROUP BY ALL),
s AS (SELECT g AS class, n AS gold, 0 AS said, CASE WHEN g = p THEN n ELSE 0 END AS hit FROM c UNION ALL SELECT p, 0, n, 0 FROM c WHERE p IS NOT NULL),
t AS (SELECT class, CAST(sum(gold) AS BIGINT) AS gold, sum(said) AS said, sum(hit) AS hit FROM s GROUP BY class),
f AS (SELECT class, gold AS support, round(CASE WHEN said > 0 THEN hit / said ELSE 0 END, 9) AS "precision", round(CASE WHEN gold > 0 THEN hit / gold ELSE 0 END, 9) AS recall, round(CASE WHEN gold + said > 0 THEN 2 * hit / (gold + said) ELSE 0 END, 9) AS f1 FROM t)"""
_add("prf_per_class", lambda s, d: E.per_class(_labels(s, d), "gold", "pred"), f'{_PRF} SELECT class, support, "precision", recall, f1 FROM f')
_add("prf_averages", lambda s, d: E.averages(E.per_class(_labels(s, d), "gold", "pred")), f"""{_PRF}
SELECT round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum("precision" * support) / sum(support), 6) AS weighted_precision,
round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")


def _groups(s, d):
    ref = table(s, d, "incident_type_ref").select(F.lower("type_name").alias("type"), F.col("category_group").alias("group"))
    both = _labels(s, d).join(F.broadcast(ref.select(F.col("type").alias("gold"), F.col("group").alias("gold_group"))), "gold", "left").join(F.broadcast(ref.select(F.col("type").alias("pred"), F.col("group").alias("pred_group"))), "pred", "left")
    return both.select(F.coalesce("gold_group", F.lit("Catch-all")).alias("gold"), F.coalesce("pred_group", F.lit("Catch-all")).alias("pred"))


_G = f"(SELECT coalesce(a.category_group, 'Catch-all') AS gold, coalesce(b.category_group, 'Catch-all') AS pred FROM {_L} l LEFT JOIN incident_type_ref a ON lower(a.type_name) = gold LEFT JOIN incident_type_ref b ON lower(b.type_name) = pred)"
_add("group_prf", lambda s, d: E.per_class(_groups(s, d), "gold", "pred"), _PRF.replace(_L, _G) + ' SELECT class, support, "precision", recall, f1 FROM f')
_add("confusion_dense", lambda s, d: E.confusion(_groups(s, d), "gold", "pred", "Catch-all"), f"""
WITH c AS (SELECT gold, pred AS predicted, count(*) AS n FROM {_G} GROUP BY ALL), k AS (SELECT gold AS c FROM c UNION SELECT predicted FROM c)
SELECT a.c AS gold, b.c AS predicted, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.gold = a.c AND c.predicted = b.c""")
_add("calibration_bins", lambda s, d: E.calibration(_rated(s, d), "qa_mean_conf", _right()), f"""
SELECT CAST(greatest(ceil(qa_mean_conf * 5) - 1, 0) AS INT) AS bin, count(*) AS n, round(avg(qa_mean_conf), 9) AS confidence, round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy
FROM {_L} WHERE pred IS NOT NULL AND qa_mean_conf BETWEEN 0 AND 1 GROUP BY 1""")
_add("roc_auc", lambda s, d: E.auc(table(s, d, "events"), "value", F.col("event_type") == "purchase"), """
WITH p AS (SELECT value, count(*) FILTER (event_type = 'purchase') AS tp, count(*) FILTER (event_type <> 'purchase') AS fp FROM events WHERE value IS NOT NULL GROUP BY 1),
r AS (SELECT *, sum(tp) OVER (ORDER BY value DESC) AS ctp FROM p)
SELECT round(sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)), 9) AS auc, CAST(sum(tp) AS BIGINT) AS positives, CAST(sum(fp) AS BIGINT) AS negatives FROM r""")
_add("latency_percentiles", lambda s, d: E.percentiles(table(s, d, "events"), ["event_type"], "value"), """
SELECT event_type, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY 1""")
_add("mean_confidence", lambda s, d: table(s, d, "scan_blotter").groupBy("batch_number").agg(F.round(F.coalesce(F.avg(F.when(F.col("qa_mean_conf") > 0, F.col("qa_mean_conf"))), F.lit(0.0)), 4).alias("conf")), """
SELECT batch_number, round(coalesce(avg(qa_mean_conf) FILTER (qa_mean_conf > 0), 0), 4) AS conf FROM scan_blotter GROUP BY 1""")
_add("field_accuracy", lambda s, d: E.field_scores(table(s, d, "scan_blotter"), {"type": ("second_encoder_label", "incident_type"), "day": ("incident_date", "date_as_written"), "encoder": ("second_encoder", "encoded_by")}), """
WITH f AS (SELECT unnest(['type', 'day', 'encoder']) AS field, trim(upper(unnest([second_encoder_label, incident_date, second_encoder]))) AS said, trim(upper(unnest([incident_type, date_as_written, encoded_by]))) AS gold FROM scan_blotter)
SELECT field, count(*) AS n, round(avg(CASE WHEN said = gold THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM f WHERE gold <> '' GROUP BY 1""")
_add("rare_types_folded", lambda s, d: E.fold_rare(_labels(s, d), "gold", 60, "others").groupBy("gold").agg(F.count("*").alias("n")), f"""
WITH c AS (SELECT gold, count(*) AS n FROM {_L} GROUP BY 1) SELECT CASE WHEN n >= 60 THEN gold ELSE 'others' END AS gold, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
_add("stratified_split", lambda s, d: E.stratified_split(_labels(s, d), "record_id", "gold").groupBy("gold", "split").agg(F.count("*").alias("n")))
_add("bootstrap_ci", lambda s, d: E.bootstrap(_rated(s, d).withColumn("ok", _right()), "ok"))
_add("top_confusions", lambda s, d: _rated(s, d).filter("gold <> pred").groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(10), f"""
SELECT gold, pred, count(*) AS n FROM {_L} WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 10""")
_add("corpus_ratio", lambda s, d: table(s, d, "scan_blotter").filter("include_in_ml").agg(F.count_if(F.col("label_source") == "encoder").alias("typed"), F.count_if(F.col("label_source") != "encoder").alias("suggested")).withColumn("ratio", F.when(F.col("typed") > 0, F.round(F.col("suggested") / F.col("typed"), 3))), """
SELECT count(*) FILTER (label_source = 'encoder') AS typed, count(*) FILTER (label_source <> 'encoder') AS suggested, round(count(*) FILTER (label_source <> 'encoder') / nullif(count(*) FILTER (label_source = 'encoder'), 0), 3) AS ratio FROM scan_blotter WHERE include_in_ml""")
_add("best_model", lambda s, d: _rated(s, d).groupBy("encoded_by").agg(F.avg(F.when(_right(), 1.0).otherwise(0.0)).alias("a"), F.count("*").alias("n")).agg(F.max_by("encoded_by", F.struct(F.round("a", 9), "n", "encoded_by")).alias("best")), f"""
SELECT encoded_by AS best FROM {_L} WHERE pred IS NOT NULL GROUP BY 1 ORDER BY round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0 END), 9) DESC, count(*) DESC, encoded_by DESC LIMIT 1""")
_add("status_key_counts", lambda s, d: table(s, d, "audit_log").groupBy(F.regexp_extract("action_name", "^([^:(_]*)", 1).alias("key"), "outcome").agg(F.count("*").alias("n")), "SELECT regexp_extract(action_name, '^([^:(_]*)', 1) AS key, outcome, count(*) AS n FROM audit_log GROUP BY ALL")
