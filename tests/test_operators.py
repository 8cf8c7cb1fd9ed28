"""Operators on small rows: ties, NULLs, empty tables, hot keys."""

import math

import pytest
from pyspark.sql import functions as F

from talasik.operators import analytics as A
from talasik.operators import correction, evaluation, forms, matching, privacy, skew

WORDS = "x string"


def test_hotspots_ties_and_empty(spark):
    df = spark.createDataFrame([("a", "t"), ("a", "s"), ("", "t"), (None, None)], "p string, c string")
    got = {r.place: (r.n_rows, r.severity, r.top_category) for r in A.hotspots(df, "p", "c").collect()}
    assert got == {"a": (2, "high", "s"), "Unknown": (2, "high", "t")}
    assert A.hotspots(df.limit(0), "p", "c").count() == 0


def test_risk_months(spark):
    df = spark.createDataFrame([("2024-01-05", "x"), ("2024-03-05", "x"), ("2024-03-06", "x"), ("2024-01-09", "y"), (None, "z")], "d string, c string")
    got = {r.category: r.direction for r in A.risk(df, "d", "c").collect()}
    assert got == {"x": "up", "y": "down", "z": "stable"}
    one = df.filter("d LIKE '2024-01%'")
    assert A.risk(one, "d", "c").count() == 0 and {r.direction for r in A.risk(one, "d", "c", True).collect()} == {"stable"}


def test_bad_day_filters_nothing(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-05 23:59:59' AS t UNION ALL SELECT TIMESTAMP_NTZ '2024-03-06 00:00:00'")
    assert A.on_day(df, "t", "no day").count() == 2 and A.on_day(df, "t", "2024-03-05").count() == 1


def test_skew_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    left = spark.range(3000).select(F.when(F.col("id") < 1200, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        mine, theirs = skew.skew_join(left, right, ["k"], how), left.join(right, ["k"], how)
        assert mine.count() == theirs.count() and mine.exceptAll(theirs.select(mine.columns)).count() == 0


def test_replays_across_buckets(spark):
    rows = [(1, "a", 0), (2, "a", 59), (3, "a", 3839), (4, "a", 3841), (5, "b", 3841)]
    df = spark.createDataFrame(rows, "id int, k string, s int").select("id", "k", F.timestamp_seconds("s").alias("t"))
    got = {r.id for r in matching.replays(df, ["k"], "t", "id", 60).filter("replay").collect()}
    assert got == {2, 4}


def test_drift_and_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (3, None)], "k int, v string")
    assert {(r.k, r.left, r.right) for r in matching.drift(a, b, "k", ["v"]).collect()} == {(2, "y", None)}
    assert matching.same_set(a, a.union(a)).first()["equal"] is True


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a "), (3, None), (4, None)], "id int, v string")
    assert sorted(r.id for r in matching.keep_first(df, F.lower(F.trim("v")), ["id"]).collect()) == [1, 3, 4]


def test_published_statistics(spark):
    df = spark.createDataFrame([(129, 188)], "k int, n int")
    low, high = df.select(*[c for c in evaluation.wilson(F.col("k"), F.col("n"))]).first()
    assert (round(low, 5), round(high, 5)) == (0.61667, 0.74821)
    pairs = spark.createDataFrame([(1, 9), (0, 0)], "b int, c int")
    assert [r[0] for r in pairs.select(evaluation.mcnemar_exact("b", "c")).collect()] == [22 / 1024, 1.0]
    chi = spark.createDataFrame([(35, 20)], "b int, c int").select(evaluation.mcnemar_corrected(F.col("b"), F.col("c"))[0]).first()[0]
    assert math.isclose(chi, 196 / 55)
    p = spark.createDataFrame([("a", 0.03), ("b", 0.01), ("c", 0.04), ("d", 0.02)], "h string, p double")
    assert [round(r.holm, 9) for r in evaluation.holm(p, "p", "h").orderBy("h").collect()] == [0.06, 0.04, 0.06, 0.06]


@pytest.mark.parametrize("n", [1, 2, 15, 40, 999, 4001])
def test_tails_of_many_trials_are_those_of_few(n, monkeypatch):
    from_top = sorted({m for m in (0, 1, 2, n // 10, n // 3, n // 2 - 20, n // 2 - 1, n // 2) if 0 <= m <= n // 2})
    whole = [sum(math.comb(n, i) for i in range(m + 1)) / 2**n for m in from_top]
    assert [evaluation.half_tail(n, m) for m in from_top] == whole
    monkeypatch.setattr(evaluation, "WHOLE_TRIALS", 0)
    for m, w in zip(from_top, whole):
        assert math.isclose(evaluation.half_tail(n, m), w, rel_tol=1e-11, abs_tol=1e-300), m


def test_mcnemar_of_millions_of_pairs(spark):
    pairs = spark.createDataFrame([(1_999_000, 2_001_000), (2_000_000, 2_000_000), (0, 3_000_000), (100_000, 100_001)], "b bigint, c bigint")
    p, same, none, near = [r[0] for r in pairs.select(evaluation.mcnemar_exact("b", "c")).collect()]
    # at this size the normal tail with continuity correction is right to about one in n
    assert math.isclose(p, math.erfc((2_000 - 1) / math.sqrt(4_000_000) / math.sqrt(2)), rel_tol=1e-5)
    assert (same, none) == (1.0, 0.0) and math.isclose(near, 1.0, rel_tol=1e-12)


def test_auc_and_calibration(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "s double, y boolean")
    assert evaluation.auc(df, "s", F.col("y")).first()["auc"] == pytest.approx(0.875)
    assert evaluation.auc(df.filter("y"), "s", F.col("y")).first()["auc"] is None
    bins = {r.bin: r.n for r in evaluation.calibration(spark.createDataFrame([(0.0, True), (0.2, True), (0.21, True), (1.0, False)], "s double, y boolean"), "s", F.col("y")).collect()}
    assert bins == {0: 2, 1: 1, 4: 1}


def test_bootstrap_and_empty(spark):
    df = spark.createDataFrame([(True,)] * 30 + [(False,)] * 10, "y boolean")
    r = evaluation.bootstrap(df, "y", 2000).first()
    assert r["mean"] == 0.75 and 0.55 < r["low"] < 0.75 < r["high"] < 0.9
    assert evaluation.bootstrap(df.limit(0), "y", 10).first()["mean"] is None


def test_per_class_declared(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None)], "g string, p string")
    classes = spark.createDataFrame([("c",)], "class string")
    got = {r["class"]: (r.support, r.f1) for r in evaluation.per_class(df, "g", "p", classes).collect()}
    assert got == {"a": (2, 0.666666667), "b": (1, 0.0), "c": (0, 0.0)}


def test_names_and_masks(spark):
    df = spark.createDataFrame([("Complainant: A B; Respondents: C D, E F", "a b met C and Riniedo"), (None, None), ("Complainant: Unknown", "unknown man")], "r string, t string")
    got = df.select(privacy.names_in(F.col("r")).alias("n"), privacy.masked(F.col("t"), privacy.names_in(F.col("r"))).alias("m")).collect()
    assert [r.n for r in got] == [["A B", "C D", "E F"], [], []]
    assert got[0].m.startswith("[PERSON] met") and got[1].m is None and got[2].m == "unknown man"


def test_encryption(spark):
    key = b"0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([("secret",), ("secret",), (None,), ("",)], WORDS)
    sealed = df.select(privacy.encrypted(F.col("x"), key, "x").alias("x")).collect()
    assert sealed[0].x != sealed[1].x and sealed[0].x.startswith("v1:") and sealed[2].x is None
    back = spark.createDataFrame(sealed, WORDS).select(privacy.decrypted(F.col("x"), key, "x")).collect()
    assert [r[0] for r in back] == ["secret", "secret", None, ""]
    with pytest.raises(Exception):
        spark.createDataFrame(sealed, WORDS).select(privacy.decrypted(F.col("x"), key, "y")).collect()


def test_digest_is_hmac(spark):
    import hashlib
    import hmac

    key = b"k" * 32
    got = spark.createDataFrame([(" Ab ñ ",), ("",), (None,)], WORDS).select(privacy.digest(F.col("x"), key)).collect()
    assert got[0][0] == hmac.new(key, "ab ñ".encode(), hashlib.sha256).hexdigest() and got[1][0] is None and got[2][0] is None


def test_forms_round_trip(spark):
    slots = {s: f"value {i}" for i, s in enumerate(forms.SLOTS)} | {"incident_summary": "line one\nPETSA: not a field", "witness": ""}
    df = spark.createDataFrame([(1, *slots.values())], "id int, " + ", ".join(f"{s} string" for s in slots))
    text = df.select("id", forms.rendered({s: F.col(s) for s in slots}).alias("t"))
    got = forms.parsed(text, "id", "t").first().asDict()
    assert {s: got[s] for s in slots} == slots
    assert forms.read_forms(None) == [] and forms.read_forms("no heading") == []


def test_corrections(spark):
    words = spark.createDataFrame([("PUROK", 9), ("PUNO", 5), ("NAKAKITA", 5)], "token string, freq bigint")
    df = spark.createDataFrame([("PUR0K at NAKAKlTA, KASAGUTAN",), (None,)], WORDS)
    got = {r.token: r.correction for r in correction.corrections(df, "x", words).collect()}
    assert got == {"NAKAKLTA": "NAKAKITA"}  # L is read for I; a digit is no letter's double, so PUR0K isn't sure enough


def test_fidelity_and_recall(spark):
    df = spark.createDataFrame([("NAGSADYA DITO SA BRGY HALL", "NAGSADYA DITO SA BARANGAY HALL NG BAYAN"), (None, "")], "a string, b string")
    assert [tuple(r[0]) for r in df.select(correction.fidelity("a", "b")).collect()] == [(0, 2, 1), (0, 0, 0)]
    got = spark.createDataFrame([("NAG5ADYA DITO", "NAGSADYA DITO")], "a string, b string").select(correction.recall("a", "b")).first()[0]
    assert tuple(got) == (0.5, 1.0, 2)


def test_reading_order(spark):
    boxes = spark.createDataFrame([("p", 50.0, 11.0, 10.0, "two"), ("p", 0.0, 10.0, 10.0, "one"), ("p", 0.0, 30.0, 10.0, "three"), ("q", 0.0, 0.0, 5.0, "x")], "page string, x double, y double, height double, text string")
    got = {r.text: (r.line_no, r.word_no) for r in matching.reading_order(boxes, "page").collect()}
    assert got == {"one": (1, 1), "two": (1, 2), "three": (2, 1), "x": (1, 1)}


def test_evolving_twice(spark):
    df = spark.createDataFrame([(1, "x")], "a int, extra string")
    once = matching.evolved(df, {"a": "bigint", "b": "string"})
    assert matching.evolved(once, {"a": "bigint", "b": "string"}).collect() == once.collect() and once.columns == ["a", "b", "extra"]


def test_brier(spark):
    df = spark.createDataFrame([([0.5, 0.5], 0), ([0.0, 1.0], 1)], "p array<double>, y int")
    r = evaluation.brier(df, "p", "y").first()
    assert r["brier"] == 0.25 and r["mean_p"] == 0.75 and math.isclose(r["log_loss"], math.log(2) / 2)


def test_row_ids_behind_an_exchange(spark):
    from talasik.session import with_row_ids

    df = with_row_ids(spark.range(500).repartition(3).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n")))
    both = df.alias("a").join(df.filter("k % 2 = 0").alias("b"), "uid")
    assert df.select("uid").distinct().count() == 50 and both.filter("a.k <> b.k").count() == 0 and both.count() == 25


def test_confusions_behind_a_header(spark):
    gold = "ang bata ay nagpunta sa malaking bahay"
    rows = [("BARANGAY HALL Page 1 ang b@ta ay nagpunta sa ma1aking bahay", gold), ("HEADER ang b@ta ay sa ma1aking bahay x", gold), (None, gold)]
    got = {(r.seen, r.meant): r.n for r in correction.confusions(spark.createDataFrame(rows, "r string, g string"), "r", "g").collect()}
    assert got == {("@", "a"): 2, ("1", "l"): 2}


def test_remarks_of_one_party(spark, tmp_path):
    from talasik.plans import textops

    rows = [(1, "si Ana Cruz at Ben Diaz", "Ana Cruz", None), (2, "si Ana Cruz at Ben Diaz", None, "Ben Diaz"), (3, "si Ana Cruz", None, None), (4, "si Ana Cruz at Ben Diaz", "Ana Cruz", "Ben Diaz")]
    spark.createDataFrame(rows, "record_id bigint, narrative_summary string, reporting_party string, respondent string").write.parquet(str(tmp_path / "scan_blotter.parquet"))
    assert sorted(map(tuple, textops.QUERIES["names_in_remarks"](spark, str(tmp_path)).collect())) == [(1, "Ana Cruz"), (2, "Ben Diaz"), (4, "Ana Cruz"), (4, "Ben Diaz")]
    got = {r.record_id: r.text for r in textops.QUERIES["mask_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: "si [PERSON] at Ben Diaz", 2: "si Ana Cruz at [PERSON]", 3: "si Ana Cruz", 4: "si [PERSON] at [PERSON]"}


def test_redacted_form(spark):
    slots = {"reporting_party": "Ana Cruz", "respondent": "Ben Diaz Jr.", "complainant_contact": "0917 555 1234", "complainant_address": "12 Mabini", "incident_summary": "Si ANA CRUZ at si Diaz, tawag sa 0917 555 1234. Umalis si Ben.", "action_taken": "Kinausap"}
    df = spark.range(1).select(privacy.redact_names(forms.rendered({k: F.lit(v) for k, v in slots.items()})).alias("t"), privacy.redact_names(F.lit(None).cast("string")).alias("none"), privacy.redact_names(F.lit("COMPLAINANT: Ana Cruz\nNARRATIVE: Cruz came")).alias("old"))
    got = df.first()
    assert "Si [REDACTED] at si [REDACTED], tawag sa [REDACTED]. Umalis si [REDACTED]." in got.t and "TIRAHAN     : [REDACTED]" in got.t and "Kinausap" in got.t
    assert not any(x in got.t for x in ("Ana", "Cruz", "Ben", "Diaz", "0917", "Mabini"))
    assert (got.none, got.old) == ("", "COMPLAINANT: [REDACTED]\nNARRATIVE: [REDACTED] came")
