"""Records on their way in, corrections, replays and pooled predictions against pairs of input and expected output."""

import datetime

import pytest
from pyspark.sql import functions as F

from talasik.functions import places
from talasik.operators import correction, evaluation, forms, intake, matching, privacy

TAXONOMY = [("Theft", ["theft", "nakaw"]), ("Malicious Mischief / Property Damage", ["property damage"]), ("Noise", ["noise"])]
OTHER = "Others / Miscellaneous"


def one(spark, columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_clean_records_both_schemas_and_twice(spark):
    rows = [(1, "May-06-2026", "2:30 PM", "PRK. 3", "bn-1 ", "Illegible", "For Blotter (Theft/Property Damage)", "MalabaÃ±as [cite: 1]"), (2, "Not Indicated", "", "", None, None, "Blotter", None)]
    df = spark.createDataFrame(rows, "id int, date string, time string, location_purok string, batch_number string, readability string, incident_type string, narrative string")
    groups = {"Theft": "Property"}
    once = intake.clean_records(df, TAXONOMY, OTHER, groups)
    got = {r.id: r for r in once.collect()}
    assert (got[1].date, got[1].time, got[1].location_purok, got[1].batch_number, got[1].readability) == ("2026-05-06", "14:30", "Purok 3", "BN-1", "unreadable")
    assert (got[1].incident_type_primary, got[1].incident_type_secondary, got[1].narrative, got[1].category_group) == ("Theft", "Malicious Mischief / Property Damage", "Malabañas", "Property")
    assert (got[2].date, got[2].time, got[2].location_purok, got[2].incident_type_primary, got[2].incident_type_secondary, got[2].readability) == (None, None, "Unspecified", OTHER, None, "readable")
    new = df.drop("incident_type").withColumn("incident_type_primary", F.lit("noise at night"))
    assert {(r.incident_type_primary, r.incident_type_secondary) for r in intake.clean_records(new, TAXONOMY, OTHER).collect()} == {("Noise", None)}
    assert {r.incident_type_primary for r in intake.clean_records(df.drop("incident_type"), TAXONOMY, OTHER).collect()} == {OTHER}
    again = {r.id: (r.date, r.time, r.location_purok, r.batch_number, r.readability, r.narrative) for r in intake.clean_records(once, TAXONOMY, OTHER, groups).collect()}
    assert again == {i: (r.date, r.time, r.location_purok, r.batch_number, r.readability, r.narrative) for i, r in got.items()}
    assert intake.clean_records(df.limit(0), TAXONOMY, OTHER).count() == 0


def test_import_of_plain_rows_and_of_rendered_forms(spark):
    slots = {"reporting_party": "Ana Cruz", "status": "Filed", "incident_summary": "Nawala ang aso\nPETSA: hindi alam", "action_taken": "Kinausap"}
    form = spark.range(1).select(forms.rendered({k: F.lit(v) for k, v in slots.items()})).first()[0]
    old = "BARANGAY BLOTTER ENTRY\n=====\nDATE OF INCIDENT  : 2023-01-02\nCOMPLAINANT       : Ben Diaz\nSTATUS            : (not stated on page)\n\nNARRATION OF FACTS\nMay ingay\nSTATUS: salita lang\n\nACTION TAKEN\nWala"
    rows = [(1, " plain ", None, "x"), (2, form, "Settled", None), (3, None, None, None), (4, old, " ", None)]
    got = {r.id: r for r in intake.import_rows(spark.createDataFrame(rows, "id int, narrative string, status string, remarks string")).collect()}
    assert (got[1].incident_summary, got[1].reporting_party, got[1].remarks) == ("plain", None, "x")
    assert (got[2].incident_summary, got[2].reporting_party, got[2].status, got[2].action_taken) == (slots["incident_summary"], "Ana Cruz", "Settled", "Kinausap")
    assert got[3].incident_summary == "" and (got[4].date, got[4].reporting_party, got[4].status, got[4].incident_summary, got[4].action_taken) == ("2023-01-02", "Ben Diaz", None, "May ingay\nSTATUS: salita lang", "Wala")


def test_slots(spark):
    got = one(spark, intake.normalized_slots({"date": F.lit("JAN. 3, 2026"), "time": F.lit("12:30 PM"), "location_purok": F.lit("  "), "status": F.lit(None).cast("string")}))
    assert (got["date"], got["time"], got["location_purok"], got["status"], got["witness"]) == ("2026-01-03", "12:30", "", "", "")
    filled = one(spark, intake.backfilled({"status": F.lit("mine"), "date": F.lit(" "), "time": F.lit("09:00")}, {"status": F.lit("Settled"), "date": F.lit("2026-01-03"), "time": F.lit("10:00"), "witness": F.lit("x")}))
    assert filled == {"status": "Settled", "date": "2026-01-03", "time": "09:00"}
    day, place = intake.record_columns({"date": F.lit("2026-01-01"), "date_reported": F.lit("2026-01-02"), "location_purok": F.lit("SIDE NG BAHAY KO"), "complainant_address": F.lit("Purok 4, Brgy. X")})
    assert one(spark, {"d": day, "p": place}) == {"d": "2026-01-02", "p": "Purok 4"}
    assert one(spark, {"m": intake.missing_slots({"date_reported": F.lit("2026-01-02"), "incident_summary": F.lit(" ")})})["m"] == ["location_purok", "incident_summary"]


@pytest.mark.parametrize("page, expected", [
    ("NOONG JAN. 3, 2026 GANAP NA 12:30 PM SA PUROK 4", ("2026-01-03", "12:30", "Purok 4", "", "")), ("PETSA 1-3-25", ("2025-01-03", "", "", "", "")), ("PETSA 25-12-24 F0R BLOTTER", ("2024-12-25", "", "", "Filed", "")),
    ("NAGKASUNDO SILA. FOR BLOTTER", ("", "", "", "Settled", "Settlement / confrontation held at barangay")), ("SCHEDULE SA NOVEMBER 23-2023 ORAS 9:00 AM", ("", "09:00", "", "For Hearing", "Scheduled: NOVEMBER 23-2023 TIME 9:00 AM")),
    ("walang nakasulat", ("", "", "", "", "")), ("", ("", "", "", "", "")),
])
def test_guessed_slots(spark, page, expected):
    got = spark.createDataFrame([(page,)], "t string").select(*[c.alias(k) for k, c in intake.guessed_slots(F.col("t")).items()]).first()
    assert tuple(got) == expected


def test_keys_and_zero_edit(spark):
    assert one(spark, {"a": intake.field_key("date", F.lit("1/2/2026"), F.lit("1 2 2026")), "b": intake.field_key("location_purok", F.lit("Purok 3, X"), F.lit("PUROK 3 X")), "c": intake.field_key("status", F.lit("x"), F.lit("X")), "d": intake.field_key("date", F.lit(None).cast("string"), F.lit(None).cast("string"))}) == {"a": "2026-01-02", "b": "Purok 3", "c": "X", "d": ""}
    df = spark.createDataFrame([("a", "a", "", "x"), ("a", "b", "c", "c"), ("", "", "", "")], "g string, s string, g2 string, s2 string")
    assert tuple(intake.zero_edit(df, {"one": (F.col("s"), F.col("g")), "two": (F.col("s2"), F.col("g2"))}).first()) == (3, 0.333333333)


def test_corrections_of_the_published_cases(spark, monkeypatch):
    words = spark.createDataFrame([(w, 5) for w in ("PUROK", "PUNO", "SAGUTAN", "IYON", "NAKAKITA", "PANINILIP")], "token string, freq bigint")
    df = spark.createDataFrame([("Punok KASAGUTAN iyong MAKAKITA 12345 PUROK",), (None,)], "x string")
    for block in (correction.BLOCK_WORDS, 2):
        monkeypatch.setattr(correction, "BLOCK_WORDS", block)
        assert {r.token: r.correction for r in correction.corrections(df, "x", words).collect()} == {"PUNOK": "PUROK"}
    assert correction.similarity("PUNOK", "PUROK") == 0.9 and correction.similarity("PUROK", "PUNOK") == 0.9 and correction.similarity("GUROK", "SUROK") == 0.8 and correction.similarity("SUROK", "GUROK") == 0.9


def test_corrector_account(spark):
    df = spark.createDataFrame([("ang PUNOK at bahay sa XYZAB dito", "ang PUROK at buhay sa dito"), (None, "x")], "r string, g string")
    fixes = spark.createDataFrame([("PUNOK", "PUROK"), ("BAHAY", "BAHALA"), ("XYZAB", "XYZAC")], "token string, correction string")
    got = correction.corrector_account(df, "r", "g", fixes).first().asDict()
    assert got == {"tokens": 6, "right_before": 4, "right_after": 5, "fixed": 1, "damage": 0, "wrong": 1, "unverified": 1, "precision": 0.5}


def test_replays_are_held_against_kept_rows(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(i, "a", at(50 * i)) for i in range(4)] + [(10, "b", at(0)), (11, "b", at(60)), (12, "b", at(61)), (13, "c", at(0)), (14, "c", at(0)), (15, None, at(0)), (16, None, at(1)), (17, "d", None)]
    rows += [(100 + i, "e", at(3800 + 40 * i)) for i in range(6)]  # across the edge of a bucket
    got = {r.id for r in matching.replays(spark.createDataFrame(rows, "id int, k string, t timestamp"), ["k"], "t", "id", 60).filter("replay").collect()}
    assert got == {1, 3, 11, 14, 101, 103, 105}


def test_pooled_predictions_are_checked(spark):
    gold, split = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, gold_type string"), spark.createDataFrame([("a", "dev"), ("b", "holdout"), ("c", "dev")], "k string, split string")
    said = spark.createDataFrame([("a", "x"), ("b", None)], "k string, pred_type string")
    assert [(r.k, r.split, r.m_right) for r in matching.pooled(gold, split, {"m": said}, "k").orderBy("k").collect()] == [("a", "dev", True), ("b", "holdout", False)]
    for bad in ((gold, split.filter("k = 'a'"), said), (gold, split, said.limit(1)), (gold, split, said.union(said)), (gold.union(gold), split, said)):
        with pytest.raises(ValueError):
            matching.pooled(bad[0], bad[1], {"m": bad[2]}, "k")


def test_areas_in_ranges(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("s"), (F.col("id") % 5 < 2).alias("y"))
    assert {evaluation.auc(df, "s", F.col("y"), b).first()["auc"] for b in (1, 7, 64)}.__len__() == 1
    p = evaluation.percentiles(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 7.0)] * 5 + [(None, 1.0)], "g string, v double"), ["g"], "v")
    assert {r.g: (r.p50, r.p95, r.most) for r in p.collect()} == {"a": (2.5, 3.85, 4.0), "b": (7.0, 7.0, 7.0), None: (1.0, 1.0, 1.0)}
    same = spark.createDataFrame([(True, False)] * 30 + [(True, True)] * 60 + [(False, True)] * 10, "a boolean, b boolean")
    r = evaluation.paired_bootstrap(same, "a", "b").first()
    assert r["difference"] == 0.2 and 0.05 < r["low"] < 0.2 < r["high"] < 0.35


@pytest.mark.parametrize("text, zone", [("5/0 Purok 4, Brgy. X", "Purok 4"), ("PUROK I, x", "Purok 1"), ("PUROK VILLASOL", None), ("Bayad P500", None), ("prk#4b", "Purok 4B"), ("P-7 a", "Purok 7A"), ("purok ng bayan, purok iv", "Purok 4"), ("purok 4bc", None), ("purok xi", None), (None, None)])
def test_zones(spark, text, zone):
    assert spark.createDataFrame([(text,)], "x string").select(places.zone_number(F.col("x"))).first()[0] == zone


def test_gazetteer(spark):
    names = spark.createDataFrame([("Villasol Subdivision",), ("Oregon Street",)], "name string")
    aliases = spark.createDataFrame([("villasol", "Villasol Subdivision"), ("brgy office", None)], "alias string, target string")
    g = places.gazetteer(names, "name", aliases, spark.createDataFrame([("Kabila",)], "name string"), "Outside")
    typed = ["4-19 COLORADO VILLASOL", "#2040 Oregon St.", "BRGY OFFICE", "Barangay Kabila", "tabi ng ilog", "N/A", "56-A Oregon Street", None]
    got = {r.x: r.canonical_place for r in places.canonical_places(spark.createDataFrame([(t,) for t in typed], "x string"), "x", g).collect()}
    assert got == {typed[0]: "Villasol Subdivision", typed[1]: "Oregon Street", typed[2]: None, typed[3]: "Outside", typed[4]: "Tabi Ng Ilog", typed[5]: None, typed[6]: "Oregon Street", None: None}


def test_no_key_in_the_plan(spark):
    key = b"0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([("x",)], "t string")
    for column in (privacy.encrypted(F.col("t"), key, "t"), privacy.digest(F.col("t"), key), privacy.decrypted(F.col("t"), key, "t")):
        plan = df.select(column)._jdf.queryExecution().toString()
        assert key.hex().lower() not in plan.lower() and key.decode() not in plan
