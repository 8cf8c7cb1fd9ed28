"""Functions against pairs of input and expected output, NULLs and blanks among them."""

import datetime

import pytest
from pyspark.sql import functions as F

from talasik.functions import dates, places, text


def values(spark, column, inputs, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[1] for r in rows.select("i", column(F.col("x"))).orderBy("i").collect()]


@pytest.mark.parametrize("column, pairs", [
    (text.fix_mojibake, {"PiÃ±ahan": "Piñahan", "Piñahan": "Piñahan", "plain": "plain", "₱5": "₱5", None: None, "": ""}),
    (text.strip_citations, {"Cash Collection[cite: 19, 20]": "Cash Collection", "a  [CITE:1] b": "a b", None: None}),
    (text.strip, {"\t a b \n": "a b", "": "", None: None}),
    (text.clean, {"Loud Music at NIGHT!!": "loud music night", None: "", "ang sa": ""}),
    (text.unwrap_lines, {"mag-\nusap\nsila\n\nBago": "mag-usap sila\n\nBago", None: None}),
    (dates.normalize_date, {"May-06-2026": "2026-05-06", "Nov. 15, 2023": "2023-11-15", "01-17-2026": "2026-01-17", "2026-01-17": "2026-01-17", "13/02/2026": "2026-02-13", "Not Indicated": None, "": None, None: None, "soon": None}),
    (dates.normalize_time, {"2:30 PM": "14:30", "12:00 AM": "00:00", "12:15 pm": "12:15", "0930": "09:30", "99:99": "99:99", "": None, None: None, "noon": None}),
    (dates.month_of, {"2023-01-02": 1, "bad": 0, None: 0}),
    (dates.weekday_of, {"2023-01-02": 0, "2023-01-08": 6, "bad": -1, None: -1}),
    (dates.period_of, {"06:00": "Morning", "12:00": "Afternoon", "18:00": "Evening", "22:00": "Late Night", "05:59": "Late Night", "25:00": "Unknown", None: "Unknown"}),
    (places.zone_number, {"PRK. 3": "Purok 3", "PUROK I, COMPOUND": "Purok 1", "purok 4b": "Purok 4B", "PUROK VILLASOL": None, "Bayad P500": None, None: None}),
    (places.zone_or_segment, {"5/0 Purok 4, Brgy. X": "Purok 4", "Batibot, Brgy. X": "Batibot", "": "Unspecified", None: "Unspecified"}),
    (places.place_key, {"#2040 Oregon St.": "oregon st", "2040 OREGON STREET": "oregon st", None: ""}),
])
def test_pairs(spark, column, pairs):
    assert values(spark, column, list(pairs)) == list(pairs.values())


def test_labels(spark):
    assert values(spark, text.split_labels, [" a | b||", None, ""]) == [["a", "b"], [], []]


def test_errors(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("x", ""), ("a b", "a c d")], "a string, b string")
    got = df.select(text.character_error(F.col("a"), F.col("b")).alias("c"), text.word_error("a", "b").alias("w")).collect()
    assert [round(r.c, 4) for r in got] == [0.3333, 0.0, 1.0, 0.6]
    assert [round(r.w, 4) for r in got] == [1.0, 0.0, 1.0, 0.6667]


def test_polygon(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (None, 0.5)], "x double, y double")
    inside = places.inside_polygon(df, "x", "y", [(0, 0), (1, 0), (1, 1), (0, 1)])
    assert [r[0] for r in df.select(inside).collect()] == [True, False, False]


def test_places(spark):
    gazetteer = spark.createDataFrame([("villasol subd", "Villasol Subdivision"), ("brgy x", None), ("sol", "Sol")], "key string, target string")
    df = spark.createDataFrame([(1, "4-19 Colorado Villasol Subd"), (2, "Brgy. X"), (3, "PRK 2"), (4, None), (5, "Somewhere Else"), (6, "n/a")], "id int, place string")
    got = {r.id: r.canonical_place for r in places.canonical_places(df, "place", gazetteer).collect()}
    assert got == {1: "Villasol Subdivision", 2: None, 3: "Purok 2", 4: None, 5: "Somewhere Else", 6: None}


def test_fallback_dates(spark):
    got = values(spark, lambda c: dates.normalize_date(c, fallback=True), ["20260117", "x", None])
    assert got[0] == datetime.date(2026, 1, 17).isoformat() and got[1:] == [None, None]
