"""The way of a record in: headers, slots, what a page says by itself, and one cleaning for every path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talasik.functions.dates import normalize_date, normalize_time
from talasik.functions.places import zone_number, zone_or_segment
from talasik.functions.text import fix_mojibake, join_labels, strip, strip_citations
from talasik.operators.forms import SLOTS, first_form
from talasik.operators.matching import keyword_categories

#: Columns of free text that cleaning goes over (fixed values).
TEXT_COLUMNS = ("narrative", "action_taken", "status", "remarks", "source_file_page", "persons_involved_masked", "encoded_by", "incident_summary", "reporting_party", "respondent")
#: Columns the narration may stand in, best first (fixed values).
SUMMARY_COLUMNS = ("incident_summary", "extracted_summary", "narration_of_facts", "narrative_summary", "narrative_summary_raw_pii", "narrative")
#: Slots that hold days and times; slots a rule on the page outranks; slots a record needs (fixed values).
DAY_SLOTS, TIME_SLOTS = ("date", "date_reported", "statement_date"), ("time", "statement_time")
RULED_SLOTS = ("status", "action_taken")
REQUIRED_SLOTS = ("date", "location_purok", "incident_summary")

_blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
_first = lambda *cs: F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs], F.lit(""))


def tidy(column: Column) -> Column:
    """Without decoding errors, citations and white space around."""
    return strip(strip_citations(fix_mojibake(column)))


def readability_grade(column: Column) -> Column:
    text = F.lower(column)
    return F.when(text.rlike("unreadable|illegible"), "unreadable").when(text.rlike("partial|moderate"), "partial").otherwise("readable")


def clean_records(df: DataFrame, taxonomy: list[tuple[str, list[str]]], fallback: str, groups: dict[str, str] | None = None) -> DataFrame:
    """Every column of an import made regular; running it on its own result changes nothing.

    With incident_type_primary, each type column is mapped by itself; with incident_type alone it gives both and is
    rewritten; with neither the fallback counts. `groups` maps types to category_group. Columns not named here stay.
    """
    have = set(df.columns)
    kind = lambda c, k=0: keyword_categories(F.col(c), taxonomy, fallback)[k]
    out = {c: F.when(F.col(c) != "", tidy(F.col(c))).otherwise(F.col(c)) for c in TEXT_COLUMNS if c in have}
    told = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out |= {"date": normalize_date(told("date")), "time": normalize_time(told("time")), "location_purok": zone_or_segment(F.coalesce(told("location_purok"), F.lit("")))}
    out |= {"batch_number": F.nullif(F.upper(strip(told("batch_number"))), F.lit("")), "readability": readability_grade(told("readability"))}
    empty = F.lit(None).cast("string")
    old = kind("incident_type") if "incident_type" in have else F.lit(fallback)
    old_second = kind("incident_type", 1) if "incident_type" in have else empty
    if "incident_type_primary" in have:
        new = F.col("incident_type_primary") != ""
        out["incident_type_primary"] = F.when(new, kind("incident_type_primary")).otherwise(old)
        second = F.when(F.col("incident_type_secondary") != "", kind("incident_type_secondary")) if "incident_type_secondary" in have else empty
        out["incident_type_secondary"] = F.when(new, second).otherwise(old_second)
    else:
        out |= {"incident_type_primary": old, "incident_type_secondary": old_second}
        if "incident_type" in have:
            out["incident_type"] = join_labels(F.array_compact(F.array(old, old_second)))
    cleaned = df.withColumns(out)
    if groups is None:
        return cleaned
    of = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return cleaned.withColumn("category_group", F.coalesce(F.try_element_at(of, F.col("incident_type_primary")), F.lit("Catch-all")))


def import_rows(df: DataFrame) -> DataFrame:
    """Rows under canonical headers as records: stripped values, the narration from the first column that has one.

    A narration that is itself a rendered form gives its slots to the columns the row leaves blank and its story as
    incident_summary. Every slot becomes a column.
    """
    have = set(df.columns)
    summary = _first(*[F.col(c) for c in SUMMARY_COLUMNS if c in have])
    form = first_form(summary)
    is_form = form.isNotNull()
    out = {c: F.nullif(strip(F.col(c)), F.lit("")) for c, t in df.dtypes if t == "string"}
    for s in SLOTS:
        if s != "incident_summary":
            own = out.get(s, F.lit(None).cast("string"))
            out[s] = F.coalesce(own, F.when(is_form, F.nullif(form[s], F.lit(""))))
    out["incident_summary"] = F.when(is_form, form["incident_summary"]).otherwise(summary)
    return df.withColumns(out)


def normalized_slots(slots: dict[str, Column]) -> dict[str, Column]:
    """Every slot as text, days and times in their ISO form ('' where unreadable), a place only if the page names one."""
    text = {s: strip(F.coalesce(slots.get(s, F.lit(None)).cast("string"), F.lit(""))) for s in SLOTS}
    text |= {s: F.coalesce(normalize_date(text[s]), F.lit("")) for s in DAY_SLOTS}
    text |= {s: F.coalesce(normalize_time(text[s]), F.lit("")) for s in TIME_SLOTS}
    place = text["location_purok"]
    text["location_purok"] = F.when(place == "", "").otherwise(F.regexp_replace(zone_or_segment(place), "^Unspecified$", ""))
    return text


def backfilled(slots: dict[str, Column], fallback: dict[str, Column]) -> dict[str, Column]:
    """Blank slots from the fallback; of RULED_SLOTS the fallback counts wherever it says something."""
    def one(s: str) -> Column:
        if s not in fallback:
            return slots[s]
        other = fallback[s]
        return F.when(~_blank(other) & (F.lit(s in RULED_SLOTS) | _blank(slots[s])), other).otherwise(slots[s])

    return {s: one(s) for s in slots}


def record_columns(slots: dict[str, Column]) -> tuple[Column, Column]:
    """Day and place of the record: when it was reported, else when it happened; the numbered zone of the place or of a party's address, else the place as written."""
    text = lambda s: F.coalesce(slots.get(s, F.lit(None)).cast("string"), F.lit(""))
    zone = F.coalesce(*[zone_number(text(s)) for s in ("location_purok", "complainant_address", "respondent_address")])
    return _first(text("date_reported"), text("date")), F.coalesce(zone, strip(text("location_purok")))


def missing_slots(slots: dict[str, Column]) -> Column:
    """Required slots that stay blank once the record's columns are filled."""
    day, place = record_columns(slots)
    have = {**slots, "date": day, "location_purok": place}
    return F.array_compact(F.array(*[F.when(_blank(have.get(s, F.lit(None)).cast("string")), F.lit(s)) for s in REQUIRED_SLOTS]))


MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_WORDED = r"(?i)\b(" + "|".join(MONTHS) + r")[a-z]*\.?\s+(\d{1,2}){gap}(\d{4})\b"
_NUMBERED = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\b"
_CLOCK = r"(?i)\b(\d{1,2})[:.](\d{2})\s*([ap])?"
_CLOCK_TEXT = r"(?i)\b(\d{1,2}[:.]\d{2}(?:\s*[ap]\.?m\.?|\b))"
#: What a page says of its outcome, the newer fact first (fixed values).
SETTLED, HEARING, FILED = r"(?i)kasunduan|nagkasundo|settlement|settled", r"(?i)schedule|takda", r"(?i)\bf[o0]r[\s.:-]*bl[o0][ti1]{1,2}[eo]r|(?:ipa|pa|ma)[\s-]*bl[o0][ti1]{1,2}[eo]r|\bbl[o0][ti1]{1,2}[eo]r\b"
#: Characters after the word for a hearing in which its day and time are looked for.
AHEAD = 60


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.when(month.between(1, 12) & day.between(1, 31), F.format_string("%04d-%02d-%02d", year, month, day))


def guessed_slots(page: Column, places: list[str] | None = None) -> dict[str, Column]:
    """date_reported, time, location_purok, status and action_taken as a page states them; '' where it doesn't.

    A day in words outranks one in numbers, month first unless the first number can be none. `places` are looked for
    in any letter case where no numbered zone is named, the first of the list counting.
    """
    worded = _WORDED.replace("{gap}", ",?\\s+")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(F.regexp_extract(page, worded, 1))).cast("int")
    a, b, y = (_number(page, _NUMBERED, k) for k in (1, 2, 3))
    year = y + F.when(y < 100, 2000).otherwise(0)
    numbered = F.when(a <= 12, _ymd(year, a, b)).otherwise(_ymd(year, b, a))
    day = F.when(page.rlike(worded), F.format_string("%04d-%02d-%02d", _number(page, worded, 3), month, _number(page, worded, 2))).otherwise(numbered)
    hour, minute, half = _number(page, _CLOCK, 1), _number(page, _CLOCK, 2), F.lower(F.regexp_extract(page, _CLOCK, 3))
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    time = F.when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute))
    named = [F.when(F.contains(F.upper(page), F.lit(p.upper())), F.lit(p)) for p in places or ()]
    settled, hearing = page.rlike(SETTLED), page.rlike(HEARING)
    after = F.regexp_extract(page, rf"(?is)(?:schedule|takda)(.{{0,{AHEAD}}})", 1)
    spoken = F.regexp_extract(after, r"(?i)\b((?:" + "|".join(MONTHS) + r")[a-z]*\.?\s+\d{1,2}[\s,-]+\d{4})\b", 1)
    said_day = F.coalesce(F.nullif(spoken, F.lit("")), F.nullif(F.regexp_extract(after, r"\b(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})\b", 1), F.lit("")))
    said_time = F.nullif(strip(F.regexp_extract(after, _CLOCK_TEXT, 1)), F.lit(""))
    meeting = F.when(hearing, F.concat(F.lit("Scheduled: "), said_day, F.lit(" TIME "), said_time))
    return {
        "date_reported": F.coalesce(day, F.lit("")), "time": F.coalesce(time, F.lit("")), "location_purok": F.coalesce(zone_number(page), *named, F.lit("")),
        "status": F.when(settled, "Settled").when(hearing, "For Hearing").when(page.rlike(FILED), "Filed").otherwise(""),
        "action_taken": F.concat_ws(" ", F.when(settled, "Settlement / confrontation held at barangay"), meeting),
    }


def field_key(slot: str, value: Column, normal: Column) -> Column:
    """What two values of a slot are compared by: its day, time or numbered zone if it has one, else `normal`; '' for blanks."""
    read = {"date": normalize_date, "time": normalize_time, "location_purok": zone_number}.get(slot)
    return F.when(F.coalesce(normal, F.lit("")) == "", "").otherwise(F.coalesce(read(value) if read else F.lit(None), normal))


def zero_edit(df: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row: rows, and the share in which every slot with a gold key agrees; a row without any gold doesn't count as right."""
    told = [gold != "" for _, gold in keys.values()]
    agree = reduce(Column.__and__, [(gold == "") | (said == gold) for said, gold in keys.values()])
    right = agree & reduce(Column.__or__, told)
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 9).alias("zero_edit"))


def quality_bucket(column: Column) -> Column:
    """clean, degraded or unknown by the first word of a free remark on readability."""
    head = F.regexp_extract(F.lower(strip(column)), r"^([a-z]+)", 1)
    clean, degraded = ("good", "clear", "readable", "high", "excellent", "legible"), ("fair", "moderate", "partial", "poor", "low", "unreadable", "illegible", "bad", "faint")
    return F.when(head.isin(*clean), "clean").when(head.isin(*degraded), "degraded").otherwise("unknown")


def bridged(column: Column, bridge: dict[str, str]) -> Column:
    """A label under its present name; one without another stays."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in bridge.items() for x in kv]), column), column) if bridge else column


def confidence_label(column: Column) -> Column:
    """agree from .6, unverified from .4, else disagree; NULL counts as none."""
    return F.when(column >= 0.6, "agree").when(column >= 0.4, "unverified").otherwise("disagree")


def label_confidence(column: Column) -> Column:
    """The number a confidence word stands for: high .8, medium .5, low .3, else .5."""
    word = F.lower(strip(column))
    return F.when(word == "high", 0.8).when(word == "low", 0.3).otherwise(0.5)


def file_of_page(column: Column) -> Column:
    """The name of a file without '(page N)' behind it."""
    return strip(F.regexp_replace(column, r"(?i)\s*\(page\s+\d+\)\s*$", ""))
