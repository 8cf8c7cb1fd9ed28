"""Text functions as native column expressions; pandas UDFs only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of Tagalog and English (fixed values).
TAGALOG_STOPS = (
    "ako ikaw ka siya kami tayo kayo sila ang ng nang sa na at ay mga ito iyon iyan dito doon diyan rito riyan roon kung kapag dahil para upang hindi wala meron mayroon may rin din lang "
    "lamang po opo ba naman pa pala kasi ni nina si sina kay kina akin iyo kanya amin inyo kanila atin sino ano saan kailan paano bakit alin yung yun"
).split()
ENGLISH_STOPS = (
    "a an the and or but if in on at to for of with by from is was are were be been being have has had do does did will would could should may might shall can need that this these those "
    "it its they them their we our you your he she his her i me my not no nor so yet both either each any all there here when where who what which how then than too very just also up out "
    "over after before between into through during about against as such other more some"
).split()


def strip(column: Column) -> Column:
    """Without white space of any kind at either end (Spark's trim removes spaces only)."""
    return F.regexp_replace(column, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def squeeze(column: Column) -> Column:
    """Runs of white space become one space, none at either end."""
    return strip(F.regexp_replace(column, r"(?U)[\s\p{Z}]+", " "))


def fix_mojibake(column: Column) -> Column:
    """UTF-8 read as Latin-1 is read again; text that isn't such stays."""
    again = F.try_validate_utf8(F.when(column.rlike(r"^[\x00-ÿ]*$"), F.encode(column, "ISO-8859-1")).cast("string"))
    return F.coalesce(again, column)


def strip_citations(column: Column) -> Column:
    """Without [cite: ...] marks, white space squeezed."""
    return squeeze(F.regexp_replace(column, r"(?i)\[cite:[^\]]*\]", ""))


def split_labels(column: Column) -> Column:
    """Parts between bars, trimmed, blanks left out; NULL gives none."""
    return F.coalesce(F.filter(F.transform(F.split(column, r"\|"), strip), lambda x: x != ""), F.array().cast("array<string>"))


def join_labels(column: Column) -> Column:
    return F.concat_ws("|", column)


def unwrap_lines(column: Column) -> Column:
    """A hyphen keeps its place at a line end, single line ends become spaces, blank lines stay."""
    joined = F.regexp_replace(column, r"-[ \t]*\n(?!\s*\n)[ \t]*", "-")
    return F.regexp_replace(joined, r"(?<!\n)\n(?!\n)", " ")


def tokens(column: Column) -> Column:
    """Lower-case words; what is neither letter, digit nor _ separates them."""
    return F.filter(F.split(F.regexp_replace(F.lower(column), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")


def without_stops(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(_any_of({*TAGALOG_STOPS, *ENGLISH_STOPS})))


def _any_of(words) -> str:
    """A pattern, compiled once, of one of the words and nothing else."""
    return "^(?:" + "|".join(sorted(words)) + ")$"


def clean(column: Column) -> Column:
    """Words that are no stop words, joined by spaces."""
    return F.concat_ws(" ", without_stops(tokens(column)))


def code_switch(column: Column, least: int = 2) -> Column:
    """mixed, tagalog, english or other by hits of each list of stop words."""
    words = tokens(column)
    tl = F.size(F.filter(words, lambda w: w.rlike(_any_of(TAGALOG_STOPS))))
    en = F.size(F.filter(words, lambda w: w.rlike(_any_of(ENGLISH_STOPS))))
    return F.when((tl >= least) & (en >= least), "mixed").when(tl >= least, "tagalog").when(en >= least, "english").otherwise("other")


def _folded(text: str | None) -> str:
    text = unicodedata.normalize("NFKC", text or "").upper()
    return " ".join(regex.sub(r"[^A-Z0-9ÑÜ]+", " ", text).split())


def _folded_all(text: pd.Series) -> pd.Series:
    return text.map(_folded)


def folded(column: Column) -> Column:
    """Compatibility form in upper case with only A-Z, digits, Ñ and Ü; '' for NULL."""
    return F.pandas_udf(_folded_all, "string")(column)


def character_error(read: Column, gold: Column) -> Column:
    """Edit distance over the gold's length; an empty gold counts 1 unless nothing was read."""
    return F.when(F.length(gold) == 0, F.when(F.length(read) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(read, gold) / F.length(gold))


def _word_distance(a: list[str], b: list[str]) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _word_errors(read: pd.Series, gold: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(read, gold):
        x, y = (a or "").split(), (b or "").split()
        out.append(_word_distance(x, y) / len(y) if y else float(bool(x)))
    return pd.Series(out)


def word_error(read: str, gold: str) -> Column:
    """Word edit distance over the gold's words; an empty gold counts 1 unless nothing was read."""
    return F.pandas_udf(_word_errors, "double")(read, gold)


def match_case(source: Column, replacement: Column) -> Column:
    """The replacement in the source's case: mostly upper, capitalised, else lower."""
    upper = F.length(F.regexp_replace(source, r"[^\p{Lu}]", "")) * 2 > F.length(F.regexp_replace(source, r"[^\p{L}]", ""))
    return F.when(upper, F.upper(replacement)).when(source.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(replacement, 1, 1)), F.lower(F.substr(replacement, F.lit(2))))).otherwise(F.lower(replacement))
