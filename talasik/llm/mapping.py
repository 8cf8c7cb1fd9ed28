"""Freely typed values mapped to the entries of a reference list (problem 2).

The list, its shortened spellings and their symmetric deletes form a dictionary. A typed value is
cleaned, its deletes are looked up, and the candidates within the edit bound are ranked by weighted
Damerau-Levenshtein distance and then by how often the entry is written correctly in the data. Digits,
single letters and short words must agree exactly. Where a glossary is given, a value that is near no
spelling is looked up word by word: its words, abbreviations, initials and translations are mapped to
words of the list in the same way, and the entry with most of them is meant. What no entry fits is
reported with id 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talasik.operators.skew import skew_join

#: Up to so many entries the dictionary is sent to every executor; longer lists are joined by their deletes.
MAX_BROADCAST_ENTRIES = 20_000

#: Abbreviations and misspelt kinds of places (fixed values).
PLACE_WORDS = {
    "prk": "purok", "purk": "purok", "porok": "purok", "puruk": "purok", "pk": "purok", "subd": "subdivision", "cmpd": "compound", "comp": "compound",
    "hts": "heights", "mkt": "market", "elem": "elementary", "sch": "school", "term": "terminal", "ph": "phase", "reloc": "relocation", "rd": "road",
}
#: Words that stand for a kind when they begin the value (fixed values).
PLACE_FIRST = {"st": "sitio", "v": "villa", "p": "purok"}
#: Filipino and Spanish numerals (fixed values).
NUMERALS = {
    "isa": 1, "uno": 1, "dalawa": 2, "dos": 2, "tatlo": 3, "tres": 3, "apat": 4, "kuwatro": 4, "lima": 5, "singko": 5, "anim": 6, "sais": 6,
    "pito": 7, "siyete": 7, "walo": 8, "otso": 8, "siyam": 9, "nuwebe": 9, "sampu": 10, "diyes": 10, "onse": 11, "dose": 12,
    "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12,
}
#: Words of a place's name that writers leave out (fixed values).
PLACE_KINDS = frozenset({"sitio", "villa", "subdivision", "compound", "heights", "homes", "public", "site"})
#: Words around a place that say nothing of which one it is (fixed values).
PLACE_LEADS = frozenset({"sa", "bandang", "banda", "may", "loob", "tapat"})
#: Words of Filipino and other English words for the words a status may have (fixed values).
STATUS_WORDS = {
    "isinampa": "filed", "naisampa": "filed", "recorded": "filed", "naitala": "filed", "nagkasundo": "settled", "naayos": "settled", "nagkaayos": "settled", "ayos": "settled", "areglado": "settled",
    "pagdinig": "hearing", "didinggin": "hearing", "dinig": "hearing", "ibinasura": "dismissed", "iniurong": "withdrawn", "binawi": "withdrawn", "withdrew": "withdrawn", "pulis": "police",
    "pulisya": "police", "pnp": "police", "endorsed": "referred", "inilipat": "referred", "ipinasa": "referred", "uusapan": "mediation", "pamamagitan": "mediation", "sertipikado": "certified",
    "sarado": "closed", "isinara": "closed", "arkibo": "archived",
}
#: Words that say nothing of which entry is meant (fixed values).
FILLERS = frozenset("na po pa naka pinag may sa ang ng for fr to the of a case kaso complaint reklamo".split())


def letters(text: str) -> str:
    """Lower case without accents, with decoding errors and digits typed for letters undone."""
    try:
        text = text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    text = unicodedata.normalize("NFKD", text).replace("~", "")
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    text = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", text)
    return re.sub(r"(?<=[a-z])1(?=[a-z])", "i", text)


def words(text: str) -> list[str]:
    return re.findall(r"[a-z]+|\d+", text)


#: The name of the barangay after a place in it.
OWN = r"[,\s](?:brgy\.?|barangay)\s+(\w+)\W*$"


def own_name(typed: DataFrame) -> str:
    """The barangay that most values (column value) end with after a place; '' if none does. Ties go to the first by name."""
    said = F.regexp_extract(F.lower("value"), OWN, 1)
    top = typed.groupBy(said.alias("name")).agg(F.count("*").alias("n")).filter("name <> ''").orderBy(F.desc("n"), "name").first()
    return letters(top["name"]) if top else ""


@lru_cache(maxsize=100_000)
def place_forms(cell: str, own_place: str = "") -> tuple[str, ...]:
    """Cleaned spellings of a typed place, the likeliest first. `own_place`: the barangay, which adds nothing to a place in it."""
    text = re.sub(r"\([^)]*\)|\s-\s.*$", " ", letters(cell))
    if own_place:
        text = re.sub(rf"[,\s]+(?:brgy\.?|barangay)\s+{re.escape(own_place)}\s*$", "", text)
    text = re.sub(r"^\s*\d+\s*(?:/\s*[a-z0-9])?\s+(?=[a-z])", "", text)
    parts = [words(p) for p in text.split(",")]
    turned = [w for p in reversed(parts) for w in p] if len(parts) == 2 else None
    forms = []
    for own in ([w for p in parts for w in p], turned):
        if not own:
            continue
        while len(own) > 1 and own[0] in PLACE_LEADS:
            own = own[1:]
        if own[0] in PLACE_FIRST and len(own) > 1:
            own = [PLACE_FIRST[own[0]], *own[1:]]
        own = [PLACE_WORDS.get(w, w) for w in own]
        if own[0] == "purok":
            own = [str(NUMERALS[w]) if w in NUMERALS else w for w in own if w != "no"]
        forms.append(" ".join(own))
        if len(own) > 1 and own[-1] == own_place:
            forms.append(" ".join(own[:-1]))
    return tuple(dict.fromkeys(forms))


@lru_cache(maxsize=100_000)
def status_forms(cell: str) -> tuple[str, ...]:
    """Cleaned spellings of a typed status."""
    text = re.sub(r"\([^)]*\)|\b20\d\d\b", " ", letters(cell))
    text = re.sub(r"\bw/\s?", "with", text)
    return tuple(dict.fromkeys(f for f in (" ".join(words(text)),) if f))


def shortened(name: str, kinds: frozenset[str]) -> Iterator[str]:
    """The name with any of its kind words left out, if a word of its own is left."""
    own = words(letters(name))
    droppable = [i for i, w in enumerate(own) if w in kinds]
    for k in range(len(droppable) + 1):
        for gone in combinations(droppable, k):
            kept = [w for i, w in enumerate(own) if i not in gone]
            if any(len(w) > 3 for w in kept):
                yield " ".join(kept)


def strict(form: str) -> tuple[str, ...]:
    """The parts that must agree exactly: numbers and single letters."""
    return tuple(w for w in words(form) if w.isdigit() or len(w) == 1)


def bound(form: str) -> int:
    """Largest edit distance allowed: none below 5 letters, 1 below 9, else 2."""
    n = sum(c.isalpha() for c in form)
    return 0 if n < 5 else 1 if n < 9 else 2


def deletes(form: str, most: int) -> set[str]:
    """The form with up to `most` characters left out."""
    out, last = {form}, {form}
    for _ in range(most):
        last = {f[:i] + f[i + 1 :] for f in last for i in range(len(f))}
        out |= last
    return out


#: Letters taken for each other by ear or by eye (fixed values).
NEAR = frozenset({"ou", "ei", "ck", "fp", "bv", "il", "ao", "sz", "un"})


def distance(a: str, b: str, most: float = float("inf")) -> float:
    """Weighted Damerau-Levenshtein: near letters .6, doubled letters .5, neighbours swapped .8, all else 1.

    Beyond `most` the result is inf; then only places that cheaper edits reach are looked at, so long words take time by their length.
    """
    n, m = len(a), len(b)
    band = n + m if most == float("inf") else int(2 * most)
    if abs(n - m) > band:
        return float("inf")
    inf = float("inf")
    wide = [inf] * (m + 2)
    last, older = [float(j) if j <= band else inf for j in range(m + 1)], wide
    for i in range(1, n + 1):
        x = a[i - 1]
        row = wide[: m + 1] if m <= 200 else _Sparse(inf)
        lo, hi = max(1, i - band), min(m, i + band)
        drop = 0.5 if i > 1 and a[i - 2] == x else 1.0
        row[0] = float(i) if i <= band else inf
        least = row[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            best = last[j - 1] if x == y else last[j - 1] + (0.6 if x + y in NEAR or y + x in NEAR else 1.0)
            if (d := last[j] + drop) < best:
                best = d
            if (d := row[j - 1] + (0.5 if j > 1 and b[j - 2] == y else 1.0)) < best:
                best = d
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y and (d := older[j - 2] + 0.8) < best:
                best = d
            row[j] = best
            if best < least:
                least = best
        if least > most and before > most if i > 1 else False:
            return inf
        before, older, last = least, last, row
    d = last[m]
    return d if d <= most else inf


class _Sparse(dict):
    """A row of which only the band is kept."""

    def __init__(self, rest: float) -> None:
        self.rest = rest

    def __missing__(self, key: int) -> float:
        return self.rest


@dataclass
class Dictionary:
    """Spellings of a reference list with their deletes."""

    spellings: dict[str, int]
    frequency: dict[int, int] = field(default_factory=dict)
    words: WordList | None = None
    index: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    longest: int = 0

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.spellings), default=0)
        for s in self.spellings:
            for d in deletes(s, bound(s)):
                self.index[d].add(s)

    def near(self, form: str) -> list[tuple[float, str]]:
        """Spellings within the bound of `form`, with their distances."""
        if len(form) > self.longest + 2:
            return []  # longer than any spelling within the bound
        found = set().union(*(self.index.get(d, ()) for d in deletes(form, bound(form))))
        return [(cost, s) for s in found if strict(s) == strict(form) and (cost := distance(form, s, bound(form))) <= bound(form)]

    def best(self, forms: tuple[str, ...]) -> tuple[int, float]:
        """(entry, distance) of the nearest spelling; ties go to the earlier form, the more frequent entry, the smaller id. (0, inf) for none."""
        ranked = []
        for k, form in enumerate(forms):
            for cost, s in self.near(form):
                entry = self.spellings[s]
                ranked.append((cost, k, -self.frequency.get(entry, 0), entry))
        if not ranked and self.words and forms:
            return self.words.best(forms[0], self.frequency)
        return (min(ranked)[3], min(ranked)[0]) if ranked else (0, float("inf"))


def skeleton(word: str) -> str:
    """The word without vowels but the first letter."""
    return word[:1] + re.sub(r"[aeiou]", "", word[1:])


class WordList:
    """The words of a list's entries, found by spelling, abbreviation, initials or translation."""

    def __init__(self, names: dict[int, str], glossary: dict[str, str]) -> None:
        self.entries = {i: tuple(w for w in words(letters(n)) if w not in FILLERS) for i, n in names.items()}
        own = {w for e in self.entries.values() for w in e}
        self.meant = {w: w for w in own} | {w: t for w, t in glossary.items() if t in own and w not in own}
        self.spelt = Dictionary({w: k for k, w in enumerate(sorted(self.meant))})
        self.listed = sorted(self.meant)
        self.initials = {"".join(w[0] for w in e): i for i, e in self.entries.items() if len(e) > 2}
        self.short: dict[str, set[str]] = defaultdict(set)
        for w in own:
            self.short[skeleton(w)].add(w)
            for n in range(3, len(w)):
                self.short[w[:n]].add(w)

    def word(self, w: str) -> set[str]:
        """The words of the list that a typed one may stand for: itself or the nearest, and one that it abbreviates."""
        near = [] if w in self.meant else self.spelt.near(w)
        own = self.short.get(w, set())
        return ({self.meant[w]} if w in self.meant else {self.meant[min(near)[1]]} if near else set()) | (own if len(own) == 1 else set())

    def best(self, form: str, frequency: dict[int, int]) -> tuple[int, float]:
        """(entry, share of typed words that say nothing) of the entry with most of the words, if these are half of all typed."""
        typed = [w for w in words(form) if w not in FILLERS and not w.isdigit()]
        for w in typed:
            if w in self.initials:
                return self.initials[w], 0.0
        meant = [self.word(w) for w in typed]
        for i, both in enumerate(a + b for a, b in zip(typed, typed[1:])):  # a word written as two
            if both in self.meant:
                meant[i], meant[i + 1] = ({self.meant[both]} | m for m in meant[i : i + 2])
        told = set().union(*meant)
        ranked = [(-len(hit), len(e) - len(hit), -frequency.get(i, 0), i) for i, e in self.entries.items() if (hit := told & set(e))]
        unsaid = sum(not m for m in meant)
        return (min(ranked)[3], unsaid / len(typed)) if ranked and unsaid * 2 <= len(typed) else (0, float("inf"))


def spellings_of(names: dict[int, str], kinds: frozenset[str]) -> dict[str, int]:
    """Every spelling that stands for exactly one entry; full names win over shortened ones, smaller ids over equal full names."""
    full = {" ".join(words(letters(n))): i for i, n in sorted(names.items(), reverse=True)}
    short: dict[str, set[int]] = defaultdict(set)
    for i, n in names.items():
        for s in shortened(n, kinds):
            short[s].add(i)
    return {s: next(iter(own)) for s, own in short.items() if len(own) == 1} | full


def _typed(cells: DataFrame) -> DataFrame:
    return cells.filter(F.length(F.regexp_replace("value", r"(?U)[\s\p{Z}]+", "")) > 0)


def map_values(cells: DataFrame, names: dict[int, str], forms, kinds: frozenset[str] = frozenset(), glossary: dict[str, str] | None = None) -> DataFrame:
    """record_id, ref_id and distance for `cells` (record_id, value).

    NULL, blank and literally correct values give no row. ref_id is 0, distance NULL, where nothing fits.
    The values never leave their partition: every batch maps its distinct values once.
    """
    spark = cells.sparkSession
    literal = spark.createDataFrame([(n,) for n in sorted(set(names.values()))], "value string")
    typed = _typed(cells)
    counted = {r["value"]: r["count"] for r in typed.join(F.broadcast(literal), "value").groupBy("value").count().collect()}
    frequency = {i: counted.get(n, 0) for i, n in names.items()}
    shared = spark.sparkContext.broadcast(Dictionary(spellings_of(names, kinds), frequency, WordList(names, glossary) if glossary else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, float]] = {}
        for pdf in batches:
            for v in pdf["value"].unique():
                if v not in known:
                    known[v] = shared.value.best(forms(v))
            hit = [known[v] for v in pdf["value"]]
            if len(known) > 500_000:
                known.clear()
            yield pd.DataFrame({"record_id": pdf["record_id"], "ref_id": pd.Series([h[0] for h in hit], dtype="int32"), "distance": [h[1] if h[0] else None for h in hit]})

    return typed.join(F.broadcast(literal), "value", "left_anti").mapInPandas(run, "record_id bigint, ref_id int, distance double")


def map_values_joined(cells: DataFrame, names: DataFrame, forms, kinds: frozenset[str] = frozenset()) -> DataFrame:
    """As `map_values` without a glossary, for a list (ref_id, name) too long to broadcast: both sides meet on their deletes."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(" ".join(words(letters(n))), i, True) for i, n in zip(pdf["ref_id"], pdf["name"])] + [(s, i, False) for i, n in zip(pdf["ref_id"], pdf["name"]) for s in shortened(n, kinds)]
            yield pd.DataFrame(rows, columns=["spelling", "ref_id", "full"]).astype({"ref_id": "int32"})

    def cut_spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, i, d) for s, i in zip(pdf["spelling"], pdf["ref_id"]) for d in deletes(s, bound(s))]
            yield pd.DataFrame(rows, columns=["spelling", "ref_id", "d"]).astype({"ref_id": "int32"})

    spelt = names.mapInPandas(spell, "spelling string, ref_id int, full boolean").groupBy("spelling").agg(F.min(F.when(F.col("full"), F.col("ref_id"))).alias("own"), F.min("ref_id").alias("least"), F.max("ref_id").alias("most"))
    spelt = spelt.select("spelling", F.coalesce("own", F.when(F.col("least") == F.col("most"), F.col("least"))).alias("ref_id")).filter("ref_id IS NOT NULL")
    longest = (spelt.agg(F.max(F.length("spelling"))).first()[0] or 0) + 2

    def cut_typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, k, f, d) for v in pdf["value"] for k, f in enumerate(forms(v)) if len(f) <= longest for d in deletes(f, bound(f))]
            yield pd.DataFrame(rows, columns=["value", "k", "form", "d"]).astype({"k": "int32"})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["distance"] = [distance(f, s) if strict(f) == strict(s) else float("inf") for f, s in zip(pdf["form"], pdf["spelling"])]
            yield pdf.loc[pdf["distance"] <= pdf["form"].map(bound), ["value", "k", "ref_id", "distance"]]

    typed = _typed(cells).join(names.select(F.col("name").alias("value")).distinct(), "value", "left_anti")
    frequency = cells.join(names.select("ref_id", F.col("name").alias("value")), "value").groupBy("ref_id").agg(F.count("*").alias("seen"))
    left = typed.select("value").distinct().mapInPandas(cut_typed, "value string, k int, form string, d string")
    right = spelt.mapInPandas(cut_spellings, "spelling string, ref_id int, d string")
    best = (
        left.join(right, "d").select("value", "k", "form", "ref_id", "spelling").distinct().mapInPandas(score, "value string, k int, ref_id int, distance double")
        .join(frequency, "ref_id", "left")
        .groupBy("value").agg(F.min_by(F.struct("ref_id", "distance"), F.struct("distance", "k", -F.coalesce("seen", F.lit(0)), "ref_id")).alias("hit"))
    )
    # a value may be typed in a large share of all cells
    return skew_join(typed.select("record_id", "value"), best, ["value"], "left").select("record_id", F.coalesce("hit.ref_id", F.lit(0)).cast("int").alias("ref_id"), "hit.distance")


def mapped(cells: DataFrame, reference: DataFrame, id_col: str, name_col: str, forms, kinds: frozenset[str] = frozenset(), glossary: dict[str, str] | None = None) -> DataFrame:
    """`map_values` with the reference list of a table; a list beyond the limit takes the joined way, which gives the same.

    A glossary is for lists of statuses and the like; with a longer list it is refused rather than left out.
    """
    rows = reference.filter(F.col(name_col).isNotNull()).select(F.col(id_col).cast("int").alias("ref_id"), F.col(name_col).alias("name"))
    some = rows.limit(MAX_BROADCAST_ENTRIES + 1).collect()
    if len(some) > MAX_BROADCAST_ENTRIES:
        if glossary:
            raise ValueError(f"a glossary goes with lists of up to {MAX_BROADCAST_ENTRIES} entries")
        return map_values_joined(cells, rows, forms, kinds)
    return map_values(cells, {r["ref_id"]: r["name"] for r in some}, forms, kinds, glossary)


def found_entries(blotter: DataFrame, place_ref: DataFrame, status_ref: DataFrame) -> DataFrame:
    """record_id, field and ref_id of every place and status cell that isn't literally an entry."""
    typed = blotter.select("record_id", F.col("location_purok").alias("value"))
    places = mapped(typed, place_ref, "place_id", "place_name", partial(place_forms, own_place=own_name(typed)), PLACE_KINDS)
    states = mapped(blotter.select("record_id", F.col("status").alias("value")), status_ref, "status_id", "status_name", status_forms, glossary=STATUS_WORDS)
    return places.select("record_id", F.lit("location_purok").alias("field"), "ref_id").unionByName(states.select("record_id", F.lit("status").alias("field"), "ref_id"))
