"""Spellings that name the same party (problem 1).

Cells are stripped of contact details and titles. Each distinct spelling is a vector of character n-grams
weighted by rarity; a sparse cosine join with prefix filtering gives all pairs above a threshold, of which those
whose surnames lie too far apart to score are left out before anything of them is shuffled. The cosine,
adjusted by how well the name's parts agree, is their score, and exact average-linkage clustering, run as
rounds of mutual best merges, groups them.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talasik.llm.mapping import distance
from talasik.llm.pii import find
from talasik.session import cut, spread

GRAM = 4
#: A word in this share of all words of names is a given name.
GIVEN_SHARE = 0.0025
#: Pairs below this cosine aren't looked at.
COSINE = 0.2
#: Clusters merge while the mean score of their pairs is at least this.
LINKAGE = 0.45
#: The root of the cosine that counts beside the parts: n-grams of short names suffer much from one slip.
ROOT = 4

#: Cells that name nobody (fixed values).
NOBODY = frozenset(
    "wala|unknown|not indicated|n a|na|none|hindi kilala|unidentified|john jane doe|john doe|jane doe|di kilalang lalaki|di kilalang babae|anonymous|not stated|unspecified".split("|")
)
#: Words before a name that aren't part of it (fixed values).
TITLES = frozenset("mr mrs ms gng g mang aling kgwd kagawad kap kapitan bb dr hon atty engr ka tatay nanay lolo lola kuya ate sps si the".split())
#: Forms of the words for elder and younger (fixed values).
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii"}
#: Words of an organisation's kind and their abbreviations (fixed values).
KINDS = {
    "inc": "", "incorporated": "", "corp": "corporation", "corporation": "corporation", "co": "corporation", "company": "corporation", "school": "school", "sch": "school", "skul": "school",
    "elem": "elementary", "elementary": "elementary", "cooperative": "cooperative", "coop": "cooperative", "trading": "trading", "trade": "trading", "trdg": "trading", "store": "store",
    "hardware": "hardware", "hdwe": "hardware", "services": "services", "svcs": "services", "service": "services", "water": "water", "lending": "lending", "association": "association",
    "assoc": "association", "assn": "association", "hoa": "homeowners association", "homeowners": "homeowners", "transport": "transport", "trans": "transport", "rice": "rice",
}
#: Words that set organisations of one name apart (fixed values).
MARKS = frozenset({"mga", "kapitbahay", "ng", "villa", "new"})
#: Given names shortened in ways no rule gives (fixed values).
SHORT = {"fco": "francisco", "ma": "maria", "jos": "jose"}


_TWO_LETTERS = regex.compile(r"\p{L}{2}")
_LEAD_IN = regex.compile(r"(?i)(?:[\s,;:/(<\-]|\b(?:of|taga|tel|cp|no|id|id#|nakatira|sa)\b\.?|#)+$")
_LETTERS = regex.compile(r"\p{L}+")
_QUOTED = regex.compile(r'"([^"]+)"')
_TOKENS = regex.compile(r"\p{L}[\p{L}'’]*(?:-\p{L}+)*")
_DOUBLE = regex.compile(r"(.)\1+")
_ALIKE = str.maketrans("cqfvz", "kkpbs")


def plain_name(cell: str) -> str:
    """The cell without contact details, in lower case without accents; '' if it names nobody."""
    spans = find(cell, True)
    at = spans[0].start if spans else len(cell)
    text = cell[:at]
    if spans and not _TWO_LETTERS.search(text):
        text = " ".join(cell[a:b] for a, b in zip([0] + [s.end for s in spans], [s.start for s in spans] + [len(cell)]))
    if spans:
        text = _LEAD_IN.sub("", text)
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    text = text.replace("“", '"').replace("”", '"')
    text = " ".join(text.split())
    bare = " ".join(_LETTERS.findall(text))
    return "" if not bare or bare in NOBODY else text


@lru_cache(maxsize=50_000)
def fold(token: str) -> str:
    """Letters that sound alike become one, double letters single."""
    return _DOUBLE.sub(r"\1", token.translate(_ALIKE))


@dataclass(frozen=True)
class Name:
    """A parsed spelling: words in order, the surname first if a comma says so."""

    words: tuple[str, ...]
    first_is_surname: bool
    suffix: str
    nick: str
    kinds: frozenset[str]
    marks: frozenset[str]

    @property
    def organisation(self) -> bool:
        return bool(self.kinds) or "kapitbahay" in self.marks


@lru_cache(maxsize=50_000)
def parse(text: str) -> Name:
    nick = ""
    m = _QUOTED.search(text) if '"' in text else None
    if m:
        nick, text = "".join(_LETTERS.findall(m[1])), f"{text[: m.start()]} {text[m.end() :]}"
    comma = "," in text
    suffix, words, kinds, marks = "", [], [], []
    tokens = _TOKENS.findall(text)
    while len(tokens) > 1 and tokens[0] in TITLES:
        tokens = tokens[1:]
    organisation = any(t in KINDS and t not in ("co", "trans", "rice", "water") for t in tokens) or "kapitbahay" in tokens
    for i, t in enumerate(tokens):
        if t in SUFFIXES and i and not (t in ("ii", "iii") and i < 1):
            suffix = SUFFIXES[t]
        elif organisation and t in KINDS:
            kinds += KINDS[t].split()
        elif organisation and t in MARKS:
            marks.append(t)
        elif t not in TITLES or len(t) > 3:
            words.append(t)
    return Name(tuple(words), comma, suffix, nick, frozenset(kinds), frozenset(marks) - {"ng", "mga"})


@lru_cache(maxsize=200_000)
def same_word(a: str, b: str) -> float:
    """How likely two spelt-out words are one: 1 if equal, less for sound-alikes and typing errors, else 0."""
    if a == b:
        return 1.0
    x, y = fold(a), fold(b)
    if x == y:
        return 0.95
    n = max(min(len(a), len(b)), min(len(x), len(y)))
    # two edits change at most four of the letters used
    if n < 4 or min(abs(len(x) - len(y)), abs(len(a) - len(b))) > 2 or min(len(set(x) ^ set(y)), len(set(a) ^ set(b))) > 4:
        return 0.0
    # folding hides slips that double a letter, and makes two of one that takes a letter from between two
    d = distance(x, y, 2)
    if d > 1 and (x, y) != (a, b):
        d = min(d, distance(a, b, 2))
    return 0.9 if d <= 1 and n > 4 else 0.8 if d <= 1 else 0.75 if d <= 1.6 and n >= 8 else 0.6 if d <= 2 and n >= 8 else 0.0


def letters(word: str) -> int:
    """Its letters as bits; two words differ in at least as many letters as in bits."""
    return sum(1 << b for b in {ord(c) % 63 for c in word})


@dataclass(frozen=True)
class Shape:
    """What tells cheaply that a word is far from others: its letters and length, as written and folded."""

    word: str
    ways: tuple[tuple[int, int], tuple[int, int]]

    @classmethod
    def of(cls, word: str) -> Shape:
        return cls(word, tuple((letters(w), len(w)) for w in (word, fold(word))))

    def like(self, other: Shape) -> bool:
        """Whether `same_word` is at least 0.8: one edit changes at most two letters and, if it doubles some, the length by two."""
        (a, n), (b, m) = self.ways
        (c, k), (d, l) = other.ways
        near = ((a ^ c).bit_count() <= 2 and -2 <= n - k <= 2) or ((b ^ d).bit_count() <= 2 and -2 <= m - l <= 2)
        return near and same_word(self.word, other.word) >= 0.8


#: Endings of Filipino pet names (fixed values).
_PET = regex.compile(r"(.{2,}?)(?:ong|ing|oy|eng)$")
_VOWELS = frozenset("aeiou")


def abbreviates(short: str, name: str) -> bool:
    """Whether up to four letters such as lds or vte stand for a name: its first letter and, in order, some of its others, with few vowels."""
    if not 3 <= len(short) <= 4 or short[0] != name[0] or len(short) >= len(name) or sum(c in _VOWELS for c in short) > 1:
        return False
    rest = iter(name)
    return all(c in rest for c in short) and (short[-1] == name[-1] or not _VOWELS & set(short))


class Givens:
    """Given names of the corpus (words that go with many others) and its nicknames."""

    def __init__(self, given: list[str], nicks: dict[str, list[str]]) -> None:
        self.given = [Shape.of(g) for g in given if len(g) > 3]
        self.known = set(given)
        self.nicks = {n: set(g) for n, g in nicks.items()}
        self.pets = [Shape.of(n) for n in nicks if len(n) > 3]
        self.meant: dict[str, frozenset[str]] = {}
        self.likely: dict[str, bool] = {}

    def lists(self) -> tuple[list[str], dict[str, list[str]]]:
        return sorted(self.known), {n: sorted(g) for n, g in self.nicks.items()}

    @staticmethod
    def of(lists: tuple[list[str], dict[str, list[str]]]) -> Givens:
        """Those of `lists`; the tasks of a worker share one, with what it has looked up."""
        return _givens(tuple(lists[0]), tuple((n, tuple(g)) for n, g in lists[1].items()))

    def means(self, word: str) -> frozenset[str]:
        """The given names a word of two letters or more may be: itself, or one it abbreviates, misspells or is a pet name of."""
        hit = self.meant.get(word)
        if hit is None:
            w = SHORT.get(word, word)
            if w in self.known:
                hit = frozenset({w})
            else:
                own = Shape.of(w)
                found = set(self.nicks.get(w, ())) | {g for n in self.pets if own.like(n) for g in self.nicks[n.word]}
                if len(w) > 2:
                    pet = _PET.match(w) if len(w) > 4 else None
                    tail = w.replace("y", "i") if len(w) > 3 else "-"
                    starts = (w, pet[1]) if pet else w
                    found |= {s.word for s in self.given if s.word.startswith(starts) or s.word.endswith(tail) or own.like(s) or len(w) < 5 and abbreviates(w, s.word)}
                hit = frozenset(found)
            if len(self.meant) > 300_000:
                self.meant.clear()
            self.meant[word] = hit
        return hit

    def is_given(self, word: str) -> bool:
        """Whether the word is a given name, also abbreviated, misspelt or as a nickname."""
        hit = self.likely.get(word)
        if hit is None:
            hit = word in self.known or word in self.nicks or len(word) > 2 and any(g.startswith(word) or same_word(word, g) >= 0.8 for g in self.means(word))
            if len(self.likely) > 300_000:
                self.likely.clear()
            self.likely[word] = hit
        return hit

    def initials(self, word: str) -> list[str]:
        """First letters of the given names the word may stand for."""
        return sorted({g[0] for g in self.means(word)} if len(word) > 1 else ()) or [word[0]]

    def same(self, a: str, b: str) -> float:
        """As `same_word`, with initials, abbreviations and nicknames."""
        a, b = SHORT.get(a, a), SHORT.get(b, b)
        if len(a) > len(b):
            a, b = b, a
        if a == b:
            return 1.0
        if len(a) == 1:
            return 0.7 if b[0] == a or any(g[0] == a for g in self.means(b)) else 0.0
        if a in self.known and b in self.known:
            return 0.0  # two given names, however alike
        if len(a) >= 3 and b.startswith(a):
            return 0.9
        if b in self.nicks.get(a, ()) or a in self.nicks.get(b, ()):
            return 0.9
        return same_word(a, b) or (0.8 if self.means(a) & self.means(b) else 0.0)

    def surname_at(self, name: Name) -> int:
        """Index of the surname: before a comma the first word, else the last long one that is no given name."""
        if name.first_is_surname or len(name.words) == 1:
            return 0
        long_ = [i for i, w in enumerate(name.words) if len(w) > 3]
        own = [i for i in long_ if not self.is_given(name.words[i])]
        return (own or long_ or [len(name.words) - 1])[-1]


@lru_cache(maxsize=2)
def _givens(given: tuple[str, ...], nicks: tuple[tuple[str, tuple[str, ...]], ...]) -> Givens:
    return Givens(list(given), {n: list(g) for n, g in nicks})


def score(a: Name, b: Name, givens: Givens) -> float:
    """0 to 1: how likely two spellings name one party."""
    if not a.words or not b.words or a.organisation != b.organisation or a.suffix != b.suffix:
        return 0.0
    if a.organisation:
        if a.marks != b.marks or not (a.kinds <= b.kinds or b.kinds <= a.kinds) or len(a.words) != len(b.words):
            return 0.0
        return math.prod(same_word(x, y) for x, y in zip(a.words, b.words))
    i, j = givens.surname_at(a), givens.surname_at(b)
    s = same_word(a.words[i], b.words[j])
    if not s:
        return 0.0
    return s * _rest([w for k, w in enumerate(a.words) if k != i], [w for k, w in enumerate(b.words) if k != j], a.nick, b.nick, givens)


def _rest(a: list[str], b: list[str], nick_a: str, nick_b: str, givens: Givens) -> float:
    """Agreement of what remains beside the surname: the given name must agree, middles must not conflict."""
    if not a or not b:
        return 0.0
    first = max([givens.same(a[0], b[0])] + [0.9 * givens.same(n, w) for n, w in ((nick_a, b[0]), (nick_b, a[0])) if n and len(n) > 1 and (len(a[0]) == 1 or len(b[0]) == 1)])
    if not first:
        return 0.0
    a, b = a[1:], b[1:]
    total = first
    short, long_ = sorted((a, b), key=len)
    used = 0
    for w in short:
        hit = next(((k, s) for k in range(used, len(long_)) if (s := givens.same(w, long_[k]))), None)
        if hit is None:
            return 0.0
        used = hit[0] + 1
        total *= 0.9 + 0.1 * hit[1]
    # middles that only one spelling has leave room for doubt
    return total * 0.88 ** (len(long_) - len(short))


def alike_key(name: Name, givens: Givens) -> str | None:
    """What `score` and `features` read of a spelling: spellings of one key score 1 with each other and the same with all others.

    None for a name of one word, which matches nothing, not even itself.
    """
    if name.organisation and name.words:
        return "|".join(["o", *(" ".join(p) for p in (name.words, sorted(name.kinds), sorted(name.marks))), name.suffix])
    if len(name.words) < 2:
        return None
    i = givens.surname_at(name)
    return "|".join(["p", name.words[i], " ".join(w for k, w in enumerate(name.words) if k != i), name.suffix, name.nick])


def alike_parts(name: Name, givens: Givens) -> tuple[str, str]:
    """(side, word): spellings score above 0 only if their sides are equal and `same_word` of their words is above 0.

    Empty for those that `alike_key` gives None for: they match nothing.
    """
    if name.organisation and name.words:
        return "|".join(["o", name.suffix, " ".join(sorted(name.marks)), str(len(name.words))]), name.words[0]
    if len(name.words) < 2:
        return "", ""
    return f"p|{name.suffix}", name.words[givens.surname_at(name)]


def may_be_same(x: str, y: str) -> Column:
    """False only where `same_word` is 0, of the words (word, folded, letters, folded_letters) of the sides x and y of a join.

    Edits that cost up to 1 are at most two insertions, deletions and replacements and change at most two of the letters used, those up to 2 are at most four.
    """
    both = lambda c: (F.col(f"{x}.{c}"), F.col(f"{y}.{c}"))
    (a, b), (p, q) = both("word"), both("folded")
    size = lambda c, d: F.least(F.length(c), F.length(d))
    apart = F.least(F.abs(F.length(a) - F.length(b)), F.abs(F.length(p) - F.length(q)))
    others = F.least(*[F.bit_count(c.bitwiseXOR(d)) for c, d in (both("letters"), both("folded_letters"))])
    near = lambda most: (F.levenshtein(p, q, most) >= 0) | (((a != p) | (b != q)) & (F.levenshtein(a, b, most) >= 0))
    n = F.greatest(size(a, b), size(p, q))
    return (others <= 4) & (apart <= 2) & ((p == q) | ((n >= 4) & (n < 8) & (others <= 2) & near(2)) | ((n >= 8) & near(4)))


def features(text: str, givens: Givens) -> set[str]:
    """Character n-grams of the cleaned name: those of the surname, each with the initial a given name may have, the
    initials of its other words and its suffix; of an organisation, those of all its words.

    An abbreviation, nickname or misspelling counts as every given name it can stand for, so spellings of one
    person share their n-grams however the given name is written, and namesakes with other given names don't.
    """
    name = parse(text)
    if not name.words:
        return set()
    if name.organisation:
        return {f"org:{g}" for w in name.words for g in _grams(w)} | {f"org:{k}" for k in name.kinds} | {f"mark:{m}" for m in name.marks}
    i = givens.surname_at(name)
    rest = [w for k, w in enumerate(name.words) if k != i]
    own = _grams(name.words[i])
    return {f"{c}:{g}" for c in (givens.initials(rest[0]) if rest else ["_"]) for g in own} | {f"middle:{w[0]}" for w in rest[1:]} | ({f"suffix:{name.suffix}"} if name.suffix else set())


def _grams(word: str) -> set[str]:
    """Its n-grams without regard to the order within each, so that two letters swapped change few of them."""
    w = f" {fold(word)} "
    return {"".join(sorted(w[i : i + GRAM])) for i in range(max(1, len(w) - GRAM + 1))}


def _gram_rows(lists: tuple[list[str], dict[str, list[str]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        givens = Givens.of(lists)
        for pdf in batches:
            ids, sizes, grams = [], [], []
            for i, n, name in zip(pdf["id"], pdf["n"], pdf["name"]):
                own = sorted(features(name, givens))
                ids += [i] * len(own)
                sizes += [n] * len(own)
                grams += own
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "n": pd.Series(sizes, dtype="int64"), "gram": pd.Series(grams, dtype="object")})

    return run


def _sized(rows: DataFrame) -> DataFrame:
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("bigint"))


def cosine_pairs(names: DataFrame, givens: Givens, threshold: float = COSINE, parts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, cosine), a < b, of `names` (id, name) whose n-gram vectors reach the threshold; none is missed.

    With a column n a row counts as n names. With `parts` (id, side, word, folded, letters, folded_letters) pairs
    that surely score 0 are left out: those of different sides or with words that can't be the same, and ids without a row there.

    Of each vector only its rarest n-grams are joined, as many as leave a rest whose length is below the
    threshold: two vectors that reach it share one of these. The full cosine is computed for those pairs.
    """
    names = _sized(names)
    n = max(names.agg(F.sum("n")).first()[0] or 0, 1)
    rows = cut(spread(names.select("id", "n", "name")).mapInPandas(_gram_rows(givens.lists()), "id bigint, n bigint, gram string"))
    df = rows.groupBy("gram").agg(F.sum("n").alias("df"))
    weighted = rows.drop("n").join(df, "gram").withColumn("w", F.log(F.lit(n + 1.0) / F.col("df")))
    own = Window.partitionBy("id")
    rarest = own.orderBy(F.desc("w"), "gram")
    unit = cut(
        weighted.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))
        .withColumn("before", F.coalesce(F.sum(F.col("u") * F.col("u")).over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.greatest(1 - F.col("before"), F.lit(0.0)))
        .select("id", "gram", "df", F.col("u").cast("float").alias("u"), F.sqrt(F.greatest(F.col("left") - F.col("u") * F.col("u"), F.lit(0.0))).cast("float").alias("after"), (F.col("left") >= threshold * threshold).alias("joined"))
    )
    prefix = unit.filter("joined AND df > 1").select("id", "gram", "u", "after")
    # at the rarest n-gram two vectors share, the cosine is at most its own part and what the lengths of the rests allow
    enough = F.col("x.u") * F.col("y.u") + F.col("x.after") * F.col("y.after") >= threshold - 1e-4
    met = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")) & enough
    if parts is not None:
        prefix = prefix.join(parts, "id")
        met = (F.col("x.side") == F.col("y.side")) & met & may_be_same("x", "y")
    pairs = prefix.alias("x").join(prefix.alias("y"), met).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    vectors = unit.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "u"))).alias("v"))
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)))
    return (
        pairs.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
        .select("a", "b", dot.alias("cosine")).filter(F.col("cosine") >= threshold - 1e-4)
    )


def _cut_anew(df: DataFrame) -> DataFrame:
    """As `cut`, without the size estimate and constraints that a checkpoint inherits: carried on from round to round they grow without bound."""
    spark, done = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def average_linkage(nodes: DataFrame, links: DataFrame, threshold: float = LINKAGE) -> DataFrame:
    """(id, cluster) of every node of `nodes` (id) under average linkage of `links` (a, b, score).

    With a column n a node stands for n that are merged already. Pairs without a link count as 0. Average linkage
    is reducible, so merging all pairs of clusters that are each other's best in every round gives the same
    clusters as merging one pair at a time, until none is left. Ties go by a hash of the pair: by the smallest id,
    a tied group would merge one pair a round, so it takes rounds by the logarithm of its size. No component is
    gathered anywhere.
    """
    member = _sized(nodes).select("id", F.col("id").alias("cluster"), "n")
    of = lambda end: member.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"))
    edges = _cut_anew(links.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("score") * F.col("na") * F.col("nb")).alias("total"), "na", "nb"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "total", F.col("nb").alias("na"), F.col("na").alias("nb"))).withColumn("mean", F.round(F.col("total") / (F.col("na") * F.col("nb")), 9))
        # links that can never reach the threshold again are kept: they still pull a mean up
        best = both.filter(F.col("mean") >= threshold).groupBy("a").agg(F.min_by("b", F.struct(-F.col("mean"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
        merge = _cut_anew(best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.a") < F.col("x.b"))).select(F.col("x.a").alias("keep"), F.col("x.b").alias("gone")))
        if merge.isEmpty():
            break
        member = _cut_anew(member.join(merge.withColumnRenamed("gone", "cluster"), "cluster", "left").select("id", F.coalesce("keep", "cluster").alias("cluster"), "n"))
        sizes = member.groupBy("cluster").agg(F.sum("n").alias("n"))
        to = merge.select("gone", "keep")
        moved = (
            edges.join(to.select(F.col("gone").alias("a"), F.col("keep").alias("ka")), "a", "left").join(to.select(F.col("gone").alias("b"), F.col("keep").alias("kb")), "b", "left")
            .select(F.coalesce("ka", "a").alias("a"), F.coalesce("kb", "b").alias("b"), "total").filter("a <> b")
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"))
        )
        edges = _cut_anew(moved.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b"))
    return member.select("id", "cluster")


def learn_givens(names: DataFrame) -> Givens:
    """Words in GIVEN_SHARE of all names, and nicknames with the given names they stand beside in quotes."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, p.nick if k < 3 else "") for n in pdf["name"] for p in [parse(n)] if not p.organisation for k, w in enumerate(p.words) if len(w) > 1]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "nick"])

    words = cut(names.mapInPandas(tokens, "word string, nick string"))
    total = max(words.count(), 1)
    common = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(4, total * GIVEN_SHARE)).collect()}
    pairs = words.filter("nick <> ''").groupBy("nick", "word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, total / 100_000)).collect()
    strong: dict[str, dict[str, int]] = {}
    for r in pairs:
        if r["word"] in common and len(r["word"]) > 3:
            strong.setdefault(r["nick"], {})[r["word"]] = r["n"]
    nicks = {n: [w for w, k in own.items() if k * 3 >= max(own.values())] for n, own in strong.items()}
    return Givens(sorted(common), nicks)


def party_clusters(cells: DataFrame) -> DataFrame:
    """(cell, cluster) of every distinct cell of `cells` (cell) that names somebody.

    NULLs, blanks and placeholders are left out. Cells that differ in case, contact details or spacing only
    share a spelling; spellings with the same parts (`alike_key`) are one node, nodes are clustered.
    """

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cell": pdf["cell"], "name": [plain_name(c) for c in pdf["cell"]]})

    named = cut(spread(cells.filter("cell IS NOT NULL").distinct()).mapInPandas(clean, "cell string, name string").filter("name <> ''"))
    names = cut(named.select("name").distinct().select(F.xxhash64("name").alias("id"), "name"))
    givens = learn_givens(names)
    shared = cells.sparkSession.sparkContext.broadcast(givens.lists())

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Givens.of(shared.value)
        for pdf in batches:
            # most pairs end at the words that must be the same
            pdf = pdf[[same_word(x, y) > 0 for x, y in zip(pdf["wa"], pdf["wb"])]].copy()
            pdf["score"] = pd.Series([score(parse(x), parse(y), own) * min(max(c, 0.0), 1.0) ** (1 / ROOT) for x, y, c in zip(pdf["na"], pdf["nb"], pdf["cosine"])], index=pdf.index, dtype="float64")
            yield pdf.loc[pdf["score"] > 0, ["a", "b", "score"]]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Givens.of(shared.value)
        for pdf in batches:
            pdf["key"] = [alike_key(parse(n), own) or f"={n}" for n in pdf["name"]]
            pdf["side"], pdf["word"] = zip(*[alike_parts(parse(n), own) for n in pdf["name"]]) if len(pdf) else ([], [])
            pdf["folded"] = [fold(w) for w in pdf["word"]]
            for c, of in (("letters", "word"), ("folded_letters", "folded")):
                pdf[c] = pd.Series([letters(w) for w in pdf[of]], index=pdf.index, dtype="int64")
            yield pdf

    part = {"side": "string", "word": "string", "folded": "string", "letters": "bigint", "folded_letters": "bigint"}
    keyed = cut(spread(names).mapInPandas(keys, "id bigint, name string, key string, " + ", ".join(f"{c} {t}" for c, t in part.items())))
    nodes = cut(keyed.groupBy("key").agg(F.min("id").alias("id"), F.min_by(F.struct("name", *part), "id").alias("of"), F.count("*").alias("n")).select("key", "id", "n", "of.*"))
    pairs = cosine_pairs(nodes, givens, parts=nodes.filter("side <> ''").select("id", *part))
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"n{end}"), F.col("word").alias(f"w{end}"))
    spelt = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "wa", "wb", "cosine")
    # a pair is a few bytes but takes a while: small partitions must not be put together
    tasks = cells.sparkSession.sparkContext.defaultParallelism * 4
    links = cut(spelt.repartition(tasks, "a", "b").mapInPandas(check, "a bigint, b bigint, score double"))
    linked = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    grouped = average_linkage(nodes.join(linked, "id").select("id", "n"), links)
    own = keyed.select("name", "key").join(nodes.select("key", "id"), "key").join(grouped, "id", "left").select("name", F.coalesce("cluster", "id").alias("cluster"))
    return named.join(own, "name").select("cell", "cluster")


def cells_of(blotter: DataFrame) -> DataFrame:
    return blotter.select(F.explode(F.array("reporting_party", "respondent")).alias("cell"))


def clusters_of(blotter: DataFrame) -> DataFrame:
    """cell and cluster of every party cell."""
    return party_clusters(cells_of(blotter))


def found_pairs(blotter: DataFrame) -> DataFrame:
    """name_a < name_b (by code point): distinct cells that name the same party."""
    own = cut(clusters_of(blotter))
    a, b = own.select(F.col("cell").alias("name_a"), "cluster"), own.select(F.col("cell").alias("name_b"), "cluster")
    return a.join(b, "cluster").filter("name_a < name_b").select("name_a", "name_b")
