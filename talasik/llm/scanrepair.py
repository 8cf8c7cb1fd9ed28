"""Repair of text read from scanned pages (problem 6).

Running headers are learnt as lines that recur within and across texts. Words are counted over all
texts; a rare word is linked to frequent ones that glyph confusions turn into it, and skip-gram vectors
of the frequent words choose the one that fits the words around it. Furniture is then removed, words cut
at line ends are joined, and lines reflow into paragraphs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talasik.session import cut, spread

#: What a scanner reads for a letter or pair (fixed values): true -> seen.
MISREADS = {
    "a": "o@4", "o": "0a", "e": "cf", "i": "1l", "l": "1i", "s": "5", "b": "68", "g": "96", "h": "b", "u": "v", "y": "v", "t": "f", "r": "i",
    "n": ("m", "ri"), "m": ("rn", "n"), "d": ("cl",), "w": ("vv",), "z": "2", "q": "9", "f": "t", "c": "e", "v": "u",
}
_PAIRS = {(t, s) for t, seen in MISREADS.items() for s in seen} | {("cl", "d"), ("rn", "m"), ("vv", "w")}
#: One letter stands for all that are mistaken for each other.
_CLASSES = str.maketrans({c: g[0] for g in ("ao0@4", "ecft", "il1r|!", "s5", "bh68g9q", "uvy", "nm", "z2") for c in g})
#: A word must be so many times rarer than the one it is taken for.
RATIO = 12
#: The vocabulary holds words with at least this share of all words, so its size has a bound.
VOCABULARY = 200_000
VECTOR = 32
#: Words at most this far apart are a pair; draws of noise a pair (few, so that small vocabularies keep cells).
SPAN, NEGATIVES = 3, 1
#: Factors beyond VECTOR and passes that make the factorisation exact enough.
SPARE, PASSES = 8, 1
#: Fields of a form, which are no furniture (fixed values).
_FIELD = regex.compile(r"^\s*\p{L}[\p{L} /]{1,24}\s*[:=]\s*\S")
_PAGE = r"(?:[\[(—–-]\s*)?(?:(?:p[a@4o][gh9b6][ei1lc]?[nmri]{0,2}[a@4o]?|pg|p)\.?\s*)?(?:b[l1i][g96]\.?\s*)?[\dlIoOSBZ]{1,4}(?:\s*(?:[o0]f|/)\s*[\dlIoOSBZ]{1,4})?(?:\s*[\])—–-])?"
_PAGE_LINE = regex.compile(rf"(?i)^\s*{_PAGE}\s*$")
_PAGE_BESIDE = regex.compile(rf"(?i)(?:\s{{2,}}{_PAGE}\s*$|^\s*{_PAGE}\s{{2,}})")
#: Most lines of a scanned page are at most so long.
PAGE_WIDTH = 100
_DIGIT = re.compile(r"\d")
_HASHED = str.maketrans("0123456789", "##########")
_EDGE = ".,;:!?\"'“”‘’()[]{}<>…*/|"
_SPLIT = regex.compile(r"\S+")
#: A header is in at least this share of the texts with several lines, and twice in this share of those.
HEADER_SHARE, HEADER_TWICE, HEADER_LEAST = 0.005, 0.15, 4


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def is_page_number(line: str) -> bool:
    return 0 < len(line) < 28 and bool(_DIGIT.search(line)) and bool(_PAGE_LINE.match(line))


def header_form(line: str) -> str:
    """A line without a page number beside it, upper case, digits as #; '' if it can't be a header."""
    s = line.strip("\f \t\r")
    if len(s) < 8 or len(s) > 70 or s[-1] in ",;" or ":" in s and _FIELD.match(s):
        return ""
    if "  " in s:
        s = _PAGE_BESIDE.sub("", s).strip()
        if len(s) < 8:
            return ""
    s = " ".join(s.upper().split()).translate(_HASHED)
    return s if s.isupper() else ""


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        last = row
    return last[-1]


def _line_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    docs, twice, total = Counter(), Counter(), 0

    def out() -> pd.DataFrame:
        return pd.DataFrame({"form": list(docs), "docs": list(docs.values()), "twice": [twice[k] for k in docs]})

    for pdf in batches:
        for text, known in zip(pdf["text"], pdf["page"]):
            own = lines_of(text)
            if not scanned(own, known):
                continue
            total += 1
            for form, n in Counter(f for f in map(header_form, own) if f).items():
                docs[form] += 1
                twice[form] += n > 1
        if len(docs) > 200_000:
            yield out()
            docs.clear(), twice.clear()
    docs[""] = total
    yield out()


def learn_headers(texts: DataFrame) -> list[str]:
    """Running headers of all texts (column text, and page if known). At most 1 / HEADER_SHARE lines a text's share of forms can qualify."""
    told = texts.select("text", "page" if "page" in texts.columns else F.lit(False).alias("page"))
    counts = told.mapInPandas(_line_counts, "form string, docs bigint, twice bigint").groupBy("form").agg(F.sum("docs").alias("docs"), F.sum("twice").alias("twice"))
    counts = cut(counts.filter(f"docs >= {HEADER_LEAST} OR form = ''"))
    total = counts.filter("form = ''").agg(F.sum("docs")).first()[0] or 0
    rows = counts.filter((F.col("form") != "") & (F.col("docs") >= max(HEADER_LEAST, total * HEADER_SHARE)) & (F.col("twice") >= HEADER_TWICE * F.col("docs"))).orderBy(F.desc("docs"), "form").collect()
    kept: list[str] = []
    for r in rows:
        if not any(edits(r["form"], k, max(2, len(k) // 8)) <= max(2, len(k) // 8) for k in kept):
            kept.append(r["form"])
    return kept


class Headers:
    """Recognises learnt headers in spite of misread characters."""

    def __init__(self, forms: list[str]) -> None:
        self.forms = [(f, set(f.split())) for f in forms]
        self.known: dict[str, bool] = {f: True for f in forms}

    def match(self, line: str) -> bool:
        form = header_form(line)
        if not form:
            return False
        hit = self.known.get(form)
        if hit is None:
            own = set(form.split())
            hit = any(
                abs(len(form) - len(f)) <= (most := max(2, len(f) // 6)) and len(own & w) * 3 >= len(w) and edits(form, f, most) <= most
                for f, w in self.forms
            )
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[form] = hit
        return hit


def core(word: str) -> str:
    return word.strip(_EDGE).lower()


_WORDLIKE = regex.compile(r"\p{L}")
_NUMBER = regex.compile(r"^(?:php|p|₱)?\s?[\d.,:/-]+(?:\.\d+)?(?:am|pm|st|nd|rd|th)?$")


def wordlike(w: str) -> bool:
    """Whether a core is a word rather than a number or amount."""
    return bool(_WORDLIKE.search(w)) and not _NUMBER.match(w)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw: Counter = Counter()

    def out() -> pd.DataFrame:
        seen: Counter = Counter()
        for w, n in raw.items():
            seen[core(w)] += n
        raw.clear()
        return pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    for pdf in batches:
        for text in pdf["text"]:
            raw.update(text.split())
        if len(raw) > 300_000:
            yield out()
    if raw:
        yield out()


def glyph_keys(word: str) -> set[str]:
    """Words that differ by glyph confusions only share one of these keys."""
    joined = word
    for pair, one in (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w")):
        joined = joined.replace(pair, one)
    return {word.translate(_CLASSES), joined.translate(_CLASSES)}


def glyph_distance(true: str, seen: str) -> float:
    """Number of glyph confusions that turn `true` into `seen`; inf if none do.

    Only places in both that confusions can reach are kept, a few at a time, so long words take time by their length.
    """
    n, m = len(true), len(seen)
    reached: list[dict[int, float]] = [{0: 0.0}, {}, {}]
    for i in range(n + 1):
        here = reached.pop(0)
        reached.append({})
        if i == n:
            return here.get(m, math.inf)
        for j, cost in sorted(here.items()):
            if j < m and true[i] == seen[j]:
                reached[0][j + 1] = min(reached[0].get(j + 1, math.inf), cost)
            for h, k in ((1, 1), (1, 2), (2, 1)):
                if i + h <= n and j + k <= m and (true[i : i + h], seen[j : j + k]) in _PAIRS:
                    reached[h - 1][j + k] = min(reached[h - 1].get(j + k, math.inf), cost + 1)
    return math.inf


@dataclass
class Lexicon:
    """Frequent words with their counts and skip-gram vectors."""

    counts: dict[str, int]
    floor: int
    vectors: dict[str, np.ndarray]
    keys: dict[str, list[str]] = field(default_factory=lambda: defaultdict(list))
    known: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    #: Words as written that need no look at what surrounds them.
    plain: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for w in self.counts:
            if len(w) > 1 and w.replace("-", "").replace("'", "").isalpha():
                for key in glyph_keys(w):
                    self.keys[key].append(w)

    def links(self, word: str) -> list[tuple[str, float]]:
        """Frequent words that `word` may be a misreading of, with scores; none if it is a word itself."""
        hit = self.known.get(word)
        if hit is None:
            own = self.counts.get(word, max(self.floor // 3, 1))
            odd = any(c.isdigit() or c == "@" for c in word)
            hit = []
            for v in {v for key in glyph_keys(word) for v in self.keys.get(key, ())}:
                if v != word:
                    d = glyph_distance(v, word)
                    # short words differ by little from other words, so they must be the rarer
                    ratio = RATIO * (1 if odd else 1 if len(word) > 4 else 4 if len(word) > 3 else 12 if len(word) > 2 else 60)
                    if d <= max(1, (len(v) + 1) // 2) and self.counts[v] >= ratio * own:
                        hit.append((v, math.log(self.counts[v]) - 1.5 * d))
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = hit
        return hit

    def fit(self, word: str, around: list[str]) -> float:
        """Mean cosine of a frequent word with those of the words around it that have vectors."""
        v = self.vectors.get(word)
        near = [self.vectors[w] for w in around if w in self.vectors]
        return float(np.mean([v @ x for x in near])) if v is not None and near else 0.0

    def correct(self, word: str, around: list[str]) -> str | None:
        """The word meant, if `word` is a misreading."""
        if word.isdigit() or not word:
            return None
        links = self.links(word)
        if not links:
            return None
        return max(links, key=lambda x: (x[1] + 4 * self.fit(x[0], around), x[0]))[0]


#: A number in which letters stand for digits: 3:4o, P1B,050, I88.
_BAD_NUMBER = regex.compile(r"^(?i:php|p|₱)?([\doOlISBZ]+(?:[:.,][\doOlISBZ]+)*)$")


_AS_DIGITS = str.maketrans("oOlISBZ", "0011582")


def right_number(word: str) -> str | None:
    """The number meant where letters stand for digits, without the punctuation around it; else None."""
    w = word.strip(_EDGE)
    m = _BAD_NUMBER.match(w)
    if not m:
        return None
    digits = sum(c.isdigit() for c in m[1])
    letters = sum(c.isalpha() for c in m[1])
    return w[: m.start(1)] + m[1].translate(_AS_DIGITS) if letters and digits >= letters and len(m[1]) > 1 else None


@dataclass
class Page:
    """A text with what was found in it: kind by (line, word), and the correction of misread words."""

    lines: list[str]
    found: dict[tuple[int, int], str]
    fixed: dict[tuple[int, int], str]
    body: list[int]
    scanned: bool = True


def scanned(lines: list[str], page: bool = False) -> bool:
    """Whether the text is laid out in lines of a page rather than typed in one go or into a form's fields.

    Most lines of a page are at most PAGE_WIDTH long; single longer ones, such as two that were merged, make no difference.
    `page`: the text is known to be one.
    """
    if len(lines) < 2 or page:
        return len(lines) > 1
    filled = sum(1 for x in lines if x.strip())
    return not any(_FIELD.match(x) for x in lines[:2]) and 2 * sum(len(x) > PAGE_WIDTH for x in lines) < filled


def read_page(text: str, headers: Headers, lexicon: Lexicon, known_page: bool = False) -> Page:
    lines = lines_of(text)
    page = Page(lines, {}, {}, [], scanned(lines, known_page))
    if not page.scanned:
        page.body = list(range(len(lines)))
        return page
    if len(lines) > 1:
        for i, line in enumerate(lines):
            if is_page_number(line.strip("\f")):
                page.found[i, 0] = "page_number"
            elif headers.match(line):
                page.found[i, 0] = "header"
            elif line.strip():
                page.body.append(i)
    last = {i: lines[i].rstrip()[-1:] for i in page.body}
    next_body = dict(zip(page.body, page.body[1:]))
    words = {i: lines[i].split() for i in page.body}
    flat = [w for i in page.body for w in words[i]]
    at = -1
    skip = -1
    for i in page.body:
        for k, w in enumerate(words[i], 1):
            at += 1
            cut_off = k == len(words[i]) and last[i] in "-‐" and len(w) > 1 and i in next_body and bool(_WORDLIKE.search(w[:-1]))
            if at == skip or w in lexicon.plain and not cut_off:
                continue
            if cut_off:
                page.found[i, k] = "hyphen_break"
                skip = _broken(page, lexicon, flat, at, (i, k), (next_body[i], 1))
                continue
            meant = right_number(w) or _meant(lexicon, core(w), flat, at)
            if meant:
                if w.lstrip(_EDGE)[:1].isdigit() and (at == 0 or flat[at - 1][-1] in ".!?"):
                    meant = meant[:1].upper() + meant[1:]
                page.found[i, k] = "misread"
                page.fixed[i, k] = meant
            else:
                if len(lexicon.plain) > 500_000:
                    lexicon.plain.clear()
                lexicon.plain.add(w)
    return page


def _around(flat: list[str], at: int) -> list[str]:
    return [core(w) for w in flat[max(0, at - 3) : at] + flat[at + 1 : at + 4]]


def _meant(lexicon: Lexicon, c: str, flat: list[str], at: int) -> str | None:
    """The word meant by core `c` if it is misread, also in a part of a compound."""
    if not wordlike(c):
        return None
    if lexicon.links(c):
        return lexicon.correct(c, _around(flat, at))
    if "-" in c and c not in lexicon.counts:
        own = c.split("-")
        parts = [p if p in lexicon.counts else lexicon.correct(p, _around(flat, at)) or p for p in own]
        if parts != own:
            return "-".join(parts)
    return None


def _broken(page: Page, lexicon: Lexicon, flat: list[str], at: int, here: tuple[int, int], there: tuple[int, int]) -> int:
    """Looks at a word cut off at its line's end together with its rest; returns the place of the rest if it was read."""
    head, tail = core(flat[at][:-1]), core(flat[at + 1]) if at + 1 < len(flat) else ""
    whole = head + tail
    if f"{head}-{tail}" in lexicon.counts or whole in lexicon.counts and not lexicon.links(whole):
        return at + 1
    around = _around(flat, at)
    meant = lexicon.correct(whole, around) or lexicon.correct(f"{head}-{tail}", around)
    if not meant:
        return -1
    # the parts whose characters differ are misread
    end = next((n for n in range(len(meant) + 1) if glyph_distance(meant[:n].rstrip("-"), head) < math.inf), None)
    if end is not None:
        if meant[:end].rstrip("-") != head:
            page.fixed[here[0], -here[1]] = meant[:end].rstrip("-")
        if meant[end:].lstrip("-") != tail:
            page.found[there] = "misread"
            page.fixed[there] = meant[end:].lstrip("-")
    return at + 1


def cased(seen: str, meant: str) -> str:
    """`meant` in the case and between the punctuation of `seen`."""
    bare = seen.strip(_EDGE)
    a = seen.find(bare)
    if sum(c.isupper() for c in bare) * 2 > sum(c.isalpha() for c in bare) > 1:
        meant = meant.upper()
    elif bare[:1].isupper() or (bare[:1].isdigit() and bare[1:2].isupper()):
        meant = meant[:1].upper() + meant[1:]
    return seen[:a] + meant + seen[a + len(bare) :]


def reflow(page: Page, lexicon: Lexicon) -> str:
    """The running paragraphs: blank lines part them, furniture is left out, cut words are joined."""
    if not page.scanned:
        return "\n".join(page.lines)
    paragraphs: list[list[str]] = [[]]
    carry = ""
    body = set(page.body)
    for i, line in enumerate(page.lines):
        if not line.strip() and not carry:
            paragraphs.append([])
        if i not in body:
            continue
        own = line.split()
        for k, w in enumerate(own, 1):
            w = cased(w, page.fixed[i, k]) if (i, k) in page.fixed else w
            if carry:
                kept = f"{core(carry)}-{core(w)}" in lexicon.counts
                w, carry = (carry + "-" if kept else carry) + w, ""
            if page.found.get((i, k)) == "hyphen_break":
                carry = w[:-1]
                if (i, -k) in page.fixed:
                    carry = cased(carry, page.fixed[i, -k])
            else:
                paragraphs[-1].append(w)
    if carry:
        paragraphs[-1].append(carry + "-")
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def learn(texts: DataFrame) -> tuple[list[str], Lexicon]:
    """Headers and lexicon of all `texts` (column text, no NULLs)."""
    headers = learn_headers(texts)
    counts = cut(texts.mapInPandas(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    floor = max(3, -(-total // VOCABULARY))
    frequent = counts.filter((F.col("n") >= floor) & F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*$|[\p{L}].*[\d@]|[\d@].*[\p{L}]"))
    words = {r["word"]: r["n"] for r in frequent.collect()}
    # only words that can be a correction need a vector
    own = sorted(w for w, n in words.items() if n >= max(5, RATIO * floor // 3))
    return headers, Lexicon(words, floor, skip_gram(texts, own))


def _pair_counts(words: list[str]):
    """How often two of the words stand within SPAN words of each other: x, y and n, each pair once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = len(words)
        ids = {w: i for i, w in enumerate(words)}
        raw: dict[str, int] = {}
        gap = [-1] * SPAN
        for pdf in batches:
            flat: list[int] = []
            for text in pdf["text"]:
                for w in text.split():
                    i = raw.get(w)
                    if i is None:
                        i = raw[w] = ids.get(core(w), -1)
                    flat.append(i)
                flat += gap
            if len(raw) > 300_000:
                raw.clear()
            at = np.array(flat, dtype=np.int64)
            keys = []
            for d in range(1, SPAN + 1):
                x, y = at[:-d], at[d:]
                both = (x >= 0) & (y >= 0)
                keys += [x[both] * v + y[both], y[both] * v + x[both]]
            pair, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pd.DataFrame({"x": pair // v, "y": pair % v, "n": n})

    return run


def _times(shared, size: int):
    """Row sums of the table (x, y, w) times the matrix `shared`, a part of them a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(shared.value)
        for pdf in batches:
            x, order = pdf["x"].to_numpy(), np.argsort(pdf["x"].to_numpy(), kind="stable")
            if len(order):
                starts = np.flatnonzero(np.diff(x[order], prepend=-1))
                total[x[order][starts]] += np.add.reduceat(shared.value[pdf["y"].to_numpy()[order]] * pdf["w"].to_numpy()[order][:, None], starts)
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"x": at, "v": list(total[at].astype(np.float32))})

    return run


def skip_gram(texts: DataFrame, words: list[str]) -> dict[str, np.ndarray]:
    """Unit vectors of `words`, learnt from all pairs of them within SPAN words of each other in `texts`.

    Skip-gram with NEGATIVES draws of noise a pair has its optimum where a word's vector times a neighbour's is their
    pointwise mutual information less log NEGATIVES, so the vectors are found as the leading factors of that table, of
    its positive cells: a randomised factorisation, whose products with the table run where its rows are. The table
    stays distributed; the driver holds VECTOR + SPARE numbers a word, and words are bounded by VOCABULARY.
    """
    if not words:
        return {}
    v, spark = len(words), texts.sparkSession
    pairs = texts.select("text").mapInPandas(_pair_counts(words), "x bigint, y bigint, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))
    pairs = cut(pairs)
    often = np.zeros(v)
    for r in pairs.groupBy("x").agg(F.sum("n").alias("n")).collect():
        often[r["x"]] = r["n"]
    total, noise = max(often.sum(), 1.0), often**0.75
    noise /= max(noise.sum(), 1e-9)
    held = spark.sparkContext.broadcast((often, noise))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, noise = held.value
        for pdf in batches:
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            w = np.log(pdf["n"].to_numpy() / (often[x] * noise[y])) - math.log(NEGATIVES)
            yield pd.DataFrame({"x": x, "y": y, "w": w})[w > 0]

    table = cut(pairs.mapInPandas(cells, "x bigint, y bigint, w double"))
    held.unpersist()

    def product(matrix: np.ndarray, turned: bool = False) -> np.ndarray:
        shared = spark.sparkContext.broadcast(matrix)
        rows = (table.select(F.col("y").alias("x"), F.col("x").alias("y"), "w") if turned else table).mapInPandas(_times(shared, v), "x bigint, v array<float>")
        out = np.zeros_like(matrix)
        for r in rows.groupBy("x").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(matrix.shape[1])]).alias("v")).collect():
            out[r["x"]] = r["v"]
        shared.unpersist()
        return out

    size = min(VECTOR + SPARE, v)
    left = np.linalg.qr(product(np.random.default_rng(11).normal(size=(v, size))))[0]
    for _ in range(PASSES):
        left = np.linalg.qr(product(np.linalg.qr(product(left, True))[0]))[0]
    u, s, _ = np.linalg.svd(product(left, True).T, full_matrices=False)
    found = ((left @ u)[:, :VECTOR] * np.sqrt(s[:VECTOR])).astype(np.float32)
    unit = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return {w: unit[i] for i, w in enumerate(words)}


def _texts(blotter: DataFrame, calibration: DataFrame) -> DataFrame:
    a = blotter.select(F.lit("scan_blotter").alias("source_table"), F.col("record_id").cast("string").alias("row_key"), F.col("narrative_summary").alias("text"), F.lit(False).alias("page"))
    b = calibration.select(F.lit("ocr_calibration").alias("source_table"), F.col("source_file").alias("row_key"), F.col("ocr_text").alias("text"), F.lit(True).alias("page"))
    return spread(a.unionByName(b).filter("text IS NOT NULL"))


def read_pages(texts: DataFrame, repair: bool = True) -> DataFrame:
    """source_table, row_key, repaired_text (NULL without `repair`) and found (line_no, word_no, kind) of every row of `texts`.

    Empty texts stay empty and nothing is found in them; repeated rows keep a row each; NULL texts must be
    left out. Headers, counts and vectors come from all rows.
    """
    headers, lexicon = learn(texts)
    shared = texts.sparkSession.sparkContext.broadcast((headers, lexicon.counts, lexicon.floor, lexicon.vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, counts, floor, vectors = shared.value
        known, words = Headers(forms), Lexicon(counts, floor, vectors)
        for pdf in batches:
            repaired, found = [], []
            for text, is_page in zip(pdf["text"], pdf["page"]):
                page = read_page(text, known, words, is_page)
                repaired.append(reflow(page, words) if repair else None)
                found.append([(i + 1, k, kind) for (i, k), kind in sorted(page.found.items())])
            yield pd.DataFrame({"source_table": pdf["source_table"], "row_key": pdf["row_key"], "repaired_text": repaired, "found": found})

    return texts.mapInPandas(run, "source_table string, row_key string, repaired_text string, found array<struct<line_no:int,word_no:int,kind:string>>")


def found_noise(blotter: DataFrame, calibration: DataFrame) -> DataFrame:
    """source_table, row_key, line_no, word_no and kind of all that is to be repaired."""
    return read_pages(_texts(blotter, calibration), False).select("source_table", "row_key", F.explode("found").alias("f")).select("source_table", "row_key", "f.line_no", "f.word_no", "f.kind")


def repaired(blotter: DataFrame, calibration: DataFrame) -> DataFrame:
    """source_table, row_key and the running paragraphs of every non-NULL text."""
    return read_pages(_texts(blotter, calibration)).drop("found")
