"""Personal details inside free text (problem 5).

Patterns propose spans with a base score, the checksum of the number's kind and nearby context words move
it, and spans that reach THRESHOLD are kept, the better of two that overlap winning. Everything happens inside one row,
so no row is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talasik.session import spread

THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
CONTEXT = 48
TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")

_EMAIL = regex.compile(
    r"(?i)(?<![\w.+-])[a-z0-9][\w.+-]{0,63}?\s?(?:@|\(at\)|\[at\]|\sat\s)\s?(?:[a-z0-9-]+(?:\.|\sdot\s|\(dot\)))+[a-z]{2,}\b(?:\.[a-z]{2,}\b)*"
)
#: What every phone and identity number, and every address, holds.
_LONG_NUMBER = re.compile(r"\d[\d\s().-]{5,}\d")
_STREET_WORD = re.compile(r"\b(?:st|street|ave|avenue|road|rd|lane|ln|ext|extension|drive|dr|blvd|boulevard|alley|kalye)\b")
_SPELT_DOT = regex.compile(r"(?i)\sdot\s|\(dot\)")
_PHONE = regex.compile(
    r"(?<![\w.-])(?:(?:\+?63[\s.-]?|0)9\d{2}[\s.-]?\d{3}[\s.-]?\d{2}\s?\d{2}|\(0\d{1,3}\)\s?\d{3,4}[\s-]\d{4})(?![\w-]|\.\d)"
)


def luhn(digits: str) -> bool:
    """Check digit of card numbers."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(number: str) -> bool:
    """Check digits of account numbers that begin with two letters and them (ISO 13616), letters counting from 10."""
    turned = number[4:] + number[:4]
    return len(number) > 4 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def mod11(digits: str) -> bool:
    """Check digit of a 9-digit tax number by weights 9 down to 2."""
    return len(digits) >= 9 and sum(int(d) * w for d, w in zip(digits, range(9, 1, -1))) % 11 % 10 == int(digits[8])


#: Shapes of identity numbers: base score, the checksum such numbers carry if any, and what it adds (fixed values).
_IDS = [
    (regex.compile(r"(?<![\w-])" + p + r"(?![\w]|-\d)"), base, check, gain)
    for p, base, check, gain in (
        (r"\d{2}-\d{7}-\d", 0.6, None, 0), (r"\d{3}-\d{3}-\d{3}(?:-\d{3,5})?", 0.5, mod11, 0.15), (r"\d{4}-\d{4}-\d{4}-\d{4}", 0.6, luhn, 0.15), (r"(?i:[A-Z])\d{2}-\d{2}-\d{6}", 0.6, None, 0),
        (r"(?i:[A-Z]\d{7}[A-Z])", 0.5, None, 0), (r"(?i:VIN)-\d{4}-\d{4,5}(?:[A-Z0-9]*)", 0.5, None, 0), (r"\d{2,3}-\d{9}(?:-\d)?", 0.5, None, 0), (r"\d{12}", 0.3, None, 0),
        (r"\d{4}\s\d{4}\s\d{4}\s\d{4}", 0.3, luhn, 0.3), (r"\d{13,19}", 0.3, luhn, 0.3), (r"[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?", 0.2, mod97, 0.6),
    )
]
#: A bare mobile number with its country code.
_BARE_MOBILE = re.compile(r"639\d{9}")
_KIND = r"(?:st|street|ave|avenue|road|rd|lane|ln|ext|extension|drive|dr|blvd|boulevard|alley)"
_STREET = rf"\p{{L}}[\p{{L}}ñ]*(?:-\p{{L}}+)*(?:\s(?-i:\p{{Lu}})\p{{L}}+(?:-\p{{L}}+)*)?\s+{_KIND}\b"
_ADDRESS = regex.compile(
    rf"(?i)(?<![\w-])(?:"
    rf"(?:blk\.?|block|b)\s?\d+,?\s+(?:lot|l)\.?\s?\d+,?\s+{_STREET}"
    rf"|(?:unit\s+[\w-]+,?\s+)?(?:no\.?\s*|#\s?|lot\s+|house\s+(?:no\.?\s*)?)?\d+(?:-\p{{L}})?,?\s+{_STREET}"
    rf"|(?:unit\s+[\w-]+,?\s+)?bahay\s+blg\.?\s*\d+(?:-\p{{L}})?,?\s+kalye\s+\p{{L}}+(?:-\p{{L}}+)*"
    rf")"
)
#: Words before a name in four languages, each with whether several names may follow (fixed values).
_MARKER = regex.compile(
    r"(?i)(?<!\w)(?:(?P<many>sina|nina|kina|at\s+that\s+time|sila\s+si|da\s+di|la\s+di)|si|kay|kang|alyas|a\.k\.a\.|(?:ya|ye|ne|na|re)\s+i|certain|coordinate\s+with|"
    r"witness\s+was|further\s+details|nangngangalang|named)\s+"
)
_TITLE = regex.compile(r"(?i)(?:(?:mrs?|ms|gng|mang|aling|kgwd|kagawad|kap|kapitan|bb|dr|hon|atty|engr|alyas|tatay|nanay|lolo|lola|kuya|ate|ka|g)\.?\s+)+(?=\S)")
_TOKEN = regex.compile(r"[\"“]?\p{L}[\p{L}\p{M}'’-]*[\"”]?\.?")
#: Words that end a name (fixed values).
_ENDS = frozenset(
    "na sa nga a king ing who can were and at ug o or ampo ampong noon noong nang ng ang para lives was had has po daw din said ay mao ni to in on is the by tel of taga from numero "
    "numerong numerung karon kay kaya busa".split()
)
_JOINS = regex.compile(r"(?i)\s+(?:at|ug|and|ampo|ampong)\s+")
_ID_WORDS = regex.compile(r"(?i)\b(?:id|identification|card|numero|numerong|numerung|number|lisensya|passport|no|blg)\b")
_PHONE_WORDS = regex.compile(r"(?i)\b(?:tel|cp|cell|contact|tawag\w*|matawagan|mayaus|numero|numerong|numerung|called|reached|gamit|coordinate|makipag-ugnayan)\b")
_AMOUNT = regex.compile(r"(?i)(?:php|₱|\bp)\s?$")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without white space and punctuation around it; a sign that belongs to the detail stays."""
    while a < b and (text[a].isspace() or text[a] in "\"'“”‘’.,;:!?<>[]{}-/|") or a < b and text[a] == "(" and ")" not in text[a:b]:
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in "\"'“”‘’.,;:!?<>[]{}-/|" or text[b - 1] == ")" and "(" not in text[a:b]):
        b -= 1
    return a, b


def _near(pattern, text: str, a: int, b: int) -> bool:
    return bool(pattern.search(text, max(0, a - CONTEXT), a) or pattern.search(text, b, min(len(text), b + CONTEXT // 2)))


def name_end(text: str, at: int) -> int:
    """End of the name that starts at `at`, or `at` if none does."""
    end, n = at, 0
    first_upper = None
    while n < 6:
        m = _TOKEN.match(text, end if n == 0 else end + len(text[end:]) - len(text[end:].lstrip()))
        if not m or n and m.start() == end:
            break
        token = m.group()
        core = token.strip("\"“”.")
        if core.casefold() in _ENDS and not (token.endswith(".") and len(core) == 1):
            break
        upper = core[:1].isupper()
        if first_upper is None:
            first_upper = upper
        elif first_upper and not upper:
            break
        end, n = m.end(), n + 1
        if token.endswith(".") and len(core) > 4:
            break
    return end


def names(text: str) -> Iterator[Span]:
    for m in _MARKER.finditer(text):
        at = m.end()
        while True:
            title = _TITLE.match(text, at)
            at = title.end() if title else at
            end = name_end(text, at)
            a, b = _trim(text, at, end)
            if b - a < 2:
                break
            own = text[a:b]
            score = 0.6 + 0.2 * (own[0].isupper()) + 0.1 * (" " in own) - 0.4 * own.isdigit()
            yield Span(a, b, "NAME", score)
            join = _JOINS.match(text, end) if m.group("many") else None
            if not join:
                break
            at = join.end()


#: A street's kind, shortened, at the end of an address; and a period after it that doesn't end a sentence as well.
_SHORT_KIND = regex.compile(r"(?i)\b(?:st|ave|rd|ln|ext|dr|blvd)$")
_GOES_ON = regex.compile(r"\.(?:[.,;:)]|\s+[\p{Ll}\d(+])")


def _own_period(text: str, end: int, party: bool) -> bool:
    """Whether the period after an address belongs to its shortened last word rather than to the sentence."""
    if text[end : end + 1] != "." or not _SHORT_KIND.search(text, max(0, end - 6), end):
        return False
    return party or bool(_GOES_ON.match(text, end))


def propose(text: str, party: bool) -> Iterator[Span]:
    """Every candidate span with its score."""
    low = text.lower()
    for m in _EMAIL.finditer(text) if "@" in text or "(at)" in low or "[at]" in low or " dot" in low else ():
        plain = "@" in m.group() or "(at)" in m.group().lower() or "[at]" in m.group().lower()
        yield Span(m.start(), m.end(), "EMAIL", 0.95 if plain else 0.7 if _SPELT_DOT.search(m.group()) else 0.2)
    numbered = bool(_LONG_NUMBER.search(text))
    for m in _PHONE.finditer(text) if numbered else ():
        score = 0.75 + 0.2 * _near(_PHONE_WORDS, text, m.start(), m.end()) - 0.6 * bool(_AMOUNT.search(text[max(0, m.start() - 5) : m.start()]))
        yield Span(m.start(), m.end(), "PHONE", score)
    for pattern, base, check, gain in _IDS:
        for m in pattern.finditer(text) if numbered else ():
            number = "".join(c for c in m.group().upper() if c.isalnum())
            score = base + 0.35 * _near(_ID_WORDS, text, m.start(), m.end()) + (gain if check and check(number) else 0) + 0.25 * party
            if _BARE_MOBILE.fullmatch(number):  # also a phone's shape, which says more than a word nearby
                score = min(score, 0.7)
            yield Span(m.start(), m.end(), "ID", min(score, 0.94))
    for m in _ADDRESS.finditer(text) if _STREET_WORD.search(low) else ():
        yield Span(m.start(), m.end() + _own_period(text, m.end(), party), "ADDRESS", 0.9)
    if not party:
        yield from names(text)


def find(text: str, party: bool = False) -> list[Span]:
    """Non-overlapping details of `text` in order. `party`: the cell is a name, so no NAME is looked for."""
    kept: list[Span] = []
    for s in sorted(propose(text, party), key=lambda s: (-s.score, s.start - s.end, s.start)):
        if s.score < THRESHOLD:
            continue
        a, b = _trim(text, s.start, s.end)
        b = s.end if s.kind == "ADDRESS" and text[b : s.end] == "." else b
        if a < b and not any(a < k.end and k.start < b for k in kept):
            kept.append(Span(a, b, s.kind, s.score))
    return sorted(kept, key=lambda s: s.start)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its typed placeholder."""
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind}]"]
        at = s.end
    return "".join(out) + text[at:]


FIELDS = {"narrative_summary": False, "reporting_party": True, "respondent": True}
_FOUND = "array<struct<field:string,pii_type:string,pii_text:string,score:double>>"


def details(df: DataFrame, fields: dict[str, bool], id_col: str) -> DataFrame:
    """`id_col`, each field with placeholders, and `found` (field, pii_type, pii_text, score), for every row.

    `fields` maps a column to whether it holds a party's name. NULL stays NULL, empty stays empty, both
    without details; repeated rows and ids keep a row each; other columns are ignored.
    """
    names_ = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {id_col: pdf[id_col].tolist(), **{f: [] for f in names_}, "found": []}
            for row in pdf[names_].itertuples(index=False):
                found = []
                for f, text in zip(names_, row):
                    if not text:
                        out[f].append(text)
                        continue
                    spans = find(text, fields[f])
                    out[f].append(redact(text, spans))
                    found += [(f, s.kind, text[s.start : s.end], s.score) for s in spans]
                out["found"].append(found)
            yield pd.DataFrame({c: pd.Series(v, dtype=object if c != id_col else pdf[id_col].dtype) for c, v in out.items()})

    kind = dict(df.dtypes)[id_col]
    rows = df.select(id_col, *names_)
    return spread(rows).mapInPandas(run, f"{id_col} {kind}, {', '.join(f'{f} string' for f in names_)}, found {_FOUND}")


def found_details(blotter: DataFrame) -> DataFrame:
    """record_id, field, pii_type and pii_text of each distinct detail of a field."""
    own = details(blotter, FIELDS, "record_id").select("record_id", F.explode(F.array_distinct(F.transform("found", lambda s: s.dropFields("score")))).alias("s"))
    return own.select("record_id", "s.field", "s.pii_type", "s.pii_text")


def redacted(blotter: DataFrame) -> DataFrame:
    """record_id and the three fields with placeholders."""
    return details(blotter, FIELDS, "record_id").drop("found")
