"""Names from remarks, masking, keyed digests and column encryption."""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels before names in remarks, words that are no names, titles (fixed values).
LABELS = ("complainants", "complainant", "respondents", "respondent", "nagsusumbong", "ipinagsusumbong", "parties")
NOT_NAMES = ("unknown", "none", "n/a", "na", "n.a", "n.a.", "nil", "unidentified", "unspecified", "wala", "walang")
TITLES = ("mr", "mrs", "ms", "jr", "sr", "ii", "iii")
PREFIX = "v1:"


def names_in(remarks: Column) -> Column:
    """Names after labels such as 'Complainant:', up to four words each; none for NULL.

    Remarks are clauses parted by semicolons; a clause that begins with a label lists names. What stands in parentheses
    is no part of one.
    """
    clauses = F.split(F.regexp_replace(remarks, r"\([^)]*\)", ""), ";")
    labelled = F.filter(clauses, lambda c: F.contains(c, F.lit(":")) & F.lower(F.regexp_extract(c, r"([^\s:,]+)\s*:", 1)).isin(*LABELS))
    listed = F.transform(labelled, lambda c: F.regexp_replace(F.substring_index(c, ":", -1), r"(?i)\s(?:and|&)\s|/", ","))
    parts = F.transform(F.split(F.array_join(listed, ","), ","), lambda x: F.btrim(F.btrim(x), F.lit(".")))
    words = lambda x: F.size(F.split(x, r"\s+"))
    name = lambda x: words(x).between(2, 4) | ((words(x) == 1) & (F.length(x) > 2) & ~F.lower(x).isin(*NOT_NAMES))
    return F.coalesce(F.filter(parts, name), F.array().cast("array<string>"))


def _mask(text: str | None, names: list[str] | None, placeholder: str) -> str | None:
    if not text or names is None or not len(names):
        return text
    wanted = set(names)
    for n in names:
        wanted |= {t for w in n.split() if len(t := w.strip(".,")) > 2 and t.lower() not in TITLES}
    longest = sorted(wanted, key=lambda w: (-len(w), w))
    return regex.sub(r"(?i)\b(?:" + "|".join(map(regex.escape, longest)) + r")\b", placeholder, text)


def masked(text: Column, names: Column, placeholder: str = "[PERSON]") -> Column:
    """The text with every name, and every word of one, replaced; longer names first, all in one pass."""

    @F.pandas_udf("string")
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_mask(a, b, placeholder) for a, b in zip(t, n)], dtype=object)

    return run(text, names)


def key_from_environment(name: str = "TALASIK_KEY") -> bytes:
    """The 32-byte key; there is no default, a missing one is an error."""
    value = os.environ.get(name)
    if not value:
        raise RuntimeError(f"set {name} to a secret of your own")
    return hashlib.blake2b(value.encode(), digest_size=32, person=b"talasik-column").digest()


def digest(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex of the stripped, lower-case text; NULL for blanks. The key is no part of the plan."""

    @F.pandas_udf("string")
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: hmac.new(key, v.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return keyed(F.when(F.length(F.trim(text)) > 0, F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))))


def _secret(text: Column, key: bytes) -> Column:
    """The key beside every row, made on the executor: as a literal it would be in plans and event logs."""

    @F.pandas_udf("binary")
    def held(values: pd.Series) -> pd.Series:
        return pd.Series([key] * len(values), dtype=object)

    return held(text)


def encrypted(text: Column, key: bytes, column: str) -> Column:
    """AES-GCM with the column's name as associated data, marked 'v1:'; what is encrypted already stays.

    `text` must be a column: a literal would be folded and share one nonce between rows.
    """
    sealed = F.aes_encrypt(text, _secret(text, key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(column.encode()))
    return F.when(text.startswith(PREFIX), text).otherwise(F.concat(F.lit(PREFIX), F.base64(sealed)))


def decrypted(text: Column, key: bytes, column: str) -> Column:
    """The inverse; text without the mark passes, a wrong key, column or byte raises."""
    opened = F.aes_decrypt(F.unbase64(F.substring(text, len(PREFIX) + 1, 1 << 30)), _secret(text, key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(column.encode()))
    return F.when(text.startswith(PREFIX), opened.cast("string")).otherwise(text)


#: Lines of a form, old or new, whose value is a name, a contact or an address (fixed values).
NAME_LINES = ("COMPLAINANT", "RESPONDENT", "A. PANGALAN NG NAG-BLO-BLOTTER/NAGREREKLAMO", "B. PANGALAN NG INIREREKLAMO", "PANGALAN NG SUMULAT NG SALAYSAY", "PANGALAN")
CONTACT_LINES, ADDRESS_LINES = ("CONTACT NO.",), ("TIRAHAN",)
_LINE = regex.compile(rf"(?m)^(\s*({'|'.join(map(regex.escape, NAME_LINES + CONTACT_LINES + ADDRESS_LINES))})\s*: ?)(.*)$")


def _names(value: str) -> list[str]:
    """As `names_in`, of one value that stands after a label."""
    listed = regex.sub(r"(?i)\s(?:and|&)\s|/", ",", regex.sub(r"\([^)]*\)", "", value.split(";")[0]))
    parts = [p.strip().strip(".") for p in listed.split(",")]
    return [p for p in parts if 2 <= len(p.split()) <= 4 or len(p.split()) == 1 and len(p) > 2 and p.lower() not in NOT_NAMES]


def _redact(text: str | None, blank: str, placeholder: str) -> str:
    if not text:
        return ""
    hits = [(m[2], v) for m in _LINE.finditer(text) if (v := m[3].strip()) and v != blank]
    out = _mask(_LINE.sub(lambda m: m[1] + placeholder, text), [n for label, v in hits if label in NAME_LINES for n in _names(v)], placeholder)
    for contact in sorted({v for label, v in hits if label in CONTACT_LINES}, key=lambda v: (-len(v), v)):
        out = regex.sub(rf"(?i){regex.escape(contact)}", lambda _: placeholder, out)
    return out


def redact_names(text: Column, placeholder: str = "[REDACTED]") -> Column:
    """A rendered form with the values of its name, contact and address lines masked, and wherever else they stand
    the names, every word of one and the contacts, longest first; '' for NULL."""
    from talasik.operators.forms import BLANK

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([_redact(x, BLANK, placeholder) for x in t], dtype=object)

    return run(text)
