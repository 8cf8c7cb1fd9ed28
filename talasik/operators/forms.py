"""The blotter form as text: rendering slots into it and reading it back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form's lines: (opens a section, label, slot); prose blocks have a heading and no label (fixed values).
LINES = (
    (True, "NO.", "blotter_no"), (True, "PETSA NG PAGBLOTTER", "date_reported"),
    (True, "A. PANGALAN NG NAG-BLO-BLOTTER/NAGREREKLAMO", "reporting_party"), (False, "TIRAHAN", "complainant_address"), (False, "CONTACT NO.", "complainant_contact"), (False, "EDAD", "complainant_age"),
    (True, "B. PANGALAN NG INIREREKLAMO", "respondent"), (False, "TIRAHAN", "respondent_address"), (False, "CONTACT NO.", "respondent_contact"), (False, "EDAD", "respondent_age"),
    (True, "C. REKLAMO", "complaint"),
    (True, "D. KAGANAPAN NG PANGYAYARI", None), (False, "PETSA", "date"), (False, "ORAS", "time"), (False, "LUGAR", "location_purok"),
    (True, "LAGDA NG SUMULAT NG SALAYSAY", None), (False, "PANGALAN NG SUMULAT NG SALAYSAY", "statement_writer"), (False, "PETSA", "statement_date"), (False, "ORAS", "statement_time"),
    (True, "(MGA) TESTIGO", None), (False, "PANGALAN", "witness"), (False, "EDAD", "witness_age"), (False, "TIRAHAN", "witness_address"), (False, "CONTACT NO.", "witness_contact"),
    (True, "PANGALAN NG BARANGAY DESK OFFICER / IMBESTIGADOR", "desk_officer"),
    (True, "KATAYUAN", "status"),
)
STORY, ACTION, SIGNED = "E. SALAYSAY", "AKSYONG GINAWA", "LAGDA NG SUMULAT NG SALAYSAY"
HEADING, RULE, BLANK = "BLOTTER FORM", "=" * 50, "(not stated on page)"
#: The older form, read but no longer rendered: heading, labels, and the headings of its two blocks of prose (fixed values).
OLD_HEADING, OLD_STORY, OLD_ACTION = "BARANGAY BLOTTER ENTRY", "NARRATION OF FACTS", "ACTION TAKEN"
OLD_LINES = (("DATE OF INCIDENT", "date"), ("TIME OF INCIDENT", "time"), ("PLACE OF INCIDENT", "location_purok"), ("COMPLAINANT", "reporting_party"), ("RESPONDENT", "respondent"), ("STATUS", "status"))
SLOTS = tuple(s for _, _, s in LINES if s) + ("incident_summary", "action_taken")


def _widths() -> dict[int, int]:
    """Width of every line's label: consecutive lines of a kind line up their colons."""
    out, group = {}, []
    for i, (opens, label, slot) in enumerate((*LINES, (True, "", None))):
        inside = slot and not opens or label in TOP
        if group and (not inside or (label in TOP) != (LINES[group[0]][1] in TOP)):
            wide = max(len(LINES[k][1]) for k in group)
            out |= dict.fromkeys(group, wide)
            group = []
        if inside:
            group.append(i)
    return out


#: Labels at the head of the form (fixed values).
TOP = ("NO.", "PETSA NG PAGBLOTTER")


def rendered(slots: dict[str, Column]) -> Column:
    """One form as text; blank slots read '(not stated on page)'."""
    value = lambda s: F.coalesce(F.nullif(F.trim(slots.get(s, F.lit(None).cast("string"))), F.lit("")), F.lit(BLANK))
    wide = _widths()
    out: list[Column] = [F.lit(f"{HEADING}\n{RULE}")]
    for i, (opens, label, slot) in enumerate(LINES):
        if label == SIGNED:
            out += [F.lit(f"\n\n{STORY}\n"), value("incident_summary")]
        if label == "KATAYUAN":
            out.append(F.lit(f"\n\n{RULE}"))
        parted = opens and label not in (*TOP, "KATAYUAN")
        head = label if opens and label not in TOP else label.ljust(wide.get(i, 0))
        out.append(F.lit(f"\n{chr(10) if parted else ''}{'' if opens else '   '}{head}"))
        if slot:
            out += [F.lit(" : "), value(slot)]
    return F.concat(*out, F.lit(f"\n\n{ACTION}\n"), value("action_taken"))


class _Layout:
    """What a line may be in one of the forms: a slot's label within its section, or the heading of a block of prose."""

    def __init__(self, story: str, action: str, after_story: str | None, fields: list[tuple[str, str, str]], sections: frozenset[str]) -> None:
        self.blocks = {story: "incident_summary", action: "action_taken"}
        self.after_story, self.fields, self.sections = after_story, {(section, label): slot for section, label, slot in fields}, sections


def _layouts() -> dict[str, _Layout]:
    fields, section = [], ""
    for opens, label, slot in LINES:
        section = label if opens else section
        if slot:
            fields.append((section, label, slot))
    new = _Layout(STORY, ACTION, SIGNED, fields, frozenset(label for opens, label, _ in LINES if opens))
    return {HEADING: new, OLD_HEADING: _Layout(OLD_STORY, OLD_ACTION, None, [(label, label, slot) for label, slot in OLD_LINES], frozenset(label for label, _ in OLD_LINES))}


_LAYOUTS = _layouts()


def _told(value: str) -> str:
    """A slot's value without rules of = and white space around it; '' for what wasn't stated."""
    kept = "\n".join(x for x in value.split("\n") if not x.strip() or x.strip("= \t\r")).strip()
    return "" if kept == BLANK else kept


def read_forms(text: str | None) -> list[dict[str, str]]:
    """Every form in the text, new or old, as slots; text without a heading has none.

    Lines are read once. A block of prose goes on to the heading that ends it, whatever labels it holds: the story to
    the signature or the action taken, the action to the end of the form.
    """
    forms: list[dict[str, str]] = []
    layout, section, block, prose = None, "", "", {}
    for line in (text or "").splitlines():
        bare = line.strip().upper()
        head = bare.removesuffix(":").rstrip()
        if bare in _LAYOUTS:
            layout, section, block, prose = _LAYOUTS[bare], "", "", {}
            forms.append(dict.fromkeys(SLOTS, "") | {"_prose": prose})
        elif layout is None:
            continue
        elif head in layout.blocks and layout.blocks[head] not in prose and block != "action_taken":
            block = layout.blocks[head]
            prose[block] = []
        elif block == "incident_summary" and head == layout.after_story:
            block, section = "", head
        elif block:
            prose[block].append(line)
        else:
            label, colon, value = line.partition(":")
            label = label.strip().upper()
            section = label if label in layout.sections else section
            slot = layout.fields.get((section, label))
            if colon and slot:
                forms[-1][slot] = _told(value)
    for form in forms:
        for slot, lines in form.pop("_prose").items():
            form[slot] = _told("\n".join(lines))
    return forms


def first_form(text: Column) -> Column:
    """Slots of the first form in the text as a struct; NULL without one."""

    @F.pandas_udf(", ".join(f"{s} string" for s in (*SLOTS, "is_form")))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(read_forms(t) if t and _MAY_HOLD.search(t) else []) for t in texts]
        return pd.DataFrame([{**(r[0] if r else dict.fromkeys(SLOTS)), "is_form": "y" if r else None} for r in rows], columns=[*SLOTS, "is_form"])

    form = run(text)
    return F.when(form["is_form"].isNotNull(), form)


_MAY_HOLD = regex.compile(rf"(?mi)^\s*(?:{HEADING}|{OLD_HEADING})\s*$")


def parsed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, entry number and slots of every form in the text; rows without one give none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *[f[s] for s in SLOTS]) for k, t in zip(pdf[key], pdf[text]) for i, f in enumerate(read_forms(t), 1)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "entry_no", *SLOTS])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, entry_no int, {', '.join(f'{s} string' for s in SLOTS)}")
