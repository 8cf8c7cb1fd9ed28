"""SQL oracles of the problems' queries, where SQL can say them."""

from __future__ import annotations

_TIDY = r"nullif(trim(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g')), '')"
_INVISIBLE = r"[\x{AD}\x{180E}\x{200B}\x{200C}\x{200D}\x{2060}-\x{2064}\x{FEFF}]"
_PICTURE = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"


def _held(text: str) -> str:
    """The text without joiners between pictographs."""
    return rf"regexp_replace({text}, '({_PICTURE})\x{{200D}}({_PICTURE})', '\1\2', 'g')"


P7_ALPHA = f"""
WITH own AS (SELECT record_id, encoded_by AS a, {_TIDY.format('incident_type')} AS label, {_TIDY.format('label_confidence')} AS sure FROM scan_blotter
  UNION SELECT record_id, second_encoder, {_TIDY.format('second_encoder_label')}, NULL FROM scan_blotter),
later AS (SELECT record_id, label FROM (SELECT *, row_number() OVER (PARTITION BY record_id, encoder_code ORDER BY labelled_at DESC NULLS LAST, label) AS k
  FROM (SELECT record_id, encoder_code, labelled_at, {_TIDY.format('incident_type')} AS label FROM encoder_label) WHERE label IS NOT NULL) WHERE k = 1),
votes AS (SELECT record_id, label FROM own WHERE label IS NOT NULL UNION ALL SELECT record_id, label FROM later),
cells AS (SELECT record_id, label, count(*) AS n FROM votes WHERE record_id IS NOT NULL GROUP BY ALL),
units AS (SELECT record_id, sum(n) AS m, sum(n * (n - 1)) AS same FROM cells GROUP BY 1 HAVING sum(n) > 1),
o AS (SELECT count(*) AS records, sum(m) AS total, sum(same / (m - 1)) AS same FROM units),
e AS (SELECT sum(c * (c - 1)) AS expected FROM (SELECT label, sum(n) AS c FROM cells JOIN units USING (record_id) GROUP BY 1))
SELECT records, CAST(total AS BIGINT) AS labels, round(1 - (1 - same / total) / (1 - expected / (total * (total - 1))), 9) AS alpha FROM o, e"""

P10_FOUND = rf"""
WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '{_INVISIBLE}', '', 'g'), '[\x{{FF01}}-\x{{FF5E}}]', 'a', 'g') AS flat, {_held(_held('text'))} AS held FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'fullwidth' AS kind FROM t WHERE regexp_matches(text, '[\x{{FF01}}-\x{{FF5E}}]')
UNION ALL SELECT doc_id, 'combining' FROM t WHERE length(nfc_normalize(flat)) < length(flat)
UNION ALL SELECT doc_id, 'invisible' FROM t WHERE regexp_matches(held, '{_INVISIBLE}')
UNION ALL SELECT doc_id, 'space' FROM t WHERE regexp_matches(text, '[\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]')
UNION ALL SELECT doc_id, 'lookalike' FROM t WHERE regexp_matches(flat, '\p{{Latin}}\p{{M}}*(?:[\p{{L}}\p{{M}}]|[-''’]\p{{L}})*[\p{{Greek}}\p{{Cyrillic}}]|[\p{{Greek}}\p{{Cyrillic}}](?:[\p{{L}}\p{{M}}]|[-''’]\p{{L}})*\p{{Latin}}')"""

SQL = {"p7_alpha": P7_ALPHA, "p10_found": P10_FOUND}
