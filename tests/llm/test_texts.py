"""Canonical forms, personal details, languages and scanned pages."""

import pytest

from talasik.llm import canonical, langid, pii, scanrepair


def test_canonical_forms(frame):
    rows = [
        (1, "the bahay ay dito"), (2, "thе bаhаy"), (3, "ｂａｈａｙ dito"), (4, "piña g̃"), (5, "ba​hay dito ﻿"), (6, "\U0001f468‍\U0001f469‍\U0001f467"),
        (7, "Вершина 5 kΩ"), (8, None), (9, ""), (10, "x"), (11, "zаzq"), (12, "a‍b"), (2, "thе bаhаy"),
    ]
    df = frame([(i, t, "clash", "clash") for i, t in rows], "doc_id bigint, text string, uid string, kinds string")
    out = canonical.canonical_forms(df).collect()
    got = {r.doc_id: (r.canonical_text, sorted(r.kinds), list(r.unattested)) for r in out}
    assert len(out) == len(rows)
    assert got[2] == ("the bahay", ["lookalike"], []) and got[3] == ("bahay dito", ["fullwidth"], [])
    assert got[4] == ("piña g̃", ["combining"], []) and got[5] == ("bahay dito ", ["invisible", "space"], [])
    assert got[6][1] == [] and got[6][0] == rows[5][1] and got[7] == ("Вершина 5 kΩ", [], [])
    assert got[8] == (None, [], []) and got[9] == ("", [], []) and got[10][1] == []
    assert got[11] == ("zаzq", ["lookalike"], ["zаzq"]) and got[12] == ("ab", ["invisible"], [])
    assert canonical.found_kinds(frame([], "doc_id bigint, text string")).count() == 0


def test_kinds_found_are_those_of_the_sql(frame):
    import duckdb

    from talasik.llm.sql import SQL

    # without a twin, of two letters, not attested, and none at all
    texts = ["zЖz", "5 kΩ", "5 ΜG", "привeт", "Вершина 10 Ω", "thе bаhаy", "a-Жb", "zа\u200bz", "ｂａｈａｙ", "x\u0301\u0416", "", None, "plain"]
    df = frame(list(enumerate(texts)), "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = sorted((r.doc_id, r.kind) for r in canonical.found_kinds(df).collect())
    assert got == sorted(con.execute(SQL["p10_found"]).fetchall())
    assert [i for i, k in got if k == "lookalike"] == [0, 1, 2, 3, 5, 6, 7, 9]


def kinds(text, party=False):
    return [(s.kind, text[s.start : s.end]) for s in pii.find(text, party)]


@pytest.mark.parametrize("text, expected", [
    ("Maaaring tawagan si Quirino Gebuca sa numerong 0903 555 9795 para sa", [("NAME", "Quirino Gebuca"), ("PHONE", "0903 555 9795")]),
    ("The witness was victorina galegas who lives at B3 L1 Banaba St.", [("NAME", "victorina galegas"), ("ADDRESS", "B3 L1 Banaba St")]),
    ("Please coordinate with R. Legalatang, (036) 555-2657 or a.b@mail.example.", [("NAME", "R. Legalatang"), ("PHONE", "(036) 555-2657"), ("EMAIL", "a.b@mail.example")]),
    ("Kasama niya noon sina Ofelia Gepeli at Nestor Cruz sa tabi ng poso.", [("NAME", "Ofelia Gepeli"), ("NAME", "Nestor Cruz")]),
    ("Ipinakita niya ang kanyang ID na may numerong 9986-9332-6012-0021 sa desk", [("ID", "9986-9332-6012-0021")]),
    ("PETSA: 2023-05-08 HALAGA: P36,150.00 ORAS: 5:05 PM", []),
    ("pumunta sa bahay blg. 71, kalye Waling-Waling ngunit", [("ADDRESS", "bahay blg. 71, kalye Waling-Waling")]),
    ("sent to tubemug_eduardo at koreo dot test last", [("EMAIL", "tubemug_eduardo at koreo dot test")]),
])
def test_details(text, expected):
    assert kinds(text) == expected


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


@pytest.mark.parametrize("right, wrong", [("4539578763621486", "4539578763621487"), ("4539 5787 6362 1486", "4539 5787 6362 1487"), ("GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33")])
def test_checksum_decides(right, wrong):
    """Without a word that says what the number is, only the checksum tells it from any other."""
    assert kinds(f"Nakasulat doon ang {right} at wala nang iba.") == [("ID", right)] and kinds(f"Nakasulat doon ang {wrong} at wala nang iba.") == []


def test_phone_shape_beats_a_chance_checksum():
    numbers = [f"639{n:09d}" for n in range(100_000_000, 100_004_000, 2)]
    assert all(kinds(f"ang kard, tawag sa {n} po") == [("PHONE", n)] for n in numbers)


@pytest.mark.parametrize("text, party, expected", [
    ("Nagpunta sa #313 Banaba St. ngunit walang tao", False, [("ADDRESS", "#313 Banaba St.")]), ("pumunta sa Blk 6 Lot 26, Dapdap St.. Hindi", False, [("ADDRESS", "Blk 6 Lot 26, Dapdap St.")]),
    ("nakatira sa B15 L27 Banaba St. Misaad ang", False, [("ADDRESS", "B15 L27 Banaba St")]), ("Ana Cruz, No. 371 Dapdap Ext., 0901.555.8724", True, [("ADDRESS", "No. 371 Dapdap Ext."), ("PHONE", "0901.555.8724")]),
    ("nakatira sa 110-B Dapdap Road.", False, [("ADDRESS", "110-B Dapdap Road")]), ("Tinuru ne i Sita a maki tatalnan", False, [("NAME", "Sita")]),
])
def test_ends_of_addresses(text, party, expected):
    assert kinds(text, party) == expected


def test_details_of_rows(frame):
    rows = [(1, "tawagan si Ana Cruz sa numerong 09035559795 o 09035559795", "Ana Cruz - 740-250-247-000", None), (2, None, "", "x" * 5000), (1, "same id", None, None)]
    df = frame(rows, "record_id bigint, narrative_summary string, reporting_party string, respondent string").withColumnRenamed("record_id", "record_id")
    got = sorted((r.record_id, r.field, r.pii_type, r.pii_text) for r in pii.found_details(df).collect())
    assert got == [(1, "narrative_summary", "NAME", "Ana Cruz"), (1, "narrative_summary", "PHONE", "09035559795"), (1, "reporting_party", "ID", "740-250-247-000")]
    shown = {r.narrative_summary for r in pii.redacted(df).collect()}
    assert "tawagan si [NAME] sa numerong [PHONE] o [PHONE]" in shown and None in shown
    assert pii.found_details(df.limit(0)).count() == 0


TL = "Nagtungo sa barangay ang nagrereklamo upang isumbong ang pangyayari noong Lunes."
EN = "The respondent did not appear although notices had already been sent to the family."
CEB = "Miadto sa barangay ang nagreklamo aron ipahibalo ang nahitabo niadtong Sabado."
PAM = "Minta ya king barangay ing mireklamu ban sabian na ing milyari aniang Martis."


def test_languages(frame):
    docs = frame([(i, t, c) for i in range(40) for t, c in ((f"{TL} {i}", "tl"), (f"{EN} {i}", "en"), (f"{CEB} {i}", "ceb"), (f"{PAM} {i}", "pam"))] + [(99, None, None)], "doc_id bigint, text string, lang string")
    rows = [(1, TL, "Filipino"), (2, EN, "tl"), (3, f"{TL} {EN} {EN} {PAM}", "tl"), (4, CEB, None), (5, "  ", "en"), (6, None, "en"), (7, EN, "en-PH"), (8, "12345 !!", ""), (9, TL, "und")]
    df = frame(rows, "record_id bigint, narrative_summary string, narrative_lang string")
    got = sorted((r.record_id, r.seg_no, r.lang) for r in langid.found_languages(df, docs).collect())
    assert got == [(2, 1, "en"), (3, 1, "tl"), (3, 2, "en"), (3, 3, "pam"), (4, 1, "ceb"), (9, 1, "tl")]
    assert all(0 < r.confidence <= 1 for r in langid.languages(df, docs).collect())
    assert langid.found_languages(df.limit(0), docs.limit(0)).count() == 0


def test_held_out_accuracy(spark, small):
    """On narratives whose label is known, the first segment agrees with most labels (some are wrong on purpose)."""
    from pyspark.sql import functions as F

    from talasik.session import table

    got = langid.identified(langid.narratives_of(table(spark, small, "scan_blotter")), table(spark, small, "documents")).filter("declared IS NOT NULL AND size(segments) = 1")
    assert got.agg(F.avg((F.col("declared") == F.col("segments")[0]["lang"]).cast("double"))).first()[0] > 0.75


def lexicon():
    words = {"pinalakihin": 300, "nakita": 400, "siya": 900, "sari-sari": 300, "store": 300, "hindi": 900, "upang": 500, "hangtod": 300}
    return scanrepair.Lexicon(words, 3, {})


@pytest.mark.parametrize("seen, meant", [("riakita", "nakita"), ("siy@", "siya"), ("bindi", "hindi"), ("hincli", "hindi"), ("vpang", "upang"), ("siya", None), ("kalabaw", None), ("512", None)])
def test_misread_words(seen, meant):
    assert scanrepair._meant(lexicon(), seen, [seen], 0) == meant


def test_page():
    text = "TANGGAPAN NG BARANGAY   Pahina 7\nhindi siy@ riakita sa sari-\nsari store upang pinalak-\nTANGGAPAN NG BARANGAY\n- 8 -\nihin hindi siya nakita\n\nhindi siya nakita 3:4o"
    page = scanrepair.read_page(text, scanrepair.Headers(["TANGGAPAN NG BARANGAY"]), lexicon())
    found = {(i + 1, k): v for (i, k), v in page.found.items()}
    assert found == {(1, 0): "header", (2, 2): "misread", (2, 3): "misread", (2, 5): "hyphen_break", (3, 4): "hyphen_break", (4, 0): "header", (5, 0): "page_number", (8, 4): "misread"}
    assert scanrepair.reflow(page, lexicon()) == "hindi siya nakita sa sari-sari store upang pinalakihin hindi siya nakita\n\nhindi siya nakita 3:40"


@pytest.mark.parametrize("line", ["[133]", "— 182 —", "- 222 -", "171", "pg 199", "Page 171 of 177", "p. 181", "Pahina blg. 50", "Pah1na 12"])
def test_page_numbers(line):
    assert scanrepair.is_page_number(line)


@pytest.mark.parametrize("line", ["P3,100", "siya 12", "", "3 buwan", "12:30 PM", "2,750"])
def test_no_page_numbers(line):
    assert not scanrepair.is_page_number(line)


def test_pages_of_rows(frame):
    blotter = frame([(1, None), (2, ""), (3, "typed in one line"), (4, "x\n" * 3)], "record_id bigint, narrative_summary string")
    pages = frame([("a", "LOGBOOK NG MGA\nhindi siya\n[4]"), ("b", None)], "source_file string, ocr_text string")
    got = {(r.source_table, r.row_key): r.repaired_text for r in scanrepair.repaired(blotter, pages).collect()}
    assert len(got) == 4 and got["scan_blotter", "3"] == "typed in one line" and got["scan_blotter", "2"] == ""
    assert {(r.line_no, r.kind) for r in scanrepair.found_noise(blotter, pages).collect()} == {(3, "page_number")}
    assert scanrepair.found_noise(blotter.limit(0), pages.limit(0)).count() == 0


def test_glyph_distances():
    assert scanrepair.glyph_distance("nakita", "riakita") == 1 and scanrepair.glyph_distance("nakita", "bakita") == float("inf")
    assert scanrepair.glyph_distance("madaling", "rnadalin9") == 2 and scanrepair.glyph_distance("", "") == 0 and scanrepair.glyph_distance("a", "") == float("inf")
    assert scanrepair.glyph_distance("a" * 50_000, "a" * 49_999 + "@") == 1


def test_skip_gram_neighbours(frame):
    """Words used alike get vectors alike, against the same table factorised in one piece."""
    import numpy as np

    texts = frame([(f"{a} {b} {c}",) for a in ("aso", "pusa") for b in ("kumain", "natulog", "tumakbo") for c in ("sala", "kusina")] * 5 + [(f"{a} {b}",) for a in ("piso", "salapi") for b in ("utang", "bayad")] * 5, "text string")
    words = sorted({"aso", "pusa", "kumain", "natulog", "tumakbo", "sala", "kusina", "piso", "salapi", "utang", "bayad"})
    got = scanrepair.skip_gram(texts, words)
    assert got["aso"] @ got["pusa"] > 0.95 and got["piso"] @ got["salapi"] > 0.95 and got["aso"] @ got["piso"] < 0.3
    pairs = np.zeros((len(words), len(words)))
    for t in [r.text.split() for r in texts.collect()]:
        for i in range(len(t)):
            for j in range(max(0, i - scanrepair.SPAN), min(len(t), i + scanrepair.SPAN + 1)):
                if i != j:
                    pairs[words.index(t[i]), words.index(t[j])] += 1
    often = pairs.sum(axis=1)
    noise = often**0.75 / (often**0.75).sum()
    with np.errstate(divide="ignore"):
        table = np.maximum(np.log(pairs / (often[:, None] * noise[None, :])) - np.log(scanrepair.NEGATIVES), 0)
    u, s, _ = np.linalg.svd(table)
    want = u[:, : scanrepair.VECTOR] * np.sqrt(s[: scanrepair.VECTOR])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    mine = np.array([got[w] for w in words])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-4)
    assert scanrepair.skip_gram(texts, []) == {}


def test_one_long_line_changes_nothing():
    text = "hindi siy@ riakita\nhindi siya nakita\nsiya hindi\n[4]"
    for extra in ("", "\n" + "hindi siya nakita " * 9):
        page = scanrepair.read_page(text + extra, scanrepair.Headers([]), lexicon())
        assert {(1, 2), (1, 3), (4, 0)} <= {(i + 1, k) for i, k in page.found}
    assert scanrepair.read_page("PETSA: x\nhindi siy@ dito", scanrepair.Headers([]), lexicon()).found == {}
    assert scanrepair.read_page("PETSA: x\nhindi siy@ dito", scanrepair.Headers([]), lexicon(), True).found == {(1, 2): "misread"}
    assert scanrepair.read_page("hindi\n" + "x" * 50 + "riakita siy@", scanrepair.Headers([]), lexicon()).found[1, 2] == "misread"


def test_lookalikes_in_other_scripts(frame):
    pure, odd = "\u043f\u0435\u0440\u0435\u0446", "\u043f\u0065\u0070\u0435\u0446"
    rows = [(1, pure), (2, f"a {odd}"), (3, "p\u0435ace"), (4, "peace"), (5, "x\u0434y")]
    got = {r.doc_id: (r.canonical_text, list(r.kinds), list(r.unattested)) for r in canonical.canonical_forms(frame(rows, "doc_id int, text string")).collect()}
    assert got[2] == (f"a {pure}", ["lookalike"], []) and got[3] == ("peace", ["lookalike"], [])
    assert got[5] == ("x\u0434y", ["lookalike"], ["x\u0434y"]) and got[1] == (pure, [], [])
