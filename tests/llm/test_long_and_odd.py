"""Very long texts, odd characters and clashing columns through every operator, in bounded time."""

import time

from talasik.llm import canonical, formdups, langid, mapping, names, pii, scanrepair

LONG = "a" * 60_000
MANY = "nakita ng tanod ang lalaki sa tulay. " * 4_000


def quick(f, *args, seconds=20):
    began = time.time()
    out = f(*args)
    assert time.time() - began < seconds
    return out


def test_details_of_long_texts():
    assert [s.kind for s in quick(pii.find, f"{LONG} x@{LONG}.com")] in ([], ["EMAIL"])
    assert quick(pii.find, LONG + "@" + "1" * 50_000) == []
    assert [s.kind for s in quick(pii.find, MANY + "si Ana Cruz, 09035559795 @" + MANY)] == ["NAME", "PHONE"]


def test_long_cells():
    d = mapping.Dictionary({"purok 4": 5})
    assert quick(d.best, mapping.place_forms(LONG)) == (0, float("inf")) and quick(d.best, mapping.place_forms("purok 4 " + MANY))[0] == 0
    other = "".join(chr(97 + i * 7 % 26) for i in range(60_000))
    assert quick(names.same_word, other, other[:-1] + "!") == 0.9 and names.same_word(LONG, LONG) == 1.0 and quick(names.same_word, other, other[::-1]) == 0.0
    assert quick(names.plain_name, MANY).startswith("nakita")


def test_long_pages():
    lexicon = scanrepair.Lexicon({"nakita": 500}, 3, {})
    page = quick(scanrepair.read_page, "\n".join([MANY[:90]] * 3_000 + [LONG[:90]]), scanrepair.Headers([]), lexicon)
    assert page.found == {}
    assert scanrepair.read_page(LONG + "\n" + LONG, scanrepair.Headers([]), lexicon).found == {}


def test_long_rows(frame):
    rows = [(1, MANY, LONG, "tl", "x"), (2, LONG, MANY, None, "y"), (3, "\x00\x0c ", "퟿", "", "z")]
    df = frame(rows, "record_id bigint, narrative_summary string, source_file_page string, narrative_lang string, text string")
    assert quick(formdups.found_copies, df).count() == 0
    documents = frame([(1, MANY, "tl"), (2, LONG, "en")], "doc_id bigint, text string, lang string")
    assert quick(lambda: langid.found_languages(df, documents).count()) >= 1
    assert quick(lambda: canonical.canonical_forms(documents).count()) == 2
