"""Parties, reference lists, copies and consensus."""

import random
from functools import partial

import pytest

from talasik.llm import consensus, formdups, mapping, names

PLACES = [(5, "Purok 4"), (6, "Purok 4B"), (15, "Sitio Malinawan"), (17, "Sitio Piñahan"), (23, "Hiraya Homes Phase 1"), (24, "Hiraya Homes Phase 2"), (34, "Masigla Public Market"), (36, "Tricycle Terminal East"), (37, "Tricycle Terminal West"), (42, "Relocation Site A"), (28, "Makulay Compound")]
STATES = [(1, "Filed"), (2, "Settled"), (3, "For Hearing"), (4, "Dismissed")]


def test_entries(frame):
    typed = {
        "prk#4": 5, "Purok IV": 5, "Purok apat B": 6, "P-4": 5, "36/B Purok 4": 5, "Pur0k 4b": 6, "Purok 27": 0, "Malinawan": 15, "St. Malinawan": 15, "Sitio PiÃ±ahan": 17, "Hiraya Ph. 1": 23, "Hiraya-Homes-Phase-2": 24,
        "Hiraya Towers": 0, "Masigla Mkt": 34, "Tricycle Term. West": 37, "bandang tricycle terminal east": 36, "Reloc. A": 42, "Compound, Makulay": 28, "Makulay Coompound (looban)": 28, "N/A": 0, "?": 0, "malapit sa ilog": 0,
    }
    rows = [(i, p, None) for i, p in enumerate(typed)] + [(100, "Purok 4", "Filed"), (101, None, "  "), (102, "", "naka-file na!"), (103, None, "sttld 2026"), (104, None, "pls check"), (105, None, "Dissmissed"), (106, "  ", "4 HEARING")]
    blotter = frame(rows, "record_id bigint, location_purok string, status string")
    got = {(r.record_id, r.field): r.ref_id for r in mapping.found_entries(blotter, frame(PLACES, "place_id int, place_name string"), frame(STATES, "status_id int, status_name string")).collect()}
    places = {p: got.pop((i, "location_purok")) for i, p in enumerate(typed)}
    assert places == typed
    assert got == {(102, "status"): 1, (103, "status"): 2, (104, "status"): 0, (105, "status"): 4, (106, "status"): 3}


def test_long_lists_give_the_same(frame, monkeypatch):
    typed = ["Sitio Malinawam", "highway", "Purok 4", None, "Tricycle Terminal Wset", "Malinawan", "Compound, Makulay", "Makulay Coompound", "Hiraya Ph. 1", "Hiraya", "prk 4b, Brgy. Masigla", "Masigla Mkt", "Term. West", "Relocation", "x" * 5000, "Sitio Malinawan"]
    cells = frame(list(enumerate(typed)), "record_id bigint, value string")
    twice = [*PLACES, (50, "Sitio Malinawan")]
    refs = frame(twice, "id int, name string")
    got = []
    for most in (100, 3):
        monkeypatch.setattr(mapping, "MAX_BROADCAST_ENTRIES", most)
        for own in ("", "masigla"):
            got.append(sorted((r.record_id, r.ref_id, r.distance) for r in mapping.mapped(cells, refs, "id", "name", partial(mapping.place_forms, own_place=own), mapping.PLACE_KINDS).collect()))
    assert got[:2] == got[2:] and {(r, i) for r, i, _ in got[1]} >= {(0, 15), (1, 0), (4, 37), (6, 28), (7, 28), (8, 23), (9, 0), (10, 6), (11, 34), (13, 0), (14, 0)}
    assert len(got[0]) == 13 and mapping.map_values(cells.limit(0), dict(PLACES), mapping.place_forms).count() == 0
    with pytest.raises(ValueError):
        mapping.mapped(cells, refs, "id", "name", mapping.place_forms, glossary={"a": "b"})


def test_own_barangay_is_learnt(frame):
    typed = ["Purok 4, Brgy. Tahimik", "prk 4, barangay tahimik", "Sitio Malinawan Tahimik", "Purok 4, Brgy. Iba", "Brgy. Tahimik"]
    blotter = frame([(i, t, None) for i, t in enumerate(typed)], "record_id bigint, location_purok string, status string")
    got = {r.record_id: r.ref_id for r in mapping.found_entries(blotter, frame(PLACES, "place_id int, place_name string"), frame(STATES, "status_id int, status_name string")).collect()}
    assert got == {0: 5, 1: 5, 2: 15, 3: 0, 4: 0}


LISTED = dict(enumerate("Filed|Settled|For Hearing|Dismissed|Withdrawn|Referred to Police|Ongoing Mediation|Certified to File Action|Closed|Archived".split("|"), 1))


@pytest.mark.parametrize("typed, meant", [
    ("naka-file na", 1), ("sttld", 2), ("amicably settled", 2), ("4 hrng", 3), ("didinggin pa", 3), ("w/drawn", 5), ("ref. to pulis", 6), ("on-going med.", 7), ("may CFA na", 8), ("cert. to file action", 8),
    ("file action", 8), ("case closed", 9), ("naka-arkibo", 10), ("pls check", 0), ("wala pa", 0), ("not indicated", 0), ("see page 2 of the old book", 0), ("c/o secretary", 0), ("?", 0),
])
def test_statuses_by_word(typed, meant):
    d = mapping.Dictionary(mapping.spellings_of(LISTED, frozenset()), {}, mapping.WordList(LISTED, mapping.STATUS_WORDS))
    assert d.best(mapping.status_forms(typed))[0] == meant


COPIES = [
    (1, "PETSA: 05-25-2024\nORAS: 1:20 AM\nSALAYSAY: Nilason daw, ang manok.", "LB1_2.jpg, p. 1", "x"),
    (2, "SALAYSAY = NILASON DAW ANG MANOK | ORAS = 1:20 am | PETSA = 05-25-2024", "p 1 lb1_2 JPG", "x"),
    (3, "PETSA: 05-25-2024\nORAS: 1:20 AM\nSALAYSAY: Nilason daw, ang manok.", "LB1_2.jpg, p. 5", "x"),
    (4, "manok ang daw Nilason", "LB1_2.jpg, p. 1", "x"), (5, " ", "LB1", "x"), (6, " ", "LB1", "x"), (7, "a", None, "x"), (8, "a", None, "x"), (9, "Pag-usap na", "q", "x"), (10, "pagusap NA!", "Q", "x"), (11, "pagusapna", "q.", "x"),
]


def test_copies(frame):
    df = frame(COPIES, "record_id bigint, narrative_summary string, source_file_page string, h string")
    assert sorted(map(tuple, formdups.found_copies(df).collect())) == [(1, 2), (9, 10), (9, 11)]
    assert {r.record_id: r.copies for r in formdups.collapsed(df).collect()} == {1: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 3}
    assert formdups.found_copies(df.limit(0)).count() == 0


def test_filter_misses_no_repeat(spark, monkeypatch):
    random.seed(2)
    values = [random.randrange(-(2**63), 2**63) for _ in range(4000)]
    repeated = values[:300] + [values[0]] * 500
    df = spark.createDataFrame([(v,) for v in values + repeated], "h bigint").repartition(7)
    rows = df.count()
    for bits, flush in ((formdups.SHARD_BITS, formdups.FLUSH_ROWS), (4096, 100), (512, 1000)):
        monkeypatch.setattr(formdups, "SHARD_BITS", bits)
        monkeypatch.setattr(formdups, "FLUSH_ROWS", flush)
        shards, _ = formdups.filter_shape(rows)
        assert (shards > formdups.WAVE_SHARDS) == (bits == 512)  # the last goes through several waves
        kept = [r.h for r in formdups.possible_repeats(df, "h", rows).collect()]
        assert set(values[:300]) <= set(kept) and len(set(kept)) < 500
        assert kept.count(values[0]) == 502 and kept.count(values[5]) == 2


def test_copies_through_many_waves(frame, monkeypatch):
    df = frame(COPIES, "record_id bigint, narrative_summary string, source_file_page string, h string")
    monkeypatch.setattr(formdups, "SHARD_BITS", 16)
    monkeypatch.setattr(formdups, "WAVE_SHARDS", 2)
    assert sorted(map(tuple, formdups.found_copies(df).collect())) == [(1, 2), (9, 10), (9, 11)]


def test_consensus_beats_the_majority(frame, monkeypatch):
    random.seed(4)
    types = ["Theft", "Robbery", "Noise", "Other"]
    good, swap = [f"g{i}" for i in range(6)], [f"s{i}" for i in range(3)]
    truth, rows, blotter = {}, [], []
    for r in range(500):
        t = truth[r] = random.choice(types[:3])
        for e in random.sample(good, 3) + random.sample(swap, 1) if r % 5 < 3 else random.sample(good, 1) + random.sample(swap, 2):
            said = t if random.random() < 0.95 else random.choice(types)
            if e in swap:
                said = {"Theft": "Robbery", "Robbery": "Theft"}.get(t, "Other")
            rows.append((r, e, said.upper() + "  ", "High", None))
        blotter.append((r, "g0", None, None, None, None))
    labels = frame(rows, "record_id bigint, encoder_code string, incident_type string, label_confidence string, labelled_at timestamp")
    base = frame(blotter, "record_id bigint, encoded_by string, incident_type string, label_confidence string, second_encoder string, second_encoder_label string")
    ref = frame([(i, t) for i, t in enumerate(types)], "type_id int, type_name string")
    got = {r.record_id: r.incident_type for r in consensus.found_types(base, labels, ref).collect()}
    assert len(got) > 400 and sum(truth[r] == t for r, t in got.items()) / len(got) > 0.93
    rated = {r.annotator: r.accuracy for r in consensus.reliability(base, labels, ref).collect()}
    assert min(rated[g] for g in good) > 0.8 and max(rated[s] for s in swap) < 0.4
    again = {r.record_id: r.incident_type for r in consensus.found_types(base, labels, ref).collect()}
    assert again == got


def test_joined_accuracies_are_the_same(frame, monkeypatch):
    random.seed(8)
    votes = frame([(r, a, random.choice("xxy") if a != "d" else "z", random.choice(["none", "high"])) for r in range(30) for a in "abcd"], "record_id bigint, annotator string, label string, sure string")
    records = consensus.grouped(votes).cache()
    monkeypatch.setattr(consensus, "ROUNDS", 4)
    monkeypatch.setattr(consensus, "STEADY", 3)
    monkeypatch.setattr(consensus, "TOLERANCE", 0.0)
    got = []
    for most, held in ((1000, 1000), (0, 3)):
        monkeypatch.setattr(consensus, "MAX_SHARED", most)
        monkeypatch.setattr(consensus, "HELD", held)
        with pytest.warns(UserWarning):
            state, rated, stable = consensus.fit(records, 3)
        assert not stable and (state.table is None) == (most > 0)
        got.append({r.annotator: (r.n_compared, round(r.accuracy, 9)) for r in rated.collect()})
    assert got[0] == got[1] and len(got[0]) == 4


def test_consensus_becomes_stable(frame):
    votes = frame([(r, a, "x" if (r + k) % 3 else "y", "none") for r in range(12) for k, a in enumerate("abcd")], "record_id bigint, annotator string, label string, sure string")
    assert consensus.fit(consensus.grouped(votes), 3)[2]


def test_last_label_counts(frame):
    labels = frame([(1, "e", "Theft", None, 1), (1, "e", "robbery ", None, 2), (1, "e", None, None, 3), (1, None, "Theft", None, 1), (2, "e", None, None, 1), (1, "e", "robbery ", None, 2)], "record_id bigint, encoder_code string, incident_type string, label_confidence string, s int")
    labels = labels.selectExpr("record_id", "encoder_code", "incident_type", "label_confidence", "timestamp_seconds(s) AS labelled_at")
    base = frame([(1, "e", " Theft", "High", None, None), (3, None, None, None, None, None)], "record_id bigint, encoded_by string, incident_type string, label_confidence string, second_encoder string, second_encoder_label string")
    votes = sorted((r.record_id, r.annotator, r.label) for r in consensus.votes_of(base, labels).collect())
    assert votes == [(1, "?", "theft"), (1, "e", "robbery"), (1, "e", "theft")]
    assert consensus.alpha(consensus.votes_of(base.limit(0), labels.limit(0))).first()["alpha"] is None


def test_alpha(frame):
    votes = frame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "a"), (3, "b"), (4, "a")], "record_id bigint, label string")
    observed, expected = 2 / 6, 1 - (3 * 2 + 3 * 2) / 30
    assert abs(consensus.alpha(votes).first()["alpha"] - (1 - observed / expected)) < 1e-8


def test_linkage_against_brute_force(frame):
    random.seed(9)
    n = 14
    scores = {(i, j): round(random.random(), 3) for i in range(n) for j in range(i + 1, n) if random.random() < 0.4}
    clusters = [{i} for i in range(n)]

    def mean(a, b):
        return round(sum(scores.get((min(x, y), max(x, y)), 0) for x in a for y in b) / (len(a) * len(b)), 9)

    while True:
        best = min(((-mean(a, b), min(min(a), min(b)), max(min(a), min(b)), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), default=(0,))
        if -best[0] < 0.4:
            break
        i, j = best[3:]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] | clusters[j]]
    nodes, links = frame([(i,) for i in range(n)], "id bigint"), frame([(a, b, s) for (a, b), s in scores.items()], "a bigint, b bigint, score double")
    got = {}
    for r in names.average_linkage(nodes, links, 0.4).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, clusters))


def test_cosine_join_misses_no_pair(frame):
    random.seed(3)
    words = ["".join(random.choice("bdgkl") + random.choice("aeiou") for _ in range(4)) for _ in range(60)]
    rows = [(i, f"maria {w if random.random() < 0.7 else w[:3] + w[4:]}") for i, w in enumerate(words * 2)]
    givens = names.Givens(["maria"], {})
    got = {(r.a, r.b): r.cosine for r in names.cosine_pairs(frame(rows, "id bigint, name string"), givens, 0.4).collect()}
    import math
    from collections import Counter

    sets = {i: names.features(t, givens) for i, t in rows}
    df = Counter(g for s in sets.values() for g in s)
    weigh = {g: math.log((len(rows) + 1) / k) for g, k in df.items()}
    norm = {i: math.sqrt(sum(weigh[g] ** 2 for g in s)) for i, s in sets.items()}
    want = {(i, j): v for i in sets for j in sets if i < j and norm[i] and norm[j] and (v := sum(weigh[g] ** 2 for g in sets[i] & sets[j]) / norm[i] / norm[j]) >= 0.401}
    assert set(want) <= set(got) and all(abs(got[p] - v) < 1e-4 for p, v in want.items())


def _parts(rows, givens):
    for i, t in rows:
        side, word = names.alike_parts(names.parse(t), givens)
        folded = names.fold(word)
        yield i, side, word, folded, names.letters(word), names.letters(folded)


PARTS = "id bigint, side string, word string, folded string, letters bigint, folded_letters bigint"


def test_words_that_can_be_same_are_let_through(frame):
    random.seed(5)
    letters = "abcdegiklnorsuvyzñ'"
    pairs = [("puuvagos", "puyuvagos"), ("luludeg", "luudeg"), ("aabb", "ab"), ("gamma", "gama"), ("o", "o")]
    for _ in range(3000):
        a = b = "".join(random.choice(letters) for _ in range(random.randint(2, 14)))
        for _ in range(random.randint(0, 4)):
            k, c = random.randrange(len(b) + 1), random.choice(letters)
            b = random.choice([b[:k] + c + b[k:], b[:k] + b[k + 1 :] or "a", b[:k] + b[k - 1 : k] + b[k:], b[:k] + b[k + 1 : k + 2] + b[k : k + 1] + b[k + 2 :]])
        pairs.append((a, b))
    side = lambda e: [(i, w, names.fold(w), names.letters(w), names.letters(names.fold(w))) for i, w in enumerate(p[e] for p in pairs)]
    columns = "id bigint, word string, folded string, letters bigint, folded_letters bigint"
    got = {r.id for r in frame(side(0), columns).alias("x").join(frame(side(1), columns).alias("y"), "id").filter(names.may_be_same("x", "y")).select("id").collect()}
    same = {i for i, (a, b) in enumerate(pairs) if names.same_word(a, b) > 0}
    assert len(same) > 500 and same <= got and len(got) < len(pairs) * 0.95
    assert [names.Shape.of(a).like(names.Shape.of(b)) for a, b in pairs] == [names.same_word(a, b) >= 0.8 for a, b in pairs]


def test_tasks_share_what_was_looked_up():
    lists = names.Givens(["maria", "jose"], {"pepe": ["jose"]}).lists()
    one, two = names.Givens.of(lists), names.Givens.of((list(lists[0]), dict(lists[1])))
    assert one is two and one.means("pepe") == {"jose"} and names.Givens.of((["maria"], {})).means("pepe") == frozenset()


def test_pairs_that_cannot_score_leave_the_join(frame):
    givens = names.Givens(["maria"], {})
    rows = list(enumerate(["maria bagongalan", "maria bagongalam", "maria dinagong", "maria bagongalan jr", "bagongalan store", "maria", "maria bagong"]))
    named = frame(rows, "id bigint, name string")
    every = {(r.a, r.b) for r in names.cosine_pairs(named, givens, 0.01).collect()}
    kept = {(r.a, r.b) for r in names.cosine_pairs(named, givens, 0.01, frame(list(_parts(rows, givens)), PARTS)).collect()}
    scored = {(i, j) for i, a in rows for j, b in rows if i < j and names.score(names.parse(a), names.parse(b), givens) > 0}
    assert kept == scored == {(0, 1)} and kept < every


def test_parties(frame):
    given = ["Maria", "Jose", "Francisco", "Ofelia", "Nestor"]
    filler = [(f"{g} {s}", None) for g in given for s in ("Bagong", "Wokulat", "Rimasug", "Dofelak", "Tungolas", "Peyarat", "Sikumol", "Vanidor")]
    same = ["Francisco V. Lapasedin", "LAPASEDIN, FRANCISCO V", "Franncisco V. Lapasedin", "Mang Francisco V. Lapasedin, 09035559795", "F. V. Lapasedin"]
    apart = ["Francisco V. Lapasedin Jr.", "Francisco V. Lapasedin Sr.", "Ofelia V. Lapasedin", "Lapasedin Rice Trading", "Unknown", "N/A", "-", " ", None]
    df = frame(filler + [(a, None) for a in same] + [(None, a) for a in apart] + [(same[0], same[0])], "reporting_party string, respondent string")
    got = {(r.name_a, r.name_b) for r in names.found_pairs(df).collect()}
    assert got == {(a, b) for a in same for b in same if a < b}
    assert names.found_pairs(df.limit(0)).count() == 0


def test_tied_links_all_merge(frame):
    n = 60
    nodes, links = frame([(i,) for i in range(n)], "id bigint"), frame([(i, j, 0.9) for i in range(n) for j in range(i + 1, n)], "a bigint, b bigint, score double")
    assert len({r.cluster for r in names.average_linkage(nodes, links).collect()}) == 1


def test_merged_nodes_count_by_size(frame):
    links = frame([(1, 2, 0.9), (2, 3, 0.8)], "a bigint, b bigint, score double")
    one = names.average_linkage(frame([(1, 1), (2, 1), (3, 1)], "id bigint, n bigint"), links, 0.5).collect()
    two = names.average_linkage(frame([(1, 1), (2, 3), (3, 1)], "id bigint, n bigint"), links, 0.5).collect()
    assert len({r.cluster for r in one}) == 2 and len({r.cluster for r in two}) == 1


def test_party_of_many_spellings(frame):
    given = ["Maria", "Jose", "Francisco", "Ofelia", "Nestor"]
    filler = [(f"{g} {s}", None) for g in given for s in ("Bagong", "Wokulat", "Rimasug", "Dofelak", "Tungolas", "Peyarat", "Sikumol", "Vanidor")]
    same = [f"{t} {n}" for t in sorted(names.TITLES)[:25] for n in ("Francisco V. Lapasedin", "Lapasedin, Francisco V")]
    got = {(r.name_a, r.name_b) for r in names.found_pairs(frame(filler + [(a, None) for a in same], "reporting_party string, respondent string")).collect()}
    assert got == {(a, b) for a in same for b in same if a < b}


def test_given_names_meant():
    g = names.Givens(["eduardo", "vicente", "victorina", "lourdes", "pablito", "ramon", "maria", "jose"], {"bening": ["beatriz"]})
    for word, meant in {"edong": "eduardo", "vte": "vicente", "lds": "lourdes", "lito": "pablito", "rmn": "ramon", "viconte": "vicente", "ma": "maria", "eduard": "eduardo"}.items():
        assert meant in g.means(word), word
    assert g.same("vte", "viconte") >= 0.8 and g.same("jose", "maria") == 0.0 and not g.means("xu")
    nick = names.score(names.parse('o. "ofing" lapasedin'), names.parse("ofelia lapasedin"), names.Givens(["ofelia"], {"ofing": ["ofelia"]}))
    assert nick > 0 and names.score(names.parse('n. "ofelia" lapasedin'), names.parse("ofelia lapasedin"), names.Givens(["ofelia", "nestor"], {})) > 0


@pytest.mark.parametrize("a, b", [("luludeg", "luudeg"), ("puuvagos", "puyuvagos"), ("gayyegafal", "gayegafal"), ("kosakong", "kosakonge")])
def test_slips_beside_double_letters(a, b):
    assert names.same_word(a, b) >= 0.75
