"""Encoding against the tokenizer itself, packing against its rules."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talasik.llm import encode, packing

pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no tokenizers")


def chunked(text, cuts, enc, piece):
    parts, at = [], 0
    for end in sorted({c for c in cuts if 0 < c < len(text)} | {len(text)}):
        c = text[at:end]
        tail = encode.open_pieces(c, [m.span() for m in encode._pattern().finditer(c)])
        parts.append((c, enc.encode_ordinary(c), len(c) - tail[0][0], sum(len(piece(c[a:b])) for a, b in tail)))
        at = end
    return parts


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c'  \n\t12,.!sdtñ é😀revl")), min_size=1, max_size=80), st.lists(st.integers(0, 80), max_size=12))
def test_joins_are_exact(text, cuts):
    enc = encode.encoding("byte_bpe_50k", encode.TOKENIZERS)
    piece = encode._piece_encoder(enc)
    assert encode.join_chunks(chunked(text, cuts, enc, piece), piece) == enc.encode_ordinary(text)


def test_contraction_across_a_cut():
    enc = encode.encoding("byte_bpe_50k", encode.TOKENIZERS)
    piece = encode._piece_encoder(enc)
    for text in ("they're", "we'll go", "a   b", "  \n\n x", "'re", "l'l'll"):
        assert encode.join_chunks(chunked(text, range(len(text)), enc, piece), piece) == enc.encode_ordinary(text)


def test_corpus(frame):
    random.seed(1)
    passage = "Nagtungo sa barangay ang nagrereklamo upang isumbong ang pangyayari noong Lunes. " * 40
    texts = [None, "", "x", "<|endoftext|>", passage, passage + "😀", "word " * 5000, "a" * 3000, passage]
    rows = [(i, t, "uid") for i, t in enumerate(texts)] + [(4, passage, "again"), (None, "null id", "z")]
    got = encode.encode_corpus(frame(rows, "doc_id bigint, text string, uid string")).collect()
    enc = encode.encoding("byte_bpe_50k", encode.TOKENIZERS)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in got) == sorted((i is None, i or 0, enc.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode.encode_corpus(frame([], "doc_id bigint, text string")).count() == 0


def test_hot_chunk_is_joined_with_salt(frame, monkeypatch):
    from talasik.operators import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    rows = [(i, "the same text " * 30 if i % 2 else f"text {i} " * 20) for i in range(200)]
    enc = encode.encoding("byte_bpe_50k", encode.TOKENIZERS)
    got = {r.doc_id: list(r.ids) for r in encode.encode_corpus(frame(rows, "doc_id bigint, text string"), bits=5).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in rows}


def totals(rows):
    bins = {}
    for r in rows:
        bins[r.container_id] = bins.get(r.container_id, 0) + r.n_units
    return bins


def test_packing_rules(frame):
    random.seed(5)
    sizes = [random.choice([1, 3, 40, 700, 1024, 1500, 2047, 2048, 2049, 5000]) for _ in range(400)] + [0, None, -3]
    df = frame([(i, s) for i, s in enumerate(sizes)], "doc_id bigint, size bigint")
    rows = packing.pack(df, "doc_id", "size").collect()
    assert max(totals(rows).values()) <= packing.CAPACITY
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert {i: sum(x.n_units for x in v) for i, v in by_doc.items()} == {i: max(s or 0, 0) for i, s in enumerate(sizes)}
    assert all(len(v) == 1 for i, v in by_doc.items() if (sizes[i] or 0) <= packing.CAPACITY)
    whole = sum(max(s or 0, 0) for s in sizes)
    assert len(totals(rows)) <= whole / packing.CAPACITY * 1.12 + 1


def test_packing_empty_and_ties(frame):
    assert packing.pack(frame([], "doc_id bigint, size bigint"), "doc_id", "size").count() == 0
    rows = packing.pack(frame([(1, 1024)] * 4, "doc_id bigint, size bigint"), "doc_id", "size").collect()
    assert totals(rows) == {r.container_id: 2048 for r in rows} and len(totals(rows)) == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), max_size=8))
def test_plan_covers_the_histogram(counts):
    plan = packing.plan_containers(counts, 20)
    seen = {}
    for pattern, bins in plan:
        assert sum(pattern) <= 20
        for s in pattern:
            seen[s] = seen.get(s, 0) + bins
    assert seen == counts
    first_fit: list[int] = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        k = next((k for k, used in enumerate(first_fit) if used + s <= 20), None)
        first_fit = [*first_fit, s] if k is None else [u + s * (i == k) for i, u in enumerate(first_fit)]
    assert sum(b for _, b in plan) <= len(first_fit) + 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c'  \n\t12,.é r  ")), min_size=1, max_size=60))
def test_tails_found_from_the_end(text):
    pat = encode._pattern()
    whole = [m.span() for m in pat.finditer(text)]
    near = [m.span() for m in pat.finditer(text, encode.last_starts(text))]
    assert near == whole[len(whole) - len(near) :] and encode.open_pieces(text, near) == encode.open_pieces(text, whole)


def fewest(items, capacity, best=None):
    """Least number of containers, by trying every place for every item, largest first."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, r in {r: k for k, r in enumerate(rooms)}.items():
            if k >= items[i]:
                place(i + 1, [x - items[i] if n == r else x for n, x in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 12), st.integers(1, 20)), max_size=9))
def test_dominance_keeps_the_optimum(items):
    counts = {s: items.count(s) for s in set(items)}
    fixed, rest = packing.dominance(counts, 20)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(items, 20)


def test_dominance_of_three():
    fixed, rest = packing.dominance({12: 1, 5: 1, 3: 2}, 20)
    assert fixed[0] == ((12, 5, 3), 1) and sum(len(p) * n for p, n in fixed) + sum(rest.values()) == 4
    assert packing.dominance({9: 2, 5: 2, 4: 3}, 19)[0] == []  # {9, 9} and {9, 5, 5}: neither dominates


def test_counts_are_lengths(frame):
    rows = [(1, None), (2, ""), (3, "Nagtungo sa barangay. " * 90), (4, "x " + "Nagtungo sa barangay. " * 90), (4, "x")]
    df = frame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, encode.count_corpus(df, bits=5).collect())) == sorted((r.doc_id, len(r.ids)) for r in encode.encode_corpus(df, bits=5).collect())
