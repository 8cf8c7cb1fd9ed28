"""Encoding of a whole corpus with a public byte-level BPE (problem 8).

Texts are cut into chunks where a rolling hash of the last WINDOW characters meets a mask, so
equal passages of different documents give equal chunks. Each shared chunk is encoded once, what lies
between shared chunks in its place. Chunk joins are then repaired: from the start of the last pre-token before a join, pre-tokens
are matched again in the joined text until a match ends where the right chunk's own matching
also ends one. From a common start the splitting pattern matches the same way, so from there on
the stored ids are exact; only the pre-tokens before it are encoded again.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talasik.operators.skew import skew_join
from talasik.session import cut, spread, with_row_ids

TOKENIZERS = os.environ.get("TALASIK_TOKENIZERS", "/opt/tokenizers")
#: The splitting pattern that belongs to the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16
_MULTIPLIER = np.uint64(6364136223846793005)


def ship_tokenizer(spark: SparkSession, name: str, folder: str) -> None:
    """Send the rank file to every executor."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _shipped.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(path)
        _shipped[spark.sparkContext.applicationId].add(path)


#: Rank files sent, by application.
_shipped: dict[str, set[str]] = {}


@lru_cache(maxsize=4)
def encoding(name: str, folder: str | None = None):
    """The tokenizer of a rank file, of those shipped if no folder is given; no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken") if folder else SparkFiles.get(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(PATTERN)


def cut_points(texts: list[str], bits: int) -> list[list[int]]:
    """For each text, the ends of its chunks (character offsets, the last is its length)."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    if not lengths.sum():
        return [[] for _ in texts]
    joined = np.concatenate(codes).astype(np.uint64)
    rolling = np.zeros(len(joined), dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(WINDOW, len(joined))):
            rolling[j:] += joined[: len(joined) - j] * power
            power = power * _MULTIPLIER
        rolling ^= rolling >> np.uint64(29)
        rolling *= np.uint64(0xBF58476D1CE4E5B9)
    cuts = np.flatnonzero((rolling >> np.uint64(64 - bits)) == 0) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for i, n in enumerate(lengths.tolist()):
        lo, hi = np.searchsorted(cuts, [starts[i] + WINDOW, starts[i] + n])
        own = (cuts[lo:hi] - starts[i]).tolist()
        out.append(own + [n] if n else [])
    return out


def _chunk_hashes(bits: int):
    """uid, seq and a 128-bit hash of every chunk; chunks themselves stay where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            uid, seq, hashes = [], [], []
            for u, t, ends in zip(pdf["uid"], texts, cut_points(texts, bits)):
                at = 0
                for k, end in enumerate(ends):
                    uid.append(u)
                    seq.append(k)
                    hashes.append(blake2b(t[at:end].encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    at = end
            yield pd.DataFrame({"uid": pd.Series(uid, dtype="int64"), "seq": pd.Series(seq, dtype="int32"), "h": pd.Series(hashes, dtype="object")})

    return run


def _piece_encoder(enc):
    @lru_cache(maxsize=200_000)
    def of(piece: str) -> tuple[int, ...]:
        return tuple(enc.encode_ordinary(piece))

    return of


def _closed(chunk: str, piece, pat) -> tuple[int, int]:
    """Characters and tokens of the pre-tokens at the chunk's end that the next chunk can still change."""
    last = open_pieces(chunk, [m.span() for m in pat.finditer(chunk, last_starts(chunk))])
    return len(chunk) - last[0][0], sum(len(piece(chunk[a:b])) for a, b in last)


def _encode_shared(name: str, bits: int):
    """h, ids and open end of the chunks of `owned` (seq, h): the shared chunks that are encoded from this row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, pat = encoding(name), _pattern()
        piece = _piece_encoder(enc)
        for pdf in batches:
            texts = pdf["text"].tolist()
            hashes, chunks = [], []
            for t, owned, ends in zip(texts, pdf["owned"], cut_points(texts, bits)):
                for o in owned:
                    k = o["seq"]
                    hashes.append(o["h"])
                    chunks.append(t[ends[k - 1] if k else 0 : ends[k]])
            ids = enc.encode_ordinary_batch(chunks, num_threads=1)
            tails = [_closed(c, piece, pat) for c in chunks]
            yield pd.DataFrame({"h": pd.Series(hashes, dtype="object"), "ids": ids, "tail_chars": pd.Series([t[0] for t in tails], dtype="int32"), "tail_tokens": pd.Series([t[1] for t in tails], dtype="int32")})

    return run


def last_starts(text: str, least: int = 3) -> int:
    """A place near the end where a pre-token surely starts, with at least `least` words after it, or 0.

    White space after anything else always starts one: no pre-token goes on from a visible character into white space.
    """
    at = len(text)
    while least and at > 0:
        at = text.rfind(" ", 0, at)
        if at <= 0:
            return 0
        if not text[at - 1].isspace():
            least -= 1
    return max(at, 0)


def open_pieces(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The last pre-tokens, which text that follows can still change.

    That is the last one, and the apostrophe before it where the two could begin 're, 've or 'll.
    """
    if len(spans) > 1 and text[slice(*spans[-1])] in ("r", "v", "l") and text[slice(*spans[-2])] == "'":
        return spans[-2:]
    return spans[-1:]


def join_chunks(parts: list[tuple[str, list[int], int, int]], piece, pat=None) -> list[int]:
    """Exact ids of the text whose consecutive chunks are `parts` (chunk, ids, tail_chars, tail_tokens)."""
    pat = pat or _pattern()
    out: list[int] = []
    tail, tail_n = "", 0
    for chunk, ids, tail_chars, tail_tokens in parts:
        if not out:
            out.extend(ids)
            tail, tail_n = chunk[len(chunk) - tail_chars :], tail_tokens
            continue
        joined, shift = tail + chunk, len(tail)
        own, own_end, dropped = pat.finditer(chunk), 0, 0
        again: list[tuple[int, int]] = []
        met = False
        for m in pat.finditer(joined):
            end = m.end() - shift
            again.append(m.span())
            while 0 <= own_end < end:
                o = next(own, None)
                if o is None:
                    break
                own_end = o.end()
                dropped += len(piece(o.group()))
            # the last match of the joined text may still grow with the next chunk, but so may the chunk's own
            if end >= 0 and own_end == end:
                met = True
                break
        del out[len(out) - tail_n :]
        fresh = [piece(joined[a:b]) for a, b in again]
        for f in fresh:
            out.extend(f)
        end = again[-1][1] - shift
        if met and end < len(chunk) - tail_chars:
            out.extend(ids[dropped:])
            tail, tail_n = chunk[len(chunk) - tail_chars :], tail_tokens
        else:
            if met:
                out.extend(ids[dropped:])
                again += [(m.start() + shift, m.end() + shift) for m in own]
                fresh += [piece(joined[a:b]) for a, b in again[len(fresh) :]]
            last = open_pieces(joined, again)
            tail, tail_n = joined[last[0][0] :], sum(map(len, fresh[len(again) - len(last) :]))
    return out


def assembled(text: str, ends: list[int], shared: dict[int, tuple[list[int], int, int]], enc, piece, pat) -> list[int]:
    """Ids of a text from those of its shared chunks, by number; what lies between them is encoded in one go."""
    parts: list[tuple[str, list[int], int, int]] = []
    at = 0
    for k in sorted(shared):
        begin = ends[k - 1] if k else 0
        for chunk, known in ((text[at:begin], None), (text[begin : ends[k]], shared[k])):
            if chunk:
                parts.append((chunk, *(known or (enc.encode_ordinary(chunk), *_closed(chunk, piece, pat)))))
        at = ends[k]
    if at < len(text):
        parts.append((text[at:], enc.encode_ordinary(text[at:]), 0, 0))
    return join_chunks(parts, piece, pat)


def _assemble(name: str, bits: int, count_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, pat = encoding(name), _pattern()
        piece = _piece_encoder(enc)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            whole = [i for i, p in enumerate(pdf["parts"]) if p is None or not len(p)]
            ids: list = [None] * len(texts)
            for i, own in zip(whole, enc.encode_ordinary_batch([texts[i] for i in whole], num_threads=1)):
                ids[i] = own
            rest = [i for i in range(len(texts)) if ids[i] is None]
            parts = pdf["parts"].tolist()
            for i, ends in zip(rest, cut_points([texts[i] for i in rest], bits)):
                shared = {p["seq"]: (p["ids"].tolist(), p["tail_chars"], p["tail_tokens"]) for p in parts[i]}
                ids[i] = assembled(texts[i], ends, shared, enc, piece, pat)
            yield pd.DataFrame({"key": pdf["key"], "out": pd.Series([len(x) for x in ids], dtype="int32") if count_only else ids})

    return run


def _encoded(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str | None, bits: int, count_only: bool) -> DataFrame:
    ship_tokenizer(df.sparkSession, tokenizer, folder or TOKENIZERS)
    rows = with_row_ids(df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")))
    # 28 bytes a chunk: the only thing of every chunk that is shuffled
    chunks = cut(spread(rows.filter(F.length("text") > 0).select("uid", "text")).mapInPandas(_chunk_hashes(bits), "uid bigint, seq int, h binary"))
    shared = cut(chunks.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("uid", "seq")).alias("owner")).filter("n > 1").select("h", "owner"))
    owned = shared.select("owner.uid", F.struct("owner.seq", "h").alias("o")).groupBy("uid").agg(F.collect_list("o").alias("owned"))
    tasks = df.sparkSession.sparkContext.defaultParallelism * 2
    placed = rows.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uid")
    # both joins read the same columns of `placed`, so that they share its exchange
    encoded = placed.join(owned, "uid").select("key", "text", "owned").mapInPandas(_encode_shared(tokenizer, bits), "h binary, ids array<int>, tail_chars int, tail_tokens int")
    parts = skew_join(chunks, encoded, ["h"]).groupBy("uid").agg(F.collect_list(F.struct("seq", "ids", "tail_chars", "tail_tokens")).alias("parts"))
    kind = dict(rows.dtypes)["key"]
    done = placed.join(parts, "uid", "left").select("key", "text", "parts").mapInPandas(_assemble(tokenizer, bits, count_only), f"key {kind}, out {'int' if count_only else 'array<int>'}")
    return done.select(F.col("key").alias(id_col), F.col("out").alias("n_tokens" if count_only else "ids"))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None, bits: int = 8) -> DataFrame:
    """`id_col` and `ids` (array<int>) of every row of `df`.

    NULL and empty texts give an empty list; rows with a NULL or repeated id are kept apart and
    each gives its own row; other columns are ignored. Chunks have 2**bits characters on average.
    Only hashes of chunks are shuffled to find the shared ones; of these each is encoded once, in the
    row that has it first, and its ids go to the rows that hold it, with salt where these are many. What
    no other row has is encoded where it stands. A text is moved once.
    """
    return _encoded(df, id_col, text_col, tokenizer, folder, bits, False)


def count_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None, bits: int = 8) -> DataFrame:
    """`id_col` and n_tokens of every row of `df`, as `encode_corpus` encodes it."""
    return _encoded(df, id_col, text_col, tokenizer, folder, bits, True)
