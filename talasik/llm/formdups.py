"""Copies of a record that differ in form only (problem 4).

Every row gets a canonical hash. Each partition builds Bloom filters of the hashes it saw once
and of those it saw again; merged, a bit of the repeat filter is set if a partition saw a hash
twice or two partitions set the bit. Rows that miss the repeat filter are singletons and are
never shuffled; the others are grouped by the SHA-256 of their canonical text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talasik.operators.skew import skew_join
from talasik.session import cut

#: Labels of the entry form's fields (fixed values: date, time, place, amount and facts in four languages).
FIELD_LABELS = (
    "petsa", "date", "aldo", "oras", "time", "lugar", "place", "lugal", "dapit", "halaga", "amount", "alaga", "kantidad",
    "salaysay", "facts", "salese", "sugilanon",
)
BITS_PER_ROW = 12
PROBES = 4
#: One shard of the filter has so many bits (1 MiB).
SHARD_BITS = 1 << 23
#: So many shards (64 MiB) are broadcast at a time.
WAVE_SHARDS = 64
#: Hashes a partition holds before it hands their bits on.
FLUSH_ROWS = 2_000_000

_INK = r"[^\p{L}\p{N}\p{M}]+"


def bare(column: Column) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(column), _INK, "")


def field_order_free(column: Column, labels: tuple[str, ...] = FIELD_LABELS) -> Column:
    """Bare text whose labelled fields are in a fixed order; text before the first label stays first.

    A label is one of `labels` in any case that a colon, dash or equals sign follows.
    """
    names = "|".join(labels)
    label = rf"(?iU)(?<![\p{{L}}\p{{N}}])({names})(?=\s*[:=\-–—])"
    parts = F.transform(F.split(F.regexp_replace(column, label, "\u0001$1"), "\u0001"), bare)
    ordered = F.concat_ws("|", F.slice(parts, 1, 1), F.array_sort(F.slice(parts, 2, F.size(parts))))
    # most texts hold no label, which a plainer pattern can tell
    return F.when(column.rlike(rf"(?i)(?:{names})[\s\p{{Z}}]*[:=\-–—]"), ordered).otherwise(bare(column))


def part_order_free(column: Column) -> Column:
    """Bare parts (runs of letters and digits) in alphabetical order."""
    return F.concat_ws(" ", F.array_sort(F.filter(F.split(F.lower(column), _INK), lambda p: p != "")))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash, by double hashing."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)])


def _test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits `at` are set in a packed bitmap."""
    at = at.astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _pack(at: np.ndarray, bits: int) -> bytes:
    """The set bits `at` (sorted, each once): their gaps while they are few, else the packed bitmap."""
    if at.size * 32 < bits:
        return b"s" + zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)
    flags = np.zeros(bits, dtype=bool)
    flags[at] = True
    return b"d" + zlib.compress(np.packbits(flags).tobytes(), 1)


def _set_bits(data: bytes, bits: int) -> np.ndarray:
    """The positions that `_pack` was given."""
    raw = zlib.decompress(data[1:])
    if data[:1] == b"s":
        return np.cumsum(np.frombuffer(raw, dtype=np.uint32).astype(np.int64))
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=bits))


def _bitmap(data: bytes, bits: int) -> np.ndarray:
    """The packed bitmap of `_pack`'s result, one bit a bit."""
    if data[:1] == b"d":
        return np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8)
    flags = np.zeros(bits, dtype=bool)
    flags[_set_bits(data, bits)] = True
    return np.packbits(flags)


def filter_shape(rows: int) -> tuple[int, int]:
    """(shards, bits of a shard) of the filters of so many rows."""
    need = max(1 << 10, rows * BITS_PER_ROW)
    shards = -(-need // SHARD_BITS)
    return shards, SHARD_BITS if shards > 1 else need


def _sharded(df: DataFrame, h: str, shards: int) -> DataFrame:
    return df.withColumn("_shard", F.pmod(F.xxhash64(h), F.lit(shards)).cast("int"))


def repeat_filter(hashes: DataFrame, rows: int) -> tuple[DataFrame, int, int]:
    """(shard, bitmap) of the hashes that occur more than once, with the shards and bits of one.

    `hashes` has one bigint column h. No hash that repeats is missed. A partition holds back FLUSH_ROWS hashes,
    sorts them by shard and hands on the few bits that each shard got, so its memory and what it hands on don't
    depend on the number of shards. A shard holds SHARD_BITS / BITS_PER_ROW rows whatever the input.
    """
    shards, bits = filter_shape(rows)

    def bits_of(shard: np.ndarray, h: np.ndarray) -> pd.DataFrame:
        pairs, counts = np.unique(np.stack([shard.astype(np.int64), h.view(np.int64)]), axis=1, return_counts=True)
        starts = np.flatnonzero(np.diff(pairs[0], prepend=-1))
        with np.errstate(over="ignore"):
            at = _positions(np.ascontiguousarray(pairs[1]).view(np.uint64), bits).astype(np.int64)
        out = []
        for a, b in zip(starts, [*starts[1:], pairs.shape[1]]):
            out.append((int(pairs[0, a]), _pack(np.unique(at[:, a:b]), bits), _pack(np.unique(at[:, a:b][:, counts[a:b] > 1]), bits)))
        return pd.DataFrame(out, columns=["shard", "once", "again"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= FLUSH_ROWS:
                yield bits_of(*(np.concatenate([p[c].to_numpy() for p in held]) for c in ("_shard", "h")))
                held, n = [], 0
        if n:
            yield bits_of(*(np.concatenate([p[c].to_numpy() for p in held]) for c in ("_shard", "h")))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        once, again = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
        for o, a in zip(pdf["once"], pdf["again"]):
            o = _set_bits(o, bits)
            again[o[once[o]]] = True
            again[_set_bits(a, bits)] = True
            once[o] = True
        return pd.DataFrame({"shard": [key[0]], "bitmap": [_pack(np.flatnonzero(again), bits)]})

    built = _sharded(hashes, "h", shards).mapInPandas(build, "shard int, once binary, again binary")
    return built.groupBy("shard").applyInPandas(merge, "shard int, bitmap binary"), shards, bits


def possible_repeats(df: DataFrame, h: str, rows: int) -> DataFrame:
    """Rows of `df` whose hash may occur more than once; no such row is missed.

    The filters of WAVE_SHARDS shards at a time are broadcast (64 MiB at most), and the rows of those shards are
    tested against them: however many rows there are, only possible repeats leave their partition. A filter takes
    BITS_PER_ROW bits a row, so that a wave serves about 45 million rows; `df` is read once a wave.
    """
    maps, shards, bits = repeat_filter(df.select(F.col(h).alias("h")), rows)
    maps = cut(maps) if shards > WAVE_SHARDS else maps
    sharded = _sharded(df, h, shards)
    schema = sharded.schema
    waves = []
    for first in range(0, shards, WAVE_SHARDS):
        here = F.col("shard").between(first, first + WAVE_SHARDS - 1)
        known = {r["shard"]: bytes(r["bitmap"]) for r in (maps.filter(here) if shards > WAVE_SHARDS else maps).collect()}
        waves.append(sharded.filter(F.col("_shard").between(first, first + WAVE_SHARDS - 1)).mapInPandas(_maybe_repeated(df.sparkSession.sparkContext.broadcast(known), h, bits), schema))
        if shards > WAVE_SHARDS:
            waves[-1] = cut(waves[-1])
    return reduce(DataFrame.unionByName, waves).drop("_shard")


def _maybe_repeated(shared, h: str, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = {s: _bitmap(b, bits) for s, b in shared.value.items()}
        for pdf in batches:
            v, shard = pdf[h].to_numpy().view(np.uint64), pdf["_shard"].to_numpy()
            hit = np.zeros(len(v), dtype=bool)
            with np.errstate(over="ignore"):
                at = _positions(v, bits)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
                bitmap = opened.get(int(shard[own[0]]))
                if bitmap is not None:
                    hit[own] = _test(bitmap, at[:, own]).all(axis=0)
            yield pdf[hit]

    return run


def collapse(df: DataFrame, id_col: str, keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(`id_col`, first_id, copies) of every row in a set of copies, and (first_id, copies) of the sets.

    Rows for which a key is NULL or blank are in no set. A set needs two rows; repeated ids count as
    rows. Singletons never leave their partition. A set holding a large share of the rows is
    aggregated before the shuffle and joined with salt.
    """
    keyed = df.select(F.col(id_col).alias("id"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    for i in range(len(keys)):
        keyed = keyed.filter(F.length(f"k{i}") > 0)
    keyed = keyed.select("id", F.concat_ws("\u0001", *[f"k{i}" for i in range(len(keys))]).alias("form")).withColumn("h", F.xxhash64("form"))
    # what is kept of a row is its id and the 256 bits that stand for its form
    keyed = cut(keyed.select("id", "h", F.unhex(F.sha2("form", 256)).alias("form")))
    some = cut(possible_repeats(keyed, "h", keyed.count()))
    sets = some.groupBy("form").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    members = skew_join(some.select("id", "form"), sets, ["form"]).select("id", "first_id", "copies")
    return members.withColumnRenamed("id", id_col), sets.select("first_id", "copies")


def blotter_keys() -> list[Column]:
    said = F.col("narrative_summary")
    return [
        F.when(said.rlike(r"[\p{L}\p{N}\p{M}]"), field_order_free(said)),
        part_order_free(F.col("source_file_page")),
    ]


def found_copies(blotter: DataFrame) -> DataFrame:
    """first_id and copy_id of records entered more than once."""
    members, _ = collapse(blotter, "record_id", blotter_keys())
    return members.filter("record_id <> first_id").select("first_id", F.col("record_id").alias("copy_id")).distinct()


def collapsed(blotter: DataFrame) -> DataFrame:
    """One row per record kept, with the number of its copies (1 for a record entered once or in no set)."""
    members, sets = collapse(blotter, "record_id", blotter_keys())
    later = members.filter("record_id <> first_id").select("record_id").distinct()
    kept = blotter.select("record_id").distinct().join(later, "record_id", "left_anti")
    return kept.join(sets.withColumnRenamed("first_id", "record_id"), "record_id", "left").select("record_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
