"""Filling containers of fixed capacity with whole documents (problem 9).

Sizes are whole numbers up to the capacity, so the instance is a histogram with at most
`capacity` entries however many documents there are. Martello-Toth dominance fixes containers on
that histogram, best fit decreasing packs the rest, and both handle all items of a size at once.
Documents are then matched to the planned slots by their rank among documents of their size,
which is found without a sort of any one size in a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talasik.llm.encode import count_corpus
from talasik.session import cut

CAPACITY = 2048
#: Rows that one rank block should hold.
BLOCK_ROWS = 200_000

Plan = list[tuple[tuple[int, ...], int]]


def _fits_none(sums: int, above: int, room: int) -> bool:
    """Whether no reachable sum lies above `above` and within `room`."""
    return not sums >> (above + 1) & ((1 << max(room - above, 0)) - 1)


def _pair_beside(left: dict[int, int], j: int, room: int) -> tuple[int, int] | None:
    """The two further items a <= b that dominate every set beside j, where at most two more fit; None if nothing is proved.

    b is the largest item that fits beside j, a the largest that fits beside both. Every other feasible pair must have
    its smaller item at most a: its larger one is at most b, so each item of the pair is covered by one of its own.
    """
    items = [s for s in sorted(left) if s != j or left[s] > 1]
    own = lambda s: left[s] - (s == j)
    smallest = [s for s in items for _ in range(min(own(s), 3))][:3]
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    b = max((s for s in items if s <= room), default=0)
    a = max((s for s in items if s <= room - b and own(s) > (s == b)), default=0)
    if not a:
        return None
    for r in reversed(items):
        if r <= a:
            break
        if own(r) > 1 and 2 * r <= room or any(r < s <= room - r for s in items):
            return None
    return min(a, b), max(a, b)


def dominance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Fix the containers that provably dominate every alternative; returns them and what remains.

    For the largest item j and the largest k that fits beside it, {j, k} dominates every set with
    j when j + k fills the container, or when no set of further items sums to more than k within
    the free room (checked on all reachable sums). Where at most two items fit beside j, {j, a, b} may
    dominate (`_pair_beside`). An item beside which nothing fits stands alone.
    Sizes for which nothing can be proved are set aside; fixing smaller ones may free them again.
    """
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    fixed: Plan = []
    changed = True
    while changed and left:
        changed = False
        sums = 1
        for s in sorted(left):
            for _ in range(min(capacity // s, left[s])):
                grown = (sums | sums << s) & ((1 << (capacity + 1)) - 1)
                if grown == sums:
                    break
                sums = grown
        for j in sorted(left, reverse=True):
            n = left.get(j, 0)
            if not n:
                continue
            room = capacity - j
            k = max((s for s in left if s <= room and (s != j or n > 1)), default=0)
            if not k:
                pattern = (j,)
            elif k == room or _fits_none(sums, k, room):
                pattern = (j, k)
            elif pair := _pair_beside(left, j, room):
                pattern = (j, *reversed(pair))
            else:
                continue
            # with fewer items there are fewer alternatives, so the proof holds until one of the pattern's runs out
            times = min(left[s] // pattern.count(s) for s in set(pattern))
            fixed.append((pattern, times))
            changed = True
            for s in set(pattern):
                left[s] -= times * pattern.count(s)
                if not left[s]:
                    del left[s]
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing, for all items of a size at once."""
    rooms: dict[int, list[list]] = {}
    done: Plan = []
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in rooms if r >= s), default=None)
            if room is None:
                groups, room = [[(), n]], capacity
            else:
                groups = rooms.pop(room)
            per = room // s
            for pattern, bins in groups:
                full = min(bins, n // per)
                rest = min(n - full * per, per) if full < bins else 0
                for times, k in ((full, per), (1 if rest else 0, rest)):
                    if times:
                        n -= times * k
                        rooms.setdefault(room - k * s, []).append([pattern + (s,) * k, times])
                unused = bins - full - (1 if rest else 0)
                if unused and pattern:
                    rooms.setdefault(room, []).append([pattern, unused])
            if 0 in rooms:
                done += [(p, b) for p, b in rooms.pop(0)]
            # groups with the same pattern are one group
            for r, own in rooms.items():
                if len(own) > 1:
                    merged: dict[tuple[int, ...], int] = {}
                    for p, b in own:
                        merged[p] = merged.get(p, 0) + b
                    rooms[r] = [[p, b] for p, b in merged.items()]
    return done + [(p, b) for own in rooms.values() for p, b in own]


def plan_containers(counts: dict[int, int], capacity: int) -> Plan:
    """(sizes in the container, number of such containers), for the whole histogram."""
    fixed, rest = dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def reduction(counts: dict[int, int], capacity: int) -> list[tuple[str, int, int, int]]:
    """(stage, containers, items, units) that dominance fixed and that best fit placed."""
    fixed, rest = dominance(counts, capacity)
    return [(stage, sum(n for _, n in plan), sum(len(p) * n for p, n in plan), sum(sum(p) * n for p, n in plan)) for stage, plan in (("dominance", fixed), ("best fit", best_fit(rest, capacity)))]


def slot_table(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first rank of each run of slots, first container, and slots per container."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, bins in plan:
        for s in sorted(set(pattern)):
            per = pattern.count(s)
            runs.setdefault(s, []).append((used.get(s, 0), base, per))
            used[s] = used.get(s, 0) + per * bins
        base += bins
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*own)) for s, own in runs.items()}


def _pieces(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> tuple[DataFrame, dict[int, int]]:
    """Items that fit (key, piece_no, n_units), and their number by size."""
    items = cut(sizes.select(F.col(id_col).alias("key"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("size")))
    full = F.floor(F.col("size") / capacity)
    pieces = items.select(
        "key", F.posexplode(F.concat(F.array_repeat(F.lit(capacity), full.cast("int")), F.when((F.col("size") % capacity > 0) | (F.col("size") == 0), F.array((F.col("size") % capacity).cast("int"))).otherwise(F.array().cast("array<int>")))).alias("piece_no", "n_units")
    )
    return pieces, {r["n_units"]: r["n"] for r in pieces.groupBy("n_units").agg(F.count("*").alias("n")).collect()}


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """`id_col`, piece_no, container_id, n_units of every item.

    An item larger than the capacity is split into full containers and one rest; no other is.
    Items of NULL, zero or negative size take no room and go to container 0. Repeated rows are
    items of their own. Other columns are ignored. The histogram (at most `capacity` rows) is the
    only thing that reaches the driver.
    """
    pieces, histogram = _pieces(sizes, id_col, size_col, capacity)
    slots = slot_table(plan_containers(histogram, capacity))
    blocks = max(8, sum(histogram.values()) // BLOCK_ROWS)
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("key", "piece_no"), F.lit(blocks)).cast("int"))
    ahead = (
        blocked.groupBy("n_units", "block").agg(F.count("*").alias("n"))
        .withColumn("ahead", F.sum("n").over(Window.partitionBy("n_units").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("n_units", "block", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    )
    ranked = (
        blocked.withColumn("at", F.row_number().over(Window.partitionBy("block", "n_units").orderBy("key", "piece_no")) - 1)
        .join(ahead, ["block", "n_units"])
        .select("key", "piece_no", "n_units", (F.col("at") + F.col("ahead")).alias("rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = np.zeros(len(pdf), dtype=np.int64)
            size, rank = pdf["n_units"].to_numpy(), pdf["rank"].to_numpy()
            for s in np.unique(size):
                if s in slots:
                    first, base, per = slots[s]
                    here = size == s
                    run = np.searchsorted(first, rank[here], side="right") - 1
                    bins[here] = base[run] + (rank[here] - first[run]) // per[run]
            yield pd.DataFrame({"key": pdf["key"], "piece_no": pdf["piece_no"], "container_id": bins, "n_units": pdf["n_units"]})

    kind = dict(ranked.dtypes)["key"]
    return ranked.mapInPandas(place, f"key {kind}, piece_no int, container_id bigint, n_units int").withColumnRenamed("key", id_col)


def containers_of_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """doc_id, piece_no, container_id, n_tokens for documents measured in tokens of `tokenizer`."""
    sizes = count_corpus(documents, "doc_id", "text", tokenizer, folder)
    return pack(sizes, "doc_id", "n_tokens", capacity).withColumnRenamed("n_units", "n_tokens")


def reduction_of_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """stage (dominance, best fit) with the containers, pieces and tokens it placed."""
    _, histogram = _pieces(count_corpus(documents, "doc_id", "text", tokenizer, folder), "doc_id", "n_tokens", capacity)
    return documents.sparkSession.createDataFrame(reduction(histogram, capacity), "stage string, containers bigint, pieces bigint, n_tokens bigint")
