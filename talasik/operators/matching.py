"""Lookups, containment joins, drift checks, deduplication and replay guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talasik.operators.skew import broadcast_if_small


def lookup(df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, defaults: dict[str, str]) -> DataFrame:
    """`df` with the dimension's columns, defaults where the key is unknown. The dimension is broadcast if small."""
    side = broadcast_if_small(dimension.dropDuplicates([dimension_key]).withColumnRenamed(dimension_key, "_key"))
    joined = df.join(side, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def keyword_categories(column: Column, taxonomy: list[tuple[str, list[str]]], fallback: str) -> tuple[Column, Column]:
    """First and second category, in list order, one of whose keywords is in the text; the fallback and NULL otherwise."""
    text = F.lower(column)
    hit = [F.when(text.rlike("|".join(rf"\Q{k}\E" for k in keywords)), F.lit(name)) for name, keywords in taxonomy]
    found = F.filter(F.array(*hit), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(fallback)), F.try_element_at(found, F.lit(2))


def pooled(gold: DataFrame, split: DataFrame, predictions: dict[str, DataFrame], key: str, groups: DataFrame | None = None) -> DataFrame:
    """key, split, gold_type and, of every model, its type and whether that is right; with `groups` (type, group) also by group.

    Fails unless keys are unique everywhere, every gold row has a split and each model has exactly the gold's keys. A
    missing prediction is wrong.
    """
    def checked(df: DataFrame, name: str, against: DataFrame | None) -> None:
        n, own = df.agg(F.count("*"), F.countDistinct(key)).first()
        if n != own:
            raise ValueError(f"{name}: {key} is not unique")
        if against is not None and (not same_set(df.select(key), against.select(key)).first()["equal"]):
            raise ValueError(f"{name}: other rows than the gold's")

    checked(gold, "gold", None)
    checked(split, "split", None)
    if gold.join(split, key, "left_anti").limit(1).count():
        raise ValueError("gold rows without a split")
    out = gold.select(key, "gold_type").join(split.select(key, "split"), key)
    group = broadcast_if_small(groups.select(F.col("type").alias("_type"), F.col("group").alias("_group"))) if groups is not None else None

    def grouped(df: DataFrame, of: str, name: str) -> DataFrame:
        return df if group is None else df.join(group, F.col(of) == F.col("_type"), "left").withColumnRenamed("_group", name).drop("_type")

    out = grouped(out, "gold_type", "gold_group")
    for name, df in predictions.items():
        checked(df, name, gold)
        out = out.join(df.select(key, F.col("pred_type").alias(f"{name}_type")), key).withColumn(f"{name}_right", F.coalesce(F.col(f"{name}_type") == F.col("gold_type"), F.lit(False)))
        if group is not None:
            out = grouped(out, f"{name}_type", f"{name}_group").withColumn(f"{name}_group_right", F.coalesce(F.col(f"{name}_group") == F.col("gold_group"), F.lit(False)))
    return out


def longest_inside(df: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, entry) of the longest entry that stands in the text as whole words, ties to the first by name; NULL if none.

    Words of the text meet the entries in an equi-join on the word of an entry that the fewest entries have; what meets
    is looked at in the text as written.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")
    told = entries.filter("entry <> ''").select("entry").distinct().select("entry", F.explode(words(F.col("entry"))).alias("_word"))
    listed = told.join(told.groupBy("_word").agg(F.count("*").alias("_n")), "_word").groupBy("entry").agg(F.min_by("_word", F.struct("_n", "_word")).alias("_word"))
    met = df.select(key, F.lower(text).alias("_low"), F.explode(words(F.col(text))).alias("_word")).join(broadcast_if_small(listed), "_word")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower("entry"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    best = met.filter(F.contains("_low", F.lower("entry")) & F.rlike("_low", whole)).groupBy(key).agg(F.min_by("entry", F.struct(-F.length("entry"), F.col("entry"))).alias("entry"))
    return df.select(key).join(best, key, "left")


def runs(words: Column, longest: int) -> Column:
    """Every run of one to `longest` consecutive words, joined by spaces."""
    none = F.array().cast("array<string>")
    of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(none)
    return F.flatten(F.array(*[of(n) for n in range(1, longest + 1)]))


def drift(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, left and right wherever two versions of a dimension differ; a missing row differs in every field."""
    a = left.select(key, *[F.col(c).cast("string").alias(f"l_{c}") for c in columns])
    b = right.select(key, *[F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    both = a.join(b, key, "full_outer")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right")) for c in columns]))
    return both.select(key, fields.alias("f")).select(key, "f.*").filter(~F.col("left").eqNullSafe(F.col("right")))


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; NULL keys are all kept.

    An aggregation, so a key that owns a large share of the rows is reduced before the shuffle.
    """
    rows = df.withColumn("_key", key)
    packed = rows.filter("_key IS NOT NULL").groupBy("_key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return packed.unionByName(rows.filter("_key IS NULL").drop("_key"))


def unseen(df: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the history; NULL keys are unseen."""
    return df.join(history.select(key).distinct(), key, "left_anti")


def replays(df: DataFrame, key: list[str], ts: str, order: str, seconds: int = 60) -> DataFrame:
    """`df` with replay: whether a row of the key that is no replay itself stands within the last `seconds` before this one.

    A replay isn't kept, so it doesn't put off the next row that is. Rows without a key or time are none. What a row is
    depends on the rows before it back to the last gap of more than `seconds`, so rows are spread by key and the start
    of their stretch and read in order, one at a time; starts are found in buckets of time, in which no key's rows all meet.
    """
    gap, columns = max(seconds, 0) * 1_000_000, df.columns
    size = F.lit(max(seconds, 1) * 1_000_000 * 64)
    whole = F.col(ts).isNotNull()
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rows = df.filter(whole).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_bucket", F.floor(F.col("_t") / size))
    own = Window.partitionBy(*key, "_bucket").orderBy("_t", order)
    last = rows.groupBy(*key, "_bucket").agg(F.max("_t").alias("_last")).withColumn("_bucket", F.col("_bucket") + 1)
    before = F.coalesce(F.lag("_t").over(own), F.col("_last"))
    begun = rows.join(last, [*key, "_bucket"], "left").withColumn("_begin", F.when(before.isNull() | (F.col("_t") - before > gap), F.col("_t"))).drop("_last")
    # the start of a stretch that began in an earlier bucket
    opened = begun.groupBy(*key, "_bucket").agg(F.max("_begin").alias("_open"))
    opened = opened.select(*key, "_bucket", F.last("_open", True).over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    placed = begun.withColumn("_begin", F.max("_begin").over(own.rowsBetween(Window.unboundedPreceding, 0))).join(opened, [*key, "_bucket"]).withColumn("_begin", F.coalesce("_begin", "_carried"))
    ordered = placed.select(*df.columns, F.xxhash64(*key, "_begin").alias("_stretch"), "_t").repartition("_stretch").sortWithinPartitions("_stretch", *key, "_t", order)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, 0
        for pdf in batches:
            out = []
            for k, t in zip(zip(pdf["_stretch"], *[pdf[c] for c in key]), pdf["_t"]):
                out.append(k == now and t - kept <= gap)
                if not out[-1]:
                    now, kept = k, t
            yield pdf[columns].assign(replay=out)

    marked = ordered.mapInPandas(mark, T.StructType([*df.schema.fields, T.StructField("replay", T.BooleanType())]))
    return marked.unionByName(df.filter(~whole).withColumn("replay", F.lit(False)))


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many distinct rows are only left, only right, and whether the sets are equal."""
    a, b = left.distinct(), right.distinct()
    gone = a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))
    return gone.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def upsert(df: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table with changed rows replaced and new ones added; of several changes of a key that with the largest `order` counts, then the last by all columns."""
    others = [c for c in df.columns if c != key]
    rank = F.struct(*([order] if order else []), *others)
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others]).select(*df.columns)
    return df.join(latest.select(key), key, "left_anti").select(*df.columns).unionByName(latest)


def fixed_up(df: DataFrame, fixes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`df` with values overridden where `fixes` has one; the word NONE clears a value."""
    side = fixes.select(key, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    joined = df.join(broadcast_if_small(side), key, "left")
    value = lambda c: F.when(F.upper(F.trim(f"_fix_{c}")) == "NONE", F.lit("")).otherwise(F.coalesce(F.nullif(F.trim(f"_fix_{c}"), F.lit("")), F.col(c)))
    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def evolved(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """`df` with every column of the schema: missing ones NULL, others cast where possible; running it again changes nothing."""
    have = set(df.columns)
    return df.select(*[F.col(c).try_cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in schema.items()], *[F.col(c) for c in df.columns if c not in schema])


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """`n` rows with the smallest hashes of seed and key: the same rows on every run and cluster."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), key)).orderBy("_h", key).limit(n).drop("_h")


def reading_order(boxes: DataFrame, page: str) -> DataFrame:
    """`boxes` (page, x, y, height, text) with line_no and word_no in reading order.

    A box joins the line above it if its middle lies within half a height of that line's running middle. The lines
    of a page depend on one another, so a page is read in one task; pages are small and many.
    """
    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(_m=pdf["y"] + pdf["height"] / 2).sort_values(["_m", "x"], kind="stable")
        lines, middle, count, no = [], None, 0, 0
        for m, h in zip(rows["_m"], rows["height"]):
            if middle is None or abs(m - middle) > h / 2:
                no, middle, count = no + 1, m, 1
            else:
                count += 1
                middle += (m - middle) / count
            lines.append(no)
        rows = rows.assign(line_no=lines).drop(columns="_m").sort_values(["line_no", "x"], kind="stable")
        return rows.assign(word_no=rows.groupby("line_no").cumcount() + 1)

    schema = ", ".join(f"{c} {t}" for c, t in boxes.dtypes)
    return boxes.groupBy(page).applyInPandas(order, f"{schema}, line_no int, word_no int")
