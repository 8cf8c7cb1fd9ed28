"""Statistics of classifiers and readers, as aggregations over predictions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talasik.operators.skew import broadcast_if_small

#: Two-sided 95 % quantile of the normal distribution.
Z = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; NULL for no trials."""
    p = k / F.nullif(n, F.lit(0))
    centre, half = (p + Z * Z / (2 * n)) / (1 + Z * Z / n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def accuracy(df: DataFrame, by: list[str], right: Column) -> DataFrame:
    """by, k, n, accuracy and its Wilson interval; an unknown verdict counts as wrong."""
    out = df.groupBy(*by).agg(F.count_if(right).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(*by, "k", "n", F.round(F.col("k") / F.col("n"), 9).alias("accuracy"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def discordance(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: pairs where only a is right, only b is, both, neither."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"))


#: Up to so many trials binomial tails are summed in whole numbers, whose digits grow with the trials.
WHOLE_TRIALS = 20_000


def _stirling_error(n: int) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - math.log(2 * math.pi) / 2
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / n**2) / n**2) / n**2) / n**2) / n


def _deviance(k: int, mean: float) -> float:
    """k log(k / mean) + mean - k, without cancellation where k is near the mean."""
    v = (k - mean) / (k + mean)
    if abs(v) > 0.1:
        return k * math.log(k / mean) + mean - k
    total, power, j = (k - mean) * v, 2 * k * v, 1
    while True:
        power *= v * v
        more = total + power / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def half_tail(n: int, m: int) -> float:
    """P(X <= m) of n even trials, m <= n / 2.

    Beyond WHOLE_TRIALS the term of m comes from Loader's expansion and the others from it, each by its ratio to the
    one before; they are summed until all that remain are less than the last digit, after some square roots of n.
    """
    if n <= WHOLE_TRIALS:
        term = tail = 1
        for i in range(m):
            term = term * (n - i) // (i + 1)
            tail += term
        return tail / 2**n
    if not m:
        return math.ldexp(1.0, -n)
    log = _stirling_error(n) - _stirling_error(m) - _stirling_error(n - m) - _deviance(m, n / 2) - _deviance(n - m, n / 2)
    total = term = 1.0
    for i in range(m):
        ratio = (m - i) / (n - m + 1 + i)
        if term * ratio < 1e-17 * total * (1 - ratio):
            break
        term *= ratio
        total += term
    return math.sqrt(n / (2 * math.pi * m * (n - m))) * math.exp(log) * total


def _exact(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * half_tail(x + y, min(x, y))) for x, y in zip(map(int, b), map(int, c))], dtype="float64")


def mcnemar_exact(b: str, c: str) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs; 1 for none. Takes time by the square root of their number."""
    return F.pandas_udf(_exact, "double")(b, c)


def _erfc_root_half(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)))


def mcnemar_corrected(b: Column, c: Column) -> tuple[Column, Column]:
    """Continuity-corrected statistic and its p."""
    chi = F.when(b + c > 0, F.pow(F.abs(b - c) - 1, F.lit(2)) / (b + c)).otherwise(0.0)
    return chi, F.pandas_udf(_erfc_root_half, "double")(chi)


def holm(df: DataFrame, p: str, order: str) -> DataFrame:
    """`df` with holm: step-down adjusted p, the running maximum of (m - rank) p, at most 1. One row per hypothesis."""
    ranked = Window.orderBy(p, order)
    m = F.count("*").over(Window.partitionBy())
    step = (m - F.row_number().over(ranked) + 1) * F.col(p)
    return df.withColumn("_step", step).withColumn("holm", F.least(F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_step")


def per_class(df: DataFrame, gold: str, predicted: str, classes: DataFrame | None = None) -> DataFrame:
    """class, support, precision, recall and f1 of every class (0 where undefined).

    Counted from the confusion cells, one shuffle over the rows. `classes` (class) adds classes without rows.
    """
    cells = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("g").alias("class"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select("s.*").filter("class IS NOT NULL")
    if classes is not None:
        sides = sides.unionByName(classes.select("class", *[F.lit(0).cast("bigint").alias(c) for c in ("gold", "said", "hit")]))
    out = sides.groupBy("class").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("gold", "said", "hit")])
    precision, recall = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("gold") > 0, F.col("hit") / F.col("gold")).otherwise(0.0)
    f1 = F.when(F.col("gold") + F.col("said") > 0, 2 * F.col("hit") / (F.col("gold") + F.col("said"))).otherwise(0.0)
    return out.select("class", F.col("gold").alias("support"), F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def averages(classes: DataFrame) -> DataFrame:
    """Macro and support-weighted means of `per_class`."""
    weight = F.col("support") / F.nullif(F.sum("support").over(Window.partitionBy()), F.lit(0))
    rows = classes.withColumn("_w", weight)
    return rows.agg(*[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[F.round(F.sum(F.col(c) * F.col("_w")), 6).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


#: A dense grid has at most so many values on an axis; more is an error, not a cut.
MOST_VALUES = 5_000


def bounded_axis(values: DataFrame) -> DataFrame:
    """The distinct values of an axis; a grid of too many would square them."""
    if values.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        raise ValueError(f"a dense grid needs at most {MOST_VALUES} values on an axis")
    return values


def confusion(df: DataFrame, gold: str, predicted: str, fill: str) -> DataFrame:
    """Dense matrix: gold, predicted and n for every pair of classes; a missing prediction counts as `fill`."""
    cells = df.filter(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("gold"), F.coalesce(F.col(predicted), F.lit(fill)).alias("predicted")).agg(F.count("*").alias("n"))
    classes = cells.select(F.col("gold").alias("c")).union(cells.select("predicted")).distinct()
    grid = classes.select(F.col("c").alias("gold")).crossJoin(broadcast_if_small(bounded_axis(classes).select(F.col("c").alias("predicted"))))
    return grid.join(cells, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def calibration(df: DataFrame, confidence: str, right: Column, bins: int = 5) -> DataFrame:
    """bin, n, mean confidence and accuracy; the first bin holds both ends, the others their upper end; empty ones are left out."""
    at = F.greatest(F.ceil(F.col(confidence) * bins) - 1, F.lit(0)).cast("int")
    return df.filter(F.col(confidence).between(0, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 9).alias("confidence"), F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 9).alias("accuracy"))


def _placed(points: DataFrame, value: str, counted: list[str], blocks: int) -> DataFrame:
    """`points` with _before_<c>: the sum of each counted column over all larger values, ranges of values being summed apart.

    Values are cut into ranges at quantiles; the totals of the ranges, `blocks` rows, are added up first.
    """
    cuts = points.approxQuantile(value, [k / blocks for k in range(1, blocks)], 0.001) if blocks > 1 else []
    at = F.array_size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    ranged = points.withColumn("_range", at)
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{c}") for c in counted])
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # at most `blocks` rows
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_all_{c}").over(above), F.lit(0)).alias(f"_above_{c}") for c in counted])
    own = Window.partitionBy("_range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(sums), "_range").select(value, *counted, *[(F.col(f"_above_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"_before_{c}") for c in counted])


def auc(df: DataFrame, score: str, positive: Column, blocks: int = 64) -> DataFrame:
    """One row: area under the ROC curve by trapezoids over distinct scores, with the numbers of each kind.

    Scores are aggregated before the running sums, which are taken in `blocks` ranges; ties share a point. NULL without both kinds.
    """
    points = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(positive).alias("tp"), F.count_if(~positive).alias("fp"))
    run = _placed(points.withColumn(score, F.col(score).cast("double")), score, ["tp"], blocks).join(points.select(F.col(score).cast("double").alias(score), "fp"), score)
    area = F.sum(F.col("fp") * (F.col("_before_tp") + F.col("tp") / 2))
    out = run.agg(area.alias("area"), F.sum("tp").cast("bigint").alias("positives"), F.sum("fp").cast("bigint").alias("negatives"))
    return out.select(F.round(F.col("area") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0)), 9).alias("auc"), "positives", "negatives")


def one_against_rest(df: DataFrame, label: str, scores: dict[str, str], blocks: int = 64) -> DataFrame:
    """class, auc and positives of every class (a score column each), of all cells together (micro), and their mean (macro).

    Classes without rows, or that all rows are of, have no area and don't count in the mean. NULL labels are no rows.
    """
    rows = df.filter(F.col(label).isNotNull())
    each = [auc(rows.select(F.col(c).alias("_s"), (F.col(label) == k).alias("_y")), "_s", F.col("_y"), blocks).select(F.lit(k).alias("class"), "auc", "positives") for k, c in scores.items()]
    cells = rows.select(F.explode(F.array(*[F.struct(F.col(c).cast("double").alias("s"), (F.col(label) == k).alias("y")) for k, c in scores.items()])).alias("x")).select("x.*")
    micro = auc(cells, "s", F.col("y"), blocks).select(F.lit("(micro)").alias("class"), "auc", "positives")
    classes = reduce(DataFrame.unionByName, each)
    macro = classes.agg(F.lit("(macro)").alias("class"), F.round(F.avg("auc"), 9).alias("auc"), F.sum("positives").cast("bigint").alias("positives"))
    return classes.unionByName(micro).unionByName(macro)


def roc_points(df: DataFrame, score: str, positive: Column, most: int = 250, blocks: int = 64) -> DataFrame:
    """threshold, tpr and fpr of at most about `most` points of the ROC curve, evenly along the scores; all of them if they are fewer."""
    points = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(positive).alias("tp"), F.count_if(~positive).alias("fp"), F.lit(1).alias("one"))
    run = _placed(points, "threshold", ["tp", "fp", "one"], blocks)
    total = points.agg(F.sum("tp").alias("p"), F.sum("fp").alias("q"), F.count("*").alias("k"))
    step = F.greatest(F.ceil(F.col("k") / most), F.lit(1))
    kept = run.crossJoin(F.broadcast(total)).filter((F.col("_before_one") % step == 0) | (F.col("_before_one") == F.col("k") - 1))
    return kept.select("threshold", F.round((F.col("_before_tp") + F.col("tp")) / F.nullif("p", F.lit(0)), 9).alias("tpr"), F.round((F.col("_before_fp") + F.col("fp")) / F.nullif("q", F.lit(0)), 9).alias("fpr"))


def agreement(df: DataFrame, a: str, b: str, gold: str) -> DataFrame:
    """agree, n and how many of a are right; two missing answers don't agree."""
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return df.groupBy(same.alias("agree")).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(gold)).alias("right"))


def field_scores(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """field, n and share of matching values over rows whose gold value is not blank; a missing value is a miss."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.upper(F.col(g))).alias("gold"), F.trim(F.upper(F.col(p))).alias("said")) for f, (p, g) in pairs.items()]))
    rows = df.select(fields.alias("x")).select("x.*").filter("gold <> ''")
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("said") == F.col("gold"), 1.0).otherwise(0.0)), 9).alias("accuracy"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """by, p50, p95 (of the shares given) and the largest value, exactly, between the two values beside each place.

    Values are counted before they are put in order, and those of a group are ordered in ranges, so a group that holds
    most of the rows is in no single buffer.
    """
    names = [f"p{round(s * 100)}" for s in shares]
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cuts = rows.approxQuantile("_v", [k / 64 for k in range(1, 64)], 0.001)
    at = F.array_size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("_v"))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", at)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_all"))
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_range").alias("_at"), F.coalesce(F.sum("_all").over(below), F.lit(0)).alias("_below"), F.sum("_all").over(Window.partitionBy(*by)).alias("_total"))
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)], F.col("_range") == F.col("_at"))
    own = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_below") + F.coalesce(F.sum("_n").over(own), F.lit(0))
    placed = ranged.join(sums, same).withColumn("_first", first).withColumn("_last", F.col("_first") + F.col("_n") - 1)
    out = []
    for name, share in zip(names, shares):
        spot = (F.col("_total") - 1) * F.lit(share)
        of = lambda k: F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col("_v")))
        low, high = of(F.floor(spot)), of(F.ceil(spot))
        part = F.max(spot - F.floor(spot))
        out.append(F.round(low + (high - low) * part, 9).alias(name))
    return placed.groupBy(*by).agg(*out, F.max("_v").alias("most"))


def brier(df: DataFrame, probabilities: str, truth: str) -> DataFrame:
    """Mean log loss (floor 1e-6), Brier score and mean probability of the truth; `truth` is a 0-based index."""
    p = F.greatest(F.try_element_at(F.col(probabilities), F.col(truth) + 1), F.lit(1e-6))
    squares = F.aggregate(F.transform(probabilities, lambda x, i: F.pow(x - F.when(i == F.col(truth), 1.0).otherwise(0.0), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.avg(-F.log(p)).alias("log_loss"), F.avg(squares).alias("brier"), F.avg(p).alias("mean_p"))


def bootstrap(df: DataFrame, value: str, resamples: int = 10_000, seed: int = 20261010) -> DataFrame:
    """mean, low and high (95 % percentile interval) of a mean of 0/1 outcomes.

    Resampling n outcomes of which k are 1 gives a binomial number of ones, so only k and n are needed, at any size.
    """
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        k = int(pdf["k"].iloc[0]) if n else 0
        if not n:
            return pd.DataFrame({"mean": [None], "low": [None], "high": [None]})
        means = np.random.default_rng(seed).binomial(n, k / n, resamples) / n
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"mean": [k / n], "low": [low], "high": [high]})

    counted = df.filter(F.col(value).isNotNull()).agg(F.sum(F.col(value).cast("int")).alias("k"), F.count("*").alias("n"))
    return counted.groupBy().applyInPandas(draw, "mean double, low double, high double")


def paired_bootstrap(df: DataFrame, a: str, b: str, resamples: int = 10_000, seed: int = 20261010) -> DataFrame:
    """difference, low and high (95 % percentile interval) of two models' accuracy, the rows being drawn for both at once.

    Drawing n rows gives multinomial numbers of the four outcomes, so only these four are counted, at any size.
    """
    x, y = F.coalesce(F.col(a).cast("int"), F.lit(0)), F.coalesce(F.col(b).cast("int"), F.lit(0))
    counted = df.agg(F.count_if((x == 1) & (y == 0)).alias("only_a"), F.count_if((x == 0) & (y == 1)).alias("only_b"), F.count("*").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        only_a, only_b, n = (int(pdf[c].iloc[0]) for c in ("only_a", "only_b", "n"))
        if not n:
            return pd.DataFrame({"difference": [None], "low": [None], "high": [None]})
        drawn = np.random.default_rng(seed).multinomial(n, [only_a / n, only_b / n, 1 - (only_a + only_b) / n], resamples)
        low, high = np.percentile((drawn[:, 0] - drawn[:, 1]) / n, [2.5, 97.5])
        return pd.DataFrame({"difference": [(only_a - only_b) / n], "low": [low], "high": [high]})

    return counted.groupBy().applyInPandas(draw, "difference double, low double, high double")


def fold_rare(df: DataFrame, label: str, least: int, other: str) -> DataFrame:
    """`df` with labels of fewer than `least` rows replaced. The frequent labels are joined, no group is gathered."""
    kept = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(F.col(label).alias("_kept"))
    return df.join(broadcast_if_small(kept), F.col(label) == F.col("_kept"), "left").withColumn(label, F.when(F.col(label).isNotNull(), F.coalesce("_kept", F.lit(other)))).drop("_kept")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.2, seed: int = 7) -> DataFrame:
    """`df` with split: `share` of each stratum is holdout, chosen by a hash of the key; strata of one row are dev.

    The hash decides each row by itself, so the split is stable when rows are added and needs no sort of a stratum.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    held = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < share * 10_000
    return df.join(broadcast_if_small(sizes), stratum, "left").withColumn("split", F.when(held & (F.col("_n") > 1), "holdout").otherwise("dev")).drop("_n")


def group_probabilities(df: DataFrame, key: str, probabilities: str, members: DataFrame) -> DataFrame:
    """key, group and the sum of the probabilities of the group's types; `members` has index (0-based) and group."""
    cells = df.select(key, F.posexplode(probabilities).alias("index", "_p"))
    return cells.join(broadcast_if_small(members), "index").groupBy(key, "group").agg(F.sum("_p").alias("p"))


def token_account(df: DataFrame, key: str, said: str, gold: str) -> DataFrame:
    """key, exact and absent: how many of the gold's words (three letters or more) stand in the other text."""
    words = lambda c: F.regexp_extract_all(F.upper(c), F.lit(r"([\p{L}\d]{3,})"), F.lit(1))
    rows = df.select(key, words(F.col(gold)).alias("_g"), words(F.col(said)).alias("_s"))
    exact = F.size(F.filter("_g", lambda w: F.array_contains("_s", w)))
    return rows.select(key, exact.alias("exact"), (F.size("_g") - exact).alias("absent"))
