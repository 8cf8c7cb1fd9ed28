"""Dashboard analytics as DataFrame plans. Blank means NULL or the empty string; blanks of spaces are values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talasik.operators.evaluation import bounded_axis


def blank(name: str) -> Column:
    """NULL for the empty string."""
    return F.nullif(F.col(name), F.lit(""))


def filled(name: str, default: str) -> Column:
    """The column, or `default` where it is blank."""
    return F.coalesce(blank(name), F.lit(default))


def filtered(df: DataFrame, equal: dict[str, str | None] | None = None, day: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Optional equality filters and an inclusive range of ISO days held as strings; what is not given filters nothing."""
    tests = [F.col(c) == v for c, v in (equal or {}).items() if v]
    tests += [F.col(day) >= since] if day and since else []
    tests += [F.col(day) <= until] if day and until else []
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def containing(df: DataFrame, text: str, needle: str) -> DataFrame:
    """Rows whose text holds `needle` in any letter case; NULL text holds nothing."""
    return df.filter(F.contains(F.lower(F.col(text)), F.lower(F.lit(needle))))


def on_day(df: DataFrame, ts: str, day: str | None) -> DataFrame:
    """Rows within [day, day + 1) UTC; a day that is no date filters nothing."""
    import datetime

    try:
        first = datetime.datetime.fromisoformat(day or "")
    except ValueError:
        return df
    return df.filter((F.col(ts) >= F.lit(first.isoformat(" ")).cast("timestamp_ntz")) & (F.col(ts) < F.lit((first + datetime.timedelta(days=1)).isoformat(" ")).cast("timestamp_ntz")))


def counts(df: DataFrame, column: str, default: str) -> DataFrame:
    """value and n, blanks counted under `default`."""
    return df.groupBy(filled(column, default).alias("value")).agg(F.count("*").alias("n"))


def vocabulary_counts(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """value and n for every word of the vocabulary, 0 where none occurs."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], "value string")
    seen = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return words.join(seen, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def trend(df: DataFrame, day: str, by: str = "month") -> DataFrame:
    """period and n by month or year of an ISO day; rows without a day are left out."""
    return df.filter(blank(day).isNotNull()).groupBy(F.substring(day, 1, 4 if by == "year" else 7).alias("period")).agg(F.count("*").alias("n"))


def choices(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not blank, in order."""
    return df.select(blank(column).alias("value")).filter("value IS NOT NULL").distinct().orderBy("value")


def cross_tab(df: DataFrame, rows: Column, columns: Column) -> DataFrame:
    """row, col and n of the cells that occur."""
    return df.groupBy(rows.alias("row"), columns.alias("col")).agg(F.count("*").alias("n"))


def cross_tab_totals(df: DataFrame, rows: Column, columns: Column) -> DataFrame:
    """The cells with a total per row, of the columns, and over all, as a cube of small cells."""
    cells = cross_tab(df, rows, columns)
    return cells.cube("row", "col").agg(F.sum("n").cast("bigint").alias("n")).select(F.coalesce("row", F.lit("(all)")).alias("row"), F.coalesce("col", F.lit("(all)")).alias("col"), "n")


def dense_tiers(df: DataFrame, rows: Column, columns: Column, high: int = 10, middle: int = 5) -> DataFrame:
    """Every row x column with its count and tier (high, mid, none, zero).

    The grid is of the distinct values on the axes, small beside the data.
    """
    cells = cross_tab(df, rows, columns)
    grid = bounded_axis(cells.select("row").distinct()).crossJoin(F.broadcast(bounded_axis(cells.select("col").distinct())))
    n = F.coalesce("n", F.lit(0))
    return grid.join(cells, ["row", "col"], "left").select("row", "col", n.alias("n"), F.when(n >= high, "high").when(n >= middle, "mid").when(n == 0, "zero").otherwise("none").alias("tier"))


def hotspots(df: DataFrame, place: str, category: str) -> DataFrame:
    """Places by number of rows with share of the largest, severity tier and commonest category.

    One aggregation by (place, category) feeds both the place totals and the commonest
    category, so the rows are shuffled once; the rest works on that small result.
    Ties of the commonest category go to the first by name. Empty input gives no rows.
    """
    cells = df.select(filled(place, "Unknown").alias("place"), blank(category).alias("category"))
    cells = cells.groupBy("place", "category").agg(F.count("*").alias("n"))
    by_place = cells.groupBy("place").agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.struct(-F.col("n"), F.col("category")))).alias("top"),
    )
    ratio = F.col("n_rows") / F.col("_most")
    return by_place.crossJoin(F.broadcast(by_place.agg(F.max("n_rows").alias("_most")))).select(
        "place",
        "n_rows",
        F.round(ratio * 100, 1).alias("pct_of_max"),
        F.when(ratio >= 0.66, "high").when(ratio >= 0.33, "medium").otherwise("low").alias("severity"),
        F.coalesce("top", F.lit("—")).alias("top_category"),
    )


def risk(df: DataFrame, day: str, category: str, stable_when_short: bool = False) -> DataFrame:
    """category, last, previous and direction (up, down, stable) over the two latest months that occur.

    Months are those with a dated row with a category; a category without rows in one counts 0 there.
    With fewer than two months there is no row, or with `stable_when_short` every category is stable.
    """
    rows = df.select(blank(category).alias("category"), F.substring(blank(day), 1, 7).alias("month")).filter("category IS NOT NULL")
    cells = rows.groupBy("category", "month").agg(F.count("*").alias("n"))
    months = cells.filter("month IS NOT NULL").select("month").distinct().orderBy(F.desc("month")).limit(2)
    ranked = months.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("month"))))
    n_months = ranked.agg(F.count("*").alias("k"))
    now = cells.join(F.broadcast(ranked), "month", "left").groupBy("category").agg(
        F.coalesce(F.sum(F.when(F.col("rank") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("last"),
        F.coalesce(F.sum(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0)).cast("bigint").alias("previous"),
    )
    told = now.crossJoin(F.broadcast(n_months)).filter("k > 1" if not stable_when_short else "k > 0")
    direction = F.when(F.col("k") < 2, "stable").when(F.col("last") > F.col("previous"), "up").when(F.col("last") < F.col("previous"), "down").otherwise("stable")
    return told.select("category", "last", "previous", direction.alias("direction"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """Page `number` (from 1) of the rows in order; the order needs a tie-break to be repeatable."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)
