"""Features and candidate models for incident types, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, CountVectorizer, NGram, Normalizer, OneHotEncoder, SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talasik.functions.dates import month_of, period_of, weekday_of
from talasik.functions.text import ENGLISH_STOPS, TAGALOG_STOPS, tokens
from talasik.operators.evaluation import averages, per_class
from talasik.operators.skew import broadcast_if_small


def structured(df: DataFrame, day: str = "incident_date", time: str = "incident_time", place: str = "location_purok") -> DataFrame:
    """`df` with month, weekday (0 when unknown), period and place columns for the models."""
    return df.withColumns({
        "f_month": month_of(F.col(day)).cast("double"), "f_weekday": (weekday_of(F.col(day)) + 1).cast("double"),
        "f_period": period_of(F.coalesce(F.col(time), F.lit(""))), "f_place": F.coalesce(F.nullif(F.trim(place), F.lit("")), F.lit("Unspecified")),
    })


def feature_stages(vocabulary: int = 5000, hashed: bool = False) -> list[Estimator | Transformer]:
    """Smoothed, normalised TF-IDF of one and two words beside one-hot period and place.

    Spark's inverse frequency is log((n + 1) / (df + 1)); the plain counts beside it give the usual + 1. With
    `hashed` no vocabulary is gathered, for corpora whose vocabulary has no bound.
    """
    text: list[Estimator | Transformer] = [
        StopWordsRemover(inputCol="words", outputCol="kept", stopWords=sorted({*TAGALOG_STOPS, *ENGLISH_STOPS})), NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=1 << 18) if hashed else CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary),
        IDF(inputCol="tf", outputCol="tfidf"), VectorAssembler(inputCols=["tf", "tfidf"], outputCol="both"), Normalizer(inputCol="both", outputCol="text_vector"),
    ]
    slots = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in ("f_period", "f_place")]
    hot = OneHotEncoder(inputCols=["f_period_i", "f_place_i"], outputCols=["period_hot", "place_hot"], dropLast=False, handleInvalid="keep")
    return [*text, *slots, hot, VectorAssembler(inputCols=["text_vector", "f_month", "f_weekday", "period_hot", "place_hot"], outputCol="features")]


def prepared(df: DataFrame, text: str, label: str) -> DataFrame:
    """Words, label and a balancing weight (n / (classes x rows of the class))."""
    rows = structured(df).withColumn("words", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))).withColumn("label_text", F.col(label))
    sizes = rows.groupBy("label_text").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = sizes.crossJoin(F.broadcast(total)).select("label_text", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return rows.join(broadcast_if_small(weights), "label_text", "left")


def candidates(trees: int = 200, seed: int = 42) -> dict[str, Estimator]:
    """The six candidates; classes are weighted but for naive Bayes and boosting."""
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "naive_bayes": NaiveBayes(**common), "logistic": LogisticRegression(weightCol="weight", maxIter=50, **common),
        "svm": OneVsRest(classifier=LinearSVC(maxIter=30), weightCol="weight", **common), "tree": DecisionTreeClassifier(weightCol="weight", seed=seed, **common),
        "forest": RandomForestClassifier(weightCol="weight", numTrees=trees, seed=seed, **common), "boosted": OneVsRest(classifier=GBTClassifier(maxIter=100, maxDepth=4, seed=seed), **common),
    }


def train_and_compare(train: DataFrame, test: DataFrame, text: str, label: str, names: tuple[str, ...] = ("naive_bayes", "logistic", "svm", "tree", "forest", "boosted")) -> tuple[PipelineModel, DataFrame]:
    """Best pipeline by macro F1 (the first of equals) and (model, macro_f1, weighted_f1) of all."""
    spark = train.sparkSession
    rows, held = prepared(train, text, label).cache(), prepared(test, text, label).cache()
    index = StringIndexer(inputCol="label_text", outputCol="label", handleInvalid="skip")
    base = Pipeline(stages=[index, *feature_stages()]).fit(rows)
    seen, shown = base.transform(rows).cache(), base.transform(held).cache()
    best, results = None, []
    for name in names:
        model = candidates()[name].fit(seen)
        score = averages(per_class(model.transform(shown), "label", "prediction")).first()
        results.append((name, float(score["macro_f1"] or 0), float(score["weighted_f1"] or 0)))
        if best is None or results[-1][1] > best[0]:
            best = (results[-1][1], PipelineModel(stages=[*base.stages, model]))
    for df in (rows, held, seen, shown):
        df.unpersist()
    return best[1], spark.createDataFrame(results, "model string, macro_f1 double, weighted_f1 double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The saved pipeline, None where there is none."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        if "does not exist" in str(e) or "PATH_NOT_FOUND" in str(e):
            return None
        raise


def folds(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """`df` with fold 0 to k - 1 by a hash of the key, even within large labels and without sorting one."""
    return df.withColumn("fold_no", F.pmod(F.xxhash64(key, label), F.lit(k)).cast("int"))
