"""Models: text and link classifiers, and exact explanations of linear ones."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: classes count alike. One row per class is broadcast."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total, classes = n.agg(F.sum("_n"), F.count("*")).first()
    weight = n.withColumn("weight", F.lit(float(total or 0)) / (F.lit(classes) * F.col("_n"))).drop("_n")
    return rows.join(F.broadcast(weight), label)


def split(rows: DataFrame, id_col: str, share: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, by a hash of the id, so that it is the same whenever it is asked."""
    held = F.pmod(F.xxhash64(id_col), F.lit(share)) == 0
    return rows.where(~held), rows.where(held)


def text_model(features: int = 1 << 16, regularisation: float = 0.01) -> Pipeline:
    """Words and word pairs, TF-IDF, a class-balanced logistic regression. Columns: text, label, weight."""
    both = "SELECT *, concat(words, pairs) AS terms FROM __THIS__"
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement=both),
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features", minDocFreq=2),
        LogisticRegression(labelCol="label", weightCol="weight", regParam=regularisation, maxIter=30),
    ])


def url_model(columns: list[str]) -> Pipeline:
    """Gradient-boosted trees over numeric link features; missing ones are kept as such."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol="label", maxDepth=4, maxIter=20, seed=7)])


def probability(scored: DataFrame, k: int = 1) -> Column:
    return vector_to_array("probability")[k]


def linear_contributions(model: PipelineModel, background: DataFrame, rows: DataFrame, id_col: str, k: int = 10) -> DataFrame:
    """(id, feature, phi, place): the exact Shapley values of a linear model, coefficient times distance from the mean.

    Only features that a row has are listed, the k largest by amount. Coefficients and means are vectors of the model's
    size, joined as a table of features that differ from zero.
    """
    linear = model.stages[-1]
    coefficients = linear.coefficients.toArray()
    mean = model.transform(background).select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    spark = rows.sparkSession
    weights = spark.createDataFrame([(i, float(c), float(mean[i])) for i, c in enumerate(coefficients) if c], "feature int, coefficient double, mean double")
    sparse = model.transform(rows).select(id_col, F.posexplode(vector_to_array("features")).alias("feature", "x")).where("x <> 0")
    phi = sparse.join(F.broadcast(weights), "feature").withColumn("phi", F.col("coefficient") * (F.col("x") - F.col("mean")))
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("phi")), "feature")
    return phi.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(id_col, "feature", "phi", "place")
