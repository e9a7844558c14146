"""Models over duel history and item metadata, with pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def duel_logit(train: DataFrame, test: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """Logistic regression with an L2 penalty of strength 1 over the rows; p for the test rows."""
    model = LogisticRegression(labelCol=label, regParam=1 / max(1, train.count()), elasticNetParam=0.0, standardization=False).fit(assembled(train, columns))
    return model.transform(assembled(test, columns)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def duel_boosted(train: DataFrame, val: DataFrame, test: DataFrame, columns: list[str], label: str = "y", trees: int = 20) -> DataFrame:
    """Boosted trees that stop when the validation rows no longer gain."""
    rows = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    model = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.1, validationIndicatorCol="_val", seed=1).fit(assembled(rows, columns))
    return model.transform(assembled(test, columns)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def boosted_regression(train: DataFrame, val: DataFrame, test: DataFrame, numeric: list[str], category: str, label: str = "b_logit", trees: int = 20) -> DataFrame:
    """Difficulty from metadata by boosted trees; unknown categories share a number."""
    index = StringIndexer(inputCol=category, outputCol="_cat", handleInvalid="keep").fit(train)
    columns = [*numeric, "_cat"]
    rows = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    model = GBTRegressor(labelCol=label, predictionCol="yhat", maxIter=trees, maxDepth=3, maxBins=128, validationIndicatorCol="_val", seed=1).fit(assembled(index.transform(rows), columns))
    return model.transform(assembled(index.transform(test), columns)).drop("features", "_cat")
