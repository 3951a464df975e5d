"""A classifier of label families: hashed character n-grams with their rarity, numbers and make-up of a token, and multinomial logistic regression.

Defined cases: a null token counts as empty and is predicted like any other; tokens that were never seen fall into
the hashed columns; a class that training never saw is never predicted.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, FeatureHasher, HashingTF, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of n-grams, and the tokens that one must be in.
SHORTEST, LONGEST, LEAST_TOKENS = 2, 5, 2
#: Hashed columns of n-grams and of a token's make-up; a model has so many weights for each class, whatever the tokens are.
GRAM_COLUMNS, MAKE_UP_COLUMNS = 1 << 14, 1 << 8
NUMBERS = ("length", "letters", "digits", "others", "runs")


def char_grams(token: Column) -> Column:
    """All n-grams of 2 to 5 characters, repeats kept, with a space at both ends."""
    text = F.concat(F.lit(" "), token, F.lit(" "))
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in range(SHORTEST, LONGEST + 1)])


def featured(rows: DataFrame, token: str) -> DataFrame:
    """rows with the columns that the pipeline reads."""
    text = F.upper(F.coalesce(F.col(token), F.lit("")))
    left = lambda other: F.length(F.regexp_replace(text, other, "")).cast("double")
    made = F.regexp_replace(F.regexp_replace(text, "[A-Z]+", "A"), "[0-9]+", "9")
    numbers = {"length": F.length(text).cast("double"), "letters": left("[^A-Z]"), "digits": left("[^0-9]"), "others": left("[A-Z0-9]"), "runs": F.length(made).cast("double")}
    return rows.withColumns({"grams": char_grams(text), "made": made, "head": F.substring(text, 1, 1), **numbers})


def family_model(rows: DataFrame, token: str, family: str, iterations: int = 60, penalty: float = 1e-4) -> PipelineModel:
    stages = [
        StringIndexer(inputCol=family, outputCol="class", stringOrderType="alphabetAsc", handleInvalid="skip"),
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=GRAM_COLUMNS),
        IDF(inputCol="counts", outputCol="rarity", minDocFreq=LEAST_TOKENS),
        VectorAssembler(inputCols=list(NUMBERS), outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=False),
        FeatureHasher(inputCols=["made", "head"], outputCol="make_up", numFeatures=MAKE_UP_COLUMNS),
        VectorAssembler(inputCols=["rarity", "scaled", "make_up"], outputCol="features"),
        LogisticRegression(labelCol="class", featuresCol="features", family="multinomial", maxIter=iterations, regParam=penalty),
    ]
    return Pipeline(stages=stages).fit(featured(rows, token))


def predicted(model: PipelineModel, rows: DataFrame, token: str) -> DataFrame:
    """rows with predicted, the likeliest family, and probability."""
    indexer = model.stages[0]
    scorer = PipelineModel(stages=[*model.stages[1:], IndexToString(inputCol="prediction", outputCol="predicted", labels=list(indexer.labels))])
    scored = scorer.transform(featured(rows, token))
    return scored.select(*rows.columns, "predicted", F.array_max(vector_to_array("probability")).alias("probability"))
