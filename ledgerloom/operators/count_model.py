"""Predicting corrections from counts: naive Bayes as joins and aggregations.

The model is three tables: how often each value was entered for a field, how many words
the corrected texts of a value have, and how often each of these words stands there. Values are
open-ended: nothing about them is held on the driver, and a new value is a new row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.features import WORD

VALUES = "field STRING, value STRING, n BIGINT, n_words BIGINT"
WORDS = "field STRING, word STRING, value STRING, n BIGINT"
FIELDS = "field STRING, n BIGINT, n_vocabulary BIGINT, usual STRING"


@dataclass(frozen=True)
class CountModel:
    """values: field, value, n, n_words; words: field, word, value, n; fields: field, n, n_vocabulary, usual (the most frequent value)."""

    values: DataFrame
    words: DataFrame
    fields: DataFrame


def _words(rows: DataFrame, keep: list[str]) -> DataFrame:
    found = F.regexp_extract_all(F.lower("original_value"), F.lit(WORD), F.lit(0))
    return rows.select(*keep, F.explode(found).alias("word"))


def train(corrections: DataFrame) -> CountModel:
    """Count (field, original_value, corrected_value); rows with a null are left out.

    Equal corrections are counted first, so one that was made a million times is one row
    from there on. Ties for the most frequent value go to the smallest.
    """
    pairs = (
        corrections.select("field", "original_value", F.col("corrected_value").alias("value")).dropna()
        .groupBy("field", "original_value", "value").agg(F.count("*").alias("m"))
    )
    words = _words(pairs, ["field", "value", "m"]).groupBy("field", "word", "value").agg(F.sum("m").alias("n"))
    sizes = words.groupBy("field", "value").agg(F.sum("n").alias("n_words"))
    values = pairs.groupBy("field", "value").agg(F.sum("m").alias("n")).join(sizes, ["field", "value"], "left")
    values = values.withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    vocabulary = words.select("field", "word").distinct().groupBy("field").agg(F.count("*").alias("n_vocabulary"))
    most = F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("usual")
    fields = values.groupBy("field").agg(F.sum("n").alias("n"), most).join(vocabulary, "field", "left")
    fields = fields.select("field", "n", F.coalesce("n_vocabulary", F.lit(0)).alias("n_vocabulary"), "usual")
    return CountModel(values.select("field", "value", "n", "n_words"), words.select("field", "word", "value", "n"), fields)


def save(model: CountModel, path: str) -> None:
    """Write the model to a new folder."""
    for name in ("values", "words", "fields"):
        getattr(model, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> CountModel:
    return CountModel(*(
        spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in (("values", VALUES), ("words", WORDS), ("fields", FIELDS))
    ))


def predict(model: CountModel, rows: DataFrame) -> DataFrame:
    """Add ``predicted_value`` to rows with field and original_value.

    Among the values that share a word with the text, the likeliest by word counts with
    one added to each; ties (likelihoods rounded to 9 digits) go to the smallest value. If
    none shares a word, the field's most frequent value; null for an unknown field.
    Equal texts are predicted once.
    """
    texts = rows.select("field", "original_value").distinct()
    counted = _words(texts, ["field", "original_value"]).groupBy("field", "original_value", "word").agg(F.count("*").alias("m"))
    lengths = counted.join(model.words.select("field", "word").distinct(), ["field", "word"], "left_semi")
    lengths = lengths.groupBy("field", "original_value").agg(F.sum("m").alias("length"))  # words that the model knows
    shared = counted.join(model.words.withColumnRenamed("n", "k"), ["field", "word"])
    gains = shared.groupBy("field", "original_value", "value").agg(F.sum(F.col("m") * F.log(F.col("k") + 1)).alias("gain"))
    scored = (
        gains.join(model.values, ["field", "value"]).join(lengths, ["field", "original_value"])
        .join(model.fields.select("field", F.col("n").alias("n_field"), "n_vocabulary"), "field")
    )
    score = F.log(F.col("n") / F.col("n_field")) + F.col("gain") - F.col("length") * F.log(F.col("n_words") + F.col("n_vocabulary"))
    best = scored.groupBy("field", "original_value").agg(F.min_by("value", F.struct(-F.round(score, 9), F.col("value"))).alias("_best"))
    best = best.select(F.col("field").alias("_f"), F.col("original_value").alias("_o"), "_best")
    usual = model.fields.select(F.col("field").alias("_u"), "usual")
    out = rows.join(best, (F.col("field") == F.col("_f")) & (F.col("original_value") == F.col("_o")), "left")
    out = out.join(usual, F.col("field") == F.col("_u"), "left")
    return out.select(*rows.columns, F.coalesce("_best", "usual").alias("predicted_value"))
