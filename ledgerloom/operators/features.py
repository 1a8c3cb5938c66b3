"""Smoothed, length-normalised TF-IDF as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of at least two letters, digits or underscores.
WORD = r"[\p{L}\p{M}\p{N}_]{2,}"


def term_counts(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Word counts per document: key, token, tf.

    Texts are shuffled by key, as they are shorter than their counted words; the words of a
    document are then counted where it is.
    """
    words = F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))
    return docs.select(key, text_col).repartition(key).select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(
        F.count("*").alias("tf")
    )


def tfidf(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Weights tf·(ln((1+n)/(1+df))+1), scaled to length one per document.

    The document frequencies are one row per word, so in their join a frequent word
    is split by the skew-join rule. The window holds the distinct words of one
    document, never more than the document itself.
    """
    tf = term_counts(docs, key, text_col)
    # Reads tf, so that both uses of the counts share the shuffle of the texts.
    df = tf.groupBy("token").agg(F.count_if(F.col("tf") > 0).alias("df"))
    n = docs.agg(F.count("*").alias("n")).scalar()
    idf = F.log((n + F.lit(1)) / (F.col("df") + 1)) + 1
    weighted = tf.join(df, "token").withColumn("_raw", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "token", "tf", "df", (F.col("_raw") / norm).alias("weight"))
