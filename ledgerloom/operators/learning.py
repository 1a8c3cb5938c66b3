"""Learning patterns and terms from correction logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import literal_pattern, strip
from ledgerloom.vocab import LEARN_THRESHOLD, PATTERN_FIELDS, TERM_FIELDS


def value_frequency(corrections: DataFrame) -> DataFrame:
    """How often each value was entered for each field, and when first."""
    return corrections.groupBy("field", "corrected_value").agg(
        F.count("*").alias("times"), F.min("id").alias("first_id")
    )


def frequent_values(corrections: DataFrame, threshold: int = LEARN_THRESHOLD) -> DataFrame:
    """The most frequent value per field if entered more than ``threshold`` times.

    A tie goes to the value entered first.
    """
    return modal_values(value_frequency(corrections), threshold)


def modal_values(frequency: DataFrame, threshold: int = LEARN_THRESHOLD) -> DataFrame:
    """As ``frequent_values``, from counts (field, corrected_value, times, first_id)."""
    order = F.struct(F.col("times"), (-F.col("first_id")).alias("earlier"))
    best = F.max_by(F.struct("corrected_value", "times"), order)
    per_field = frequency.groupBy("field").agg(
        best.alias("_best"), F.min("first_id").alias("first_id")
    )
    return per_field.select("field", "_best.corrected_value", "_best.times", "first_id").where(
        F.col("times") > threshold
    )


def described_item(value: Column) -> Column:
    """The description in an item payload, or the value itself if it is plain text."""
    v = strip(value)
    is_object = F.startswith(v, F.lit("{")) & F.endswith(v, F.lit("}"))
    return F.when(is_object, F.coalesce(F.get_json_object(v, "$.description"), value)).otherwise(value)


def item_terms(item_corrections: DataFrame) -> DataFrame:
    """Corrected item descriptions as (term, source_rank, first_id), without threshold."""
    useful = (F.col("field") == "description") & (F.coalesce("corrected_value", F.lit("")) != "")
    return item_corrections.where(useful).select(
        described_item(F.col("corrected_value")).alias("term"), F.lit(1).alias("source_rank"),
        F.col("id").alias("first_id"),
    )


def header_terms(frequent: DataFrame) -> DataFrame:
    return frequent.where(F.col("field").isin(*TERM_FIELDS)).select(
        F.col("corrected_value").alias("term"), F.lit(0).alias("source_rank"), "first_id"
    )


def distinct_terms(terms: DataFrame) -> DataFrame:
    """Each term once, at its first position; header terms come before item terms."""
    first = F.min(F.struct("source_rank", "first_id"))
    return terms.groupBy("term").agg(first.alias("_at")).select("term", "_at.*")


def learn(corrections: DataFrame, item_corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns (field, regex) and terms; the result replaces what was learned before."""
    frequent = frequent_values(corrections)
    patterns = frequent.where(F.col("field").isin(*PATTERN_FIELDS)).select(
        "field", literal_pattern(F.col("corrected_value")).alias("regex")
    )
    terms = distinct_terms(header_terms(frequent).unionByName(item_terms(item_corrections)))
    return patterns, terms


def merge_patterns(base: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned patterns override base patterns of the same field."""
    b = base.select("field", F.col("regex").alias("_base"))
    l = learned.select("field", F.col("regex").alias("_learned"))
    origin = F.when(F.col("_learned").isNotNull(), "learned").otherwise("base")
    return b.join(l, "field", "full_outer").select(
        "field", F.coalesce("_learned", "_base").alias("regex"), origin.alias("origin")
    )


def patterns_as_dict(patterns: DataFrame) -> dict[str, str]:
    """The pattern table as a dictionary for ``extract_header``: one pattern for each field, else an error."""
    rows = patterns.select("field", "regex").collect()
    found = {r["field"]: r["regex"] for r in rows}
    if len(found) < len(rows):
        raise ValueError("a field has several patterns")
    return found
