"""Learned patterns and generic records as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEARNED_SCHEMA = T.StructType([
    T.StructField("regex_patterns", T.MapType(T.StringType(), T.StringType())),
    T.StructField("nlp_terms", T.ArrayType(T.StringType())),
    T.StructField("item_patterns", T.MapType(T.StringType(), T.StringType())),
])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, whole_file: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", whole_file).option("mode", "PERMISSIVE").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write records as lines of JSON. Fails if the folder exists: what was learned is never overwritten."""
    df.write.mode("errorifexists").json(path)


def read_learned(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Learned pattern files; an unreadable record gives an empty set.

    Written files have a record in each line; ``whole_file`` reads files written by
    hand, with one record over many lines.
    """
    return read_json(spark, path, LEARNED_SCHEMA, whole_file)


def parse_learned(json: Column) -> Column:
    return F.from_json(json, LEARNED_SCHEMA)


def explode_learned(learned: DataFrame, keys: list[str]) -> DataFrame:
    """Long form ``(keys…, kind, name, value)`` of learned pattern records."""
    def entry(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))

    def of_map(kind: str, c: str) -> Column:
        pairs = F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>"))
        return F.transform(pairs, lambda e: entry(kind, e["key"], e["value"]))

    terms = F.coalesce("nlp_terms", F.array().cast("array<string>"))
    no_name = F.lit(None).cast("string")
    entries = F.concat(
        of_map("regex", "regex_patterns"),
        of_map("item", "item_patterns"),
        F.transform(terms, lambda t: entry("term", no_name, t)),
    )
    return learned.select(*keys, F.inline(entries))


def learned_records(patterns: DataFrame, terms: DataFrame) -> DataFrame:
    """Patterns and terms as records of the learned-pattern layout.

    Each record holds one pattern or one term, so nothing is collected; readers
    explode all records of a folder into the same tables.
    """
    no_map = F.lit(None).cast("map<string,string>")
    p = patterns.select(
        F.create_map("field", "regex").alias("regex_patterns"),
        F.lit(None).cast("array<string>").alias("nlp_terms"),
        no_map.alias("item_patterns"),
    )
    t = terms.select(
        no_map.alias("regex_patterns"), F.array("term").alias("nlp_terms"), no_map.alias("item_patterns")
    )
    return p.unionByName(t)
