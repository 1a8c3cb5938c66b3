"""Queries that learn from corrections and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import count_model as counts, features, learning as learn_ops, models, quality
from ledgerloom.operators.corrections import upsert_corrections
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans.registry import query
from ledgerloom.session import spread, work_dir
from ledgerloom.sources import json_files
from ledgerloom.sources.catalog import table


def item_corrections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_size > 10 THEN 'description' ELSE 'quantity' END AS field",
        "CASE WHEN p_brand = 'Brand#1' THEN '' WHEN p_brand = 'Brand#2' THEN concat('{', p_name, '}') "
        "WHEN p_type = 'ECONOMY' THEN to_json(named_struct('description', p_name, 'quantity', p_size)) ELSE p_name END AS corrected_value",
    )


ITEM_TERMS_SQL = """
  SELECT CASE WHEN p_brand = 'Brand#2' THEN '{' || p_name || '}' ELSE p_name END AS term, 1 AS source_rank, p_partkey AS first_id
  FROM part WHERE p_size > 10 AND p_brand <> 'Brand#1'"""


@query(f"""
SELECT field, corrected_value, count(*) AS times, min(id) AS first_id FROM ({fx.HEADER_CORRECTIONS_SQL}) GROUP BY ALL""")
def correction_freq(spark: SparkSession, folder: str) -> DataFrame:
    return learn_ops.value_frequency(fx.header_corrections(spark, folder))


def mode_sql(log: str) -> str:
    return f"""
  SELECT field, corrected_value, times, field_first AS first_id FROM (
    SELECT *, min(first_id) OVER (PARTITION BY field) AS field_first,
      row_number() OVER (PARTITION BY field ORDER BY times DESC, first_id) AS rn
    FROM (SELECT field, corrected_value, count(*) AS times, min(id) AS first_id FROM {log} GROUP BY ALL))
  WHERE rn = 1 AND times > 5"""


@query(mode_sql(f"({fx.HEADER_CORRECTIONS_SQL})"))
def correction_mode(spark: SparkSession, folder: str) -> DataFrame:
    return learn_ops.frequent_values(fx.header_corrections(spark, folder))


@query(f"SELECT term, source_rank, min(first_id) AS first_id FROM ({ITEM_TERMS_SQL}) GROUP BY ALL")
def learned_terms(spark: SparkSession, folder: str) -> DataFrame:
    return learn_ops.distinct_terms(learn_ops.item_terms(item_corrections(spark, folder)))


LEARN_SQL = rf"""
WITH c AS (SELECT * FROM ({fx.HEADER_CORRECTIONS_SQL})
  QUALIFY row_number() OVER (PARTITION BY invoice_id, field ORDER BY corrected_at DESC, id DESC) = 1),
f AS ({mode_sql("c")}),
t AS (SELECT corrected_value AS term, 0 AS source_rank, first_id FROM f WHERE field IN ('supplier_name', 'customer_name', 'supplier_tax_id', 'customer_tax_id')
  UNION ALL {ITEM_TERMS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY source_rank, first_id) AS rn FROM t)
SELECT 'pattern' AS kind, field AS name, '(?iu)(\Q' || corrected_value || '\E)' AS value, first_id FROM f WHERE field = 'invoice_number'
UNION ALL SELECT 'term', CAST(source_rank AS VARCHAR), term, first_id FROM r WHERE rn = 1"""


def learned_rows(patterns: DataFrame, terms: DataFrame, frequent: DataFrame) -> DataFrame:
    p = patterns.join(frequent.select("field", "first_id"), "field").select(
        F.lit("pattern").alias("kind"), F.col("field").alias("name"), F.col("regex").alias("value"), "first_id"
    )
    return p.unionByName(terms.select(
        F.lit("term").alias("kind"), F.col("source_rank").cast("string").alias("name"), F.col("term").alias("value"), "first_id"
    ))


@query(LEARN_SQL)
def learn_patterns(spark: SparkSession, folder: str) -> DataFrame:
    corrections = upsert_corrections(fx.header_corrections(spark, folder))
    patterns, terms = learn_ops.learn(corrections, item_corrections(spark, folder))
    return learned_rows(patterns, terms, learn_ops.frequent_values(corrections))


@query(f"""
SELECT CASE kind WHEN 'pattern' THEN 'regex' ELSE kind END AS kind, CASE WHEN kind = 'pattern' THEN name END AS name, value
FROM ({LEARN_SQL})""")
def patterns_file_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Learned patterns and terms, written as JSON files to a new folder and read from there."""
    patterns, terms = learn_ops.learn(upsert_corrections(fx.header_corrections(spark, folder)), item_corrections(spark, folder))
    path = work_dir(spark, "learned")
    json_files.write_json(json_files.learned_records(patterns, terms), path)
    return json_files.explode_learned(json_files.read_learned(spark, path), [])


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
r AS (SELECT *, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM tf JOIN df USING (token))
SELECT doc_id, token, tf, df, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""")
def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    out = features.tfidf(spread(table(spark, folder, "documents")), "doc_id")
    return out.withColumn("weight", F.round("weight", 6))


def _training_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "concat(event_type, ' k', get_json_object(props, '$.k')) AS original_value",
        "CASE WHEN event_type = 'error' THEN 'Sin Dato' ELSE concat('Corregido ', event_type) END AS corrected_value",
    )


@query("""
SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS null_original_value,
  count(*) FILTER (value < 10) AS null_corrected_value FROM events""")
def training_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_report(table(spark, folder, "events").selectExpr(
        "CASE WHEN event_type <> 'error' THEN event_type END AS original_value",
        "CASE WHEN value >= 10 THEN value END AS corrected_value",
    ))


@query()
def ml_train_predict(spark: SparkSession, folder: str) -> DataFrame:
    log = _training_log(spark, folder)
    return models.predict_corrections(models.train_corrections(log), log)


@query()
def predict_fill(spark: SparkSession, folder: str) -> DataFrame:
    log = _training_log(spark, folder)
    entities = log.selectExpr("event_id", "original_value", "CASE WHEN original_value LIKE 'view%' THEN '' ELSE corrected_value END AS value")
    out = models.predict_corrections(models.train_corrections(log), entities)
    return out.select(
        "event_id",
        models.merge_prediction(F.col("value"), F.col("predicted_value"), "fill").alias("filled"),
        models.merge_prediction(F.col("value"), F.col("predicted_value"), "overwrite").alias("overwritten"),
    )


@query("""
WITH m AS (SELECT event_type, arg_max(k, n * 1000 - k) AS predicted FROM (
  SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type)
SELECT event_id, CASE WHEN value < 10 THEN 'k' || predicted ELSE 'v' || user_id END AS filled, 'k' || predicted AS overwritten
FROM events JOIN m USING (event_type)""")
def prediction_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Both merge modes with the most frequent value per field as the prediction."""
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    counts = events.groupBy("event_type", "k").agg(F.count("*").alias("n"))
    predicted = counts.groupBy("event_type").agg(
        F.concat(F.lit("k"), F.max_by("k", F.col("n") * 1000 - F.col("k"))).alias("predicted")
    )
    value = F.expr("CASE WHEN value < 10 THEN '' ELSE concat('v', user_id) END")
    return events.join(predicted, "event_type").select(
        "event_id",
        models.merge_prediction(value, F.col("predicted"), "fill").alias("filled"),
        models.merge_prediction(value, F.col("predicted"), "overwrite").alias("overwritten"),
    )


@query()
def classify_docs(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = models.train_classifier(docs.join(labels, "doc_id"), "text", "quality")
    return models.classify(model, docs).drop("text")


#: Corrections of two fields, whose texts share words with several values.
_OPEN_LOG = [
    "event_id", "IF(user_id % 2 = 0, 'supplier_name', 'currency') AS field",
    "concat(event_type, ' k', get_json_object(props, '$.k'), ' u', user_id % 7) AS original_value",
    "CASE WHEN value < 5 THEN NULL ELSE concat('Valor ', event_type, ' ', cast(get_json_object(props, '$.k') AS int) % 3) END AS corrected_value",
]
_OPEN_SQL = r"""
log AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'supplier_name' ELSE 'currency' END AS field,
    event_type || ' k' || (props->>'$.k') || ' u' || (user_id % 7) AS original_value,
    CASE WHEN value >= 5 THEN 'Valor ' || event_type || ' ' || (CAST(props->>'$.k' AS INT) % 3) END AS value FROM events),
known AS (SELECT * FROM log WHERE value IS NOT NULL),
tokens AS (SELECT field, value, unnest(regexp_extract_all(lower(original_value), '[\p{L}\p{M}\p{N}_]{2,}')) AS word FROM known),
w AS (SELECT field, word, value, count(*) AS k FROM tokens GROUP BY ALL),
v AS (SELECT field, value, count(*) AS n FROM known GROUP BY ALL),
s AS (SELECT field, value, sum(k) AS n_words FROM w GROUP BY ALL),
f AS (SELECT field, sum(n) AS n_field, arg_min(value, (-n, value)) AS usual FROM v GROUP BY ALL),
voc AS (SELECT field, count(DISTINCT word) AS n_vocabulary FROM w GROUP BY ALL)"""


@query(f"""
WITH {_OPEN_SQL}
SELECT field, word, value, k AS n, n AS n_value, CAST(n_words AS BIGINT) AS n_words, CAST(n_field AS BIGINT) AS n_field, n_vocabulary, usual
FROM w JOIN v USING (field, value) JOIN s USING (field, value) JOIN f USING (field) JOIN voc USING (field)""")
def count_model_train(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of the correction model, saved and loaded."""
    path = work_dir(spark, "count_model")
    counts.save(counts.train(table(spark, folder, "events").selectExpr(*_OPEN_LOG)), path)
    model = counts.load(spark, path)
    values = model.values.withColumnRenamed("n", "n_value")
    return model.words.join(values, ["field", "value"]).join(model.fields.withColumnRenamed("n", "n_field"), "field")


@query(rf"""
WITH {_OPEN_SQL},
t AS (SELECT DISTINCT field, original_value FROM log),
m AS (SELECT field, original_value, word, count(*) AS m FROM (
  SELECT field, original_value, unnest(regexp_extract_all(lower(original_value), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')) AS word FROM t) GROUP BY ALL),
len AS (SELECT field, original_value, sum(m) AS l FROM m SEMI JOIN w USING (field, word) GROUP BY ALL),
g AS (SELECT m.field, original_value, value, sum(m * ln(k + 1)) AS gain FROM m JOIN w USING (field, word) GROUP BY ALL),
p AS (SELECT g.field, g.original_value, arg_min(g.value, (-round(ln(n / n_field) + gain - l * ln(n_words + n_vocabulary), 9), g.value)) AS best
  FROM g JOIN v ON v.field = g.field AND v.value = g.value JOIN s ON s.field = g.field AND s.value = g.value
  JOIN f ON f.field = g.field JOIN voc ON voc.field = g.field JOIN len ON len.field = g.field AND len.original_value = g.original_value GROUP BY ALL)
SELECT event_id, coalesce(best, usual) AS overwritten, coalesce(log.value, best, usual) AS filled
FROM log LEFT JOIN p USING (field, original_value) LEFT JOIN f USING (field)""")
def count_model_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections predicted for every logged text, to overwrite the value there is or to fill a missing one."""
    log = table(spark, folder, "events").selectExpr(*_OPEN_LOG)
    path = work_dir(spark, "count_model")
    counts.save(counts.train(log), path)
    out = counts.predict(counts.load(spark, path), log)
    return out.select(
        "event_id", models.merge_prediction(F.col("corrected_value"), F.col("predicted_value"), "overwrite").alias("overwritten"),
        models.merge_prediction(F.col("corrected_value"), F.col("predicted_value"), "fill").alias("filled"),
    )
