"""Mixing sources to target weights by capped water-filling.

Every source asks for its weighted share of the wanted size. Sources that would
exceed their most epochs stop there, and the excess is shared again by weight
until none is above. Whole epochs repeat every document; the fraction is filled
with the documents of smallest seeded draw, and the last one is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import digest_number, keeps_names, staged, table, word_count
from ledgerloom.llm.registry import query

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = "mix-1"
#: Hexadecimal digits of a draw decided by each of the two counting passes.
DIGITS = 3

ADDED = ("size", "source_size", "target", "repeats", "part")


def source_table(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row for each source: source, source_size, weight, target.

    ``sized`` has source and size. The rows are as many as there are sources, the
    sizes are summed before the shuffle.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = staged(
        per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))),
        "sources",
    )
    most_col = F.col("source_size") * most
    wanted = share * float(per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # those that the level stops, and what is left for the others by weight
        full = most_col <= F.col("weight") * level
        row = per.agg(
            F.sum(F.when(full, most_col)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not row.open:
            break
        new = (wanted - (row.used or 0.0)) / row.open
        if new <= level * (1 + 1e-12):
            break
        level = new
    return per.withColumn("target", F.least(most_col, F.col("weight") * F.lit(level)).cast("double"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` (doc_id, text, source, more) with size, source_size, target, repeats and part added.

    ``repeats`` counts whole repetitions; ``part`` is the number of words of one
    more, fractional repetition (0: none). Weights go to sources in order of their
    code points, null last, repeating. Null texts and texts without words have
    size 0 and are taken 0 words in any number of repetitions. Rows with the same
    id have the same draw: they are taken together, or in equal parts. A source
    without words has target 0. Columns of the added names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    sized = docs.withColumn("size", word_count(F.col("text")))
    return mix_sized(sized, weights, share, most, seed)


@keeps_names
def mix_sized(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """As ``mix``, for rows that have doc_id, source and size."""
    draw = digest_number(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digits=2 * DIGITS)
    sized = sized.withColumn("_draw", draw)
    small = staged(sized.select("source", "size", "_draw"), "sizes")
    plan = source_table(small, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(epochs + 1e-12)
    plan = staged(
        plan.select(
            "source", "source_size", "target", whole.cast("int").alias("_whole"),
            F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0)).alias("_rest"),
        ),
        "targets",
    )
    # Two passes find where the running sum of the draws reaches the rest: by the high
    # digits, then inside that one bucket by the low ones.
    values = 16**DIGITS
    high = F.expr(f"_draw div {values}")
    sums = small.groupBy("source", high.alias("_bucket")).agg(F.sum("size").alias("_sum"))
    first = _crossing(sums.withColumn("_start", F.lit(0).cast("long")), plan)
    first = staged(first.select(F.col("source").alias("_s"), F.col("_bucket").alias("_high"), F.col("_before").alias("_start")), "first")
    inside = small.join(first, F.col("source").eqNullSafe(F.col("_s")) & (high == F.col("_high")))
    sums = inside.groupBy("source", "_start", "_high", (F.col("_draw") % values).alias("_bucket")).agg(F.sum("size").alias("_sum"))
    second = _crossing(sums, plan)
    cut = second.select(
        F.col("source").alias("_s"), (F.col("_high") * values + F.col("_bucket")).alias("_at"),
        F.col("_sum").alias("_tied"), (F.col("_rest") - F.col("_start") - F.col("_before")).alias("_left"),
    )
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = staged(plan.withColumnRenamed("source", "_source"), "cuts")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    open_rest = F.col("_rest") > 0
    below = open_rest & (F.col("_draw") < F.col("_at"))
    part = F.when(open_rest & (F.col("_draw") == F.col("_at")), F.floor(F.col("size") * F.col("_left") / F.col("_tied")))
    return joined.select(
        *[f"`{c}`" for c in sized.columns if c != "_draw"], "source_size", "target",
        (F.col("_whole") + F.coalesce(below, F.lit(False)).cast("int")).alias("repeats"),
        F.coalesce(part, F.lit(0)).cast("long").alias("part"),
    )


def _crossing(sums: DataFrame, plan: DataFrame) -> DataFrame:
    """The bucket of each source in which the running sum first exceeds what is left of the rest."""
    own = plan.select(F.col("source").alias("_p"), "_rest")
    running = F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    joined = sums.withColumn("_before", running - F.col("_sum")).join(own, F.col("source").eqNullSafe(F.col("_p")))
    left = F.col("_rest") - F.col("_start")
    return joined.where((F.col("_before") <= left) & (F.col("_before") + F.col("_sum") > left)).drop("_p")


def materialise(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each repetition; a fractional one becomes a row if it is at least half of the document."""
    half = F.col("part") * 2 >= F.greatest(F.col("size"), F.lit(1))
    count = (F.col("repeats") + half.cast("int")).cast("int")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return mixed.where(count > 0).select(F.explode(F.array_repeat(row, count)).alias("row")).select("row.*")


_ORACLE = f"""
    WITH sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
               CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {2 * DIGITS}) AS BIGINT) AS draw
        FROM documents),
    per AS (
        SELECT source, s, w, {MOST_EPOCHS} * s AS cap, {MOST_EPOCHS} * s / w AS ratio FROM (
            SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
            FROM (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source) AS a) AS b),
    cum AS (
        SELECT ratio, w,
               coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
               sum(w) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open
        FROM per),
    lev AS (
        SELECT (t - used) / open AS level
        FROM cum, (SELECT {SHARE} * sum(s) AS t FROM per) AS x WHERE (t - used) / open <= ratio ORDER BY ratio LIMIT 1),
    targets AS (
        SELECT source, s, least(cap, w * coalesce((SELECT level FROM lev), cap / w)) AS target FROM per),
    placed AS (
        SELECT d.*, t.s, t.target, CAST(floor(t.target / t.s + 1e-12) AS BIGINT) AS whole,
               t.target - floor(t.target / t.s + 1e-12) * t.s AS rest,
               coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
               sum(size) OVER (PARTITION BY d.source, draw) AS tied
        FROM sized AS d JOIN targets AS t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, s AS source_size, target,
           CAST(size * whole + CASE WHEN upto <= rest THEN size
                WHEN upto - tied <= rest AND rest > 0 THEN floor(size * (rest - (upto - tied)) / tied) ELSE 0 END AS BIGINT) AS taken
    FROM placed"""


@query(_ORACLE)
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the number of its words that the mix takes."""
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sized(staged(docs, "counted"))
    taken = F.col("size") * F.col("repeats") + F.col("part")
    return mixed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
