"""The corpus pipeline: five stages from raw documents to sharded, mixed training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, mixing, near_dup, sharding
from ledgerloom.llm.common import staged, table
from ledgerloom.llm.decontamination import mark_leaks

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Texts whose words are, in the mean, no surer of any language than this are rejected:
#: 0 is a guess among the languages, 1 certainty. A text in several languages is sure of each word's.
LEAST_SURE = 0.2


def _aside(docs: DataFrame, added: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``work``, and give its rows with the columns of ``docs``, also those named as what it adds."""
    taken = {c.lower() for c in docs.columns}
    free = "own_"
    while any(c.startswith(free) for c in taken):
        free += "_"
    own = {c: f"{free}{c}" for c in docs.columns if c.lower() in added}
    done = work(docs.withColumnsRenamed(own))
    return done.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents without a recognisable language; the field is fitted on the labelled ones."""
    model = language_id.train(docs)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("certainty") >= LEAST_SURE)
    return _aside(docs, language_id.FOUND, lambda own: language_id.identify(own, model).where(sure))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document, the one of smallest id, of each near-duplicate component."""
    judged = near_dup.near_duplicates(docs)
    dropped = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_id"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    benchmark = table(spark, folder, "benchmark")
    return _aside(docs, ("leaks",), lambda own: mark_leaks(own, benchmark).where(F.size("leaks") == 0))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeat or leave out documents so that the sources reach their target sizes."""
    def work(own: DataFrame) -> DataFrame:
        return mixing.materialise(mixing.mix(own), own.columns)

    return _aside(docs, mixing.ADDED, work)


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Give every document (and each of its repetitions) its shard; adds slot and shard."""
    return sharding.place(docs, sharding.document_key(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The fitted language model has no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
