"""The invoice store as set-based jobs: snapshot in, snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.amounts import amount_es
from ledgerloom.functions.dates import date_storage
from ledgerloom.functions.text import sentinel_to_null
from ledgerloom.vocab import (
    AMOUNT_FIELDS, CORRECTABLE_FIELDS, DATE_FIELDS, FIELD_NAMES, ITEM_FIELD_NAMES,
)

#: Rows of its largest table that a deletion gives to one task.
ROWS_A_TASK = 250_000


def canonicalise(records: DataFrame) -> DataFrame:
    """Producer field names to canonical ones; sentinel texts to null."""
    texts = {f.name for f in records.schema.fields if isinstance(f.dataType, StringType)}
    return records.select(*[
        (sentinel_to_null(F.col(c)) if c in texts else F.col(c)).alias(FIELD_NAMES.get(c, c))
        for c in records.columns
    ])


def canonical_items(items: DataFrame) -> DataFrame:
    """Items whose producer used either set of names: the canonical name wins if both are set."""
    out = [c for c in items.columns if c not in ITEM_FIELD_NAMES and c not in ITEM_FIELD_NAMES.values()]
    for producer, canonical in ITEM_FIELD_NAMES.items():
        present = [F.col(c) for c in (canonical, producer) if c in items.columns]
        value = F.coalesce(*present) if present else F.lit(None)
        out.append(value.alias(canonical))
    return items.select(*out)


def attach_user(invoices: DataFrame, users: DataFrame, default_user: int | None = None) -> DataFrame:
    """Set user_id by customer e-mail; without a match the default stays.

    Of several users with one address the one of lowest id counts.
    """
    owners = users.groupBy(F.col("email").alias("customer_email")).agg(F.min("id").alias("_owner"))
    joined = invoices.join(owners, "customer_email", "left")
    owner = F.coalesce("_owner", F.lit(default_user).cast("long"))
    return joined.withColumn("user_id", owner).drop("_owner")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in the given order (map-side combined)."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("_row")).select("_row.*")


def upsert(
    existing: DataFrame, incoming: DataFrame, key: str = "file_path", order: str = "seq", highest: int | None = None
) -> DataFrame:
    """Merge extracted invoices into the snapshot.

    The last incoming row per key wins. A matched invoice keeps its id and takes
    every incoming value, nulls included; unmatched rows get new ids above the
    present ones; the rest stays. Both sides are unique on the key when they
    meet, so no key can be hot in the join. New ids are the highest stored id
    plus the row's sequence number, which needs no global ordering. ``highest`` is that
    stored id if it is known, or if ``existing`` is only a part of what is stored.
    """
    fresh = latest_per_key(incoming, key, [order])
    values = [c for c in existing.columns if c not in ("id", key)]
    new = fresh.select(key, F.col(order).alias("_seq"), *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = existing.join(new, key, "full_outer")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar() if highest is None else F.lit(highest)
    arrived, known = F.col("_seq").isNotNull(), F.col("id").isNotNull()
    action = F.when(arrived & known, "update").when(arrived, "insert").otherwise("keep")
    return joined.select(
        F.coalesce("id", top + F.col("_seq")).alias("id"),
        key,
        *[F.when(arrived, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        action.alias("action"),
    )


def corrected_value(raw: Column, field: str) -> Column:
    """The typed form of a correction's text; null if it does not parse."""
    if field in AMOUNT_FIELDS:
        return amount_es(raw)
    if field in DATE_FIELDS:
        return date_storage(raw)
    return raw


def header_corrections_wide(corrections: DataFrame, fields: list[str]) -> DataFrame:
    """Latest correction per field, one row per invoice, in a single aggregation."""
    def newest(f: str) -> Column:
        entry = F.struct("corrected_at", "id", "corrected_value")
        return F.max(F.when(F.col("field") == f, entry))["corrected_value"]

    return corrections.groupBy("invoice_id").agg(*[newest(f).alias(f"_c_{f}") for f in fields])


def apply_header_corrections(invoices: DataFrame, corrections: DataFrame, where: Column | None = None) -> DataFrame:
    """Corrections beat extracted values, field by field; with ``where`` in the rows of that condition only."""
    fields = [f for f in CORRECTABLE_FIELDS if f in invoices.columns]
    wide = header_corrections_wide(corrections, fields).withColumnRenamed("invoice_id", "id")
    joined = invoices.join(wide, "id", "left")
    return joined.select(*[
        F.coalesce(corrected_value(F.col(f"_c_{c}") if where is None else F.when(where, F.col(f"_c_{c}")), c), F.col(c)).alias(c)
        if c in fields else F.col(c)
        for c in invoices.columns
    ])


def replace_items(items: DataFrame, changed: DataFrame, new_items: DataFrame) -> DataFrame:
    """Invoices listed in ``changed`` get their new items (possibly none); others keep theirs."""
    kept = items.join(changed.select("invoice_id").distinct(), "invoice_id", "left_anti")
    return kept.unionByName(new_items)


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Remove invoices and everything that refers to them.

    ``doomed`` has one column, ``invoice_id``. The tables are counted first, so they should
    be stored ones. The doomed keys are dealt to so many tasks that each gets about
    ``ROWS_A_TASK`` rows of the largest table, and the join deals the tables likewise: the
    compressed size of keys, by which adaptive execution joins partitions, says little of
    their number. A task holds its doomed keys in a hash table, each once, and sorts nothing.
    """
    spark, doomed = doomed.sparkSession, doomed.select("invoice_id")
    largest = max(df.count() for df in (doomed, *tables.values()))
    # With fewer than the usual number the join would deal both sides anew.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest // ROWS_A_TASK))
    keys = doomed.repartition(parts, "invoice_id").hint("shuffle_hash")
    out = {}
    for name, df in tables.items():
        key = "id" if name == "invoices" else "invoice_id"
        out[name] = df.join(keys.withColumnRenamed("invoice_id", key), key, "left_anti")
    return out


def lookup(rows: DataFrame, keys: DataFrame, key: str, order: str = "id") -> DataFrame:
    """First row (lowest id) for each wanted key."""
    hits = rows.join(keys.select(key).distinct(), key, "left_semi")
    first = F.min_by(F.struct(*rows.columns), F.col(order))
    return hits.groupBy(key).agg(first.alias("_row")).select("_row.*")


def children(rows: DataFrame, keys: DataFrame, key: str = "invoice_id") -> DataFrame:
    """All rows that belong to the wanted invoices."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def with_items(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Invoices with their items, one row per item; invoices without items stay.

    Not one outer join: Spark cannot split a hot invoice's items there. The inner
    join can be split, and the invoices without items are added separately.
    """
    own = items.withColumnsRenamed({"id": "item_id", "invoice_id": "id"})
    bare = invoices.join(own.select("id").distinct(), "id", "left_anti")
    return invoices.join(own, "id").unionByName(bare, allowMissingColumns=True)
