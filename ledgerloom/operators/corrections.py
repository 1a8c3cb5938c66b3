"""Correction logs and the item changes they describe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import amount_es
from ledgerloom.functions.text import item_signature
from ledgerloom.sources.snapshots import conform
from ledgerloom.vocab import CORRECTION_KINDS, ITEM_NUMBER_FIELDS

_ITEM_FIELDS = ["description", *ITEM_NUMBER_FIELDS]
_SIGNATURE = ["sig_description", "sig_quantity", "sig_unit_price"]
#: Ids and line numbers of one run of places within a group; a group of any size is numbered run by run.
RUN = 1 << 16


def kind_code(kind: Column) -> Column:
    """One of update, add, delete, whatever spelling the log uses."""
    low = F.lower(kind)
    return F.coalesce(*[F.when(low.isin(*names), code) for code, names in CORRECTION_KINDS.items()])


def item_payload(parsed: Column) -> Column:
    """An item struct from a parsed (variant) payload; numbers given as text are Spanish amounts.

    The payload is parsed once into a variant column; reading fields off it is
    cheap, while a schema per field would parse the text again for each.
    """
    def number(f: str) -> Column:
        path = f"$.{f}"
        is_text = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING"
        as_text = F.try_variant_get(parsed, path, "string")
        return F.when(is_text, amount_es(as_text)).otherwise(F.try_variant_get(parsed, path, "double"))

    description = F.try_variant_get(parsed, "$.description", "string").alias("description")
    item = F.struct(description, *[number(f).alias(f) for f in ITEM_NUMBER_FIELDS])
    return F.when(parsed.isNotNull(), item)


def upsert_corrections(log: DataFrame) -> DataFrame:
    """One correction per invoice and field: the latest, with its own time stamp."""
    order = F.struct("corrected_at", "id")
    last = F.max_by(F.struct("id", "original_value", "corrected_value", "corrected_at"), order)
    return log.groupBy("invoice_id", "field").agg(last.alias("_last")).select(
        "invoice_id", "field", "_last.*"
    )


def overlay_items(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replay item corrections on freshly extracted items.

    Items (invoice_id, seq, item fields) and corrections (invoice_id, id, kind,
    original_item_id, field, original_value, corrected_value) meet in one
    aggregation per invoice and signature:

    * of items with equal signature the last stays;
    * any delete removes the signature;
    * otherwise the last update replaces the item;
    * the first add counts only if the signature did not survive.

    Items may have an id; what survives keeps it, added items have none.
    """
    own = ["id"] if "id" in items.columns else []
    kind = F.col("_kind")
    coded = corrections.withColumn("_kind", kind_code(F.col("kind")))
    complete = (
        F.col("original_item_id").isNotNull() & F.col("field").isNotNull()
        & F.col("corrected_value").isNotNull()
    )
    parsed = coded.where((kind != "update") | complete).select(
        "invoice_id", F.col("id").alias("_order"), "_kind",
        F.try_parse_json(F.when(kind != "add", F.col("original_value"))).alias("_old"),
        F.try_parse_json(F.when(kind != "delete", F.col("corrected_value"))).alias("_new"),
    )
    read = parsed.select(
        "invoice_id", "_order", "_kind",
        item_payload(F.col("_old")).alias("_original"), item_payload(F.col("_new")).alias("_item"),
    )
    # A payload that is no JSON makes the correction void.
    readable = F.when(kind == "add", F.col("_item").isNotNull()).when(
        kind == "delete", F.col("_original").isNotNull()
    ).otherwise(F.col("_item").isNotNull() & F.col("_original").isNotNull())
    changes = read.withColumn("_target", F.coalesce("_original", "_item")).select(
        "invoice_id",
        *item_signature(F.col("_target.description"), F.col("_target.quantity"), F.col("_target.unit_price")),
        F.when(readable, kind).alias("_kind"), "_order", "_item",
    )
    base = items.select(
        "invoice_id",
        *item_signature(F.col("description"), F.col("quantity"), F.col("unit_price")),
        F.lit("base").alias("_kind"), F.col("seq").alias("_order"),
        F.struct(*_ITEM_FIELDS).alias("_item"), *own,
    )

    def of_kind(k: str, fold) -> Column:
        is_kind = kind == k
        return fold(F.when(is_kind, F.struct("_order", "_item")))["_item"]

    signature = ["sig_description", "sig_quantity", "sig_unit_price"]
    both = base.unionByName(changes, allowMissingColumns=True)
    last_id = [F.max_by("id", F.when(kind == "base", F.col("_order"))).alias("_id") for _ in own]
    merged = both.groupBy("invoice_id", *signature).agg(
        of_kind("base", F.max).alias("_base"),
        of_kind("update", F.max).alias("_update"),
        of_kind("add", F.min).alias("_add"),
        F.coalesce(F.bool_or(kind == "delete"), F.lit(False)).alias("_deleted"), *last_id,
    )
    survives = F.col("_base").isNotNull() & ~F.col("_deleted")
    result = F.when(survives, F.coalesce("_update", "_base")).otherwise(F.col("_add"))
    ids = [F.when(survives, F.col("_id")).alias("id") for _ in own]
    return merged.select("invoice_id", result.alias("_r"), *ids).where(F.col("_r").isNotNull()).select(
        "invoice_id", "_r.*", *own
    )


def _typed(field: str, raw: Column) -> Column:
    return amount_es(raw) if field in ITEM_NUMBER_FIELDS else raw


def update_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply field changes (item_id, field, corrected_value, id) to items, latest per field."""
    def newest(f: str) -> Column:
        return F.max(F.when(F.col("field") == f, F.struct("id", "corrected_value")))["corrected_value"]

    wide = changes.groupBy("item_id").agg(*[newest(f).alias(f"_c_{f}") for f in _ITEM_FIELDS])
    joined = items.join(wide, items["id"] == wide["item_id"], "left")
    return joined.select(*[
        F.coalesce(_typed(c, F.col(f"_c_{c}")), items[c]).alias(c) if c in _ITEM_FIELDS else items[c]
        for c in items.columns
    ])


def replay_item_fields(items: DataFrame, log: DataFrame) -> DataFrame:
    """Apply logged changes of single fields (kind, original_item_id, field, corrected_value, id).

    These rows hold a plain value and not an item payload. Run it before
    ``overlay_items``, which applies the payloads. The latest change of a field counts.
    """
    plain = ~F.startswith(F.ltrim("corrected_value"), F.lit("{"))
    changes = log.where((kind_code(F.col("kind")) == "update") & F.col("field").isin(*_ITEM_FIELDS) & plain)
    return update_items(items, changes.select(F.col("original_item_id").alias("item_id"), "field", "corrected_value", "id"))


def numbered_within(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add ``_nth``: the place of each row within its group, by ``order`` (a whole number, unique in the group).

    Numbers are given within runs of RUN values of the order, and each run starts where
    the runs before it end. Only the sizes of runs are seen per group, so a group with a
    third of all rows is numbered in as many tasks as it has runs. Null group parts are equal.
    """
    run = F.floor(F.col(order) / RUN)
    keyed = rows.withColumn("_run", run)
    sizes = keyed.groupBy(*group, "_run").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_run").alias("_g_run"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    joined = keyed.join(starts, reduce(Column.__and__, same, F.col("_run") == F.col("_g_run")))
    place = F.row_number().over(Window.partitionBy(*group, "_run").orderBy(order))
    return joined.withColumn("_nth", F.col("_start") + place).select(*rows.columns, "_nth")


def as_extracted(items: DataFrame, log: DataFrame) -> DataFrame:
    """Stored items as they were extracted: before their first logged change of each field.

    ``log`` rows of scalar changes hold the value before in ``original_value``, as stored.
    """
    plain = ~F.startswith(F.ltrim(F.coalesce("corrected_value", F.lit(""))), F.lit("{"))
    changes = log.where((kind_code(F.col("kind")) == "update") & F.col("field").isin(*_ITEM_FIELDS) & plain)

    def first(f: str) -> Column:
        # the entry as a struct: an original value may be null
        return F.min(F.when(F.col("field") == f, F.struct("id", "original_value"))).alias(f"_o_{f}")

    wide = changes.groupBy(F.col("original_item_id").alias("_item_id")).agg(*[first(f) for f in _ITEM_FIELDS])
    joined = items.join(wide, items["id"] == wide["_item_id"], "left")

    def before(f: str) -> Column:
        value = F.col(f"_o_{f}.original_value")
        value = value.try_cast("double") if f in ITEM_NUMBER_FIELDS else value
        return F.when(F.col(f"_o_{f}").isNotNull(), value).otherwise(items[f]).alias(f)

    return joined.select(*[before(c) if c in _ITEM_FIELDS else items[c] for c in items.columns])


def match_identities(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Give freshly extracted items (invoice_id, seq, fields) the ids of the items they were before.

    ``old``: id, invoice_id and the fields as extracted. Items of one invoice match by
    signature, and those of equal signature by their order (id, seq). An item without
    counterpart has a null id; an old item without one is gone.
    """
    def keyed(rows: DataFrame, order: str) -> DataFrame:
        signature = item_signature(F.col("description"), F.col("quantity"), F.col("unit_price"))
        return numbered_within(rows.select("*", *signature), ["invoice_id", *_SIGNATURE], order)

    known = keyed(old.select("id", "invoice_id", "description", "quantity", "unit_price"), "id")
    known = known.select("id", *[F.col(c).alias(f"_k_{c}") for c in ("invoice_id", *_SIGNATURE, "_nth")])
    new = keyed(fresh.drop("id"), "seq")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("invoice_id", *_SIGNATURE)]
    joined = new.join(known, reduce(Column.__and__, same, F.col("_nth") == F.col("_k__nth")), "left")
    return joined.select("id", *[c for c in fresh.columns if c != "id"])


def replay_on_extracted(old: DataFrame, fresh: DataFrame, log: DataFrame) -> DataFrame:
    """Fresh items with the ids of the old ones and all logged corrections: scalar ones by id, then payloads by signature.

    ``old`` are the items as stored, corrections included. Returns id (null for new
    items), invoice_id and the item fields.
    """
    matched = match_identities(as_extracted(old, log), fresh)
    return overlay_items(replay_item_fields(matched, log), log)


def add_items(items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add requested items; returns the new items table and the audit rows.

    A request has its own number (``request_id``); the new id is the highest
    stored id plus that number, so no global ranking is needed.
    """
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    added = requests.select(
        (top + F.col("request_id")).alias("id"), "invoice_id", "description",
        *[amount_es(F.col(f)).alias(f) for f in ITEM_NUMBER_FIELDS],
    )
    audit = added.select(
        "invoice_id", F.col("id").alias("original_item_id"), F.lit("add").alias("kind"),
        F.to_json(F.struct(*_ITEM_FIELDS), {"ignoreNullFields": "false"}).alias("corrected_value"),
    )
    return items.select(*added.columns).unionByName(added), audit


def change_audit(items: DataFrame, changes: DataFrame) -> DataFrame:
    """One audit row per requested field change that really changes the value.

    Numbers are compared as numbers, so '23,00' is no change to 23.
    """
    joined = changes.join(items, changes["item_id"] == items["id"])
    old, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in _ITEM_FIELDS:
        is_field = F.col("field") == f
        old = F.when(is_field, items[f].cast("string")).otherwise(old)
        new = F.when(is_field, _typed(f, changes["corrected_value"]).cast("string")).otherwise(new)
    return joined.select(
        items["invoice_id"], changes["item_id"], changes["field"],
        old.alias("original_value"), new.alias("new_value"), changes["corrected_value"],
    ).where(~F.col("original_value").eqNullSafe(F.col("new_value"))).drop("new_value")


def delete_items(items: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove items by id (``doomed.item_id``); returns remaining items and audit rows."""
    ids = doomed.select(F.col("item_id").alias("id")).distinct()
    old = F.to_json(F.struct("id", "invoice_id", *_ITEM_FIELDS), {"ignoreNullFields": "false"})
    audit = items.join(ids, "id", "left_semi").select(
        "invoice_id", F.col("id").alias("original_item_id"), F.lit("delete").alias("kind"),
        old.alias("original_value"),
    )
    return items.join(ids, "id", "left_anti"), audit


def log_rows(log: DataFrame, at: Column, changed: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """Audit rows of updates, additions and deletions as rows that can be appended to the item log.

    Their ids are above the log's largest, unique and without order.
    """
    changed = changed.withColumnRenamed("item_id", "original_item_id").withColumn("kind", F.lit("update"))
    rows = changed.unionByName(added, allowMissingColumns=True).unionByName(deleted, allowMissingColumns=True)
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    return conform(rows.withColumns({"id": top + 1 + F.monotonically_increasing_id(), "corrected_at": at}), "item_corrections")


def patch_log(log: DataFrame, appended: DataFrame, patches: DataFrame, removed: DataFrame) -> DataFrame:
    """Append to, patch and delete from a correction log.

    Patches (id, corrected_value, patched_at) replace the value and refresh the
    time stamp, of several for one id the latest; removed ids vanish.
    """
    newest = F.max_by("corrected_value", F.struct("patched_at", "corrected_value"))
    p = patches.groupBy("id").agg(newest.alias("_value"), F.max("patched_at").alias("patched_at"))
    kept = log.unionByName(appended).join(removed.select("id").distinct(), "id", "left_anti")
    rows = kept.join(p, "id", "left")
    hit = F.col("patched_at").isNotNull()
    return rows.withColumns({
        "corrected_value": F.when(hit, F.coalesce("_value", "corrected_value")).otherwise(F.col("corrected_value")),
        "corrected_at": F.coalesce("patched_at", "corrected_at"),
    }).drop("_value", "patched_at")
