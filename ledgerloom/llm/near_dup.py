"""Near duplicates by SetSketch registers, joint likelihood and exact verification.

Texts with equal sets of word shingles are one class. Sketches of the classes are
cut into bands; classes that share a band meet. In each such bucket every member is
first compared with the smallest one; what is still apart is compared in blocks
after the links found so far have been contracted, so members of one component
are never paired again, and only links leave a block. Pairs are kept on their
likely similarity and confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import setsketch as sk
from ledgerloom.llm.common import staged, table
from ledgerloom.llm.components import components
from ledgerloom.llm.hashing import mixed, shingle_sets
from ledgerloom.llm.registry import query

#: Two texts are linked at this Jaccard similarity of their shingle sets, in hundredths.
SIMILAR = 75
#: Pairs less likely similar than this are not confirmed: nearly six standard errors below the bound.
LIKELY = 0.55
#: Most members of a block, on average, and most bytes of their sets (a larger set is a block of its own kind).
BLOCK = 256
BLOCK_BYTES = 16 << 20
#: Copies of one text are dealt to so many keys: a class of any size is joined by many tasks.
SALTS = 1024
_FINGERPRINT = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, d1, d2, sketch = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            d2.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
            sketch.append(sk.registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(sketch, pa.binary())],
            schema=_FINGERPRINT,
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keys = sk.band_keys(_sketches(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), pa.array(np.tile(np.arange(sk.BANDS, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, sk.BANDS))],
            names=["key", "band", "id"],
        )


def _sketches(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), sk.REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, sketches, sizes), those that are likely similar."""
    for batch in batches:
        if batch.num_rows:
            left, right = (_sketches(batch.column(c).to_pylist()) for c in ("a_sketch", "b_sketch"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("a_n", "b_n"))
            j = sk.similarity((left > right).sum(axis=1), (left < right).sum(axis=1), n_a, n_b)
            fine = batch.filter(pa.array(j >= LIKELY))
            yield pa.RecordBatch.from_arrays([fine.column("a"), fine.column("b")], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["id", "elements"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= SIMILAR * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SIMILAR * (len(both) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sets, those that are linked."""
    for batch in batches:
        pairs = zip(batch.column("a_set"), batch.column("b_set"), strict=True)
        kept = [_linked(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair)) for pair in pairs]
        fine = batch.filter(pa.array(kept, pa.bool_()))
        yield pa.RecordBatch.from_arrays([fine.column("a"), fine.column("b")], names=["a", "b"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks of one bucket, links that join components.

    Likely pairs from different components that meet in no earlier band are checked
    on their sets, the likeliest first; a pair whose components have been joined on
    the way is passed over.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            left, right = row["x"], row["y"]
            (ids_l, comp_l, n_l, sk_l), (ids_r, comp_r, n_r, sk_r) = (
                (np.array([m["id"] for m in s]), np.array([m["component"] for m in s]), np.array([m["n"] for m in s], dtype=float), _sketches([m["sketch"] for m in s]))
                for s in (left, right)
            )
            band = row["band"]
            found = []
            for at in range(len(ids_l)):
                other = np.flatnonzero((comp_r != comp_l[at]) & ((ids_r > ids_l[at]) if row["same"] else True))
                if len(other):
                    equal = sk_r[other] == sk_l[at]
                    earlier = equal[:, : 4 * band].reshape(len(other), band, 4).all(axis=2).any(axis=1)
                    other = other[~earlier & (equal.sum(axis=1) >= 0.4 * sk.REGISTERS)]
                    found.append(np.stack((np.full(len(other), at), other)))
            x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            j = sk.similarity((sk_l[x] > sk_r[y]).sum(axis=1), (sk_l[x] < sk_r[y]).sum(axis=1), n_l[x], n_r[y])
            order = np.argsort(-j, kind="stable")[: int((j >= LIKELY).sum())]
            links = _joining(x[order], y[order], comp_l, comp_r, [m["elements"] for m in left], [m["elements"] for m in right])
            ends = np.array([(ids_l[u], ids_r[v]) for u, v in links], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])


def _joining(x: np.ndarray, y: np.ndarray, comp_l: np.ndarray, comp_r: np.ndarray, left: list[bytes], right: list[bytes]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root.setdefault(root[c], root[c])
            c = root[c]
        return c

    kept = []
    for u, v in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(int(comp_l[u])), find(int(comp_r[v]))
        if a != b and _linked(np.frombuffer(left[u], np.uint64), np.frombuffer(right[v], np.uint64)):
            root[a] = b
            kept.append((u, v))
    return kept


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, checked on their full sets."""
    side = lambda p: sets.select(F.col("id").alias(p), F.col("elements").alias(f"{p}_set"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_set", "b_set")
    return staged(joined.mapInArrow(_confirmed, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Null and empty texts, and texts without words, have 0 shingles and are linked with
    nothing. Rows without id are linked with nothing, have no component and are kept.
    Rows that repeat an id are one document: all of them kept or none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = staged(own.mapInArrow(_fingerprints, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"), "fingerprints")
    counts = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    linkable = prints.where(counts).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classes = linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.collect_set("salt").alias("salts"))
    classes = classes.where("n > 1").select("d1", "d2", "first", F.explode("salts").alias("salt"))  # a class once for each of its salts
    # a row is the first of its class unless its class has a smaller id
    members = staged(
        linkable.drop("sketch").join(classes, ["d1", "d2", "salt"], "left").select("doc_id", "n_shingles", "salt", F.coalesce("first", "doc_id").alias("rep")),
        "members",
    )
    copies = members.where("rep <> doc_id").select("doc_id").distinct()
    reps = linkable.join(copies, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch")

    # Buckets of two classes and more, with their smallest member.
    bands = reps.select("id", "sketch").mapInArrow(_bands, "key long, band int, id long")
    heads = bands.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("size"))
    heads = heads.where(F.col("last") > F.col("head"))
    buckets = staged(bands.join(heads.select("key", "head", "size"), "key"), "buckets")

    pairs = buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    met = staged(buckets.select("id").distinct(), "met")
    held = staged(reps.join(met, "id", "left_semi").dropDuplicates(["id"]), "sketches")
    texts = own.join(met, own.doc_id == met.id, "left_semi").dropDuplicates(["doc_id"])
    sets = staged(texts.mapInArrow(_sets, "id long, elements binary"), "sets")

    side = lambda p: held.select(F.col("id").alias(p), F.col("n").alias(f"{p}_n"), F.col("sketch").alias(f"{p}_sketch"))
    likely = pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_likely, "a long, b long")
    links = _confirm(likely, sets)
    joined = components(links)

    # Pairs of members other than the smallest, where they are in different components.
    crowded = buckets.where("size > 2").join(joined, F.col("id") == F.col("node"), "left")
    crowded = staged(crowded.select("key", "band", "size", "id", F.coalesce("component", "id").alias("component")), "crowded")
    open_keys = crowded.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_rows = staged(crowded.join(open_keys, "key", "left_semi").join(held.select("id", "n"), "id"), "open")
    chunks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    parts = open_rows.drop("size").join(open_rows.groupBy("key").agg(chunks.alias("chunks")), "key")
    parts = parts.join(held.select("id", "sketch"), "id").join(sets, "id")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    parts = parts.groupBy("key", "band", "chunks", chunk.alias("chunk")).agg(
        F.collect_list(F.struct("id", "component", "n", "sketch", "elements")).alias("block")  # BLOCK members, BLOCK_BYTES on average
    )
    parts = staged(parts, "blocks")
    # each pair of blocks has a key of its own
    x = parts.select("key", "band", F.col("chunk").alias("cx"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("cy"), F.col("block").alias("x"))
    y = parts.select("key", F.explode(F.sequence(F.lit(0), "chunk")).alias("cx"), F.col("chunk").alias("cy"), F.col("block").alias("y"))
    met_blocks = x.join(y, ["key", "cx", "cy"]).select("band", (F.col("cx") == F.col("cy")).alias("same"), "x", "y")
    more = staged(met_blocks.mapInArrow(_apart, "a long, b long"), "more-links")
    if not more.isEmpty():
        joined = components(links.union(more))

    # Copies find their component by (class, salt); rows that nothing can be linked with meet in no join.
    own_class = members.where("rep = doc_id").join(joined, F.col("rep") == F.col("node"), "left")
    copied = members.where("rep <> doc_id")
    places = copied.select("rep", "salt").distinct().join(joined, F.col("rep") == F.col("node")).select("rep", "salt", "component")
    found = [
        part.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        for part in (own_class, copied.join(places, ["rep", "salt"], "left"))
    ]
    bare = prints.where(~counts).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found[0].union(found[1]).union(bare).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


@query()
def op6_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(table(spark, folder, "documents"))
