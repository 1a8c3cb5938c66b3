"""Frequent phrases (word n-grams) and how firmly their words belong together.

Pass 1 deals all n-grams to hash partitions. A task sends its n-grams as sorted
numbers with counts, the differences coded in byte planes, a few bytes each. Each
partition keeps a Misra-Gries summary: tables of counts are merged, and when more
entries than the capacity are left, the largest count beyond it is taken off all. The
capacity exceeds the mass of a partition divided by the threshold, so that less than
the threshold is ever taken off one entry and every frequent n-gram survives (were a
partition's mass larger than planned, the table would grow instead). What may reach
the threshold goes to a bit field of bounded size.

Pass 2 reads the texts again and counts exactly, as strings, what has its bit in
the broadcast field, again in the hash partitions. A field too full for its n-grams lets more of them through, which
costs shuffle and changes no count.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, table
from ledgerloom.llm.hashing import PIECE, mixed, numbers, word_spans
from ledgerloom.llm.registry import query

#: Phrases have 2 to LONGEST words and occur LEAST times in their language; BEST of each language are reported.
LONGEST, LEAST, BEST = 5, 100, 2000
#: N-grams of a hash partition, as planned.
PART_MASS = 1 << 26
#: Most bits of the field of survivors (a broadcast of 32 MB), and bits for each entry that can survive.
FIELD_BITS, BITS_EACH = 1 << 28, 16
#: N-grams (pass 1) and different phrases (pass 2) that a task gathers before it sends them on.
GATHER, PHRASES = 1 << 22, 1 << 19
UNKNOWN = "und"
#: Most tasks of the summaries; a task works on one partition after the other.
TASKS = 1 << 14
COUNTED = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("count", pa.int64())])

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PLACES = numbers(LONGEST, 12) | np.uint64(1)
_LENGTHS = numbers(LONGEST + 1, 13)


class Words:
    """Words of some whole texts, or of a part of one long text."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, first: int, repeated: int) -> None:
        self.data, self.repeated = data, repeated  # the first words may repeat the last ones of the part before
        self.starts, self.ends, self.hashes = word_spans(data, cuts, _GAP)
        rows = np.searchsorted(cuts, self.starts, side="right") - 1
        self.rows = rows + first
        self.pieces = np.cumsum(_BREAK[data])[self.starts] + rows if len(data) else rows

    def phrase(self, at: int, n: int) -> str:
        spans = zip(self.starts[at : at + n], self.ends[at : at + n], strict=True)
        return b" ".join(self.data[a:b].tobytes() for a, b in spans).translate(_LOWER).decode()


def words_of(texts: pa.Array) -> Iterator[Words]:
    """All words of the texts in parts of bounded size; a long text is cut between words, with LONGEST - 1 words repeated."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1, first + 1)
        at, end, done, repeated = offsets[first], offsets[last], offsets[first], 0
        if last > first + 1 or end - at <= PIECE:
            yield Words(data[at:end], offsets[first : last + 1] - at, first, 0)
            first = last
            continue
        while done < end:
            stop = min(max(at + PIECE, done + 1), end)
            while stop < end:  # to the end of the word
                gaps = np.flatnonzero(_GAP[data[stop : min(stop + PIECE, end)]])
                stop = stop + int(gaps[0]) if len(gaps) else min(stop + PIECE, end)
                if len(gaps):
                    break
            part = Words(data[at:stop], np.array([0, stop - at]), first, repeated)
            yield part
            keep = min(LONGEST - 1, len(part.starts))
            at, done, repeated = (at + part.starts[-keep] if keep else stop), stop, keep
        first = last


def grams(words: Words, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, numbers) of all n-grams inside pieces; the language's seed is part of the number."""
    total = np.zeros(len(words.hashes), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(words.hashes) - n + 1
        if m <= 0:
            return
        total = total[:m] + words.hashes[n - 1 :] * _PLACES[n - 1]
        inside = words.pieces[:m] == words.pieces[n - 1 :]
        inside[: max(words.repeated - n + 1, 0)] = False
        at = np.flatnonzero(inside)
        yield n, at, mixed(total[at] + seeds[words.rows[at]] + _LENGTHS[n])


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray]:
    names = pc.fill_null(column.cast(pa.string()), UNKNOWN).to_pylist()
    seed = {x: int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in set(names)}
    return names, np.array([seed[x] for x in names], dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then the next ones and so on, compressed: planes of zeros cost next to nothing."""
    apart = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + pa.compress(apart.tobytes(), codec="zstd", asbytes=True)


def unplanes(data: bytes) -> np.ndarray:
    apart = pa.decompress(data[4:], decompressed_size=4 * int.from_bytes(data[:4], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(apart, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _send(parts: int):
    """Pass 1, tasks of texts: (part, steps, counts) for each hash partition that has n-grams here."""

    def flush(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(gathered)
        keys = every % np.uint64(parts) << np.uint64(32) | every >> np.uint64(32)
        keys, counts = np.unique(keys, return_counts=True)
        owner = (keys >> np.uint64(32)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        prints = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            row = [int(owner[a])], [planes(np.diff(prints[a:b], prepend=0))], [planes(counts[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["part", "steps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            _, seeds = _languages(batch.column(1))
            for words in words_of(batch.column(0)):
                for _, _, found in grams(words, seeds):
                    gathered.append(found)
                    held += len(found)
                if held >= GATHER:
                    yield from flush(gathered)
                    gathered, held = [], 0
        if held:
            yield from flush(gathered)

    return run


class Summary:
    """A Misra-Gries summary of counted numbers; ``error`` is what was taken off every entry at most."""

    def __init__(self, capacity: int, threshold: int) -> None:
        self.capacity, self.threshold, self.error = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held >= self.capacity:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        firsts = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[firsts], (np.add.reduceat(counts, firsts) if len(firsts) else counts)
        if len(keys) > self.capacity:
            beyond = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            off = min(beyond, self.threshold - 1 - self.error)  # the error stays below the threshold, whatever the mass
            keys, counts, self.error = keys[counts > off], counts[counts > off] - off, self.error + off
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.error >= self.threshold]


def _summarise(capacity: int, bits: int, threshold: int):
    """Pass 1, tasks of partitions, whose rows come one partition after the other: (part, bits of the survivors)."""

    def packed(part: int, summary: Summary) -> pa.RecordBatch:
        field = np.zeros(bits, dtype=bool)
        field[summary.survivors() % bits] = True
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(field).tobytes()], pa.binary())], names=["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None
        for batch in batches:
            for owner, steps, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                if owner.as_py() != part:
                    if summary is not None:
                        yield packed(part, summary)
                    part, summary = owner.as_py(), Summary(capacity, threshold)
                summary.add(np.cumsum(unplanes(steps.as_py()), dtype=np.int64), unplanes(counts.as_py()).astype(np.int64))
        if summary is not None:
            yield packed(part, summary)

    return run


def _recount(parts: int, bits: int, field) -> object:
    """Pass 2, tasks of texts: lists of (lang, n, phrase, count) of what has its bit, one row for each partition; the
    words of a language come with n = 0."""

    class Tally:
        """Counts of numbered phrases; a phrase is read from the text when its number is first met."""

        def __init__(self) -> None:
            self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            self.names: dict[int, tuple[str, int, str]] = {}

        def places(self, keys: np.ndarray) -> np.ndarray:
            """Where the keys stand, which are sorted and known."""
            return np.searchsorted(self.keys, keys)

        def add(self, words: Words, langs: list[str], n: int, at: np.ndarray, found: np.ndarray) -> None:
            keys, times = np.unique(found, return_counts=True)
            place = np.minimum(self.places(keys), max(len(self.keys) - 1, 0))
            new = keys[self.keys[place] != keys] if len(self.keys) else keys
            if len(new):
                first = np.flatnonzero(np.isin(found, new))
                ones, where = np.unique(found[first], return_index=True)
                for key, i in zip(ones.tolist(), at[first[where]].tolist(), strict=True):
                    self.names[key] = langs[words.rows[i]], n, words.phrase(i, n)
                into = np.searchsorted(self.keys, new)
                self.keys, self.counts = np.insert(self.keys, into, new), np.insert(self.counts, into, 0)
            self.counts[self.places(keys)] += times

        def rows(self) -> Iterator[pa.RecordBatch]:
            owner = (self.keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(owner[order], prepend=-1)), len(order))
            keys = self.keys[order].tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lang, n, phrase = zip(*(self.names[k] for k in keys[a:b]), strict=True)
                yield listed(int(owner[order[a]]), lang, n, phrase, self.counts[order[a:b]])

    def listed(part: int, *columns) -> pa.RecordBatch:
        lists = [pa.array([pa.array(c, f.type)], pa.list_(f.type)) for c, f in zip(columns, COUNTED, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *lists], names=["part", *COUNTED.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(field.value, np.uint8)
        tally, totals = Tally(), Counter()
        for batch in batches:
            langs, seeds = _languages(batch.column(1))
            for words in words_of(batch.column(0)):
                for row, n in zip(*np.unique(words.rows[words.repeated :], return_counts=True), strict=True):
                    totals[langs[row]] += int(n)
                for n, at, found in grams(words, seeds):
                    place = (found % np.uint64(parts)).astype(np.int64) * bits + ((found >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)
                    hit = np.flatnonzero(data[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    tally.add(words, langs, n, at[hit], found[hit])
                if len(tally.keys) >= PHRASES:
                    yield from tally.rows()
                    tally = Tally()
        yield from tally.rows()
        if totals:
            yield listed(0, list(totals), [0] * len(totals), [""] * len(totals), list(totals.values()))

    return run


def _total(least: int):
    """Pass 2, tasks of partitions: the sums of one partition after the other, which hold its survivors only."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).group_by(["lang", "n", "phrase"]).aggregate([("count", "sum")])
        return whole.rename_columns(COUNTED.names).cast(COUNTED)

    def kept(tables: list[pa.Table]) -> list[pa.RecordBatch]:
        whole = summed(tables)
        return whole.filter(pc.or_(pc.greater_equal(whole["count"], least), pc.equal(whole["n"], 0))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tables, held, before = None, [], 0, 0
        for batch in batches:
            for i, owner in enumerate(batch.column(0).to_pylist()):
                if owner != part and tables:
                    yield from kept(tables)
                    tables, held, before = [], 0, 0
                part = owner
                lists = [batch.column(c).slice(i, 1).flatten() for c in range(1, 5)]
                tables.append(pa.table(lists, schema=COUNTED))
                held += len(lists[0])
                if held >= 2 * before + PHRASES:
                    tables = [summed(tables)]
                    held = before = tables[0].num_rows
        if tables:
            yield from kept(tables)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, part_mass: int = PART_MASS, field_bits: int = FIELD_BITS) -> DataFrame:
    """Exact counts of all phrases of 1 to LONGEST words that occur ``least`` times in their language.

    Returns lang, n (words of the phrase; with 0 the row counts all words of the
    language), phrase (words joined by a space) and count. Null texts have no words,
    a null lang counts as ``und``, repeated rows count each. Texts are cut in pieces at
    ``.,;:!?`` and line ends; a phrase lies within one piece.

    ``field_bits`` bounds the broadcast; where more than about a tenth as many n-grams
    are frequent, a larger field spares shuffle.
    Inside one task phrases are told apart by 64-bit numbers; between tasks, and in
    the result, by their words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    # A word and its gap have two bytes at least, and begin LONGEST n-grams at most.
    parts = max(1, math.ceil(LONGEST * size / 2 / part_mass))
    mass = min(part_mass, LONGEST * size)
    capacity = mass // least + 1
    bits = max(8, min(field_bits // parts, BITS_EACH * capacity) // 8 * 8)

    sent = texts.mapInArrow(_send(parts), "part long, steps binary, counts binary")
    apart = sent.repartition(min(parts, TASKS), "part").sortWithinPartitions("part")
    fields = staged(apart.mapInArrow(_summarise(capacity, bits, least), "part long, bits binary"), "survivors")
    whole = bytearray(parts * bits // 8)
    for row in fields.collect():  # field_bits in all, a byte for each partition at least
        whole[row.part * bits // 8 : (row.part + 1) * bits // 8] = row.bits
    field = spark.sparkContext.broadcast(bytes(whole))

    counted = texts.mapInArrow(_recount(parts, bits, field), "part long, lang array<string>, n array<int>, phrase array<string>, count array<long>")
    apart = counted.repartition(min(parts, TASKS), "part").sortWithinPartitions("part")
    return apart.mapInArrow(_total(least), "lang string, n int, phrase string, count long")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, part_mass: int = PART_MASS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to LONGEST words.

    a counts the phrase, n all words of the language. Every cut of the phrase into a
    first part (l times) and a rest (r times) is scored floor(1000 a n / (l r)); the
    lowest counts, ties to the shortest first part. A phrase that lies in a longer one
    of the same count is dropped. Order: score, then a, both descending, then phrase
    by its bytes. Nulls as in ``frequent_phrases``; empty tables give no rows.
    """
    counts = staged(frequent_phrases(docs, least, part_mass), "phrases")
    phrases = counts.where("n >= 1").select("lang", "phrase", "n", "count")
    candidates = phrases.where("n >= 2").withColumn("words", F.split("phrase", " "))
    # Within a longer phrase of the same count, every phrase between the two has that count too:
    # it is enough to look at phrases longer by one word.
    inner = candidates.where("n >= 3").select("lang", "count", F.explode(F.array(
        F.array_join(F.slice("words", F.lit(1), F.col("n") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.col("n") - 1), " "),
    )).alias("phrase")).distinct()
    own = candidates.join(inner, ["lang", "phrase", "count"], "left_anti")
    cut = own.select("lang", "phrase", F.col("count").alias("a"), "n", "words", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest"),
    )
    # Parts of a frequent phrase are frequent, so their counts are there.
    part = lambda p, c: phrases.select("lang", F.col("phrase").alias(p), F.col("count").alias(c))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    both = both.join(counts.where("n = 0").select("lang", F.col("count").alias("total")), "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    over = (F.lit(1000).cast("decimal(38,0)") * F.col("a")).cast("decimal(38,0)")
    quotient = F.call_function("div", (over * F.col("total")).cast("decimal(38,0)"), (big("l") * big("r")).cast("decimal(38,0)"))
    lowest = both.withColumn("score", quotient.cast("long")).groupBy("lang", "phrase", "a", "total").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m")
    )
    ranked = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = lowest.select("lang", "phrase", "a", "m.l", "m.r", F.col("total").alias("n"), "m.score")
    rows = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= best)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_ORACLE = rf"""
    WITH pieces AS (
        SELECT coalesce(lang, '{UNKNOWN}') AS lang, doc_id,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    words AS (SELECT lang, [w FOR w IN regexp_split_to_array(piece, '[\x20\x09]+') IF w <> ''] AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
    starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
    grams AS (SELECT lang, len(w) AS size, w, i, unnest([1, 2, 3, 4, 5]) AS k FROM starts),
    f AS (
        SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
        FROM grams WHERE i + k - 1 <= size GROUP BY ALL HAVING count(*) >= {LEAST}),
    kept AS (
        SELECT * FROM f WHERE k >= 2 AND NOT EXISTS (
            SELECT 1 FROM f AS g WHERE g.lang = f.lang AND g.k > f.k AND g.a >= f.a
            AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
    cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM kept),
    scored AS (
        SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, CAST(t.n AS BIGINT) AS n, c.cut,
               CAST((1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
        FROM cuts AS c JOIN totals AS t ON t.lang = c.lang
        JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.cut], ' ')
        JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1 :], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest QUALIFY rank <= {BEST}"""


@query(_ORACLE)
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 firmest phrases of each language of ``documents``."""
    return collocations(table(spark, folder, "documents").select("text", "lang"))
