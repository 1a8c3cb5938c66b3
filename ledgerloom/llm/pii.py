"""Personal data by bootstrapped contextual extraction.

Base entities of fixed shapes (e-mail, IP, card, phone) are the seeds. The two
words before a seed make a pattern; patterns and identifier-like strings form a
graph that is scored in rounds: a pattern is as good as the share of its instances
known to be of one kind, an instance as good as the patterns that lead to it.
Instances of high-confidence patterns are found wherever they stand.

All work is done with column functions and joins. A text is read once; later steps
use a small staged table of its entities and candidates.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.once import select_once
from ledgerloom.llm.common import keeps_names, staged, table
from ledgerloom.llm.registry import query

# Shapes of the base entities, in the order in which kinds are listed.
# Possessive quantifiers and the look-behinds keep long runs linear; they match the
# same strings as the plain forms, as no later start of a run can match if the first cannot.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a kind to be looked for.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: An identifier-like word: with an at sign or six digits and more.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+(?:@|[0-9](?:[^\s0-9]*+[0-9]){5})\S*+"
#: Shapes that a discovered identifier of a kind may have.
LIKE = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]+(?:[.:][0-9]+){3}(?::[0-9]+)?$",
    "card": r"^[0-9](?:-?[0-9]){7,18}$",
    "phone": r"^[+(]?[0-9][0-9().-]{4,}[0-9]$",
}
#: Least number of different known instances of a pattern, and least share of one kind among its instances.
SUPPORT = 5
CONFIDENCE = 0.7
#: Characters before an entity in which its two words are looked for.
CONTEXT = 100
#: Stands for an earlier identifier among these words.
EARLIER = " identifier "

SPAN = "struct<kind:string,rank:int,start:int,end:int,instance:string,pattern:string>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n + 1 - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _with_before(rows: DataFrame, keep: list[str], sizes: Column, chunk: int = 64) -> DataFrame:
    """Add ``_before``: the sum of all sizes before each place.

    Sums over chunks first, so that many places cost little. Each step is a column of
    its own, as a lambda would compute it again for every place.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    none = F.array().cast("array<int>")
    rows = select_once(rows, keep, [sizes.alias("_sizes")])
    n = F.size("_sizes")
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))
    sums = F.transform(chunks, lambda k: total(F.slice("_sizes", k * chunk + 1, F.lit(chunk))))
    rows = select_once(rows, [*keep, "_sizes"], [F.when(n > 0, sums).otherwise(none).alias("_sums")])
    heads = F.transform("_sums", lambda _, k: total(F.slice("_sums", F.lit(1), k)))
    rows = select_once(rows, [*keep, "_sizes"], [heads.alias("_heads")])
    at = lambda _, i: F.get("_heads", F.floor(i / chunk).cast("int")) + total(F.slice("_sizes", i - i % chunk + 1, i % chunk))
    return select_once(rows, keep, [F.transform("_sizes", at).alias("_before")])


def _pattern(left: Column) -> Column:
    """The two words before an entity, lower-cased and without digits and marks; null if there are not two."""
    tail = F.lower(F.right(left, F.lit(CONTEXT)))
    two = F.regexp_extract(tail, r"(?<!\S)([^\s]+\s+[^\s]+)\s+[^\sa-z0-9]*$", 1)
    words = F.trim(F.regexp_replace(F.regexp_replace(two, r"[\x21-\x40\x5B-\x60\x7B-\x7E]", ""), r"\s+", " "))
    return F.when(words.contains(" "), words)


def _spans(rows: DataFrame, keep: list[str], text: str, kind: str, rank: int, shape: str, needed: str | None) -> DataFrame:
    """Add the matches of a shape to each row, as an array of spans in ``_<kind>``."""
    there = F.col(text).contains(needed) if needed else F.col(text).rlike("[0-9@]")
    none = F.array().cast("array<string>")
    hits = F.when(there, F.regexp_extract_all(F.col(text), F.lit(shape), 0)).otherwise(none)
    rows = select_once(rows, keep, [hits.alias("_hits")])
    left = F.when(F.size("_hits") > 0, F.split(F.col(text), shape, -1)).otherwise(none)
    rows = select_once(rows, [*keep, "_hits"], [left.alias("_left")])
    pairs = F.zip_with(F.slice("_left", 1, F.size("_hits")), "_hits", lambda a, b: F.length(a) + F.length(b))
    rows = _with_before(rows, [*keep, "_hits", "_left"], pairs)

    def span(found: Column, i: Column) -> Column:
        gap = F.get("_left", i)
        # Two words are at most two identifiers back.
        words = F.concat_ws(EARLIER, *(F.right(F.get("_left", i - k), F.lit(CONTEXT)) for k in (2, 1, 0)))
        start = F.get("_before", i) + F.length(gap)
        if kind != "candidate":
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), (start + F.length(found)).alias("end"),
                found.alias("instance"), _pattern(words).alias("pattern"),
            )
        lead = F.length(F.regexp_extract(found, r"^[^A-Za-z0-9+(]*", 0))
        bare = F.regexp_replace(F.regexp_replace(found, r"^[^A-Za-z0-9+(]+", ""), r"[^A-Za-z0-9)]+$", "")
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), (start + lead).alias("start"),
            (start + lead + F.length(bare)).alias("end"), bare.alias("instance"), _pattern(words).alias("pattern"),
        )

    spans = F.transform("_hits", span)
    if kind != "candidate":
        spans = F.filter(spans, lambda s: _valid(kind, s["instance"]))
    return select_once(rows, keep, [spans.cast(f"array<{SPAN}>").alias(f"_{kind}")])


def _meets(spans: Column, c: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are sorted and apart: the last that begins before its end is looked up."""
    n = F.size(spans)
    steps = F.sequence(F.lit(0), F.floor(F.log2(n)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        before = F.get(spans, middle)["start"] < c["end"]
        open_ = at["low"] < at["high"]
        return F.struct(
            F.when(open_ & before, middle + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(at["high"]).alias("high")
        )

    begun = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve)["low"]
    return F.when((n == 0) | (begun == 0), False).otherwise(F.get(spans, begun - 1)["end"] > c["start"])


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the text's digest, base spans and candidate spans (those that meet no base span)."""
    own = [f"`{c}`" for c in docs.columns if c != text and c.lower() not in ("base", "found")]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*own, F.md5(whole).alias("_text_key"), whole.alias("_text"))
    keep = [*own, "_text_key", "_text"]
    for rank, (kind, shape) in enumerate(KINDS.items()):
        rows = _spans(rows, keep, "_text", kind, rank, shape, NEEDED[kind])
        keep.append(f"_{kind}")
    rows = _spans(rows, keep, "_text", "candidate", len(KINDS), CANDIDATE, None)
    base = F.array_sort(
        F.flatten(F.array(*[F.col(f"_{k}") for k in KINDS])),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]),
    )
    rows = select_once(rows, [*own, "_text_key", "_candidate", *(f"_{k}" for k in KINDS)], [base.alias("_base")])
    free = F.filter("_candidate", lambda c: ~functools.reduce(Column.__or__, [_meets(F.col(f"_{k}"), c) for k in KINDS]))
    return rows.select(*own, "_text_key", "_base", F.when(F.size("_candidate") > 0, free).otherwise(F.col("_candidate")).alias("_candidates"))


def discover(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Identifiers that high-confidence patterns lead to: instance, kind.

    Rounds go on until one adds no instance: what is learned makes patterns surer, so
    nothing once learned is lost, and the instances are finite.

    ``found`` comes from ``entities``. Each (pattern, instance) counts once however
    often it stands, so that copies of a text add no weight.
    """
    seeds = found.select(F.explode("_base").alias("s")).select("s.pattern", "s.instance", "s.kind")
    others = found.select(F.explode("_candidates").alias("s")).select("s.pattern", "s.instance", F.lit(None).cast("string"))
    graph = staged(seeds.union(others).where("pattern is not null").distinct(), "graph")
    like = F.array(*[F.when(F.col("instance").rlike(shape), F.lit(k)) for k, shape in LIKE.items()])
    free = graph.where("kind is null").select("pattern", "instance", F.explode(F.array_compact(like)).alias("kind"))
    known = graph.where("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("sure"))
    sizes = graph.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    learned, before = None, -1
    while True:
        rows = known if learned is None else known.union(free.join(learned, ["instance", "kind"]).select("pattern", "instance", "kind", "sure"))
        # how sure a pattern is: the known part of all its instances
        patterns = (
            rows.groupBy("pattern", "kind")
            .agg(F.count("*").alias("m"), F.sum("sure").alias("s"))
            .where(F.col("m") >= support)
            .join(sizes, "pattern")
            .where(F.col("s") / F.col("n") >= confidence)
            .select("pattern", "kind", (F.col("s") / F.col("n")).alias("p"))
        )
        # how sure an instance is: not all of its patterns are wrong
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("p") * F.col("p"), F.lit(1e-6)))))
        scored = free.join(patterns, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - doubt).alias("sure"))
        learned = staged(scored.where(F.col("sure") >= confidence * confidence), "learned")
        now = learned.count()
        if now <= before or not now:
            break
        before = now
    return learned.groupBy("instance").agg(F.max_by("kind", F.struct("sure", "kind")).alias("kind"))


@keeps_names
def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with base and found added: arrays of (kind, start, end).

    Null texts count as empty and have no spans. Spans of one kind do not overlap;
    a discovered span never meets a base span. Texts that are equal have equal
    results, whatever their ids. Columns of these names are replaced.
    """
    rows = staged(entities(docs, text), "entities")
    learned = discover(rows)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    candidates = rows.where(F.size("_candidates") > 0).dropDuplicates(["_text_key"]).select("_text_key", F.explode("_candidates").alias("c"))
    more = (
        candidates.select("_text_key", "c.start", "c.end", "c.instance")
        .join(learned, "instance")
        .groupBy(F.col("_text_key").alias("_key"))
        .agg(F.collect_list(F.struct("kind", rank.alias("rank"), "start", "end")).alias("_more"))  # of one text
    )
    # Only texts with candidates look for finds: the many equal or empty texts without any stay where they are.
    asking = rows.where(F.size("_candidates") > 0).join(more, F.col("_text_key") == F.col("_key"), "left").drop("_key")
    joined = rows.where(F.size("_candidates") <= 0).withColumn("_more", F.lit(None).cast(more.schema["_more"].dataType)).unionByName(asking)
    own = [f"`{c}`" for c in rows.columns if c not in ("_text_key", "_base", "_candidates")]
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    base = slim(F.col("_base"))
    return joined.select(*own, base.alias("base"), F.coalesce("_more", F.filter(base, lambda s: F.lit(False))).alias("found"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans, order), text), ",")


@query()
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    found = find(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "found")).alias("spans"),
    )
