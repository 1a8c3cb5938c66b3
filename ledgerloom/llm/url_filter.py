"""URL filters that know when: dated list entries joined to captures as of their fetch time.

List changes (domain added or removed on a day) become validity intervals. A
capture is judged by the entries of its host and of the host's parent domains
that were active on the day of the fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import keeps_names, table
from ledgerloom.llm.registry import query

#: Day on which an entry without a removal ends.
OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a leading ``www.``; null if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels and more; a host of one label stands for itself."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, count), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """Validity intervals [valid_from, valid_to) from rows (list, domain, action, day).

    The action is ``add`` or ``remove``; other actions, and rows with a null list,
    domain or day, say nothing. Of several changes on one day the removal wins, so
    repeated rows change nothing. Two entries without a removal between them are one.
    A domain has at most one row a day left before its days are ordered.
    """
    known = changes.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "domain", "day"])
    daily = known.groupBy("list", F.lower("domain").alias("domain"), "day").agg(
        F.min((F.col("action") == "add").cast("int")).alias("on")
    )
    by = W.partitionBy("list", "domain").orderBy("day")
    turns = daily.withColumn("_was", F.lag("on", 1, 0).over(by)).where(F.col("on") != F.col("_was"))
    ended = turns.withColumn("valid_to", F.lead("day").over(by))
    return ended.where("on = 1").select(
        "list", "domain", F.col("day").alias("valid_from"),
        F.coalesce("valid_to", F.lit(OPEN_END).cast("date")).alias("valid_to"),
    )


@keeps_names
def filter_urls(captures: DataFrame, changes: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` with host, blocked, lists, entry and entry_from added (replacing such columns).

    ``blocked`` is true if an entry was active on the day; ``lists`` are the names of
    all such lists, sorted and comma-joined; ``entry`` is the most specific domain
    among them (its earliest interval start in ``entry_from``). A capture without
    host or day is not blocked and has nulls there.

    The verdict depends on host and day alone, so it is made once for each distinct
    pair: a host with a third of all captures is one row a day in the as-of join.
    """
    added = ("host", "blocked", "lists", "entry", "entry_from")
    rows = captures.drop(*[c for c in captures.columns if c.lower() in added]).withColumn("host", host_of(F.col(url)))
    asked = rows.select("host", F.col(f"`{day}`").alias("_day")).dropna().distinct()
    domains = asked.withColumn("_domain", F.explode(suffixes(F.col("host"))))
    spans = intervals(changes)
    active = domains.join(
        spans,
        (F.col("_domain") == F.col("domain")) & (F.col("_day") >= F.col("valid_from")) & (F.col("_day") < F.col("valid_to")),
    )
    best = F.struct(F.length("domain").alias("n"), (-F.datediff("valid_from", F.lit("1970-01-01"))).alias("d"))
    found = active.groupBy(F.col("host").alias("_host"), "_day").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.max(F.struct(best.alias("_by"), F.col("domain").alias("entry"), F.col("valid_from").alias("entry_from"))).alias("_best"),
    )
    joined = rows.join(found, (F.col("host") == F.col("_host")) & (F.col(f"`{day}`") == F.col("_day")), "left")
    kept = [f"`{c}`" for c in rows.columns]
    return joined.select(
        *kept, F.col("lists").isNotNull().alias("blocked"), "lists",
        F.col("_best.entry").alias("entry"), F.col("_best.entry_from").alias("entry_from"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch time: spread the captures over the 365 days of 2024's start by their id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetched"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Two dated lists over the hosts of ``pages``: every third registered domain is
    listed as ``spam`` for a time, every fourth host as ``adult`` from some day on.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).dropna().distinct()
    number = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("domain"))), 1, 6), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    parents = (
        hosts.where(F.size(F.split("host", r"\.")) >= 3)
        .select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain"))
        .distinct()
    )
    spam = parents.where(number("s") % 3 == 0).withColumn("_from", F.date_add(start, number("f") % 300))
    adult = hosts.select(F.col("host").alias("domain")).where(number("a") % 4 == 0).withColumn("_from", F.date_add(start, number("g") % 365))
    added = spam.select(F.lit("spam").alias("list"), "domain", F.lit("add").alias("action"), F.col("_from").alias("day"))
    gone = spam.select(F.lit("spam"), "domain", F.lit("remove"), F.date_add("_from", 1 + number("t") % 120))
    return added.union(gone).union(adult.select(F.lit("adult"), "domain", F.lit("add"), "_from"))


_NUMBER = "CAST('0x' || substr(md5('{}' || domain), 1, 6) AS INTEGER)"
_ORACLE = r"""
    WITH cap AS (
        SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id % 365) + 365) % 365 AS INTEGER) AS fetched,
               nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', ''), '') AS host
        FROM pages),
    hosts AS (SELECT DISTINCT host AS domain FROM cap WHERE host IS NOT NULL),
    parents AS (SELECT DISTINCT regexp_extract(domain, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM hosts
                WHERE regexp_matches(domain, '[^.]+\.[^.]+\.[^.]+$')),
    spans AS (
        SELECT 'spam' AS list, domain, DATE '2024-01-01' + {f} % 300 AS a, DATE '2024-01-01' + {f} % 300 + 1 + {t} % 120 AS b
        FROM parents WHERE {s} % 3 = 0
        UNION ALL
        SELECT 'adult', domain, DATE '2024-01-01' + {g} % 365, DATE '9999-12-31' FROM hosts WHERE {x} % 4 = 0),
    hit AS (
        SELECT c.page_id, s.list, s.domain, s.a, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC, s.a) AS k
        FROM cap AS c JOIN spans AS s ON c.host = s.domain OR (length(c.host) > length(s.domain) AND right(c.host, length(s.domain) + 1) = '.' || s.domain)
        WHERE c.fetched >= s.a AND c.fetched < s.b),
    best AS (SELECT page_id, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
                    max(CASE WHEN k = 1 THEN domain END) AS entry, max(CASE WHEN k = 1 THEN a END) AS entry_from
             FROM hit GROUP BY page_id)
    SELECT c.page_id, c.url, c.fetched, c.host, b.lists IS NOT NULL AS blocked, b.lists, b.entry, b.entry_from
    FROM cap AS c LEFT JOIN best AS b ON c.page_id = b.page_id"""
for _name, _salt in (("f", "f"), ("t", "t"), ("s", "s"), ("g", "g"), ("x", "a")):
    _ORACLE = _ORACLE.replace("{" + _name + "}", _NUMBER.format(_salt))


@query(_ORACLE)
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the list entries active on the day of its capture."""
    pages = table(spark, folder, "pages")
    return filter_urls(dated_captures(pages), dated_lists(pages))
