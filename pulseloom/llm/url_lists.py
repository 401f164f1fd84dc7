"""URL filtering by dated lists: native temporal join of captures with list entries.

List events (list, pattern, action add or remove, day) become validity intervals: an added entry holds from its
day up to the next event of the same list and pattern.  Every distinct pair of host and fetch time is judged once,
by the entries in force at that time for the host and every parent domain: an equi-join on the pattern with the
interval as condition.  Patterns that more than a thousandth of these pairs ask for, such as top-level domains, are
dealt to as many parts as they need, and their entries repeated for each.  Verdicts are joined back to the captures;
pairs that hold more than a thousandth of them, fewer than a thousand, by broadcast.  Blocked is what has an entry
in force on a blocking list, unless an entry of the `allow` list is at least as specific as the most specific of them.

Events with null list, pattern or day are ignored; of several events of one list and pattern on one day a removal
counts last.  Captures with null or unparsable URLs have host null, and nothing applies to them; those without
fetch time likewise.  Captures need no key: repeated ones, whatever their other columns, are judged alike, each as a
row of its own.  Empty tables give empty results or no matches.  Other columns of the captures are carried along;
those named host, lists, since or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.tables import skew_join

KEYED = 1000


def host(url: Column) -> Column:
    """Lower-case host without port, credentials and final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def intervals(events: DataFrame) -> DataFrame:
    """list, pattern, since, until (exclusive; null: still in force)."""
    known = events.where("list is not null and pattern is not null and day is not null and action in ('add', 'remove')")
    by = Window.partitionBy("list", "pattern").orderBy("day", F.expr("action = 'remove'"))
    dated = known.select("list", "pattern", "action", F.col("day").alias("since"), F.lead("day").over(by).alias("until"))
    return dated.where("action = 'add' and (until is null or since < until)").drop("action")


def judge(captures: DataFrame, events: DataFrame, url_col: str, time_col: str) -> DataFrame:
    """captures with host, lists (in force, sorted), since (of the entry last added) and verdict (blocked, allowed or clear)."""
    placed = captures.drop(*{"host", "lists", "since", "verdict"} - {url_col, time_col}).withColumn("host", host(F.col(url_col)))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pairs = placed.where(F.col("host").isNotNull() & F.col(time_col).isNotNull()).select("host", F.col(time_col).alias("at")).distinct()
    asked = pairs.withColumn("pattern", F.explode(domains))
    limit = max(1000, asked.count() // KEYED)
    parts = F.ceil(F.col("count") / limit).cast("int").alias("parts")
    heavy = F.broadcast(asked.groupBy("pattern").count().where(F.col("count") > limit).select("pattern", parts))  # KEYED rows at most
    many = F.coalesce("parts", F.lit(1))
    asked = asked.join(heavy, "pattern", "left").withColumn("part", F.pmod(F.xxhash64("host", "at"), many).cast("int")).drop("parts")
    entries = intervals(events).join(heavy, "pattern", "left").withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
    held = asked.join(entries, ["pattern", "part"]).where("at >= since and (until is null or at < until)")
    depth = F.size(F.split("pattern", r"\."))
    allow = F.col("list") == "allow"
    found = held.groupBy("host", "at").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max("since").alias("since"), F.max(F.when(~allow, depth)).alias("block"), F.max(F.when(allow, depth)).alias("pass"))
    verdict = F.when(F.col("block").isNull(), F.when(F.col("pass").isNull(), "clear").otherwise("allowed")).when(F.col("pass") >= F.col("block"), "allowed").otherwise("blocked")
    found = found.select("host", F.col("at").alias(time_col), "lists", "since", verdict.alias("verdict"))
    return skew_join(placed, found, ["host", time_col]).withColumns({"lists": F.coalesce("lists", F.lit("")), "verdict": F.coalesce("verdict", F.lit("clear"))})


def _hex(text: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 2), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day in 2024 derived from page_id, as the table has no dates."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def derived_events(pages: DataFrame) -> DataFrame:
    """Dated list events for hosts and parent domains of the pages, drawn by MD5: added, removed and added again."""
    hosts = pages.select(host(F.col("url")).alias("h")).where("h is not null").distinct()
    patterns = hosts.union(hosts.select(F.regexp_replace("h", r"^[^.]*\.", ""))).distinct().withColumnRenamed("h", "pattern")
    name = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam", "allow"))), F.pmod(_hex(F.col("pattern"), 1), F.lit(4)) + 1)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    first, gap = _hex(F.col("pattern"), 3), _hex(F.col("pattern"), 5)
    steps = F.array(*(F.struct(F.lit(a).alias("action"), day(n).alias("day")) for a, n in (("add", first), ("remove", first + gap), ("add", first + gap + 20))))
    return patterns.select(name.alias("list"), "pattern", F.explode(steps).alias("e")).select("list", "pattern", "e.action", "e.day")


def judge_pages(pages: DataFrame) -> DataFrame:
    return judge(page_captures(pages), derived_events(pages), "url", "fetched").select("page_id", "host", "fetched", "lists", "since", "verdict")


SQL = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS host,
    (DATE '2024-01-01' + (((page_id * 37) % 366 + 366) % 366)::INT)::DATE AS fetched FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
p AS (SELECT host AS pattern FROM h UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM h),
d AS (SELECT pattern, ['adult', 'malware', 'spam', 'allow'][('0x' || substr(md5(pattern), 1, 2))::INT % 4 + 1] AS list,
  ('0x' || substr(md5(pattern), 3, 2))::INT AS first, ('0x' || substr(md5(pattern), 5, 2))::INT AS gap FROM p),
i AS (SELECT list, pattern, (DATE '2024-01-01' + first)::DATE AS since, (DATE '2024-01-01' + first + gap)::DATE AS until FROM d WHERE gap > 0
  UNION ALL SELECT list, pattern, (DATE '2024-01-01' + first + gap + 20)::DATE, NULL FROM d),
a AS (SELECT host, fetched, array_to_string(string_split(host, '.')[k:], '.') AS pattern FROM (SELECT DISTINCT host, fetched FROM c) c, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(k) WHERE host IS NOT NULL AND fetched IS NOT NULL),
f AS (SELECT host, fetched, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, max(since) AS since,
  max(CASE WHEN list <> 'allow' THEN len(string_split(pattern, '.')) END) AS block, max(CASE WHEN list = 'allow' THEN len(string_split(pattern, '.')) END) AS pass
  FROM a JOIN i USING (pattern) WHERE fetched >= since AND (until IS NULL OR fetched < until) GROUP BY host, fetched)
SELECT c.page_id, c.host, c.fetched, coalesce(lists, '') AS lists, since,
  CASE WHEN block IS NULL AND pass IS NULL THEN 'clear' WHEN block IS NULL OR pass >= block THEN 'allowed' ELSE 'blocked' END AS verdict
FROM c LEFT JOIN f USING (host, fetched)
"""
