"""URL filters over time: every capture against the list entries active when it was fetched.

A list is a log of dated entries: a key (a host, which stands for its sub-domains too, or a host with a
path prefix), an action (`add` or `remove`) and a time. An entry is valid from its time until the next
entry of its key. A capture is looked up under its host, the host's parent domains and all prefixes of
its path; for each of these keys the as-of join finds the entry whose interval holds the fetch time.

The join is a union of captures and entries, ordered by time within a key: each capture takes the last
entry before it. It costs the same however many entries a key has. Keys with very many captures are
dealt over several tasks, each with a copy of that key's entries.

Edge cases: a null url, or one without a host, matches nothing; a null fetch time matches nothing;
entries with a null key or time are ignored, and so is any action but `add` and `remove`; of entries of
one key at one time, `remove` wins; an entry is active at its own instant; repeated captures are one
row; empty tables on either side are fine; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.llm.common import stored

ROWS_PER_TASK = 1_000_000


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a final dot; empty if there is none."""
    rest = F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.rtrim(F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", "")), F.lit("."))


def path_of(url: Column) -> Column:
    """Path without query and fragment, beginning with a slash."""
    path = F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def keys_of(url: Column) -> Column:
    """Host, parent domains, and host with each prefix of the path that ends at a slash or at its end."""
    host, path = host_of(url), path_of(url)
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(
        host, F.array_join(F.slice(steps, F.lit(1), k), "/"), F.when(k < F.size(steps), "/").otherwise("")))
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, valid_from, valid_to (open at the end, null for ever) of each entry that is ever valid."""
    log = entries.filter("key is not null and listed_at is not null and action in ('add', 'remove')").select(
        F.lower("key").alias("key"), "action", "listed_at").distinct()
    own = Window.partitionBy("key").orderBy("listed_at", "action")
    spans = log.withColumn("valid_to", F.lead("listed_at").over(own)).withColumnRenamed("listed_at", "valid_from")
    return spans.filter("valid_to is null or valid_to > valid_from")


def screened(captures: DataFrame, entries: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """page_id, url, fetched_at, blocked, matches (keys of the active entries, sorted) for each capture."""
    pages = captures.select("page_id", "url", "fetched_at").distinct()
    asks = pages.select("page_id", "url", "fetched_at", F.explode(keys_of(F.col("url"))).alias("key"))
    spans = stored(intervals(entries), "intervals")
    load = asks.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_task)
    # Fewer rows than there are captures times keys over rows_per_task.
    hot = stored(load.select("key", F.ceil(F.col("n") / rows_per_task).cast("int").alias("fan")), "hot")
    salted = asks.join(hot, "key", "left").withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.coalesce("fan", F.lit(1))).cast("int"))
    copied = spans.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)))
    timeline = salted.select("key", "salt", F.col("fetched_at").alias("at"), F.lit(1).alias("asks"), "page_id", "url",
                             F.lit(None).cast("string").alias("action"), F.lit(None).cast("timestamp").alias("valid_to"))
    timeline = timeline.unionByName(copied.select(
        "key", "salt", F.col("valid_from").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("url"), "action", "valid_to"))
    entry = F.when(F.col("asks") == 0, F.struct("action", "valid_to"))
    before = Window.partitionBy("key", "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    current = timeline.withColumn("entry", F.last(entry, ignorenulls=True).over(before)).filter("asks = 1")
    active = (F.col("entry.action") == "add") & F.col("at").isNotNull() & (
        F.col("entry.valid_to").isNull() | (F.col("entry.valid_to") > F.col("at")))
    hits = (current.filter(active)
            .groupBy(F.col("page_id").alias("__page"), F.col("url").alias("__url"), F.col("at").alias("__at"))
            .agg(F.array_sort(F.collect_set("key")).alias("matches")))
    return pages.join(hits, _same(), "left").select(
        "page_id", "url", "fetched_at", F.col("matches").isNotNull().alias("blocked"),
        F.coalesce("matches", F.array().cast("array<string>")).alias("matches"))


def _same() -> Column:
    return (F.col("page_id").eqNullSafe(F.col("__page")) & F.col("url").eqNullSafe(F.col("__url"))
            & F.col("fetched_at").eqNullSafe(F.col("__at")))


def allowed(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that no active entry blocks, whole."""
    bad = screened(captures, entries).filter("blocked").select(
        F.col("page_id").alias("__page"), F.col("url").alias("__url"), F.col("fetched_at").alias("__at"))
    return captures.join(bad, _same(), "left_anti")
