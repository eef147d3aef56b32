"""URL filters by lists whose entries come and go.

A list is a table of dated changes: an entry is added or removed at a time. Changes become
validity intervals, and every capture is judged by the entries that are active when it was
fetched: an as-of join, from the entry's time on and before its removal.

Entries are of three kinds: a domain stands for itself and all hosts below it, a prefix for a host
and leading path segments, a url for one address. A capture looks up each suffix of its
host, each prefix of its path that is no deeper than the deepest entry, and its own address, all by equality.

Time is cut into buckets of 30 days and intervals at their borders, so captures and intervals
meet by (kind, key, bucket) and a range check sorts out the rest. A key that was changed many
times is ordered bucket by bucket; only one row per bucket goes on to the ordering of the
whole key. Captures of equal address and time are judged once.

Defined results: of an addition and a removal of one entry at one time the removal counts; a
change without list, kind, key, action or time is skipped; a null url, one without a host, or
a null time matches nothing; repeated captures are judged alike, each in its own row; without
changes nothing is blocked; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import unused

#: Microseconds of a bucket.
BUCKET = 30 * 86_400 * 1_000_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower case, without user, port and closing dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), F.lit("."))


def address_of(url: Column) -> Column:
    """Host and path, without query, fragment and closing slash."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)
    return F.rtrim(F.concat(host_of(url), path), F.lit("/"))



def keys_of(url: Column, deepest: Column) -> Column:
    """array<struct<kind, key>>: everything an entry may say about one url."""
    host, labels, segments = host_of(url), F.split(host_of(url), r"\."), F.split(address_of(url), "/")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("key")),
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(segments), deepest.cast("int")))),
        lambda k: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.slice(segments, 1, k), "/").alias("key")),
    )
    own = F.array(F.struct(F.lit("url").alias("kind"), address_of(url).alias("key")))
    return F.when(host != "", F.concat(domains, prefixes, own))


def intervals(changes: DataFrame, until: Column) -> DataFrame:
    """Validity intervals cut at bucket borders: list, verdict, kind, key, bucket, since, before.

    ``changes``: list, verdict (block or allow), kind, key, action (add or remove), at
    (timestamp). ``until``: the last bucket of interest.
    """
    entry = ["list", "verdict", "kind", "key"]
    at = F.unix_micros(F.col("at").cast("timestamp"))
    dated = (
        changes.filter(F.col("action").isin("add", "remove"))
        .select(*entry, at.alias("at"), (F.col("action") == "add").alias("added"))
        .dropna()
        .groupBy(*entry, "at")
        .agg(F.min("added").alias("added"))
        .withColumn("bucket", F.floor(F.col("at") / BUCKET))
    )
    inside = dated.select(
        *entry,
        "bucket",
        "added",
        F.col("at").alias("since"),
        F.coalesce(F.lead("at").over(Window.partitionBy(*entry, "bucket").orderBy("at")), (F.col("bucket") + 1) * BUCKET).alias("before"),
    )
    inside = inside.filter("added").drop("added")
    # What a bucket leaves behind holds until the first change of a later bucket.
    ends = dated.groupBy(*entry, "bucket").agg(F.max_by("added", "at").alias("added"), F.min("at").alias("first"))
    over = Window.partitionBy(*entry).orderBy("bucket")
    carried = (
        ends.select(*entry, "bucket", "added", F.lead("bucket").over(over).alias("next"), F.lead("first").over(over).alias("stop"))
        .filter("added")
        .withColumn("last", F.least(F.coalesce("next", until), until))
        .filter(F.col("last") > F.col("bucket"))
        .withColumn("bucket", F.explode(F.sequence(F.col("bucket") + 1, F.col("last"))))
        .select(
            *entry,
            "bucket",
            (F.col("bucket") * BUCKET).alias("since"),
            F.when(F.col("bucket") == F.col("next"), F.col("stop")).otherwise((F.col("bucket") + 1) * BUCKET).alias("before"),
        )
    )
    return inside.unionByName(carried).filter("since < before")


def judged(captures: DataFrame, changes: DataFrame, url_column: str = "url", time_column: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, n_entries and lists (sorted, joined by commas).

    A capture is blocked when a blocking entry is active and no allowing one.
    """
    url, time = F.col(url_column).cast("string"), F.unix_micros(F.col(time_column).cast("timestamp"))
    asked = captures.select(url.alias("url"), time.alias("time")).dropna().distinct().withColumn("bucket", F.floor(F.col("time") / BUCKET))
    last = asked.agg(F.coalesce(F.max("bucket"), F.lit(0))).scalar()
    deepest = changes.agg(F.coalesce(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("key", "/")))), F.lit(1))).scalar()
    held = intervals(changes, last)
    looked_up = asked.withColumn("deepest", deepest).withColumn("found", F.explode(keys_of(F.col("url"), F.col("deepest")))).select("url", "time", "bucket", "found.kind", "found.key")
    verdicts = (
        looked_up.join(held, ["kind", "key", "bucket"])
        .filter("since <= time and time < before")
        .groupBy("url", "time")
        .agg(
            F.count("*").alias("n_entries"),
            F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
            (F.bool_or(F.col("verdict") == "block") & ~F.bool_or(F.col("verdict") == "allow")).alias("blocked"),
        )
    )
    names = [unused(captures, c) for c in ("asked_url", "asked_time")]
    return (
        captures.withColumns({names[0]: url, names[1]: time})
        .join(
            verdicts.select(F.col("url").alias(names[0]), F.col("time").alias(names[1]), *[F.col(c).alias(unused(captures, c)) for c in ("blocked", "n_entries", "lists")]),
            names,
            "left",
        )
        .select(
            *[f"`{c}`" for c in captures.columns],
            F.coalesce(unused(captures, "blocked"), F.lit(False)).alias(unused(captures, "blocked")),
            F.coalesce(unused(captures, "n_entries"), F.lit(0)).alias(unused(captures, "n_entries")),
            F.coalesce(unused(captures, "lists"), F.lit("")).alias(unused(captures, "lists")),
        )
    )
