"""URL filters: dated list entries become validity intervals, and an as-of join judges every capture at its fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of each list entry over which the hosts that ask for its key are dealt.
SALTS = 16


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute http(s) URL without user, port and last dot; null if there is none."""
    raw = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@]*@)?([^/:?#@]+)", 1)
    return F.nullif(F.regexp_replace(raw, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame, bucket_days: int) -> DataFrame:
    """(key, action, listed, until, bucket) from (key, listed, action): an entry holds until the key's next one.

    Of several entries of one key and day the last action by name holds ("block" over "allow").  ``until`` is null for the
    key's last entry.  An interval stands in every bucket of days that it touches, the last one in a bucket of its own
    kind (-1) that is looked up besides, so that open intervals needn't be repeated for all time.
    """
    one = entries.where("key is not null and listed is not null and action is not null").groupBy("key", "listed").agg(F.max("action").alias("action"))
    nxt = F.lead("listed").over(Window.partitionBy("key").orderBy("listed"))
    day = lambda c: F.floor(F.unix_date(c) / bucket_days).cast("int")
    spread = F.when(F.col("until").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(day(F.col("listed")), day(F.date_sub("until", 1))))
    return one.withColumn("until", nxt).withColumn("bucket", F.explode(spread))


def url_filter(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched", bucket_days: int = 32) -> DataFrame:
    """captures with host, kept, entry_key and entry_listed: the verdict of the list entries active on the day of fetch.

    ``entries``: key (a host; it holds for its subdomains too), listed (date), action ("block", "allow", or "drop" to end an
    entry without a new one).  The most specific key with an active block or allow entry decides; without one a capture is kept.
    Each host and day is judged once.  A key that many hosts ask for (``com``) is dealt over SALTS copies of its entries; a hot
    host and day is split, in the last join, by Spark's skew handling.

    Null or other URLs without a host, and null days: kept, no entry.  Very long URLs: whole.  Repeated captures: judged each.  Ties:
    of several entries of a key and day the last action by name.  Empty list: everything kept; no captures: none.  Columns of
    captures with other names than the four are handed on, whatever their names; those four are replaced.
    """
    added = ("host", "kept", "entry_key", "entry_listed")
    names = [c for c in captures.columns if c.casefold() not in added]
    own = F.struct(*[F.col(f"`{c}`") for c in names])
    cap = captures.select(own.alias("row"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{fetched}`").cast("date").alias("day"))
    spans = intervals(entries, bucket_days).where("action <> 'drop'").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = cap.where("host is not null and day is not null").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), i.alias("cut")))
    buckets = F.array(F.floor(F.unix_date("day") / bucket_days).cast("int"), F.lit(-1))
    salt = F.pmod(F.xxhash64("host", "day"), F.lit(SALTS)).cast("int")
    probes = asked.select("host", "day", salt.alias("salt"), F.explode(keys).alias("k")).select("host", "day", "salt", "k.key", "k.cut", F.explode(buckets).alias("bucket"))
    hit = probes.join(spans, ["key", "bucket", "salt"]).where((F.col("listed") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    verdict = hit.groupBy("host", "day").agg(F.min(F.struct("cut", "key", "action", "listed")).alias("v"))
    out = cap.join(verdict, ["host", "day"], "left")
    kept = F.coalesce(F.col("v.action") != "block", F.lit(True))
    return out.select(*[F.col(f"row.`{c}`") for c in names], "host", kept.alias("kept"), F.col("v.key").alias("entry_key"), F.col("v.listed").alias("entry_listed"))
