"""URL filters by a temporal list join.

The entries of a block list are dated: a pattern is added or removed on a day. They become validity intervals, and each
capture is judged by the entries that were active when it was fetched (an as-of join). A pattern is a domain, which
covers its subdomains, or a host and the beginning of a path, in whole segments.

A capture looks its domains and path beginnings up by their MD5, so a path of very many segments makes one short key for
each and never all its beginnings as texts; beginnings of more segments than any pattern has aren't looked up. Only keys
that are on the list go on. They and the beginnings of intervals are put in one order of days for each pattern, spread over
range partitions where a pattern has very many captures, and each capture takes the last interval that began. So rows don't
multiply with the length of intervals, and what is broadcast is decided by Spark from the written list's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RID, Workspace, with_rid
from tidemark.operators.ordered import Ordered

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, _URL, 1), r"\.+$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def plain_path(path: Column) -> Column:
    """The path without empty segments and without slashes at its ends."""
    return F.trim(F.regexp_replace(path, "/+", "/"), F.lit("/"))


def keys_of(host: Column, plain: Column, most: int) -> Column:
    """MD5 of all patterns that would cover the URL: the domains of the host, and the host with each beginning of its plain path, of ``most`` segments at most."""
    none = F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.md5(F.array_join(F.slice(labels, i, n), ".").cast("binary")))
    number = F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit("/"), F.lit(""))) + 1)
    last = F.least(number, F.lit(most))
    begun = F.transform(F.sequence(F.lit(1), last), lambda i: F.md5(F.concat(host, F.lit("/"), F.call_function("substring_index", plain, F.lit("/"), i)).cast("binary")))
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(domains, F.when(last > 0, begun).otherwise(none))))


def validity(entries: DataFrame, pattern_col: str = "pattern", action_col: str = "action", day_col: str = "day") -> DataFrame:
    """(pattern, since, until): the days on which each pattern is on the list, until is exclusive and null if open.

    The host part of patterns is lower-cased and slashes at the end are dropped. Of several entries for a pattern and day,
    ``remove`` wins. Entries with a null, or with another action than ``add`` and ``remove``, are left out. Adding what is
    on the list changes nothing.
    """
    text = F.regexp_replace(F.col(pattern_col), "/+$", "")
    host = F.lower(F.substring_index(text, "/", 1))
    rows = entries.select(F.concat(host, F.substring(text, F.length(host) + 1, F.length(text))).alias("pattern"), F.col(action_col).alias("action"), F.col(day_col).cast("date").alias("day"))
    # At most one row for a pattern and day is left, so that a pattern's window holds no more rows than there are days.
    daily = rows.where("pattern <> '' and day is not null and action in ('add', 'remove')").groupBy("pattern", "day").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("pattern").orderBy("day")
    turns = daily.withColumn("was", F.lag("on").over(w)).where("was is null and on or was <> on")
    return turns.withColumn("until", F.lead("day").over(w)).where("on").select("pattern", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(id, host, blocked, pattern, since, n_patterns) per capture; pattern is the longest active one (of equals the first).

    A null or unparsable URL has host "" and is not blocked, nor is a capture with a null day. Null and repeated ids are
    captures of their own. Other columns are not read.
    """
    spark = captures.sparkSession
    ws = Workspace(spark, "urls")
    rows, _ = with_rid(captures, id_col, ws, url_col, day_col)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = rows.select(F.col(RID).alias("rid"), F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(day_col).cast("date").alias("day"))
    lists = ws.table(validity(entries).withColumn("key", F.md5(F.col("pattern").cast("binary"))), "validity")
    slashes = F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))
    most = lists.agg(F.max(slashes)).first()[0] or 0
    url_keys = rows.where("day is not null").select("rid", "day", "host", plain_path(F.col("path")).alias("path"))
    asked = url_keys.select("rid", "day", F.explode(keys_of(F.col("host"), F.col("path"), most)).alias("key"))
    asked = ws.table(asked.join(lists.select("key").distinct(), "key", "left_semi"), "asked")
    turn = F.struct("pattern", "since", "until").alias("turn")
    begun = lists.select("key", F.col("since").alias("day"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("rid"), turn)
    both = asked.select("key", "day", F.lit(True).alias("asks"), "rid", F.lit(None).cast(begun.schema["turn"].dataType).alias("turn")).unionByName(begun)
    met = Ordered(both, ["key"], ["day", "asks", "rid"]).last("now", F.col("turn")).frame()
    hit = met.where("asks and now is not null and (now.until is null or day < now.until)").select("rid", "now.pattern", "now.since")
    best = F.min(F.struct((-F.length("pattern")).alias("m"), "pattern", "since")).alias("b")
    hits = ws.table(hit.groupBy("rid").agg(best, F.count(F.lit(1)).alias("n_patterns")), "hits")
    out = rows.join(hits, "rid", "left")
    return out.select(F.col("id").alias(id_col), "host", F.col("b").isNotNull().alias("blocked"), F.col("b.pattern").alias("pattern"), F.col("b.since").alias("since"), F.coalesce("n_patterns", F.lit(0)).cast("long").alias("n_patterns"))
