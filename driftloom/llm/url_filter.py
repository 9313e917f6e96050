"""URL filters with dated lists: an as-of join of captures with the entries in force when fetched.

A list is a log of dated additions and removals. Each addition holds until the next event of the
same entry, which makes the log a set of validity intervals. Intervals are gathered per listed
host, joined to the hosts of the captures once for each host, and each capture then looks up its
own fetch time in its host's intervals: no capture is multiplied, and the only join of all
captures is on the host, where adaptive execution can split a host with any share of them.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """From the first slash after the host up to the query or fragment; at least a slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, host, path, since, until) from entries (list, host, path, action, at).

    action is add or remove; until is null while nothing followed. Events of one instant: a
    removal wins. Repeated additions make adjoining intervals. Rows with a null list, host,
    action or time are left out; a null path is the whole host.
    """
    known = entries.where("list is not null and host is not null and action in ('add', 'remove') and at is not null")
    named = known.select("list", F.lower("host").alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "action", "at").distinct()
    after = F.lead("at").over(Window.partitionBy("list", "host", "path").orderBy("at", "action"))
    spans = named.withColumn("until", after).where("action = 'add' and (until is null or until > at)")
    return spans.select("list", "host", "path", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per capture: key, host, fetched time, lists (sorted names), blocked.

    An entry applies to its host and all hosts below it, and to paths that begin with its path,
    from ``since`` up to but not including ``until``. A capture without host or fetch time is
    listed nowhere. Repeated captures are evaluated alike. Without captures or entries the result
    has no rows, or no lists.
    """
    seen = captures.select(
        F.col(key).alias("k"), host_of(F.col(url).cast("string")).alias("h"), path_of(F.col(url).cast("string")).alias("p"), F.col(fetched).cast("timestamp").alias("t")
    )
    hosts = seen.select("h").where("h is not null").distinct()
    labels = F.split("h", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spans = intervals(entries)
    listed = hosts.select("h", F.explode(above).alias("host")).join(spans, "host")
    of_host = listed.groupBy("h").agg(F.collect_set(F.struct("list", "path", "since", "until")).alias("spans"))
    both = seen.join(of_host, "h", "left")
    holds = lambda s: (
        (s["since"] <= F.col("t")) & (s["until"].isNull() | (F.col("t") < s["until"])) & F.startswith(F.col("p"), s["path"])
    )
    found = F.coalesce(F.filter("spans", holds), F.array().cast("array<struct<list:string,path:string,since:timestamp,until:timestamp>>"))
    lists = F.sort_array(F.array_distinct(F.transform(found, lambda s: s["list"])))
    return both.select(F.col("k").alias(key), F.col("h").alias("host"), F.col("t").alias(fetched), lists.alias("lists"), (F.size(found) > 0).alias("blocked"))
