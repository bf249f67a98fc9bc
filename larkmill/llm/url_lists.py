"""URL filters: an as-of join of captures with dated list entries, in DataFrame functions only.

Each list entry says that from its day on a key (a host, a parent domain, or a host with a leading path of whole parts)
is blocked, allowed, or removed from the list. Entries of a key become validity intervals [day, next day of that key); a
capture matches the intervals of its own keys that hold its fetch time, and the longest matching key decides.

Hosts are compared in lower case, paths as they are, on both sides. A path entry covers that path and all below it:
``a.com/x`` covers ``a.com/x`` and ``a.com/x/y``, not ``a.com/xy``; slashes at the end of an entry don't count.

Defined cases: a capture with null or unreadable URL, or null time, matches nothing and is kept; of entries with the
same key and day the last action in the order allow, block, remove wins, and repeated entries count once; entries with
null key, day or action, or without a host, are ignored; an empty list keeps every capture; repeated captures each get
a row; other columns are ignored. One number, the parts of the list's longest path, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkmill.session import cut_lineage

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host, empty where there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_keys(url: Column, parts: int) -> Column:
    """Keys a list may name for a URL: its host, each parent domain of two labels or more, and the host with each
    leading path of up to ``parts`` parts."""
    labels = F.split(url_host(url), r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.greatest(n - i + 1, F.lit(1))), "."),
    )
    path = F.split(F.regexp_extract(url, PATH, 1), "/", -1)  # begins with an empty part
    ends = F.filter(F.sequence(F.lit(1), F.lit(max(1, parts))), lambda j: (j < F.size(path)) & (F.get(path, j) != "") & (j <= parts))
    paths = F.transform(ends, lambda j: F.concat(url_host(url), F.array_join(F.slice(path, 1, j + 1), "/")))
    return F.array_distinct(F.filter(F.concat(suffixes, paths), lambda k: (k != "") & ~k.startswith("/")))


def list_key(key: Column) -> Column:
    """A list's key with its host in lower case, without slashes at its end."""
    return F.concat(F.lower(F.regexp_extract(key, r"^[^/]*", 0)), F.regexp_extract(key, r"^[^/]*(.*?)/*$", 1))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) of entries (key, action, day); valid_to is exclusive, null while in force."""
    known = F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("allow", "block", "remove")
    own = entries.where(known).select(list_key(F.col("key")).alias("key"), "day", "action").where(~F.col("key").rlike("^(/|$)"))
    last = own.groupBy("key", "day").agg(F.max("action").alias("action"))
    by_key = Window.partitionBy("key").orderBy("day")
    return last.select(
        "key", "action", F.col("day").alias("valid_from"), F.lead("day").over(by_key).alias("valid_to")
    ).where(F.col("action") != "remove")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_at) with host, matched_key, matched_action, valid_from and kept."""
    slim = captures.select("page_id", "url", "fetched_at").withColumn("uh", F.xxhash64("url"))
    # Cut here, the join deals both of its sides anew, and the captures of a host with a large share can be split.
    held = cut_lineage(validity_intervals(entries).withColumnRenamed("key", "list_key"))
    longest = held.agg(F.max(F.size(F.split("list_key", "/", -1)) - 1).alias("n")).first()["n"] or 0
    keyed = slim.select("page_id", "uh", "fetched_at", F.explode(url_keys(F.col("url"), int(longest))).alias("key"))
    match = F.struct(F.length("list_key").alias("n"), F.col("list_key"), F.col("action"), F.col("valid_from"))
    best = (
        keyed.join(
            held,
            (keyed["key"] == held["list_key"])
            & (keyed["fetched_at"] >= held["valid_from"])
            & (held["valid_to"].isNull() | (keyed["fetched_at"] < held["valid_to"])),
        )
        .groupBy(F.col("page_id").alias("m_id"), F.col("uh").alias("m_uh"), F.col("fetched_at").alias("m_at"))
        .agg(F.max(match).alias("m"))
    )
    joined = slim.join(
        best,
        slim["page_id"].eqNullSafe(best["m_id"]) & (slim["uh"] == best["m_uh"]) & (slim["fetched_at"] == best["m_at"]),
        "left",
    )
    return joined.select(
        "page_id", "url", "fetched_at", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"),
        F.col("m.list_key").alias("matched_key"), F.col("m.action").alias("matched_action"),
        F.col("m.valid_from").alias("valid_from"),
        (F.coalesce(F.col("m.action"), F.lit("allow")) != "block").alias("kept"),
    )
