"""URL rules by a sort-merge range join.

A host read backwards by labels (``www.example.com`` is ``[com, example, www]``) turns a rule for a host and
all its subdomains into an interval: arrays that begin with the rule's labels stand together when sorted.
Pages and rules are range-partitioned and sorted by that key, and a sweep keeps a stack of the rules that
are open, one place for each depth, closed as soon as a key leaves their interval. Each partition starts
with the stack that the partitions before it left, so a host with very many pages may span partitions. The
paths of the rules on the stack then decide. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.scratch import durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first ``://`` and ``/ ? #`` with A-Z lower-cased, and from there to ``? #``."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(whole, r"(?s)://([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(whole, r"(?s)://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a page: ``(page_id, host, path, rule, verdict, n_open)``.

    ``pages`` has ``page_id`` and ``url``, ``rules`` has ``host``, ``path`` and ``verdict``; other columns are
    left alone. A rule fits its host and all subdomains if the page's path starts with the rule's. The rule
    whose text (host and path) is longest wins, on a tie the one with the longer host, then ``block``. Where
    no rule fits, the method allows pages with a host and blocks those without. ``n_open`` is the number of
    hosts on the stack at the page.

    A null url, or one without ``://``, has an empty host and path. Null page ids and repeated rows are kept
    as they are. Rules with a null host, path or verdict are ignored; without rules only the method's own
    verdict is left. An empty table of pages gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    labels = lambda name: F.reverse(F.split(name, r"\."))
    page_rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", labels("host"))
    known = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna().distinct()
    listed = known.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "verdict"))).alias("paths")).withColumn("key", labels("host"))
    depth = listed.agg(F.max(F.size("key"))).first()[0] or 0

    opens = listed.select(F.lit(None).cast("long").alias("page_id"), "host", F.lit(None).cast("string").alias("path"), "key", "paths")
    rows = page_rows.withColumn("paths", F.lit(None).cast("array<struct<path:string,verdict:string>>")).unionByName(opens).withColumn("page", F.col("paths").isNull())
    swept = durable(rows.repartitionByRange("key", "page", "page_id").withColumn("part", F.spark_partition_id()), "sweep")

    levels = range(1, depth + 1)
    opened = {n: F.when(~F.col("page") & (F.size("key") == n), F.struct("key", "host", "paths")) for n in levels}
    left = swept.where("not page").groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.max(opened[n]).alias(f"left_{n}") for n in levels])
    parts = swept.select("part").distinct().join(left, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = parts.select("part", *[F.last(f"left_{n}", ignorenulls=True).over(before).alias(f"carried_{n}") for n in levels])
    so_far = Window.partitionBy("part").orderBy("key", "page", "page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = swept.select("*", *[F.last(opened[n], ignorenulls=True).over(so_far).alias(f"open_{n}") for n in levels]).where("page")
    stack = stacked.join(F.broadcast(carried), "part")  # at most a row a shuffle partition

    places = [F.coalesce(f"open_{n}", f"carried_{n}") for n in levels]
    still = [F.when(F.slice(F.col("key"), 1, n) == place["key"], place) for n, place in zip(levels, places, strict=True)]
    held = stack.withColumn("stack", F.filter(F.array(*still), lambda x: x.isNotNull()) if still else F.array().cast("array<struct<key:array<string>,host:string,paths:array<struct<path:string,verdict:string>>>>"))
    choices = F.flatten(F.transform("stack", lambda r: F.transform(F.filter(r["paths"], lambda p: F.startswith(F.col("path"), p["path"])), lambda p: F.struct((F.length(r["host"]) + F.length(p["path"])).alias("size"), F.length(r["host"]).alias("host_size"), p["verdict"].alias("verdict"), F.concat(r["host"], p["path"]).alias("rule")))))
    best = F.array_max(choices)
    own = F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit("allow"))
    return held.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], own).alias("verdict"), F.size("stack").cast("long").alias("n_open"))
