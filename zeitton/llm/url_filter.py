"""URL filters: rules on hosts and paths by a sort-merge range join.

The labels of a host are reversed, so that a host and its subdomains share a prefix and a rule is an
interval of keys. Urls are dealt by ranges of keys; a hash breaks ties, so a host of a third of all urls
spreads over many ranges. A rule goes to the ranges its interval meets. In each range a sweep over the sorted keys keeps a
stack of the rules whose intervals are open; they nest, as prefixes do.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from zeitton.llm.text import ascii_lower
from zeitton.session import stage

SWEPT = "id bigint, host string, path string, rule string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty for null and for urls without ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def place_rules(rules: DataFrame, bounds: list[tuple[int, str, str]]) -> DataFrame:
    """A copy of each rule for every range ``(part, first key, last key)`` that its interval meets."""
    parts, firsts, lasts = [list(x) for x in zip(*bounds, strict=True)] if bounds else ([], [], [])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                at = bisect_left(lasts, row.key)
                while at < len(parts) and (firsts[at] <= row.key or firsts[at].startswith(row.key)):
                    found.append((parts[at], row.key, row.path, row.verdict))
                    at += 1
            yield pd.DataFrame(found, columns=["part", "key", "path", "verdict"])

    return rules.mapInPandas(place, "part int, key string, path string, verdict string")


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rules and urls sorted by range and key, rules first: the longest open rule of each url."""
    part, open_rules = None, []  # each: key, {path: (rule, verdict)}, lengths of the paths, longest first
    for frame in frames:
        found = []
        for row in frame.itertuples(index=False):
            if row.part != part:
                part, open_rules = row.part, []
            while open_rules and not row.key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if not row.is_url:
                if not open_rules or open_rules[-1][0] != row.key:
                    open_rules.append((row.key, {}, []))
                _, paths, lengths = open_rules[-1]
                name = ".".join(reversed(row.key[:-1].split("."))) + row.path
                # Of rules for one host and path, a block wins.
                if row.path not in paths or row.verdict == "block":
                    paths[row.path] = (name, row.verdict)
                lengths[:] = sorted({len(x) for x in paths}, reverse=True)
                continue
            hit = (None, None)
            for _, paths, lengths in reversed(open_rules):
                fitting = (paths.get(row.path[:n]) for n in lengths if n <= len(row.path))
                hit = next((x for x in fitting if x), None) or hit
                if hit[0] is not None:
                    break
            found.append((row.id, row.host, row.path, *hit))
        yield pd.DataFrame(found, columns=["id", "host", "path", "rule", "verdict"]).astype({"id": "Int64"})


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Id, ``host``, ``path``, ``rule`` and ``verdict`` of each row.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains if the path starts
    with the rule's. Of the fitting ones the longest host wins, then the longest path; of equal rules a
    block. Without a rule ``rule`` is null and the verdict ``default``. Null urls and urls without
    ``://`` have an empty host and path. Repeated rows and null ids are judged like others; further
    columns of ``urls`` are left out. Rules with null host or path are ignored.
    """
    host, path = url_parts(F.col(url_col))
    parts = urls.select(F.col(id_col).cast("bigint").alias("id"), host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("path", "id"))
    dealt = stage(keyed.repartitionByRange("key", "tie").withColumn("part", F.spark_partition_id()), "urls-by-key")
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    bounds = sorted((r["part"], r["first"], r["last"]) for r in ends.collect())  # one row per range
    usable = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    placed = place_rules(usable.select(host_key(ascii_lower(F.col("host"))).alias("key"), "path", "verdict").distinct(), bounds)
    both = dealt.select("part", "key", F.lit(True).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        placed.select("*", F.lit(False).alias("is_url")), allowMissingColumns=True
    )
    swept = both.repartition("part").sortWithinPartitions("part", "key", "is_url").mapInPandas(sweep, SWEPT)
    return swept.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
