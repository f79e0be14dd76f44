"""URL rules as a sort-merge range join.

A rule is a host and the start of a path. Its key is the host's labels in reverse, a zero character and the path's start;
the keys that begin with it form an interval. A url has a probe for each of its host's endings that a rule could name:
the ending's labels in reverse, a zero character, the path. A rule fits a url exactly if one of the url's probes lies in
the rule's interval. Intervals of prefixes are nested or disjoint, so one sweep over rules and probes in key order, with
a stack of the rules that are open, finds all fits.

Probes are made distinct first, so a host, path or url that many rows share is swept once. The key range is cut at
quantiles of a bounded sample of probes; a rule goes to every part of the range that its interval reaches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docbasin.llm.common import read

ALLOW, BLOCK = "allow", "block"
#: Host, start of the path, verdict.
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
#: Parts of the key range for each shuffle partition, and probes sampled for each part.
PARTS, SAMPLED = 8, 16
LAST = "\U0010ffff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def matches(probes: DataFrame, rules: DataFrame) -> DataFrame:
    """probes (key), distinct; rules (key, rule, verdict, host_length) -> key, rule, verdict, host_length of the longest fitting rule."""
    spark = probes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS * partitions
    sample = sorted(r.key for r in probes.orderBy(F.xxhash64("key"), "key").limit(parts * SAMPLED).collect())
    cuts = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts, k) for k in batch["key"].to_pylist()], pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = [range(bisect_right(cuts, k), bisect_right(cuts, k + LAST) + 1) for k in batch["key"].to_pylist()]
            again = batch.take(pa.array([i for i, r in enumerate(reach) for _ in r], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p for r in reach for p in r], pa.int32()), *again.columns], names=["part", *batch.schema.names])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_rules = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != part:
                    part, open_rules = row[0], []
                while open_rules and not row[1].startswith(open_rules[-1][1]):
                    open_rules.pop()
                if row[2] is not None:
                    open_rules.append(row)
                elif open_rules:
                    best = max(open_rules, key=lambda r: (len(r[2]), r[4]))
                    out.append((row[1], *best[2:]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["key", "rule", "verdict", "host_length"])

    fields = "part int, key string, rule string, verdict string, host_length int"
    placed = probes.select("key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("host_length")).mapInArrow(place, fields)
    both = placed.unionByName(rules.select("key", "rule", "verdict", "host_length").mapInArrow(spread, fields))
    swept = both.repartition(partitions, "part").sortWithinPartitions("part", "key", F.col("rule").isNull()).mapInArrow(sweep, "key string, rule string, verdict string, host_length int")
    return swept


def judge(pages: DataFrame, rules: DataFrame, *, otherwise: str = ALLOW) -> DataFrame:
    """`pages` (page_id, url), rules (host, path, verdict) -> page_id, host, path, rule, verdict, a row for each page.

    The longest fitting rule decides (host and path together in characters; of equal ones that with the longer host; a
    repeated rule that contradicts itself blocks); a page without one gets `otherwise` and a null rule. A url that is
    null or has no "://" has an empty host and path and no rule. Repeated pages get repeated results.
    """
    host, path = host_and_path(F.col("url"))
    hosted = pages.select("page_id", host.alias("host"), path.alias("path"))
    zero = F.lit("\0")
    clean = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    keyed = clean.select(F.concat(reversed_host(labels), zero, F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"), F.size(labels).alias("depth"))
    deepest = keyed.agg(F.max("depth")).first()[0] or 0
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda n: F.concat(reversed_host(F.slice(labels, F.size(labels) - n + 1, n)), zero, F.col("path")))
    probes = hosted.select("host", "path").distinct().where("host <> ''").select("host", "path", F.explode(endings).alias("key"))
    found = matches(probes.select("key").distinct(), keyed)
    best = probes.join(found, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict")).alias("best"))
    return hosted.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def op2_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = r"""
with rules(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
m as (select h.page_id, h.host, h.path, rules.host || rules.path as rule, rules.verdict, length(rules.host) as hl
  from h left join rules on (h.host = rules.host or ends_with(h.host, '.' || rules.host)) and starts_with(h.path, rules.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from (select *, row_number() over (partition by page_id order by length(rule) desc nulls last, hl desc) as k from m) where k = 1
"""
