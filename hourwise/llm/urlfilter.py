"""URL filters as a sort-merge range join (DataFrame operations only).

A rule (host, path, verdict) fits the urls of its host and all subdomains whose path starts with the rule's; the
longest host + path wins (then the longer host; of equal rules that disagree, ``block``).  The canonical key is the
reversed host, ``#`` (which neither part can hold), then the path, in hex: the rule ``example.org/es/`` covers exactly
the keys of the interval [hex('org.example#/es/'), the same + 'G').  A url stands in the sweep once for each of its
host's suffixes, up to the longest rule host.

Sweep: rule starts, rule ends and url keys are range-partitioned and sorted together.  Intervals are nested or
disjoint, so a stack of active rules suffices; each boundary carries the top of the stack after it (a start: its
rule; an end: the rule enclosing the one that ends, found by a running depth over the rules alone).  A url takes the
last boundary before it.  Buckets of the range partitioning hand their last boundary to the next bucket.

Distinct (host, path) pairs are swept, so repeated urls cost one row; a hot host is split by its paths.

Edge cases: null urls and urls without ``://`` have empty host and path and match no rule; an empty rule table gives
every url the default verdict; repeated rows each get their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.common import lower_ascii, staged

#: Fixed values of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """``labels``: host labels, outermost first."""
    return F.hex(F.encode(F.concat(F.array_join(labels, "."), F.lit("#"), path), "utf-8"))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, ord, top): the top of the stack of active rules from each boundary on. Starts come before urls, ends after."""
    r = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select("host", _key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"),
                F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len")).alias("top"))
    )
    ev = r.select("host", "key", F.lit(1).alias("step"), "top").unionByName(
        r.select("host", F.concat("key", F.lit("G")).alias("key"), F.lit(-1).alias("step"), "top")
    )
    # starts and ends are all different within a host: keys of rules differ, and only ends hold a G
    order = Window.partitionBy("host").orderBy("key")
    ev = ev.withColumn("depth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    starts = ev.where("step = 1")
    kind = starts.schema["top"].dataType.simpleString()
    outer = starts.select("host", "key", "depth", F.struct("top").alias("rule_at"), F.lit(None).cast("string").alias("inner"))
    asks = starts.select(
        "host", "key", (F.col("depth") - 1).alias("depth"), F.lit(None).cast(f"struct<top:{kind}>").alias("rule_at"), F.col("key").alias("inner")
    )
    within = Window.partitionBy("host", "depth").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        outer.unionByName(asks)
        .withColumn("parent", F.last("rule_at", ignorenulls=True).over(within))
        .where("inner is not null")
        .select(F.concat("inner", F.lit("G")).alias("key"), F.lit(2).alias("ord"), F.struct(F.col("parent.top").alias("top")).alias("state"))
    )
    return r.select("key", F.lit(0).alias("ord"), F.struct("top").alias("state")).unionByName(ends)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule (null where none fits) and verdict."""
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    depth = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("d")).first()["d"]  # one number
    urls = p.where("host <> ''").groupBy("host", "path").count().drop("count")
    labels = F.reverse(F.split("host", r"\."))
    levels = urls.withColumn("labels", labels).withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.least(F.size("labels"), F.lit(depth))))
    ).where("level > 0")
    swept = levels.select(
        _key(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key"),
        F.lit(1).alias("ord"), "host", "path",
    )
    edges = _boundaries(rules)
    both = swept.withColumn("state", F.lit(None).cast(edges.schema["state"].dataType)).unionByName(
        edges, allowMissingColumns=True
    )
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # staged: the bucket bounds are fixed by what was written, whatever is computed again later
    dealt = staged(
        both.repartitionByRange(n, "key", "ord", "host").withColumn("bucket", F.spark_partition_id())
    )
    order = Window.partitionBy("bucket").orderBy("key", "ord")
    here = dealt.withColumn(
        "here", F.last("state", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).where("host is not null")
    carry = (
        dealt.groupBy("bucket").agg(F.max_by(F.struct("state"), F.when(F.col("state").isNotNull(), F.struct("key", "ord"))).alias("last"))
        .withColumn(
            "carried",
            F.last("last.state", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        )  # one row per bucket
        .select("bucket", "carried")
    )
    top = F.coalesce("here", "carried")["top"]
    found = (
        here.join(carry, "bucket").withColumn("top", top).where("top is not null")
        .groupBy("host", "path")
        .agg(F.max_by("top", F.struct(F.length("top.rule"), F.col("top.host_len"))).alias("top"))
        .withColumnRenamed("host", "h").withColumnRenamed("path", "p")
    )
    return p.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
    )
