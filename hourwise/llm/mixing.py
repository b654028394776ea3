"""Mixing sources to target weights by hierarchical budgeting (DataFrame operations only).

Leaves are (domain, lang, source); inner nodes are (domain, lang), domain and the root.  A leaf offers its tokens
times ``epochs``.  Budgets go from the root down: a node's budget is shared among its children in proportion to
their weights, no child gets more than its subtree offers, and what a short child leaves is shared again among its
siblings, always in proportion (water filling), before any of it is left to the node's own siblings; capacities are
known bottom-up, so a node is never given more than its subtree can use.

A leaf's budget is spent on whole epochs, then on a prefix: its documents in the order of md5(seed:epoch:doc_id), as
long as their running token sum stays within what is left.  Running sums are two-level: tokens per (leaf, bucket of
the order key) first, then rows of each leaf's one boundary bucket only, so a hot leaf is never one task.

Edge cases: null texts have no tokens, and documents without tokens are never selected; null lang or source are the
name ``-``; weights that are not given are 1, negative or null ones 0; repeated rows of one doc_id stand side by
side in the order and are ordered by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.common import free_names, staged

LEVELS = ("domain", "lang", "source")
#: Buckets of the order key per leaf and epoch, as hex digits of md5.
BUCKET_DIGITS = 3

#: Fixed values of the registered query: relative weights by path prefix; paths that are not listed weigh 1.
WEIGHTS = [
    ("core", None, None, 3.0), ("web", None, None, 2.0), ("core", "en", None, 2.0), ("web", "en", None, 4.0),
    ("core", "en", "src0", 2.0), ("web", "en", "src10", 3.0), ("web", "de", "src11", 2.0),
]


def tokens(text: Column) -> Column:
    """Words without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """``web`` for sources whose name ends in two digits, else ``core``."""
    return F.when(source.rlike("[0-9][0-9]$"), "web").otherwise("core")


def _fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """Water filling: ``budget`` of the parent over its children (cap, weight); adds ``share``."""
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rank = by.orderBy(F.col("ratio").asc_nulls_last(), "name")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    c = (
        children.withColumn("ratio", ratio)
        .withColumn("full_before", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.try_divide(F.col("budget") - F.col("full_before"), F.col("weight_left")))
        .withColumn("short", F.col("ratio") <= F.col("level"))
    )
    # children are short up to some rank; all later ones get the level of the first that is not
    water = F.min(F.when(~F.col("short"), F.struct("ratio", "name", "level"))).over(by)["level"]
    return (
        c.withColumn("water", water)
        .withColumn("share", F.when(F.coalesce("weight", F.lit(0.0)) <= 0, 0.0).when(F.col("short"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water"))))
        .drop("ratio", "full_before", "weight_left", "level", "short", "water")
    )


def leaf_budgets(leaves: DataFrame, weights: DataFrame, fraction: float, epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, n_tokens) with ``budget``: tokens each leaf may spend, a whole number."""
    w = weights.groupBy(*LEVELS).agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("weight"))
    weighted = leaves.withColumn("cap", (F.col("n_tokens") * epochs).cast("double"))
    nodes = []
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        cap = weighted.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        cond = [cap[k].eqNullSafe(w[k]) for k in keys] + [w[k].isNull() for k in LEVELS[depth:]]
        joined = cap.join(w.where(F.col(keys[-1]).isNotNull()), cond, "left")
        node = joined.select(*[cap[k] for k in keys], "cap", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        # a subtree whose weight is zero offers nothing
        nodes.append(node.withColumn("name", F.col(keys[-1])))
    n3 = nodes[2].withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
    n2 = nodes[1].drop("cap").join(n3.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")), ["domain", "lang"])
    n2 = n2.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
    n1 = nodes[0].drop("cap").join(n2.groupBy("domain").agg(F.sum("cap").alias("cap")), ["domain"])
    n1 = n1.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
    total = leaves.agg(F.sum("n_tokens").alias("all")).select(F.floor(F.col("all") * F.lit(fraction)).cast("double").alias("budget"))
    d1 = _fill(n1.withColumn("budget", F.least(total.scalar(), F.sum("cap").over(Window.partitionBy(F.lit(0))))), [])
    d2 = _fill(n2.join(d1.select("domain", F.col("share").alias("budget")), "domain"), ["domain"])
    d3 = _fill(n3.join(d2.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"]), ["domain", "lang"])
    return leaves.join(
        d3.select(*LEVELS, F.floor(F.col("share") + F.lit(1e-6)).cast("long").alias("budget")), list(LEVELS)
    )


def mix_sources(docs: DataFrame, weights: DataFrame, fraction: float = 0.6, epochs: int = 4, seed: int = 17, carry: bool = False) -> DataFrame:
    """One row for each time a document is selected: doc_id, domain, lang, source, n_tokens, epoch (from 0).

    With ``carry`` the text and all other columns of ``docs`` follow; names that are taken get underscores."""
    src = F.coalesce("source", F.lit("-"))
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "lang", "source")] if carry else []
    named = dict(zip(others, free_names(["doc_id", *LEVELS, "n_tokens", "epoch"], *others)))
    packed = [F.struct(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]).alias("carried")] if others else []
    d = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), domain_of(src).alias("domain"), F.coalesce("lang", F.lit("-")).alias("lang"),
            src.alias("source"), tokens(F.col("text")).alias("n_tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), *packed,
        )
    )
    leaves = d.where("n_tokens > 0").groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"))
    plan = staged(
        leaf_budgets(leaves, weights, fraction, epochs)
        .withColumn("whole", F.floor(F.col("budget") / F.col("n_tokens")))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("n_tokens"))
        .select(*LEVELS, "whole", "rest")
    )
    rows = d.where("n_tokens > 0").join(plan, list(LEVELS))
    whole = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))))
    last = rows.where("rest > 0").withColumn("epoch", F.col("whole").cast("int"))
    last = last.withColumn("ord", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
    last = last.withColumn("bucket", F.substring("ord", 1, BUCKET_DIGITS))
    by_leaf = Window.partitionBy(*LEVELS).orderBy("bucket")
    buckets = (
        last.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("r"))
        .withColumn("before", F.sum("n").over(by_leaf.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .where("before < r")
        .withColumn("inside", F.col("before") + F.col("n") <= F.col("r"))
        .select(*LEVELS, "bucket", "before", "inside")
    )
    dealt = last.join(buckets, [*LEVELS, "bucket"])
    edge = Window.partitionBy(*LEVELS, "bucket").orderBy("ord", "text_md5").rowsBetween(Window.unboundedPreceding, 0)
    boundary = dealt.where("not inside").withColumn("run", F.col("before") + F.sum("n_tokens").over(edge)).where("run <= rest")
    out = ["doc_id", *LEVELS, "n_tokens", F.col("epoch").cast("int").alias("epoch"), *(["carried.*"] if packed else [])]
    return whole.select(*out).unionByName(dealt.where("inside").select(*out)).unionByName(boundary.select(*out))
