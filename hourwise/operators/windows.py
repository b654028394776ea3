"""Windows over *raw readings* without a PARTITION BY, made scalable.

A window with an ORDER BY but no PARTITION BY (NTILE over all readings, a 3-row moving average over all readings) makes
Spark move every row into one partition (``Exchange SinglePartition``).  The operators here compute the same values from the
cell counts of :mod:`hourwise.operators.ordered`:

* :func:`global_ntile` (X1) - NTILE(k) by selection.  A few counting passes narrow the k - 1 cut positions to cells of the sort
  key; the tile of a row is then a projection.  Nothing is sorted, staged or shuffled but cell counts.
* :func:`global_row_number` (X1) - exact position: buckets of consecutive cells with known starts, one shuffle of the rows to
  their buckets, ``row_number`` inside each.
* :func:`moving_window` (X2) - ROWS BETWEEN b PRECEDING AND a FOLLOWING over the global order.  The same buckets and one
  shuffle, one sort and one window inside each bucket.  The cells next to a bucket that hold the b rows before and the a rows
  behind it travel to it as copies, which are dropped after the window.  A bucket has 16 cells and more, so copies are few;
  buckets shorter than the frame are fine, as a cell goes to as many buckets as need it.
* :func:`ntile_top` / :func:`moving_head` - the top-k reports of the original (top 30 by count with their quartile, first 50
  moving averages) computed exactly from a top-k plus the row count, without ordering all readings.

Sort keys that are integers, booleans, dates, timestamps or decimals of 18 digits at most have cells.  For other keys (text,
doubles, expressions), and for rows that tie in all keys where a cut has to fall between them, positions come from a range
shuffle that is written once to the shared checkpoint folder (:func:`stage_ordered`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourwise.functions.columns import count_all
from hourwise.operators import ordered
from hourwise.session import checkpoint_dir

LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index in partition
_POS = "_hw_pos"
# Range buckets hold at most BUCKET_ROWS rows; below that, buckets are added (down to
# MIN_BUCKET_ROWS each) until every core has a few, so one slow bucket cannot hold a stage.
BUCKET_ROWS = 4 << 20
MIN_BUCKET_ROWS = 1 << 16
BUCKETS_PER_CORE = 4


def default_buckets(df: DataFrame) -> int:
    """Range buckets for ``df`` from its row count (one counting pass, whatever the source)."""
    rows = df.count()
    spread = min(BUCKETS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-rows // MIN_BUCKET_ROWS))
    return max(1, spread, -(-rows // BUCKET_ROWS))


def _sort_cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def stage_ordered(df: DataFrame, keys: Sequence[str | Column], buckets: int | None = None) -> DataFrame:
    """Range-partition ``df`` on ``keys`` (a total order), number rows within partitions
    and write the result to the shared checkpoint folder; returns the re-read table.

    The write is the one eager step of the operators in this module.
    """
    spark = df.sparkSession
    b = buckets or default_buckets(df)
    cols = _sort_cols(keys)
    path = f"{checkpoint_dir(spark).rstrip('/')}/hourwise-stage-{uuid.uuid4().hex}"
    (df.repartitionByRange(b, *cols)
       .sortWithinPartitions(*cols)
       .withColumn(_POS, F.monotonically_increasing_id())
       .write.parquet(path))
    return spark.read.parquet(path)


def _offsets(staged: DataFrame) -> DataFrame:
    """Per bucket: rows before it (prefix sum) and the total row count.

    One row per range bucket - bounded by the bucket count, so it is safe to broadcast.
    """
    counts = staged.groupBy(F.shiftright(_POS, LOCAL_BITS).alias("_hw_b")).agg(count_all().alias("_hw_n"))
    before = F.sum("_hw_n").over(Window.orderBy("_hw_b").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(
        "_hw_b",
        F.coalesce(before, F.lit(0)).alias("_hw_off"),
        F.sum("_hw_n").over(Window.partitionBy()).alias("_hw_total"),
    )


def bucket_rows(df: DataFrame, n: int | None, least: int = 1) -> Callable[[int], int]:
    """Rows per bucket by the number of rows: for ``n`` buckets, or for a few on every core within the two bounds."""
    cores = BUCKETS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    cells = ordered.MAX_CELLS // ordered.BUCKET_CELLS
    return lambda rows: max(least, -(-rows // cells), -(-rows // n) if n else min(BUCKET_ROWS, max(MIN_BUCKET_ROWS, -(-rows // cores))))


def _numbered(df: DataFrame, keys: Sequence[str | Column], out: str, n: int | None) -> DataFrame:
    """``df`` with its 1-based positions from a staged range shuffle, and the row count as ``_hw_total``."""
    staged = stage_ordered(df, keys, n or default_buckets(df))
    offs = F.broadcast(_offsets(staged))  # size bound: three numbers for each BUCKET_ROWS rows or ``n``
    local = F.col(_POS).bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    joined = staged.join(offs, F.shiftright(staged[_POS], LOCAL_BITS) == offs["_hw_b"])
    return joined.withColumn(out, F.col("_hw_off") + local + F.lit(1)).drop(_POS, "_hw_b", "_hw_off")


def _starts(spark: SparkSession, starts: list[int]) -> DataFrame:
    """(_hw_b, _hw_start) of the buckets, to broadcast: one row for each BUCKET_ROWS rows or wanted bucket."""
    return F.broadcast(spark.createDataFrame(pa.table({"_hw_b": pa.array(range(len(starts)), pa.int64()), "_hw_start": pa.array(starts, pa.int64())})))


def global_row_number(df: DataFrame, keys: Sequence[str | Column], out: str = "row_number",
                      buckets: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY keys)`` without a single-partition window.

    ``keys`` must define a total order (end with a unique column) for a deterministic
    result, like any ROW_NUMBER.
    """
    found = ordered.buckets(df, keys, bucket_rows(df, buckets))
    if found is None:
        return _numbered(df, keys, out, buckets).drop("_hw_total")
    if not found.starts:
        return df.withColumn(out, F.lit(0).cast("long"))
    inside = F.row_number().over(Window.partitionBy("_hw_b").orderBy(*_sort_cols(keys)))
    rows = found.attach(df, "_hw_b").withColumn("_hw_i", inside).join(_starts(df.sparkSession, found.starts), "_hw_b")
    return rows.withColumn(out, F.col("_hw_start") + F.col("_hw_i")).drop("_hw_b", "_hw_i", "_hw_start")


def ntile_of(rn: Column, n: Column, k: int) -> Column:
    """NTILE(k) bucket of 1-based position ``rn`` among ``n`` rows.

    The first ``n mod k`` tiles hold ``n div k + 1`` rows, the rest ``n div k``.
    """
    q = F.floor(n / F.lit(k)).cast("long")
    m = (n % F.lit(k)).cast("long")
    big = m * (q + 1)
    first = F.floor((rn - 1) / (q + 1)) + 1
    rest = m + F.floor((rn - big - 1) / q) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def global_ntile(df: DataFrame, k: int, keys: Sequence[str | Column], out: str = "ntile",
                 buckets: int | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY keys)`` over all rows by distributed selection of the k - 1 cuts.

    ``buckets`` only matters for keys without cells (see the module)."""
    found = ordered.tiles(df, keys, k, out)
    if found is not None:
        return found
    numbered = _numbered(df, keys, "_hw_rn", buckets)
    return numbered.withColumn(out, ntile_of(F.col("_hw_rn"), F.col("_hw_total"), k)).drop("_hw_rn", "_hw_total")


AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def moving_window(df: DataFrame, keys: Sequence[str | Column], value: str, before: int, after: int,
                  agg: str = "avg", out: str = "moving", block_rows: int | None = None,
                  buckets: int | None = None) -> DataFrame:
    """``agg(value) OVER (ORDER BY keys ROWS BETWEEN before PRECEDING AND after FOLLOWING)``.

    Frames truncate at both ends of the whole series only.  ``block_rows`` bounds the rows of a bucket, ``buckets`` asks for
    about so many; by default a bucket is several times as long as the frame."""
    size = (lambda rows: block_rows) if block_rows else bucket_rows(df, buckets, 1 if buckets else 16 * (before + after))
    found = ordered.buckets(df, keys, size)
    if found is None:
        return _moving_staged(df, keys, value, before, after, agg, out, block_rows or 1 << 16, buckets)
    fn = AGGREGATES[agg]
    if not found.starts:
        return df.withColumn(out, fn(value).over(Window.partitionBy()))
    w = Window.partitionBy("_hw_to").orderBy(*_sort_cols(keys)).rowsBetween(-before, after)
    rows = found.attach(df, "_hw_b", ("_hw_first", "_hw_last"), before, after)
    copies = rows.withColumn("_hw_to", F.explode(F.sequence("_hw_first", "_hw_last")))
    return copies.withColumn(out, fn(value).over(w)).where("_hw_to = _hw_b").drop("_hw_b", "_hw_first", "_hw_last", "_hw_to")


def _moving_staged(df: DataFrame, keys: Sequence[str | Column], value: str, before: int, after: int, agg: str, out: str,
                   block_rows: int, buckets: int | None) -> DataFrame:
    """The same for keys without cells: blocks of staged positions with copies of the rows around them."""
    block_rows = max(block_rows, before, after, 1)  # the copies reach one block at most
    numbered = _numbered(df, keys, "_hw_rn", buckets).drop("_hw_total")
    s = F.lit(block_rows)
    idx = F.col("_hw_rn") - 1
    within = idx % s
    # 0 = own block; -1 = copy for the previous block; +1 = for the next block.
    targets = F.array(F.lit(0))
    if after > 0:
        targets = F.when(within < after, F.array_union(targets, F.array(F.lit(-1)))).otherwise(targets)
    if before > 0:
        targets = F.when(within >= s - before, F.array_union(targets, F.array(F.lit(1)))).otherwise(targets)
    copies = numbered.select("*", F.explode(targets).alias("_hw_shift")).withColumn(
        "_hw_block", F.floor(idx / s).cast("long") + F.col("_hw_shift"))
    w = Window.partitionBy("_hw_block").orderBy("_hw_rn").rowsBetween(-before, after)
    windowed = copies.withColumn(out, AGGREGATES[agg](value).over(w))
    return windowed.filter(F.col("_hw_shift") == 0).drop("_hw_shift", "_hw_block", "_hw_rn")


# Top-k reports -----------------------------------------------------------------------------
def ntile_top(df: DataFrame, k: int, order_col: str, tiebreak: str, n: int, out: str = "ntile") -> DataFrame:
    """The ``n`` rows that come *last* in ``ORDER BY order_col, tiebreak`` with their
    NTILE(k) - i.e. the top ``n`` by ``order_col`` descending.

    Their global positions are ``N - i + 1`` for the i-th from the top, so a per-task top-n
    and the row count (a scalar subquery) are all that is needed: no global sort.
    """
    total = df.agg(count_all()).scalar()
    desc = [F.desc(order_col), F.desc(tiebreak)]
    top = df.orderBy(*desc).limit(n)
    # Window over the n selected rows only; position and count become columns once.
    ranked = top.select("*", F.row_number().over(Window.orderBy(*desc)).alias("_hw_pos"),
                        total.alias("_hw_total"))
    rn = F.col("_hw_total") - F.col("_hw_pos") + 1
    return ranked.withColumn(out, ntile_of(rn, F.col("_hw_total"), k)).drop("_hw_pos", "_hw_total")


def moving_head(df: DataFrame, keys: Sequence[str | Column], value: str, before: int, after: int,
                n: int, out: str = "moving") -> DataFrame:
    """The first ``n`` rows in ``keys`` order with their moving average.

    Row ``n`` needs ``after`` rows beyond it, so ``n + after`` rows are taken (a per-task
    top-k) and the window runs over them only.
    """
    cols = _sort_cols(keys)
    head = df.orderBy(*cols).limit(n + after)
    w = Window.orderBy(*cols).rowsBetween(-before, after)  # over n + after rows only
    return head.withColumn(out, F.avg(value).over(w)).orderBy(*cols).limit(n)
