"""Positions in a total order of all rows, by counting cells instead of sorting.

The sort keys become whole numbers that keep their order.  A *level* cuts one key into cells of ``2**shift`` neighbouring numbers
and counts rows per cell: a partial aggregate, so a task sends one row a cell whatever the data.  Cells that the caller wants finer
are split by the next level (fewer bits of the same key, then the next key), so a value that holds a third of the rows is cut by
the key behind it.  What remains is a small table of leaf cells in sort order with their exact starts; rows find their leaf by
broadcast hash joins on (parent cell, number >> shift), one for each level.  No row is sorted, staged or moved for that.

* quantile cuts (:func:`tiles`): only cells with a cut strictly inside are split, so NTILE is a projection at the end;
* range buckets (:func:`buckets`): only cells of more than the wanted rows are split; neighbouring leaves join.

A level counts at most ``MAX_CELLS`` cells, which also bounds what the driver holds and the joins broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that one level counts at most (over all its parents).
MAX_CELLS = 1 << 20
#: Bits by which one level splits a cell at most: a task's partial aggregate has this many groups a parent.
LEVEL_BITS = 16
#: Cells that a bucket has at least, but for those where one cell holds much of it.
BUCKET_CELLS = 16
_DAY = 86_400_000_000


def whole_number(name: str, kind: T.DataType, zone: str) -> str | None:
    """SQL for ``name`` as a BIGINT of the same order, or None for kinds of which no such number is known.

    Wall-clock times are taken apart unless the session's ``zone`` is UTC: elsewhere, clocks that are set back change the order."""
    c = f"`{name}`"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return f"CAST({c} AS BIGINT)"
    if isinstance(kind, T.DateType):
        return f"CAST(unix_date({c}) AS BIGINT)"
    if isinstance(kind, T.TimestampType):
        return f"unix_micros({c})"
    if isinstance(kind, T.TimestampNTZType) and zone in ("UTC", "Etc/UTC"):
        return f"unix_micros(CAST({c} AS TIMESTAMP))"
    if isinstance(kind, T.TimestampNTZType):
        second = f"CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT)"
        return f"unix_date(CAST({c} AS DATE)) * {_DAY}L + hour({c}) * 3600000000L + minute({c}) * 60000000L + {second}"
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return f"CAST({c} * {10**kind.scale} AS BIGINT)"
    return None


@dataclass
class Level:
    """Cells of one level.  ``node`` numbers the cells that the next level splits (else -1): there, they are the parents."""

    number: str  # SQL of the whole number
    shift: int
    parent: list[int] = field(default_factory=list)
    cell: list[int] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)

    def join(self, df: DataFrame, i: int, columns: dict[str, pa.Array], only_nodes: bool) -> DataFrame:
        """``df`` with the level's columns of each row's cell; ``i`` is the level's place."""
        cols = {f"_hw_p{i}": pa.array(self.parent, pa.int64()), f"_hw_c{i}": pa.array(self.cell, pa.int64()),
                f"_hw_n{i}": pa.array(self.node, pa.int64()), **columns}
        table = pa.table(cols)
        if only_nodes:
            table = table.filter(pc.greater_equal(table.column(f"_hw_n{i}"), 0))
        small = F.broadcast(df.sparkSession.createDataFrame(table))  # MAX_CELLS rows at most
        on = F.expr(f"shiftright({self.number}, {self.shift})") == F.col(f"_hw_c{i}")
        if i:
            on = on & (F.col(f"_hw_n{i - 1}") == F.col(f"_hw_p{i}"))
        return df.join(small, on, "inner" if only_nodes or not i else "left")


@dataclass
class Layout:
    """Cells of all rows, and the leaves in sort order as (level, place in the level)."""

    rows: int
    levels: list[Level]

    def leaves(self) -> list[tuple[int, int]]:
        below = []
        for lv in self.levels:
            by: dict[int, list[int]] = {}
            for x, p in enumerate(lv.parent):
                by.setdefault(p, []).append(x)  # in cell order already
            below.append(by)
        out, todo = [], [(0, x) for x in reversed(below[0][0])] if self.rows else []
        while todo:
            i, x = todo.pop()
            n = self.levels[i].node[x]
            if n < 0:
                out.append((i, x))
            else:
                todo += [(i + 1, y) for y in reversed(below[i + 1][n])]
        return out

    def attach(self, df: DataFrame, names: Sequence[str], kind: pa.DataType, values: dict[tuple[int, int], tuple]) -> DataFrame:
        """``df`` with columns ``names``: the values of each row's leaf."""
        out = df
        for i, lv in enumerate(self.levels):
            own = [values.get((i, x), (None,) * len(names)) for x in range(len(lv.cell))]
            out = lv.join(out, i, {f"_hw_v{i}_{j}": pa.array([v[j] for v in own], kind) for j in range(len(names))}, only_nodes=False)
        found = [F.coalesce(*[F.col(f"_hw_v{i}_{j}") for i in range(len(self.levels))]).alias(n) for j, n in enumerate(names)]
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *found)


def _shift(lo: int, hi: int, bits: int) -> int:
    """The least shift that leaves 2**bits cells at most between ``lo`` and ``hi``."""
    s = 0
    while (hi >> s) - (lo >> s) >= 1 << bits:
        s += 1
    return s


def _counted(df: DataFrame, levels: list[Level], new: Level) -> list[tuple[int, int, int]]:
    """(parent, cell, rows) of the new level, sorted: MAX_CELLS of them at most."""
    parent = F.lit(0).cast("long")
    for i, lv in enumerate(levels):
        df = lv.join(df, i, {}, only_nodes=True)
        parent = F.col(f"_hw_n{i}")
    cell = F.expr(f"shiftright({new.number}, {new.shift})")
    counts = df.select(parent.alias("p"), cell.alias("c")).groupBy("p", "c").agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["p"], r["c"], r["n"]) for r in counts.collect())


def layout(df: DataFrame, keys: Sequence[str | Column], finer: Callable[[int, int, int], bool],
           bits: Callable[[int], int]) -> Layout | None:
    """Cells of ``df`` in the order of ``keys`` (ascending, nulls first, as Spark sorts).

    ``finer(rows, start, count)`` tells whether a cell must be split, ``bits(rows)`` into how many cells the first level
    cuts at most (as a power of two).  One job for the ranges, then one for each level.  None when a key has no whole
    numbers, or when rows that are equal in all keys should be split."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    numbers = [whole_number(k, kinds[k], zone) if isinstance(k, str) and k in kinds else None for k in keys]
    if None in numbers:
        return None
    sums = [F.expr(f"{fn}({e})").alias(f"{fn}{i}") for i, e in enumerate(numbers) for fn in ("min", "max", "count")]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()  # one row
    rows = seen["n"]
    if not rows:
        return Layout(0, [])
    spans = []
    for i, e in enumerate(numbers):
        lo, hi = (seen[f"min{i}"], seen[f"max{i}"]) if seen[f"count{i}"] else (0, 0)
        if seen[f"count{i}"] < rows:
            if lo == -(2**63):
                return None
            lo -= 1  # the place of nulls
            numbers[i] = f"coalesce({e}, {lo}L)"
        spans.append((lo, hi))

    levels: list[Level] = []
    key, shift = 0, _shift(*spans[0], max(1, min(LEVEL_BITS, bits(rows))))
    starts = [0]
    while True:
        lv = Level(numbers[key], shift)
        following: list[int] = []
        left = 0
        at = list(starts)
        for p, c, n in _counted(df, levels, lv):
            split = finer(rows, at[p], n)
            lv.parent.append(p)
            lv.cell.append(c)
            lv.node.append(len(following) if split else -1)
            lv.start.append(at[p])
            lv.count.append(n)
            if split:
                following.append(at[p])
                left += n
            at[p] += n
        levels.append(lv)
        if not following:
            return Layout(rows, levels)
        # few rows have few cells, however fine
        room = 64 if left <= 1 << LEVEL_BITS else max(1, min(LEVEL_BITS, (MAX_CELLS // len(following)).bit_length() - 1))
        if shift:
            shift = max(0, shift - room)
        else:
            key += 1
            if key == len(keys):
                return None
            shift = _shift(*spans[key], room)
        starts = following


# Quantile cuts -------------------------------------------------------------------------------
def tile_ends(rows: int, k: int) -> list[int]:
    """Rows up to the end of each NTILE(k) tile but the last: the first ``rows mod k`` tiles hold one row more."""
    q, m = divmod(rows, k)
    return [e for i in range(1, k) if (e := i * q + min(i, m)) < rows]


def tiles(df: DataFrame, keys: Sequence[str | Column], k: int, out: str) -> DataFrame | None:
    """``df`` with NTILE(k) over ``keys`` as a projection, or None (see :func:`layout`)."""
    ends: dict[int, list[int]] = {}

    def cut_inside(rows: int, start: int, count: int) -> bool:
        e = ends.setdefault(rows, tile_ends(rows, k))
        return bisect_right(e, start) < bisect_left(e, start + count)

    # a level counts the cells of one parent a cut: fewer bits for many tiles
    cells = layout(df, keys, cut_inside, lambda rows: LEVEL_BITS)
    if cells is None:
        return None
    if not cells.rows:
        return df.withColumn(out, F.lit(1))
    e = ends[cells.rows]
    tile = {(i, x): (1 + bisect_right(e, cells.levels[i].start[x]),) for i, x in cells.leaves()}
    return cells.attach(df, [out], pa.int32(), tile)


# Range buckets -------------------------------------------------------------------------------
@dataclass
class Buckets:
    """Consecutive buckets of the order: first position (from 0) of each, and the bucket of every leaf."""

    cells: Layout
    starts: list[int]
    of: dict[tuple[int, int], int]

    def attach(self, df: DataFrame, name: str, span: tuple[str, str] | None = None, before: int = 0, after: int = 0) -> DataFrame:
        """``df`` with each row's bucket as ``name`` and, for ``span``, the first and last bucket that need the row's cell to
        have ``before`` rows in front of them and ``after`` rows behind."""
        ends = [*self.starts[1:], self.cells.rows]
        values = {}
        for (i, x), b in self.of.items():
            values[(i, x)] = (b,)
            if span:
                s, n = self.cells.levels[i].start[x], self.cells.levels[i].count[x]
                values[(i, x)] = (b, bisect_right(ends, s - after), bisect_left(self.starts, s + n + before) - 1)
        return self.cells.attach(df, [name, *(span or ())], pa.int64(), values)


def buckets(df: DataFrame, keys: Sequence[str | Column], size: Callable[[int], int]) -> Buckets | None:
    """Buckets of at most ``size(rows)`` rows: cells of more are split, and neighbouring leaves join while they fit."""
    cells = layout(df, keys, lambda rows, start, count: count > size(rows),
                   lambda rows: (2 * BUCKET_CELLS * rows // size(rows)).bit_length())
    if cells is None:
        return None
    starts: list[int] = []
    of = {}
    for i, x in cells.leaves():
        start, count = cells.levels[i].start[x], cells.levels[i].count[x]
        if not starts or start + count - starts[-1] > size(cells.rows):
            starts.append(start)
        of[(i, x)] = len(starts) - 1
    return Buckets(cells, starts, of)
