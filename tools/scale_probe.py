"""Where do the scaled global windows (and the one-scan sections) pay off?

Derives larger readings from the sf0.1 events inside Spark (``copies`` shifted copies
with distinct ids and times; nothing written) and times plain vs scaled NTILE(4) and
3-row moving average, and aggregate sections from one scan each vs one for all, with the noop sink.  Diagnostic only, not a registered query.

usage: python tools/scale_probe.py [copies ...]
       python tools/scale_probe.py --dir DIR   (a folder with an events.parquet, e.g. a
                                                written copy of the derived readings)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from hourwise.config import EVENTS  # noqa: E402
from hourwise.operators import windows  # noqa: E402
from hourwise.operators.enrich import enrich  # noqa: E402
from hourwise.plans import moments  # noqa: E402
from hourwise.session import checkpoint_dir, local_session  # noqa: E402
from hourwise.sources.readings import from_events  # noqa: E402


def derived(spark, copies: int):
    base = from_events(spark, "/root/testdata/sf0.1")
    k = spark.range(copies).withColumnRenamed("id", "k")
    return base.crossJoin(k).selectExpr(
        "record_id + k * 100000000 AS record_id",
        "traffic_time + make_dt_interval(k * 31, 0, 0, 0) AS traffic_time",
        "traffic_count")


def timed(build) -> float:
    """Seconds to build (the scaled operators stage data eagerly) and run a query."""
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 2)


def main() -> None:
    spark = local_session(cores=8, shuffle_partitions=8, app="hourwise-scale-probe")
    checkpoint_dir(spark)
    out = {}
    args = sys.argv[1:]
    if args[:1] == ["--dir"]:
        inputs = [(None, lambda: from_events(spark, args[1]))]
    else:
        inputs = [(c, lambda c=c: derived(spark, c).repartition(8 * max(1, c // 10)))
                  for c in ([int(x) for x in args] or [10, 100])]
    for copies, make in inputs:
        r = make()
        keys_n, keys_t = ["traffic_count", "record_id"], ["traffic_time", "record_id"]
        row = {"rows": r.count()}
        row["ntile_plain"] = timed(lambda: r.withColumn("q", F.ntile(4).over(Window.orderBy(*keys_n))))
        row["ntile_scaled"] = timed(lambda: windows.global_ntile(r, 4, keys_n, out="q"))
        w = Window.orderBy(*keys_t).rowsBetween(-1, 1)
        row["moving_plain"] = timed(lambda: r.withColumn("m", F.avg("traffic_count").over(w)))
        row["moving_scaled"] = timed(lambda: windows.moving_window(r, keys_t, "traffic_count", 1, 1, out="m"))
        # Seven aggregate sections: one scan each vs one scan for all.
        e = enrich(r, EVENTS)
        names = [n for n in moments.EXECUTIVE if n]
        t0 = time.perf_counter()
        for n in names:
            moments.SECTIONS[n].direct(e, EVENTS).write.format("noop").mode("overwrite").save()
        row["sections_direct"] = round(time.perf_counter() - t0, 2)
        t0 = time.perf_counter()
        shared = moments.materialize(moments.executive_moments(e, EVENTS))
        for n in names:
            moments.section_of(shared, n, EVENTS).write.format("noop").mode("overwrite").save()
        row["sections_one_scan"] = round(time.perf_counter() - t0, 2)
        out[copies] = row
        print(json.dumps(row), flush=True)


if __name__ == "__main__":
    main()
