"""Headline queries timed at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

A query's time is the median of ``$BENCH_RUNS`` (5) runs after a warm-up.  The
view and indexed counts read an index stored once before, as the engine is
meant to be used; ``index_build`` is timed on its own.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from bitquarry.functions.flags import Mask
from bitquarry.operators import compare, index, query, report
from bitquarry.plans import skipping
from bitquarry.plans.catalog import Catalog
from bitquarry.queries import MASK, RARE
from bitquarry.sources.records import lineitem_records

#: Few records, in few blocks.
SELECTIVE = Mask(0xB08, 0x400)
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
RUNS = int(os.environ.get("BENCH_RUNS", 5))


def timed(make) -> float:  # noqa: ANN001
    def once() -> float:
        began = time.perf_counter()
        df: DataFrame = make()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    once()
    return statistics.median(once() for _ in range(RUNS))


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        records = lineitem_records(spark.read.parquet(f"{SF_DIR}/lineitem.parquet"))
        catalog = Catalog(spark, f"{folder}/indexes")
        catalog.save("items", index.build(records))
        stored = catalog.load("items")
        skipping.write_records(records, f"{folder}/records", 256)
        bucketed = spark.read.parquet(f"{folder}/records")
        found = {
            "index_build": timed(lambda: index.build(records)),
            "count_indexed": timed(lambda: query.count(stored, MASK)),
            "count_scan": timed(lambda: query.scan_count(records, MASK)),
            "view_indexed": timed(lambda: skipping.view_of(bucketed, stored, RARE, 256)),
            "view_direct": timed(lambda: query.view_direct(records, RARE)),
            "view_selective_indexed": timed(lambda: skipping.view_of(bucketed, stored, SELECTIVE, 256)),
            "view_selective_direct": timed(lambda: query.view_direct(records, SELECTIVE)),
            "top_flags": timed(lambda: report.top_flags(stored)),
            "block_stats": timed(lambda: index.block_stats(stored)),
            "index_merge": timed(lambda: index.merge(stored, stored)),
            "equivalence": timed(lambda: compare.is_equivalent(stored, stored)),
            "count_all": timed(lambda: query.count(stored, Mask())),
        }
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 4), "unit": "sec", "queries": {k: round(v, 4) for k, v in found.items()}, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
