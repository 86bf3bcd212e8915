"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workloads import fixtures  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINES = [
    "extract_links", "extract_skip_code", "extract_nav", "heading_repeats", "html_anchors", "decode_body",
    "target_kinds", "distinct_targets", "check_local", "check_corpus", "check_prefix", "check_remote",
    "check_remote_follow", "redirect_chains", "redirects_nofollow", "report_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # call sites for error messages cost three calls into the JVM per column operation
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    fixtures.SPREAD = int(os.environ.get("BENCH_SPREAD", cpus))
    chosen = sys.argv[1:] or HEADLINES
    # one run of the flagship at the smallest scale starts the JVM's compilers, outside the timing
    QUERIES["tag_counts"](spark, str(Path(sf_dir).parent / "sf0.001")).collect()
    seconds, rows = {}, {}
    for name in chosen:
        started = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        # all columns are computed for all rows, but nothing is moved to the driver
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if name.startswith(("check_", "redirects_")):
            rows[name] = df.count()
            print(f"{name}: {rows[name] / seconds[name]:.0f} links/s", file=sys.stderr)
    checked = [n for n in chosen if n in rows]
    total = sum(seconds[n] for n in checked)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "links_checked_per_sec": round(sum(rows.values()) / total) if total else None,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
