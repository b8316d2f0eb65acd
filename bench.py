"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of five runs after a warm-up, to a noop
"""

from __future__ import annotations

import json
import datetime
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from pitchlake import catalog
from pitchlake.plans import match
from pitchlake.sources.adapter import football_events
from pitchlake.sources.feed import store_by_match

HEADLINE = (
    "match_general", "match_attacks", "match_transitions", "match_duels", "match_possession", "match_passes", "match_players", "team_corners",
    "team_radar", "team_percentiles", "player_counting", "player_npxg_xa", "player_threat", "player_table", "archetype_scores"
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        # the adapter's formulas make methods that the JVM doesn't compile; below this size Spark splits them
        "spark.sql.codegen.hugeMethodLimit": "8000"
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(6):  # the first compiles
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
        if "--table" in sys.argv:
            out = catalog.QUERIES[name](spark, sf_dir)
            rows = out.count()
            plan = out._jdf.queryExecution().executedPlan().toString()
            exchanges = sum(line.lstrip(" :+-*()0123456789").startswith("Exchange") for line in plan.splitlines())
            read = spark.read.parquet(f"{sf_dir}/events.parquet").count()
            print(
                f"| {name} | {sf_dir.rpartition('sf')[2]} | {read} | {rows} | {seconds[name]} | {exchanges} | {cpus} | {datetime.date.today()} |",
                file=sys.stderr
            )
    if "--store" in sys.argv:
        # the reports of a match, read from the table as it is and from one bucketed by match
        events = football_events(spark, sf_dir)
        stored = store_by_match(events, "bench_events", int(cpus), tempfile.mkdtemp(prefix="spark-bench-"))
        for name in ("general", "attacks", "transitions", "duels", "possession"):
            for form, table in (("plain", events), ("stored", stored)):
                times = []
                for _ in range(6):
                    began = time.perf_counter()
                    getattr(match, name)(table).write.format("noop").mode("overwrite").save()
                    times.append(time.perf_counter() - began)
                print(f"| match {name} | {form} | {statistics.median(times[1:]):.3f} |", file=sys.stderr)
        spark.sql("drop table bench_events")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
