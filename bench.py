"""Headline queries, each in the median of three runs after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from skein.plans.catalogue import QUERIES

HEADLINE = (
    "relationship_strength_top", "relationship_strength", "monthly_activity", "graph_stats_by_type", "degree_stats_density", "simple_edges_collapse",
    "induced_subgraph", "activity_bursts", "burst_evidence_interval", "transfer_chains", "resolve_candidates", "validate_relationships", "grounding_check",
    "proximity_pairs", "upsert_merge", "audit_page", "bfs_ownership", "closeness", "betweenness", "components_ownership",
)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("skein-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            if sum(runs) > 30:
                break
        took[name] = round(median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
