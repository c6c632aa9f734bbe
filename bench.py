"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strataquill.plans import queries as plans  # noqa: E402
from strataquill.session import session  # noqa: E402

NAMES = ["tokenize_counts", "bm25_top5", "dense_top5", "rrf_hybrid_top5", "pr_rr_at_k", "furniture_lines", "reflow_blocks", "sentence_spans", "merge_undersized", "chunk_fixed_invariants", "semantic_breaks", "paired_effect", "wilcoxon_w", "validator_issues", "near_duplicates"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
