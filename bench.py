"""Headline queries on the tables at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from labelsieve.plans.catalog import QUERIES  # noqa: E402
from labelsieve.session import build_session  # noqa: E402

HEADLINE = (
    "review_queue_centroid", "review_queue_logreg", "knn_cosine_exact", "knn_cosine_approximate", "knn_vote", "noise_detection", "centroid_softmax", "oof_logreg",
    "project_2d_pca", "stratified_folds", "embed_documents", "input_snapshot", "analysis_fingerprint",
    "json_project_scan", "xml_project_scan", "archive_scan", "analysis_batch_check", "target_path_collision",
    "effective_updates", "undo_redo_fold", "review_stream", "stale_invalidation", "queue_rank", "queue_top", "queue_neighbors",
    "reference_samples", "plot_sample", "grid_nearest", "chunk_completeness", "precision_recall_lift_at_k",
    "baseline_random_orders", "export_corrected", "result_store",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "labelsieve-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["queue_top"](spark, sf_dir).collect()  # start the JVM's code paths before the clock
    timings = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
