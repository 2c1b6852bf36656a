"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local cores. Each query runs to the end of its plan, every column
included; nothing is cached between queries. One untimed query on the smallest data
warms up the JVM.
"""

from __future__ import annotations

import json
import os
import time

from sceneloom.plans import load
from sceneloom.session import local_session

HEADLINE = [
    "object_state", "mask_iou_pairs", "patch_tokens", "mask_stats", "best_per_object", "discover_new",
    "merge_gate", "fuse_tracks", "track_segments", "track_window", "scene_to_json", "associate_frames",
    "spatial_edges", "knn_edges", "motion_label", "align_chunks", "backproject_frame", "accuracy",
    "extract_answer_texts", "session_tracks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), shuffle_partitions=max(int(cpus), 1))
    queries, _ = load()
    # one untimed run on the smallest data starts the JVM's and Python's machinery
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        queries["fuse_tracks"](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    frames = spark.read.parquet(f"{folder}/events.parquet").selectExpr("count(distinct user_id div 15) * 120 as n").first()["n"]
    lift_ms = 1000 * (seconds["object_state"] + seconds["fuse_tracks"]) / max(frames, 1)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "frames": frames, "lift_and_fuse_ms_per_frame": round(lift_ms, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
