"""Seconds per headline query, one JSON line: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_KEYS (comma list or 'all')."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OMP_NUM_THREADS", "1")

HEADLINE = [
    "merge_scores", "clip_scores", "parity_diff", "pair_frames", "run_rollup", "steady_state", "smoothed_value", "ema_scale_bias",
    "scaling_table", "frame_enumerate", "pingpong_extend", "depth_metrics", "scale_shift_fit", "align_inv_depth", "coverage_score",
    "knn_join", "bilinear_splat", "zbuffer_nearest", "asof_keyframe", "box_iou_join", "box_nms", "rle_encode", "mask_iou",
    "track_displacement", "block_matmul", "set_moments", "frechet_distance", "psnr", "ssim", "frame_distance", "explode_results",
    "stream_load_peak",
]


def main() -> None:
    from reelframe.plans import QUERIES
    from reelframe.session import local_session

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = os.environ.get("BENCH_KEYS", "")
    keys = list(QUERIES) if keys == "all" else keys.split(",") if keys else HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "12g"))
    QUERIES["mean_by_name"](spark, path).write.format("noop").mode("overwrite").save()
    took = {}
    for k in keys:
        t = time.perf_counter()
        QUERIES[k](spark, path).write.format("noop").mode("overwrite").save()
        took[k] = round(time.perf_counter() - t, 3)
        print(k, took[k], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": path.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
