"""Explicit schemas for readers; nullable fields stand for optional keys."""

TIMING = ("n BIGINT, wall_total_s DOUBLE, wall_mean_s DOUBLE, cpu_total_s DOUBLE, cpu_mean_s DOUBLE, "
          "gpu_total_s DOUBLE, gpu_mean_s DOUBLE, gpu_busy_total_s DOUBLE, gpu_busy_mean_s DOUBLE, "
          "cpu_parallelism DOUBLE, gpu_occupancy DOUBLE, skipped_warmup BIGINT")
SAMPLE = ("name STRING, wall_s DOUBLE, cpu_s DOUBLE, gpu_s DOUBLE, gpu_busy_s DOUBLE, cpu_par DOUBLE, "
          "gpu_util_mean DOUBLE, extra MAP<STRING, STRING>")
RESULT = ("name STRING, frames INT, scores MAP<STRING, DOUBLE>, "
          "fvd_logits STRUCT<raw: ARRAY<ARRAY<DOUBLE>>, gen: ARRAY<ARRAY<DOUBLE>>>")


def _nested(ddl: str) -> str:
    """Field list as the inside of STRUCT<...>."""
    out, depth, word = [], 0, ddl
    parts, cur = [], ""
    for ch in word:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts.append(cur)
    for p in parts:
        name, typ = p.strip().split(" ", 1)
        out.append(f"{name}: {typ}")
    return ", ".join(out)


SHARD = (
    "rank INT, world_size INT, threads_requested INT, model_load_s DOUBLE, compute_s DOUBLE, "
    "env MAP<STRING, STRING>, "
    "thread_check STRUCT<requested: INT, actual_torch_threads: INT, omp_env: STRING, mismatch: BOOLEAN>, "
    f"timing STRUCT<{_nested(TIMING)}>, timing_steady_state STRUCT<{_nested(TIMING)}>, "
    f"per_sample ARRAY<STRUCT<{_nested(SAMPLE)}>>, results ARRAY<STRUCT<{_nested(RESULT)}>>, videos ARRAY<STRING>"
)
SWEEP_ROW = (
    "arm STRING, G INT, rep INT, threads_per_worker INT, rc INT, wall_s DOUBLE, n_videos BIGINT, "
    "throughput_v_per_s DOUBLE, cpu_s_per_video DOUBLE, gpu_busy_s_per_video DOUBLE, straggler_s DOUBLE, "
    "imbalance DOUBLE, peak_loadavg DOUBLE, steady_state_wall_mean_s DOUBLE, final_scores MAP<STRING, DOUBLE>, "
    "log STRING"
)
SWEEP = f"env MAP<STRING, STRING>, args MAP<STRING, STRING>, rows ARRAY<STRUCT<{_nested(SWEEP_ROW)}>>"
MANIFEST = (
    "source STRING, num_pairs INT, frames STRING, jitter_range ARRAY<INT>, resolution STRING, fps DOUBLE, "
    "seed INT, strength_range ARRAY<DOUBLE>, "
    "videos ARRAY<STRUCT<name: STRING, frames: INT, degrade_strength: DOUBLE>>"
)
LOAD_TRACE = "epoch DOUBLE, l1 DOUBLE, l5 DOUBLE, l15 DOUBLE"
