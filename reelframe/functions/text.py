"""String expressions: paths, names, captions, patterns and nested fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_field(doc: Column, path: str, typ: str, default) -> Column:
    """Nested value of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(doc, path).cast(typ), F.lit(default).cast(typ))


def epoch_to_ts(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def format_eta(seconds: Column) -> Column:
    """Whole seconds as h:mm:ss."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))


def stem(path: Column) -> Column:
    """Last path element without its extension, query or fragment."""
    base = F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), -1), r"\.[^.]*$", "")
    return base


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"/[^/]*$", "")


def artifact_path(root: Column, kind: str, name: Column, ext: str) -> Column:
    return F.concat_ws("/", root, F.lit(kind), F.concat(name, F.lit("." + ext)))


def frame_file_name(idx: Column, ext: str = "png") -> Column:
    return F.concat(F.lpad(idx.cast("string"), 5, "0"), F.lit("." + ext))


def frame_index(file: Column) -> Column:
    return F.split(file, r"\.")[0].cast("int")


def normalize_caption(text: Column) -> Column:
    """Lower case, trimmed, ending in a full stop."""
    t = F.trim(F.lower(text))
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def join_phrases(phrases: Column) -> Column:
    """['a', 'b'] -> 'a.b.'"""
    return F.concat(F.array_join(phrases, "."), F.lit("."))


def parse_resolution(text: Column) -> Column:
    """'WxH' as a struct (w, h); 'source' and unreadable texts give nulls."""
    p = F.split(F.lower(text), "x")
    ok = F.lower(text).rlike(r"^\d+x\d+$")
    return F.struct(F.when(ok, p[0].cast("int")).alias("w"), F.when(ok, p[1].cast("int")).alias("h"))


def parse_model_name(text: Column, default_sub: str = "default") -> Column:
    """'prefix_metric[_video]' and 'name-sub': (name, metric, video, sub)."""
    p = F.split(text, "_")
    head = F.split(p[0], "-")
    return F.struct(head[0].alias("name"), F.coalesce(F.get(head, F.lit(1)), F.lit(default_sub)).alias("sub"),
                    F.get(p, F.lit(1)).alias("metric"), (F.coalesce(F.get(p, F.lit(2)), F.lit("")) == "video").alias("video"))


# fixed values: names and formats of the sampling patterns
PATTERNS = {
    "count": r"^(\d+)$", "downscale": r"^downscale_(\d+)$", "cubic": r"^cubic_(\d+)$",
    "distance": r"^distance_(\d+)_(\d+)$", "lidar": r"^LiDAR_(\d+)$",
}


def classify_pattern(text: Column) -> Column:
    """Sampling pattern name with its one or two numbers; null kind when none fits."""
    kind, a, b = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, pat in PATTERNS.items():
        hit = text.rlike(pat)
        kind = F.when(hit, k).otherwise(kind)
        a = F.when(hit, F.regexp_extract(text, pat, 1).cast("int")).otherwise(a)
        if pat.count("(") == 2:
            b = F.when(hit, F.regexp_extract(text, pat, 2).cast("int")).otherwise(b)
    return F.struct(kind.alias("kind"), a.alias("a"), b.alias("b"))


def map_merge(a: Column, b: Column) -> Column:
    """Union of two maps; the second wins on equal keys."""
    keep = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(keep, b)
