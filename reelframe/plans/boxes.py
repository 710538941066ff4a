"""Queries over boxes, masks and objects."""

from pyspark.sql import functions as F

from reelframe.fixtures import CLASSES
from reelframe.functions import text as TX
from reelframe.functions.values import rounded
from reelframe.operators import boxes as B
from reelframe.operators import masks as M
from reelframe.plans.depth import R
from reelframe.plans.registry import query



def _b():
    return [F.col(c) for c in B.XYXY]


_OV = """o AS (SELECT a.image, a.box_id AS a_id, b.box_id AS b_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS iw, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS ih,
      (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s,
      (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS hull
      FROM boxes a JOIN boxes b ON a.image = b.image AND a.box_id < b.box_id)"""


@query("box_iou_join", f"""
    WITH {_OV} SELECT image, a_id, b_id, s - iw * ih AS "union", round(iw * ih / (s - iw * ih + 1e-6), 6) AS iou FROM o WHERE iw > 0 AND ih > 0""")
def box_iou_join(v):
    b = v.boxes.drop("score")
    return B.box_iou(b, b, ["image"], half="box_id").filter("a_box_id < b_box_id").select(
        "image", F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), "union", rounded(F.col("iou")).alias("iou"))


@query("box_giou_join", f"""
    WITH {_OV} SELECT image, a_id, b_id, round(iw * ih / (s - iw * ih + 1e-6) - (hull - (s - iw * ih)) / (hull + 1e-6), 6) AS giou FROM o WHERE iw > 0 AND ih > 0""")
def box_giou_join(v):
    b = v.boxes.drop("score")
    return B.box_giou(b, b, ["image"], half="box_id").filter("a_box_id < b_box_id").select(
        "image", F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), rounded(F.col("giou")).alias("giou"))


@query("box_iou_aligned", """
    WITH o AS (SELECT image, box_id, greatest(x1 - (x0 + 5), 0) * greatest(y1 - (y0 + 3), 0) AS inter, 2 * (x1 - x0) * (y1 - y0) AS s, (x1 + 5 - x0) * (y1 + 3 - y0) AS hull FROM boxes)
    SELECT image, box_id, round(inter / (s - inter), 6) AS iou, round(inter / (s - inter) - (hull - (s - inter)) / hull, 6) AS giou FROM o""")
def box_iou_aligned(v):
    b = v.boxes
    c = b.withColumns({"x0": F.col("x0") + 5, "x1": F.col("x1") + 5, "y0": F.col("y0") + 3, "y1": F.col("y1") + 3})
    return B.box_iou_aligned(b, c, ["image", "box_id"]).select("image", "box_id", R("iou"), R("giou"))


@query("box_convert", """
    SELECT image, box_id, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, round(x0, 6) AS bx0, round(y1, 6) AS by1,
           CAST(trunc(x0 / 300 * 640) AS INT) AS px0, CAST(trunc(y1 / 300 * 480) AS INT) AS py1, x0 + 7 AS ux0, y1 + 9 AS uy1 FROM boxes""")
def box_convert(v):
    b = _b()
    c = B.to_cxcywh(b)
    back = B.from_cxcywh(c)
    px = B.to_pixels([x / 300 for x in b], 480, 640)
    un = B.uncrop(b, F.lit(7), F.lit(9))
    return v.boxes.select("image", "box_id", B.to_xywh(b)[2].alias("w"), c[3].alias("h"), c[0].alias("cx"), c[1].alias("cy"),
                          R(back[0], "bx0"), R(back[3], "by1"), px[0].alias("px0"), px[3].alias("py1"), un[0].alias("ux0"), un[3].alias("uy1"))


@query("region_boxes", """
    WITH c AS (SELECT image, box_id, greatest(least(x0 - 40, 120), 0) AS x0, greatest(least(y0 - 30, 90), 0) AS y0, greatest(least(x1 - 40, 120), 0) AS x1, greatest(least(y1 - 30, 90), 0) AS y1 FROM boxes)
    SELECT image, box_id, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area, 120 - x1 AS mx0, x1 * 2 AS sx1 FROM c WHERE x1 > x0 AND y1 > y0""")
def region_boxes(v):
    d = B.region_boxes(v.boxes, 30.0, 40.0, 90.0, 120.0)
    return d.select("image", "box_id", *B.XYXY, "area", B.mirror(_b(), 120.0)[0].alias("mx0"), B.rescale(_b(), 2.0, 2.0)[2].alias("sx1"))


@query("batch_pad_shape", "SELECT image, max(y1 - y0) AS h, max(x1 - x0) AS w FROM boxes GROUP BY image")
def batch_pad_shape(v):
    return B.batch_pad_shape(v.boxes, "image", F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))


@query("concat_by_name", """
    SELECT image, box_id, x0, NULL::DOUBLE AS y0, score FROM boxes WHERE box_id % 2 = 0 UNION ALL SELECT image, box_id, NULL, y0, NULL FROM boxes WHERE box_id % 2 = 1""")
def concat_by_name(v):
    a = v.boxes.filter("box_id % 2 = 0").select("image", "box_id", "x0", "score")
    return a.unionByName(v.boxes.filter("box_id % 2 = 1").select("image", "box_id", "y0"), allowMissingColumns=True)


@query("topk_keypoints", """
    SELECT image, box_id, score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS k FROM boxes) WHERE k <= 10""")
def topk_keypoints(v):
    return B.topk_keypoints(v.boxes, "image", "score", 10, "box_id").select("image", "box_id", "score")


# greedy suppression as recursion: one box per step in priority order, kept boxes as a list
def _nms_sql(score: str, thr: float) -> str:
    iou = ("(least(x1, q.x1) - greatest(x0, q.x0)) * (least(y1, q.y1) - greatest(y0, q.y0)) / ((x1 - x0) * (y1 - y0) + (q.x1 - q.x0) * (q.y1 - q.y0)"
           " - (least(x1, q.x1) - greatest(x0, q.x0)) * (least(y1, q.y1) - greatest(y0, q.y0)))")
    return f"""
    WITH RECURSIVE b AS (SELECT image, box_id, x0, y0, x1, y1, row_number() OVER (PARTITION BY image ORDER BY {score} DESC, box_id) AS k FROM boxes),
    e AS (SELECT b.image, q.k AS strong, list(b.k) AS weak FROM b JOIN b q ON b.image = q.image AND q.k < b.k
          AND least(b.x1, q.x1) > greatest(b.x0, q.x0) AND least(b.y1, q.y1) > greatest(b.y0, q.y0)
          AND {iou.replace('x0', 'b.x0').replace('y0', 'b.y0').replace('x1', 'b.x1').replace('y1', 'b.y1').replace('q.b.', 'q.')} > {thr} GROUP BY 1, 2),
    n AS (SELECT image, max(k) AS n FROM b GROUP BY image),
    s AS (SELECT image, 0::BIGINT AS k, []::BIGINT[] AS gone FROM n
      UNION ALL SELECT s.image, s.k + 1, CASE WHEN list_contains(s.gone, s.k + 1) OR e.weak IS NULL THEN s.gone ELSE list_distinct(list_concat(s.gone, e.weak)) END
      FROM s JOIN n ON n.image = s.image AND s.k < n.n LEFT JOIN e ON e.image = s.image AND e.strong = s.k + 1),
    f AS (SELECT s.image, s.gone FROM s JOIN n ON s.image = n.image AND s.k = n.n)
    SELECT b.image, b.box_id FROM b JOIN f ON b.image = f.image WHERE NOT list_contains(f.gone, b.k)"""


@query("box_nms", _nms_sql("score", 0.5))
def box_nms(v):
    return B.nms(v.boxes, ["image"], "box_id", "score", 0.5).select("image", "box_id")


@query("crop_nms", _nms_sql("(1 / (1 + box_id % 4))", 0.5))
def crop_nms(v):
    return B.crop_nms(v.boxes, ["image"], "box_id", 1.0 + F.col("box_id") % 4, 0.5).select("image", "box_id")


@query("renms_changed", _nms_sql("(CASE WHEN box_id % 3 = 0 THEN 0 ELSE 1 END)", 0.4))
def renms_changed(v):
    return B.renms_changed(v.boxes, ["image"], "box_id", F.col("box_id") % 3 == 0, 0.4).select("image", "box_id")


# --- masks -----------------------------------------------------------------------------------------

_MASK = "depth_px WHERE depth > 2.5"


def _mask(v):
    return v.depth_px.filter("depth > 2.5").select("frame", "u", "v")


@query("rle_encode", f"""
    WITH p AS (SELECT f.frame, k AS pos, (m.u IS NOT NULL)::INT AS x FROM (SELECT DISTINCT frame FROM depth_px) f CROSS JOIN range(3072) r(k)
               LEFT JOIN (SELECT frame, u, v FROM {_MASK}) m ON m.frame = f.frame AND m.u * 48 + m.v = k),
    c AS (SELECT *, CASE WHEN x <> coalesce(lag(x) OVER (PARTITION BY frame ORDER BY pos), 0) THEN 1 ELSE 0 END AS ch FROM p),
    r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY frame ORDER BY pos) AS BIGINT) AS run FROM c),
    g AS (SELECT frame, run, count(*) AS length FROM r GROUP BY 1, 2)
    SELECT * FROM g UNION ALL SELECT frame, 0, 0 FROM g GROUP BY frame HAVING min(run) = 1""")
def rle_encode(v):
    return M.rle_encode(_mask(v), ["frame"], 48, 64, v.depth_px.select("frame"))


@query("rle_decode", f"SELECT frame, u, v FROM {_MASK}")
def rle_decode(v):
    return M.rle_decode(M.rle_encode(_mask(v), ["frame"], 48, 64), ["frame"], 48)


@query("mask_area_box", """
    WITH m AS (SELECT frame, obj_id FROM objects), g AS (SELECT frame, label, count(*) AS area, min(u) AS x0, min(v) AS y0, max(u) AS x1, max(v) AS y1 FROM depth_px GROUP BY 1, 2)
    SELECT m.frame, m.obj_id AS label, coalesce(area, 0) AS area, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1
    FROM m LEFT JOIN g ON m.frame = g.frame AND m.obj_id = g.label""")
def mask_area_box(v):
    m = v.objects.select("frame", F.col("obj_id").alias("label"))
    return M.mask_area_box(v.depth_px, ["frame", "label"], m)


@query("rle_area", """
    SELECT frame, count(*) FILTER (depth > 2.5) AS area FROM depth_px GROUP BY frame""")
def rle_area(v):
    # run lengths of a frame as one array: at most as many runs as pixels of an image
    r = M.rle_encode(_mask(v), ["frame"], 48, 64, v.depth_px.select("frame")).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("run", "length"))).alias("r"))
    return r.select("frame", M.rle_area(F.col("r.length")).alias("area"))


@query("stability_score", """
    SELECT frame, label, round(count(*) FILTER (depth > 3.5) / nullif(count(*) FILTER (depth > 1.5), 0)::DOUBLE, 6) AS stability FROM depth_px GROUP BY 1, 2""")
def stability_score(v):
    return M.stability_score(v.depth_px, ["frame", "label"], "depth", 2.5, 1.0).select("frame", "label", R("stability"))


@query("mask_iou", """
    SELECT frame, round(count(*) FILTER (depth > 2.5 AND target > 3.5) / greatest(count(*) FILTER (depth > 2.5 OR target > 3.5), 1)::DOUBLE, 6) AS iou
    FROM depth_px GROUP BY frame""")
def mask_iou(v):
    p = v.depth_px
    return M.mask_iou(p.filter("depth > 2.5"), p.filter("target > 3.5"), ["frame"], p).select("frame", R("iou"))


@query("confusion_counts", """
    SELECT count(*) FILTER (pred = 1 AND gt = 1) AS tp, count(*) FILTER (pred = 1 AND gt <> 1) AS fp, count(*) FILTER (pred <> 1 AND gt <> 1) AS tn,
           count(*) FILTER (pred <> 1 AND gt = 1) AS fn FROM predictions""")
def confusion_counts(v):
    return M.confusion(v.predictions, "pred", "gt")


@query("topk_accuracy", """
    WITH s AS (SELECT vec_id, label, unnest(embedding[1:10]) AS x, unnest(range(10)) AS c FROM embedding_set),
    r AS (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) AS k FROM s)
    SELECT round(avg(CASE WHEN k <= 1 THEN 100.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN k <= 3 THEN 100.0 ELSE 0 END), 6) AS top3,
           round(avg(CASE WHEN k <= 5 THEN 100.0 ELSE 0 END), 6) AS top5 FROM r WHERE c = label""")
def topk_accuracy(v):
    d = v.embedding_set.select(F.slice("embedding", 1, 10).alias("s"), "label")
    return M.topk_accuracy(d, "s", "label", [1, 3, 5]).select(R("top1"), R("top3"), R("top5"))


@query("onehot_accuracy", "SELECT round(avg((pred = gt)::INT) * 100, 6) AS accuracy FROM predictions")
def onehot_accuracy(v):
    d = v.predictions.select(M.one_hot(F.col("pred"), 1).alias("p"), M.one_hot(F.col("gt"), 1).alias("g"))
    return M.onehot_accuracy(d, "p", "g").select(R("accuracy"))


@query("best_metric", """
    WITH d AS (SELECT sample_id, wall_s, rank % 2 = 0 AS ema FROM sample_timing), a AS (SELECT 'all' AS variant, * FROM d UNION ALL SELECT CASE WHEN ema THEN 'ema' ELSE 'regular' END, * FROM d)
    SELECT variant, max(wall_s) AS best_res, arg_max(sample_id, {'x': wall_s, 'e': -sample_id}) AS best_ep FROM a GROUP BY variant""")
def best_metric(v):
    return M.best_metric(v.sample_timing, "wall_s", "sample_id", 0.0, "large", F.col("rank") % 2 == 0)


@query("object_ids", """
    SELECT frame, obj_id, count(*) OVER (PARTITION BY frame) AS n, max(obj_id) OVER (PARTITION BY frame) AS max_id FROM objects WHERE obj_id <> 0""")
def object_ids(v):
    return M.object_ids(v.objects, "frame", "obj_id")


_TRACK = "SELECT frame, u, v, CASE WHEN (u + v) % 16 = 0 OR label = 4 THEN label ELSE 0 END AS track, label AS seg FROM depth_px"


@query("new_objects", f"""
    WITH g AS (SELECT frame, seg, count(*) AS area, count(*) FILTER (track = 0) AS new_area FROM ({_TRACK}) WHERE seg <> 0 GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY seg) + 9 AS new_id FROM g WHERE new_area > 0 AND new_area / area::DOUBLE >= 0.8 AND new_area >= 40)
    SELECT frame, seg, area, new_area, new_id FROM o WHERE new_id <= 13""")
def new_objects(v):
    t = F.when(((F.col("u") + F.col("v")) % 16 == 0) | (F.col("label") == 4), F.col("label")).otherwise(0)
    d = v.depth_px.select("frame", "u", "v", t.alias("track"), F.col("label").alias("seg"))
    return M.new_objects(d, "frame", "track", "seg", 10, 0.8, 40, 13)


_DICT = "SELECT obj_id, arg_max(phrase, {'f': frame, 'p': phrase}) AS phrase FROM objects GROUP BY obj_id"


@query("frame_phrases", f"SELECT DISTINCT p.frame, CAST(p.label AS INT) AS obj_id, d.phrase FROM depth_px p JOIN ({_DICT}) d ON p.label = d.obj_id")
def frame_phrases(v):
    from reelframe.sources.shards import combined_phrases

    ids = v.depth_px.select("frame", F.col("label").cast("int").alias("obj_id"))
    return M.frame_phrases(ids, combined_phrases(v.objects), "frame", "obj_id").select("frame", "obj_id", "phrase")


@query("phrase_to_class", """
    SELECT frame, obj_id, phrase, CASE """ + " ".join(f"WHEN contains(phrase, '{c}') THEN {i}" for i, c in enumerate(CLASSES)) + " END AS class FROM objects")
def phrase_to_class(v):
    return v.objects.withColumn("class", M.phrase_class(F.col("phrase"), CLASSES))


@query("best_phrase", """
    WITH s AS (SELECT frame, obj_id, round(sum((length(t) * 7 + frame * 3 + ascii(t)) % 11 / 10.0::DOUBLE), 9) AS score, any_value(phrase) AS phrase
      FROM (SELECT frame, obj_id, phrase, unnest(string_split(phrase, ' ')) AS t FROM objects) GROUP BY 1, 2)
    SELECT frame, arg_max(phrase, {'s': score, 'o': -obj_id}) AS phrase, max(score) AS score FROM s GROUP BY frame""")
def best_phrase(v):
    w = F.concat(F.split("phrase", " "), F.array(F.lit(".")))
    t = v.objects.select("frame", "obj_id", F.posexplode(w).alias("p", "token"))
    t = t.select("frame", (F.col("obj_id").cast("long") * 16 + F.col("p")).alias("ord"), "token",
                 ((F.length("token") * 7 + F.col("frame") * 3 + F.ascii("token")) % 11 / 10.0).alias("score"))
    return M.best_phrase(t, ["frame"], "ord", "token", "score")


@query("label_color", """
    SELECT frame, obj_id, CAST(((obj_id & 1) << 7) | ((obj_id & 8) << 3) | ((obj_id & 64) >> 1) AS INT) AS r,
           CAST(((obj_id & 2) << 6) | ((obj_id & 16) << 2) | ((obj_id & 128) >> 2) AS INT) AS g,
           CAST(((obj_id & 4) << 5) | ((obj_id & 32) << 1) AS INT) AS b FROM objects""")
def label_color(v):
    r, g, b = M.label_color(F.col("obj_id"))
    return v.objects.select("frame", "obj_id", r.alias("r"), g.alias("g"), b.alias("b"))


@query("one_hot_relabel", """
    SELECT frame, obj_id, dense_rank() OVER (PARTITION BY frame ORDER BY obj_id) AS compact, CAST(k AS INT) AS slot, CASE WHEN k = obj_id % 4 THEN 1.0::DOUBLE ELSE 0.0 END AS x
    FROM objects, range(4) r(k)""")
def one_hot_relabel(v):
    d = M.compact_ids(v.objects.select("frame", "obj_id"), ["frame"], "obj_id")
    return d.select("frame", "obj_id", "compact", F.posexplode(M.one_hot(F.col("obj_id") % 4, 3)).alias("slot", "x"))


@query("attribute_union", """
    SELECT frame, string_agg(DISTINCT split_part(phrase, ' ', 1), ',' ORDER BY split_part(phrase, ' ', 1)) AS attributes FROM objects GROUP BY frame""")
def attribute_union(v):
    d = v.objects.withColumn("a", F.split("phrase", " ")[0])
    return d.groupBy("frame").agg(F.array_join(F.array_sort(F.collect_set("a")), ",").alias("attributes"))


@query("phrase_map_ops", f"""
    SELECT obj_id + 100 AS obj_id, CASE WHEN obj_id % 5 = 0 THEN 'new ' || phrase ELSE phrase END AS phrase FROM ({_DICT}) WHERE obj_id % 2 = 0""")
def phrase_map_ops(v):
    from reelframe.sources.shards import combined_phrases

    # the dictionary in shards of one map per ten ids: merge (later wins), filter keys, rename keys
    d = combined_phrases(v.objects).groupBy(F.floor(F.col("obj_id") / 10).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("obj_id", "phrase"))).alias("m"))
    later = F.transform_values(F.map_filter("m", lambda k, x: k % 5 == 0), lambda k, x: F.concat(F.lit("new "), x))
    m = TX.map_merge(F.col("m"), later)
    m = F.transform_keys(F.map_filter(m, lambda k, x: k % 2 == 0), lambda k, x: k + 100)
    return d.select(F.explode(m).alias("obj_id", "phrase"))


# --- text ------------------------------------------------------------------------------------------

_STEM = "regexp_replace(list_last(string_split(regexp_replace(s, '[?#].*$', ''), '/')), '\\.[^.]*$', '')"


@query("stem_parts", f"""
    SELECT id, {_STEM} AS stem, regexp_replace(regexp_replace(s, '[?#].*$', ''), '/[^/]*$', '') AS parent, '/out/pose/' || {_STEM} || '.npz' AS pose_path FROM strings""")
def stem_parts(v):
    s = F.col("s")
    return v.strings.select("id", TX.stem(s).alias("stem"), TX.parent(s).alias("parent"),
                            TX.artifact_path(F.lit("/out"), "pose", TX.stem(s), "npz").alias("pose_path"))


@query("frame_file_name", "SELECT name, frame_idx, lpad(CAST(frame_idx AS VARCHAR), 5, '0') || '.png' AS file, frame_idx AS back FROM frames")
def frame_file_name(v):
    d = v.frames.select("name", "frame_idx", TX.frame_file_name(F.col("frame_idx")).alias("file"))
    return d.withColumn("back", TX.frame_index(F.col("file")))


@query("caption_normalize", """
    SELECT frame, obj_id, CASE WHEN obj_id % 2 = 0 THEN lower(trim('  ' || upper(phrase) || '. ')) ELSE lower(phrase) || '.' END AS caption,
           array_to_string(string_split(phrase, ' '), '.') || '.' AS joined FROM objects""")
def caption_normalize(v):
    raw = F.when(F.col("obj_id") % 2 == 0, F.concat(F.lit("  "), F.upper("phrase"), F.lit(". "))).otherwise(F.col("phrase"))
    return v.objects.select("frame", "obj_id", TX.normalize_caption(raw).alias("caption"), TX.join_phrases(F.split("phrase", " ")).alias("joined"))


@query("parse_resolution", """
    SELECT id, CASE WHEN id % 5 <> 0 THEN CAST(320 + id % 640 AS INT) END AS w, CASE WHEN id % 5 <> 0 THEN CAST(240 + id % 480 AS INT) END AS h FROM strings""")
def parse_resolution(v):
    t = F.when(F.col("id") % 5 == 0, "source").otherwise(F.concat_ws("x", (320 + F.col("id") % 640).cast("string"), (240 + F.col("id") % 480).cast("string")))
    return v.strings.select("id", TX.parse_resolution(t).alias("r")).select("id", "r.w", "r.h")




@query("parse_model_name", """
    SELECT id, CASE id % 3 WHEN 0 THEN 'prefix' WHEN 1 THEN 'flat' ELSE 'net' || (id % 7) END AS name, CASE WHEN id % 3 = 2 THEN 's' ELSE 'default' END AS sub,
           CASE id % 3 WHEN 0 THEN 'depth' WHEN 1 THEN 'metric' END AS metric, id % 3 = 0 AS video FROM strings""")
def parse_model_name(v):
    i = F.col("id")
    t = F.when(i % 3 == 0, "prefix_depth_video").when(i % 3 == 1, "flat_metric").otherwise(F.concat(F.lit("net"), (i % 7).cast("string"), F.lit("-s")))
    return v.strings.select("id", TX.parse_model_name(t).alias("p")).select("id", "p.*")


@query("classify_pattern", """
    SELECT id, ['count', 'downscale', 'cubic', 'distance', 'lidar', NULL][id % 6 + 1] AS kind, CASE WHEN id % 6 < 5 THEN CAST(id AS INT) END AS a, CASE WHEN id % 6 = 3 THEN CAST(id + 5 AS INT) END AS b FROM strings""")
def classify_pattern(v):
    n = F.col("id").cast("string")
    t = F.element_at(F.array(n, F.concat(F.lit("downscale_"), n), F.concat(F.lit("cubic_"), n),
                             F.concat(F.lit("distance_"), n, F.lit("_"), (F.col("id") + 5).cast("string")),
                             F.concat(F.lit("LiDAR_"), n), F.lit("sift")), (F.col("id") % 6 + 1).cast("int"))
    return v.strings.select("id", TX.classify_pattern(t).alias("p")).select("id", "p.*")
