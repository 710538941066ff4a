"""Views that map the given tables onto the data model (frames, clips, boxes, poses, timings).

Each view is one SQL text that both engines run; K and E(n) are the only dialect differences.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.operators.ordered import rank0

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    # per-frame metric scores with the worker that produced them; worker 0 is oversized
    "frame_scores": """
        SELECT l_orderkey AS name, CAST(l_linenumber AS INT) - 1 AS frame_idx,
               CASE l_returnflag WHEN 'A' THEN 'clip' WHEN 'N' THEN 'lpips' ELSE 'ssim' END AS metric,
               CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 8 END AS rank,
               min(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    # one row per frame of a clip
    "frames": """
        SELECT l_orderkey AS name, CAST(l_linenumber AS INT) - 1 AS frame_idx, min(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2""",
    "sample_timing": """
        SELECT event_id AS sample_id, event_type AS run, user_id % 8 AS rank, ts, value AS wall_s,
               value * (1 + K) AS cpu_s,
               CASE WHEN K % 7 = 0 THEN NULL ELSE value * K / 100.0 END AS gpu_busy_s
        FROM events""",
    "load_trace": "SELECT ts, value AS l1, value / 2 AS l5, value / 4 AS l15 FROM events",
    "embedding_set": """
        SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'raw' ELSE 'gen' END AS set_name, label, embedding
        FROM embeddings""",
    "poses": """
        SELECT clip, frame_idx, frame_idx % 5 = 0 AS is_kf, tx, ty, tz,
               qx / n AS qx, qy / n AS qy, qz / n AS qz, qw / n AS qw
        FROM (SELECT *, sqrt(qx*qx + qy*qy + qz*qz + qw*qw) AS n
              FROM (SELECT label AS clip,
                           CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INT) - 1 AS frame_idx,
                           CAST(E(1) AS DOUBLE) AS tx, CAST(E(2) AS DOUBLE) AS ty, CAST(E(3) AS DOUBLE) AS tz,
                           CAST(E(4) AS DOUBLE) AS qx, CAST(E(5) AS DOUBLE) AS qy, CAST(E(6) AS DOUBLE) AS qz,
                           CAST(E(7) AS DOUBLE) AS qw
                    FROM embeddings) a) b""",
    "boxes": """
        SELECT p_partkey % 50 AS image, p_partkey AS box_id,
               CAST((p_partkey * 37) % 200 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 150 AS DOUBLE) AS y0,
               CAST((p_partkey * 37) % 200 + 10 + p_size AS DOUBLE) AS x1,
               CAST((p_partkey * 53) % 150 + 10 + p_size % 20 AS DOUBLE) AS y1, p_retailprice AS score
        FROM part""",
    "points": """
        SELECT c_custkey AS pid, c_acctbal / 100 AS x, CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 10 AS y,
               1 + CAST(c_custkey % 50 AS DOUBLE) / 10 AS z FROM customer""",
    "query_points": """
        SELECT s_suppkey AS qid, s_acctbal / 100 AS x, CAST((s_suppkey * 104729) % 1000 AS DOUBLE) / 10 AS y,
               1 + CAST(s_suppkey % 50 AS DOUBLE) / 10 AS z FROM supplier""",
    "depth_px": """
        SELECT l_suppkey % 20 AS frame, l_partkey % 64 AS u, l_orderkey % 48 AS v,
               avg(l_quantity) / 10 AS depth, avg(l_extendedprice) / 10000 AS target,
               max(l_linenumber) <> 7 AS valid, max(l_linenumber) AS label
        FROM lineitem GROUP BY 1, 2, 3""",
    "raw_clips": """
        SELECT o_orderkey AS name, o_orderstatus AS status,
               CASE WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE CAST(o_orderkey % 120 AS STRING) END AS num_frames
        FROM orders""",
    "gen_clips": "SELECT l_orderkey AS name, count(*) AS frames FROM lineitem GROUP BY 1",
    "observations": """
        SELECT event_type AS view_id, CAST(day(ts) AS INT) AS frame, user_id AS kp,
               avg(value) AS u, avg(value) / 2 AS v FROM events GROUP BY 1, 2, 3""",
    "edges": """
        SELECT l_partkey % 100 AS i, l_suppkey % 100 AS j, avg(l_quantity) AS dist,
               max(l_linenumber) AS age, max(l_linestatus) = 'O' AS active
        FROM lineitem GROUP BY 1, 2""",
    "objects": """
        SELECT p_partkey % 100 AS frame, p_size AS obj_id, min(p_name) AS phrase FROM part GROUP BY 1, 2""",
    "coo": "SELECT l_partkey % 200 AS i, l_suppkey % 50 AS j, l_quantity AS a FROM lineitem",
    "logs": """
        SELECT event_id AS line_no,
               CASE WHEN event_id % 97 = 0 THEN concat('[rank ', CAST(user_id % 8 AS STRING), '] FAILED ', event_type, ': no frame: ', CAST(event_id AS STRING))
                    ELSE concat('[rank ', CAST(user_id % 8 AS STRING), '] ', CAST(K AS STRING), '/99 ', event_type,
                      ' wall=', CAST(CAST(value AS DECIMAL(10,2)) AS STRING), 's cpu=', CAST(user_id % 50 AS STRING), '.5s ',
                      CASE event_id % 3 WHEN 0 THEN 'cache=0.25s ' WHEN 1 THEN concat('gpu_busy=', CAST(event_id % 7 AS STRING), '.25s ') ELSE 'gpu_busy=Nones ' END,
                      'gpu_util=', CASE event_id % 5 WHEN 0 THEN 'None' ELSE CAST(event_id % 101 AS STRING) END, '% cores_busy=', CAST(user_id % 9 AS STRING), '.0') END AS line
        FROM events""",
    "runs": """
        SELECT event_type AS arm, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS g,
               event_id % 3 AS rep, sum(value) / 100 AS wall_s, max(value) / 10 AS straggler_s,
               count(*) AS n_videos, avg(value * (1 + K)) AS cpu_s_per_video,
               avg(value * K / 100.0) AS gpu_s_per_video
        FROM events GROUP BY 1, 2, 3""",
    # frames as arrays; vec_id 2k and 2k+1 are the two sides of a pair, 8x8, row-major
    "frame_px": """
        SELECT vec_id, CAST(floor(vec_id / 2) AS BIGINT) AS pair_id,
               CASE WHEN vec_id % 2 = 0 THEN 'raw' ELSE 'gen' END AS side, 8 AS h, 8 AS w, embedding AS px_raw
        FROM embeddings""",
    "predictions": "SELECT doc_id AS item, quality AS pred, toxic AS gt FROM labels",
    "strings": "SELECT page_id AS id, url AS s FROM pages",
}

# fixed values: class list and sky phrase used by the phrase operators
CLASSES = ["ring", "bolt", "gear", "plate", "anvil"]
SKY_PHRASE = "blue bolt"
LOAD_QUOTA = 400.0


def view_sql(name: str, dialect: str) -> str:
    """SQL text of a view for 'spark' or 'duckdb'."""
    spark = dialect == "spark"
    get = "get_json_object(props,'$.k')" if spark else "json_extract_string(props,'$.k')"
    sql = re.sub(r"\bK\b", f"CAST({get} AS INT)", VIEWS[name])
    return re.sub(r"\bE\((\d+)\)", r"element_at(embedding,\1)" if spark else r"embedding[\1]", sql)


class Views:
    """Views of one table folder as attributes: `Views(spark, path).frame_scores`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(text)

    def _poses(self) -> DataFrame:
        e = lambda n: F.element_at("embedding", n).cast("double")
        d = self.table("embeddings").select(
            F.col("label").alias("clip"), "vec_id",
            *[e(n + 1).alias(c) for n, c in enumerate(["tx", "ty", "tz", "qx", "qy", "qz", "qw"])])
        d = rank0(d, ["clip"], "vec_id", "frame_idx").withColumn("frame_idx", F.col("frame_idx").cast("int"))
        q = ["qx", "qy", "qz", "qw"]
        n = F.sqrt(sum((F.col(c) * F.col(c) for c in q[1:]), F.col("qx") * F.col("qx")))
        d = d.withColumn("n", n)
        return d.select("clip", "frame_idx", (F.col("frame_idx") % 5 == 0).alias("is_kf"), "tx", "ty", "tz",
                        *[(F.col(c) / F.col("n")).alias(c) for c in q])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self._poses() if name == "poses" else self.sql(view_sql(name, "spark"))
