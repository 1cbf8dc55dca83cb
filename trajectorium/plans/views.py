"""Tracking views over the driver's tables, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DET_SQL = """det AS (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, event_id) - 1 AS BIGINT) det_index, event_id, tid, score, cx, cy, w, h, heading
FROM (SELECT event_id, user_id tid, CAST(floor((epoch(ts) - 1704067200)/14400) AS BIGINT) frame,
CAST((event_id*53) % 1000 AS DOUBLE)/1E3 score, value cx, CAST(json_extract_string(props,'$.k') AS INT)*5E0 cy,
CAST(20 + event_id % 30 AS DOUBLE) w, CAST(8 + event_id % 10 AS DOUBLE) h, CAST((event_id*37) % 360 AS DOUBLE) heading FROM events) z)"""
OBS_SQL = DET_SQL + """, obs AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY tid, frame ORDER BY event_id) rn FROM det d) z WHERE rn = 1)"""
STRUNG_SQL = OBS_SQL + ", strung AS (SELECT event_id, tid // 4 * 100000 + frame AS frame, tid % 4 AS tid, score, cx, cy, w, h, heading FROM obs)"
FRAG_SQL = "frag AS (SELECT vec_id frag_id, CAST(label AS BIGINT) obj_id, vec_id*10 start_frame, vec_id*10 + 3 + vec_id % 5 end_frame, embedding centroid FROM embeddings)"


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a detection; a frame is four hours."""
    e = F.col("event_id")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.floor(micros / 1e6 / 14400).cast("long").alias("frame"), e, F.col("user_id").alias("tid"), ((e * 53) % 1000 / 1000.0).alias("score"), F.col("value").alias("cx"),
        (F.get_json_object("props", "$.k").cast("int") * 5.0).alias("cy"), (20 + e % 30).cast("double").alias("w"), (8 + e % 10).cast("double").alias("h"), ((e * 37) % 360).cast("double").alias("heading"),
    )


def indexed(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("frame").orderBy(F.desc("score"), "event_id")
    return d.withColumn("det_index", (F.row_number().over(w) - 1).cast("long"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one detection per track and frame: the first."""
    d = det(spark, sf_dir)
    rest = [c for c in d.columns if c not in ("tid", "frame", "event_id")]
    first = d.groupBy("tid", "frame").agg(F.min_by(F.struct("event_id", *rest), "event_id").alias("_x"))
    return first.select("tid", "frame", "_x.*")


def strung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks, four to a video, their ids 0 to 3 and the videos one after the other: what a wide table holds."""
    return obs(spark, sf_dir).withColumns({"frame": F.expr("tid div 4 * 100000 + frame"), "tid": F.col("tid") % 4})


def frag(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(v.alias("frag_id"), F.col("label").cast("long").alias("obj_id"), (v * 10).alias("start_frame"), (v * 10 + 3 + v % 5).alias("end_frame"), F.col("embedding").alias("centroid"))
