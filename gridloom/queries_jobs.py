"""The jobs as queries: each runs twice into one new folder, and the whole output after the second run is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import scratch
from gridloom.queries import query
from jobs import sensor_days, text_ledger


@query(
    """
WITH m AS (SELECT ts::DATE AS day, user_id AS rig, epoch_us(ts) AS stamp, event_id AS id, min((event_type, value)) AS rest
           FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
g AS (SELECT *, rest[1] AS topic, stamp - lag(stamp) OVER (PARTITION BY day, rig ORDER BY stamp, id) AS gap FROM m),
c AS (SELECT day, rig, count(*) AS n_messages, count(DISTINCT topic) AS n_topics, min(stamp) AS first_us, max(stamp) AS last_us,
             max(gap) AS longest_us, count(*) FILTER (WHERE gap > 43200000000) AS n_silent FROM g GROUP BY ALL),
f AS (SELECT day, rig, stamp, id FROM g WHERE topic = 'view'),
s AS (SELECT rig, stamp FROM g WHERE topic = 'click'),
n AS (SELECT f.day, f.rig, f.stamp, f.id, min(abs(s.stamp - f.stamp)) AS off FROM f LEFT JOIN s ON s.rig = f.rig AND abs(s.stamp - f.stamp) <= 21600000000 GROUP BY ALL),
t AS (SELECT day, rig, count(*) AS n_frames, count(off) AS n_matched, sum(off)::BIGINT AS offset_us FROM n GROUP BY ALL)
SELECT day::VARCHAR AS day, rig, n_messages, n_topics, first_us, last_us, longest_us, n_silent, coalesce(n_frames, 0) AS n_frames, coalesce(n_matched, 0) AS n_matched, offset_us
FROM c LEFT JOIN t USING (day, rig)
"""
)
def job1_sensor_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "job1-sensor-days", keep=True)
    for _ in range(2):
        sensor_days.run(spark, f"{sf_dir}/events.parquet", f"{at}/output", f"{at}/checkpoint")
    return spark.read.schema(sensor_days.REPORT).parquet(f"{at}/output/days").withColumn("day", F.col("day").cast("string"))


@query(
    """
WITH r AS (
  SELECT 'documents' AS kind, doc_id::VARCHAR AS name, source AS grp, text AS text FROM documents UNION ALL
  SELECT 'pages', url, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), html FROM pages UNION ALL
  SELECT 'conversations', concat_ws('/', conv_id::VARCHAR, turn::VARCHAR), role, text FROM conversations),
a AS (SELECT kind, coalesce(name, '') AS name, grp, strlen(text) AS n_bytes, sha256(text) AS sha256, count(*) AS n_rows FROM r GROUP BY ALL),
f AS (SELECT kind, sha256, min(name) AS first FROM a WHERE sha256 IS NOT NULL GROUP BY ALL)
SELECT kind, (('0x' || substr(sha256(name), 1, 8))::BIGINT % 16)::INTEGER AS shelf, name, grp, n_bytes, a.sha256, n_rows, CASE WHEN first < name THEN first END AS copy_of
FROM a LEFT JOIN f USING (kind, sha256)
"""
)
def job2_text_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "job2-text-ledger", keep=True)
    for _ in range(2):
        text_ledger.run(spark, sf_dir, f"{at}/output")
    return text_ledger.ledger(spark, f"{at}/output").drop("signature")
