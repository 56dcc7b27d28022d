"""Recognition-job status events (derived from ``events``; four events per job)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fixtures import table

JOBS_SQL = """
SELECT CAST((event_id - event_id % 4) / 4 AS bigint) AS job_id, event_id, ts,
  CASE WHEN event_id % 4 = 0 THEN 'IN_QUEUE'
       WHEN event_type = 'click' THEN 'IN_PROGRESS' WHEN event_type = 'purchase' THEN 'COMPLETED'
       WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'FAILED' ELSE 'TIMED_OUT' END
       WHEN event_type = 'view' THEN 'IN_PROGRESS'
       WHEN k % 5 = 0 THEN 'CANCELLED' ELSE NULL END AS status,
  CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN '{{"error": "no staves"}}'
       ELSE '{{"notes": 1}}' END AS output,
  CAST(k * 371 % 5000 AS bigint) AS delay_ms, CAST(k * k + event_id % 7 AS bigint) AS exec_ms
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM {events}) e
"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, event_id, ts, status, output, delay_ms, exec_ms)``."""
    return spark.sql(JOBS_SQL, events=table(spark, sf_dir, "events"))
