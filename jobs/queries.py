"""The jobs as named queries: each runs twice into one new folder of the shared place and returns the output read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import link_flows, update_headways
from routelab.staging import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_update_headways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headways of the events by date, route and stop: the second run finds nothing new."""
    folder = _folder(spark, "job1")
    for _ in range(2):  # a stream takes folders; as a pattern the path may be that of a file as well
        update_headways.run(spark, f"{sf_dir}/events.parque[t]", f"{folder}/out", f"{folder}/checkpoint")
    return update_headways.table(spark, f"{folder}/out")


def job2_link_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between neighbouring words of all documents by language."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        link_flows.run(spark, f"{sf_dir}/documents.parquet", folder)
    return link_flows.table(spark, folder)


QUERIES = {"job1_update_headways": job1_update_headways, "job2_link_flows": job2_link_flows}

ORACLE_SQL = {
    "job1_update_headways": """
WITH rows AS (SELECT event_id, CAST(ts AS DATE) AS service_date, 'R' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS route_id, event_type AS stop_id,
                (epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP))) / 1e6 AS second FROM events),
calls AS (SELECT event_id, service_date, MIN(ROW(second, route_id, stop_id)) AS c FROM rows
  WHERE event_id IS NOT NULL AND service_date IS NOT NULL AND route_id IS NOT NULL AND stop_id IS NOT NULL GROUP BY event_id, service_date),
gaps AS (SELECT service_date, c[2] AS route_id, c[3] AS stop_id, c[1] - LAG(c[1]) OVER (PARTITION BY service_date, c[2], c[3] ORDER BY c[1]) AS gap FROM calls)
SELECT service_date, route_id, stop_id, COUNT(*) AS n_calls, MEDIAN(gap) FILTER (gap > 0 AND gap < 3600) / 60 AS headway_min FROM gaps GROUP BY ALL""",
    "job2_link_flows": r"""
WITH cut AS (SELECT COALESCE(NULLIF(lang, ''), 'none') AS route, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
step AS (SELECT route, w, UNNEST(range(1, len(w))) AS k FROM cut WHERE len(w) > 1),
flows AS (SELECT route, w[k] AS from_node, w[k + 1] AS to_node, COUNT(*) AS flow FROM step GROUP BY ALL)
SELECT route, from_node, to_node, flow, flow / SUM(flow) OVER (PARTITION BY route, from_node) AS share FROM flows""",
}
