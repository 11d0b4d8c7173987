"""Streaming queries: drained over the files there are, so that a batch query gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import streams as S

_START = "epoch(time_bucket(INTERVAL '{w}', ts, TIMESTAMP '1970-01-01'))::BIGINT"


def _bounds(df):
    return df.select(F.unix_timestamp("window.start").alias("start_s"), F.unix_timestamp("window.end").alias("end_s"), *[c for c in df.columns if c != "window"])


@query("stream_tumbling", f"SELECT {_START.format(w='30 minutes')} AS start_s, {_START.format(w='30 minutes')} + 1800 AS end_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return _bounds(S.drain(S.tumbling(S.read_events(spark, sf_dir)), "tessera_tumbling", "complete"))


@query("stream_sliding", "WITH w AS (SELECT unnest(range(6)) AS i) SELECT (epoch_us(ts) // 1800000000 - i) * 1800 AS start_s, (epoch_us(ts) // 1800000000 - i) * 1800 + 10800 AS end_s, event_type, count(*) AS n FROM events, w GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return _bounds(S.drain(S.sliding(S.read_events(spark, sf_dir)), "tessera_sliding", "complete"))


@query("stream_session", """WITH e AS (SELECT user_id, ts, ts > lag(ts) OVER w + INTERVAL '2 hours' OR lag(ts) OVER w IS NULL AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT floor(epoch(min(ts)))::BIGINT AS start_s, floor(epoch(max(ts)))::BIGINT + 7200 AS end_s, user_id, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_session(spark, sf_dir):
    return _bounds(S.drain(S.sessions(S.read_events(spark, sf_dir)), "tessera_sessions", "complete"))


@query("stream_state", """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events), g AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 21600 AS gap FROM e)
SELECT user_id, count(*) AS n, max(s) AS last_s, count(*) FILTER (gap) AS gaps FROM g GROUP BY user_id""")
def stream_state(spark, sf_dir):
    return S.drain(S.streaks(S.read_events(spark, sf_dir)), "tessera_state", "update")
