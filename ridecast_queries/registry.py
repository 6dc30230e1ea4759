"""Query registry and the common table expressions of the SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The views the operators run on, in SQL; each may use the ones above it.
VIEWS = {
    "raw": """
        SELECT event_id AS seq_id, event_id + 1000000 AS hubway_id,
               CASE WHEN event_id % 13 = 0 THEN 'open' ELSE 'closed' END AS status,
               CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -60
                    ELSE CAST(floor(value * 4) AS INTEGER) * 15 END AS duration,
               ts AS start_date, CAST(nullif(user_id, 3) AS INTEGER) AS strt_statn,
               ts + INTERVAL 10 MINUTE AS end_date,
               CAST(nullif(event_id % 40, 0) AS INTEGER) AS end_statn,
               'B' || (event_id % 500) AS bike_nr,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'Registered' ELSE 'Casual' END AS subsc_type,
               CASE WHEN event_type IN ('purchase', 'signup') THEN '''0' || (user_id % 2000 + 1000) END AS zip_code,
               CASE WHEN event_type IN ('purchase', 'signup') OR event_id % 17 = 0
                    THEN CAST(1950 + user_id % 50 AS INTEGER) END AS birth_date,
               CASE WHEN event_type IN ('purchase', 'signup')
                    THEN CASE WHEN user_id % 2 = 0 THEN 'Female' ELSE 'Male' END END AS gender
        FROM events""",
    "typed": """
        SELECT * EXCLUDE (start_date), duration / CAST(60 AS DOUBLE) AS duration_min,
               date_trunc('minute', start_date) AS start_date,
               CAST(start_date AS DATE) AS start_date_trunc,
               CASE WHEN subsc_type = 'Registered' THEN 1 ELSE 0 END AS is_registered
        FROM raw WHERE strt_statn IS NOT NULL""",
    "wx": """
        SELECT date_trunc('hour', ts) AS "DATE",
               CASE WHEN count(*) = 1 THEN CAST(0 AS DOUBLE)
                    ELSE CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) / 100 END AS "HPCP",
               CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS has_trace
        FROM events
        WHERE event_type = 'purchase'
        GROUP BY 1""",
    "days90": """
        SELECT strt_statn, start_date_trunc, sum(duration_min) AS tot, count(duration_min) AS n
        FROM typed WHERE duration_min <= 90 GROUP BY 1, 2""",
    "avg7": """
        SELECT strt_statn, start_date_trunc,
               CASE WHEN count(*) OVER w = 7
                    THEN sum(tot) OVER w / nullif(CAST(sum(n) OVER w AS DOUBLE), 0) END AS avg_duration_prev_7days
        FROM days90
        WINDOW w AS (PARTITION BY strt_statn ORDER BY start_date_trunc ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
    "prep": """
        SELECT t.*, a.avg_duration_prev_7days, CAST(isodow(t.start_date) - 1 AS INTEGER) AS dow,
               sin(2 * pi() * (isodow(t.start_date) - 1) / 7) AS dow_sin,
               cos(2 * pi() * (isodow(t.start_date) - 1) / 7) AS dow_cos,
               date_trunc('hour', t.start_date - INTERVAL 1 MINUTE) AS wkey
        FROM typed t LEFT JOIN avg7 a
          ON t.strt_statn = a.strt_statn AND t.start_date_trunc = a.start_date_trunc""",
    "training": """
        SELECT p.seq_id, p.start_date, p.strt_statn, p.end_statn, p.duration_min, p.is_registered,
               p.avg_duration_prev_7days, p.dow_sin, p.dow_cos, coalesce(w."HPCP", 0) AS "HPCP",
               coalesce(w.has_trace, 0) AS has_trace,
               CASE WHEN p.wkey < b.lo OR p.wkey > b.hi THEN 0 ELSE 1 END AS has_precip_data,
               p.start_date_trunc, p.dow
        FROM prep p LEFT JOIN wx w ON p.wkey = w."DATE"
        CROSS JOIN (SELECT min("DATE") AS lo, max("DATE") AS hi FROM wx) b""",
    "covered": "SELECT * FROM training WHERE has_precip_data = 1",
    "trimmed": """
        SELECT c.* FROM covered c
        CROSS JOIN (SELECT quantile_cont(duration_min, 0.95) AS bound FROM covered) q
        WHERE c.duration_min > 0 AND c.duration_min <= q.bound""",
    "cleaned": "SELECT * FROM trimmed WHERE avg_duration_prev_7days IS NOT NULL",
    "nonnull": "SELECT * FROM training WHERE avg_duration_prev_7days IS NOT NULL AND duration_min IS NOT NULL",
    "study": """
        SELECT c.* FROM nonnull c
        CROSS JOIN (SELECT quantile_cont(duration_min, 0.98) AS bound FROM nonnull) q
        WHERE c.duration_min > 0 AND c.duration_min <= q.bound""",
    "pairs": """
        SELECT l_returnflag AS model, CAST(l_orderkey % 4 AS INTEGER) AS fold, l_linenumber AS max_depth,
               CAST(trunc(l_tax * 100) AS INTEGER) AS n_estimators,
               floor(l_extendedprice) / 1024 AS y, l_quantity * 1500 / 1024 AS y_hat
        FROM lineitem""",
    "req": """
        SELECT event_id AS request_id,
               CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN '-1.5'
                    WHEN event_id % 41 = 0 THEN 'fast'
                    ELSE CAST(floor(value * 4) / 4 AS VARCHAR) END AS avg_duration_prev_7days,
               CASE WHEN event_id % 43 = 0 THEN '-0.25'
                    ELSE CAST(event_id % 8 / CAST(8 AS DOUBLE) AS VARCHAR) END AS "HPCP",
               CASE WHEN event_id % 47 = 0 THEN '2.5' ELSE CAST(user_id % 9 - 1 AS VARCHAR) END AS dow,
               CASE WHEN event_id % 2 = 0 THEN 'true' WHEN event_id % 5 = 0 THEN 'true'
                    WHEN event_id % 5 = 1 THEN 'false' WHEN event_id % 5 = 2 THEN '1'
                    WHEN event_id % 5 = 3 THEN 'No' ELSE 'maybe' END AS is_registered,
               CASE WHEN event_id % 53 = 0 THEN NULL ELSE 'false' END AS has_trace
        FROM events""",
    "checked": """
        SELECT request_id, avg_n AS avg_duration_prev_7days, hpcp_n AS "HPCP", dow_n AS dow,
               reg_b AS is_registered, trace_b AS has_trace,
               concat_ws('; ',
                 CASE WHEN avg_t IS NULL THEN 'avg_duration_prev_7days: missing'
                      WHEN avg_n IS NULL THEN 'avg_duration_prev_7days: not valid'
                      WHEN avg_n < 0 THEN 'avg_duration_prev_7days: below 0' END,
                 CASE WHEN hpcp_n < 0 THEN 'HPCP: below 0' END,
                 CASE WHEN dow_n IS NULL THEN 'dow: not valid'
                      WHEN dow_n NOT BETWEEN 0 AND 6 THEN 'dow: not in 0..6' END,
                 CASE WHEN reg_b IS NULL THEN 'is_registered: not valid' END,
                 CASE WHEN trace_b IS NULL THEN 'has_trace: missing' END) AS reasons
        FROM (SELECT request_id, avg_duration_prev_7days AS avg_t,
                     TRY_CAST(avg_duration_prev_7days AS DOUBLE) AS avg_n,
                     TRY_CAST("HPCP" AS DOUBLE) AS hpcp_n,
                     CASE WHEN dow LIKE '%.%' THEN NULL ELSE CAST(dow AS INTEGER) END AS dow_n,
                     CASE WHEN is_registered IN ('true', '1') THEN TRUE
                          WHEN is_registered IN ('false', 'No') THEN FALSE END AS reg_b,
                     CASE WHEN has_trace = 'false' THEN FALSE END AS trace_b
              FROM req) r""",
}


def with_views(body: str) -> str:
    """Prefix the views that the body needs, directly or through other views."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                texts.append(view)
    views = ", ".join(f"{name} AS ({view})" for name, view in VIEWS.items() if name in needed)
    if not views:
        return body
    body = body.lstrip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"


def fp(expression: str, name: str | None = None) -> str:
    """The SQL twin of `functions.flags.fixed_point` with six digits."""
    text = f"floor(({expression}) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE)"
    return f'{text} AS "{name}"' if name else text


def query(name: str, sql: str | None = None, like: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL or that of another query (`like`); without, only its rows can be checked."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        elif like is not None:
            ORACLES[name] = ORACLES[like]
        return function

    return register
