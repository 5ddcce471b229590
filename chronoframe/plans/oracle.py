"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark plans: plain windows over whole sessions,
correlated aggregates and generate_series, no chunking.
"""

from __future__ import annotations

# events -> raw game-log columns (same mapping as sources.tables.events_as_log)
RAW = r"""
raw AS (
  SELECT CAST(ts AS TIMESTAMP) AS "Timestamp",
         event_type AS "Event",
         CAST(user_id AS DOUBLE) AS "Participant",
         'C' || CAST(k % 4 AS VARCHAR) AS "Condition",
         CAST(user_id AS VARCHAR) AS "SessionID",
         CASE WHEN event_type IN ('click', 'error') THEN 'm' || CAST(k % 8 AS VARCHAR) END AS "MoleId",
         value AS "MolePositionWorldX",
         CAST(k AS DOUBLE) AS "MolePositionWorldY",
         value AS "RightControllerLaserPosWorldX",
         CAST(k % 10 AS DOUBLE) AS "RightControllerLaserPosWorldY",
         CAST(value AS VARCHAR) AS "WorldGazeHitPositionX",
         CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS "WorldGazeHitPositionY",
         CASE WHEN event_type = 'view' THEN CAST(value AS VARCHAR) END AS "WorldGazeHitPositionZ",
         CAST(k AS VARCHAR) || 'e-2' AS "GazeConfidence",
         event_id AS "_ord"
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k"\s*:\s*(\d+)', 1) AS INTEGER) AS k FROM events)
)"""

RAW_COLS = """"Timestamp", "Event", "Participant", "Condition", "SessionID", "MoleId",
  "MolePositionWorldX", "MolePositionWorldY", "RightControllerLaserPosWorldX",
  "RightControllerLaserPosWorldY", "WorldGazeHitPositionX", "WorldGazeHitPositionY",
  "WorldGazeHitPositionZ", "GazeConfidence", "_ord" """

SESSION_W = 'PARTITION BY "Participant", "Condition" ORDER BY "Timestamp" ASC NULLS LAST, "_ord" ASC NULLS LAST'

# derived log: PlayPeriod, Time_delta, Hz, clocks
DLOG = (
    RAW
    + f""",
marked AS (
  SELECT *,
    SUM(CASE WHEN "Event" IN ('signup', 'purchase') THEN 1 ELSE 0 END)
      OVER ({SESSION_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _c,
    LAG("Timestamp") OVER ({SESSION_W}) AS _prev_ts,
    MIN(CASE WHEN "Event" = 'signup' THEN "Timestamp" END)
      OVER (PARTITION BY "Participant", "Condition") AS "GameStarted",
    MIN(CASE WHEN "Event" = 'purchase' THEN "Timestamp" END)
      OVER (PARTITION BY "Participant", "Condition") AS "GameFinished"
  FROM raw
),
hz AS (
  SELECT date_trunc('second', "Timestamp") AS _sec, COUNT(*) FILTER (WHERE "Event" = 'view') AS "Hz"
  FROM raw GROUP BY 1
),
dlog AS (
  SELECT m.*,
    CASE WHEN "Event" = 'purchase' THEN 'Game' WHEN _c < 1 THEN 'PreGame'
         WHEN _c > 1 THEN 'PostGame' ELSE 'Game' END AS "PlayPeriod",
    COALESCE((epoch_us("Timestamp") - epoch_us(_prev_ts)) / 1e6, 0.0) AS "Time_delta",
    h."Hz",
    (epoch_us("Timestamp") - epoch_us("GameStarted")) / 1e6 AS "GameTimeSpent",
    (epoch_us("GameFinished") - epoch_us("Timestamp")) / 1e6 AS "GameTimeLeft"
  FROM marked m JOIN hz h ON date_trunc('second', m."Timestamp") IS NOT DISTINCT FROM h._sec
)"""
)

SQL: dict[str, str] = {}

SQL["derived_log"] = f"""WITH {DLOG}
SELECT {RAW_COLS}, "PlayPeriod", "Time_delta", "Hz", "GameStarted", "GameTimeSpent",
       "GameFinished", "GameTimeLeft"
FROM dlog"""

SQL["play_period"] = f"""WITH {DLOG}
SELECT "_ord", "Participant", "Condition", "Timestamp", "Event", "PlayPeriod" FROM dlog"""

SQL["time_delta"] = f"""WITH {DLOG}
SELECT "_ord", "Participant", "Condition", "Timestamp", "Time_delta" FROM dlog"""

SQL["sample_rate"] = f"""WITH {DLOG}
SELECT "_ord", "Timestamp", "Event", "Hz" FROM dlog"""

SQL["game_clock"] = f"""WITH {DLOG}
SELECT "_ord", "Participant", "Condition", "GameStarted", "GameFinished", "GameTimeSpent",
       "GameTimeLeft" FROM dlog"""

SQL["session_summary"] = f"""WITH {DLOG},
game AS (SELECT * FROM dlog WHERE "PlayPeriod" = 'Game'),
agg AS (
  SELECT "Participant", "Condition",
    COUNT(*) FILTER (WHERE "Event" = 'click') AS "MoleHitCount",
    SUM("Time_delta") AS "PlayTime_delta",
    AVG(TRY_CAST("WorldGazeHitPositionX" AS DOUBLE)) AS "MeanGaze_x",
    AVG(TRY_CAST("WorldGazeHitPositionY" AS DOUBLE)) AS "MeanGaze_y",
    AVG(TRY_CAST("WorldGazeHitPositionZ" AS DOUBLE)) AS "MeanGaze_z",
    AVG(TRY_CAST("GazeConfidence" AS DOUBLE)) AS "MeanGazeConf",
    AVG("Hz") AS "MeanHz",
    BOOL_OR("Event" = 'signup') AS _has_start,
    MIN(CASE WHEN "Event" = 'signup' THEN "Timestamp" END) AS _start
  FROM game GROUP BY "Participant", "Condition"
),
ends AS (SELECT "Participant", "Condition", "Timestamp" AS _end FROM game WHERE "Event" = 'purchase')
SELECT a."Participant", a."Condition", "MoleHitCount",
  (epoch_us(_end) - epoch_us(_start)) / 1e6 AS "PlayTime",
  ROUND("PlayTime_delta", 6) AS "PlayTime_delta",
  ROUND("MeanGaze_x", 6) AS "MeanGaze_x", ROUND("MeanGaze_y", 6) AS "MeanGaze_y",
  ROUND("MeanGaze_z", 6) AS "MeanGaze_z", ROUND("MeanGazeConf", 6) AS "MeanGazeConf",
  ROUND("MeanHz", 6) AS "MeanHz"
FROM agg a JOIN ends e
  ON a."Participant" IS NOT DISTINCT FROM e."Participant" AND a."Condition" IS NOT DISTINCT FROM e."Condition"
WHERE _has_start"""

# ---- frames, hourly buckets -------------------------------------------------
KEYS_EQ = 'a."Participant" = b."Participant" AND a."Condition" = b."Condition"'

FRAMES = (
    DLOG
    + r""",
spans AS (
  SELECT "Participant", "Condition", date_trunc('hour', s) AS time_start,
         date_trunc('hour', e) AS time_end,
         CAST(trunc((epoch_us(e) - epoch_us(s)) / 1e6) AS INTEGER) AS total_time
  FROM (SELECT "Participant", "Condition",
               MIN(CASE WHEN "Event" = 'signup' THEN "Timestamp" END) AS s,
               MIN(CASE WHEN "Event" = 'purchase' THEN "Timestamp" END) AS e
        FROM dlog GROUP BY "Participant", "Condition")
  WHERE s IS NOT NULL AND e IS NOT NULL
),
tmpl AS (
  SELECT "Participant", "Condition", x, y, id, CAST(NULL AS DOUBLE) AS size, 'Active Mole' AS name
  FROM (SELECT "Participant", "Condition", "MolePositionWorldX" AS x, "MolePositionWorldY" AS y, "MoleId" AS id,
               ROW_NUMBER() OVER (PARTITION BY "Participant", "Condition", "MoleId"
                                  ORDER BY "Timestamp" ASC NULLS LAST, "_ord" ASC NULLS LAST) AS rn
        FROM dlog WHERE "MoleId" IS NOT NULL)
  WHERE rn = 1
),
ptmpl AS (
  SELECT DISTINCT "Participant", "Condition", CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y,
         'laser' AS id, CAST(0.0 AS DOUBLE) AS size, 'Laser' AS name
  FROM dlog
),
alltmpl AS (SELECT * FROM tmpl UNION ALL SELECT * FROM ptmpl),
dense AS (
  SELECT t."Participant", t."Condition", t.x, t.y, t.id, t.size, t.name, sp.time_start, sp.total_time,
         sp.time_start + to_hours(CAST(g.k AS BIGINT)) AS second
  FROM alltmpl t JOIN spans sp ON t."Participant" = sp."Participant" AND t."Condition" = sp."Condition",
       LATERAL generate_series(0, CAST(floor(sp.total_time / 3600) AS BIGINT)) AS g(k)
  WHERE sp.total_time >= 0
),
act AS (
  SELECT "Participant", "Condition", "Event", "MolePositionWorldX" AS x, "MolePositionWorldY" AS y,
         "MoleId" AS id,
         CASE WHEN "Event" = 'click' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS size,
         date_trunc('hour', "Timestamp") AS second, 'Active Mole' AS name, "_ord"
  FROM dlog WHERE "Event" IN ('click', 'error')
),
gp AS (SELECT *, date_trunc('hour', "Timestamp") AS second FROM dlog WHERE "PlayPeriod" = 'Game'),
track AS (
  SELECT l."Participant", l."Condition", l.second, (h.flag IS NOT NULL) AS has_hit,
         CASE WHEN h.flag IS NOT NULL THEN h.hx ELSE l.lx END AS x,
         CASE WHEN h.flag IS NOT NULL THEN h.hy ELSE l.ly END AS y,
         'laser' AS id, 'Laser' AS name, CAST(1.0 AS DOUBLE) AS size
  FROM (SELECT "Participant", "Condition", second, "RightControllerLaserPosWorldX" AS lx,
               "RightControllerLaserPosWorldY" AS ly
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "Participant", "Condition", second
                                           ORDER BY "Timestamp" DESC NULLS FIRST, "_ord" DESC NULLS FIRST) AS rn
              FROM gp) WHERE rn = 1) l
  LEFT JOIN (SELECT "Participant", "Condition", second, 1 AS flag, "RightControllerLaserPosWorldX" AS hx,
                    "RightControllerLaserPosWorldY" AS hy
             FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "Participant", "Condition", second
                                                ORDER BY "Timestamp" ASC NULLS LAST, "_ord" ASC NULLS LAST) AS rn
                   FROM gp WHERE "Event" = 'click') WHERE rn = 1) h
    ON l."Participant" = h."Participant" AND l."Condition" = h."Condition" AND l.second = h.second
),
act_s AS (SELECT a.*, sp.time_start, sp.total_time FROM act a JOIN spans sp
          ON a."Participant" = sp."Participant" AND a."Condition" = sp."Condition" WHERE sp.total_time >= 0),
track_s AS (SELECT t.*, sp.time_start, sp.total_time FROM track t JOIN spans sp
            ON t."Participant" = sp."Participant" AND t."Condition" = sp."Condition" WHERE sp.total_time >= 0)"""
)

SQL["session_span"] = f"""WITH {FRAMES}
SELECT "Participant", "Condition", time_start, time_end, total_time FROM spans"""

SQL["time_spine"] = f"""WITH {FRAMES}
SELECT sp."Participant", sp."Condition", sp.time_start + to_hours(CAST(g.k AS BIGINT)) AS second
FROM spans sp, LATERAL generate_series(0, CAST(floor(sp.total_time / 3600) AS BIGINT)) AS g(k)
WHERE sp.total_time >= 0"""

SQL["object_template"] = f"""WITH {FRAMES} SELECT * FROM tmpl"""

SQL["object_activity"] = f"""WITH {FRAMES} SELECT * FROM act"""

SQL["first_per_key"] = f"""WITH {DLOG}
SELECT "Participant", "Condition", "Event", "_ord", "Timestamp", "MolePositionWorldX"
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "Participant", "Condition", "Event"
                                   ORDER BY "Timestamp" ASC NULLS LAST, "_ord" ASC NULLS LAST) AS rn
      FROM dlog) WHERE rn = 1"""

SQL["distinct_buckets"] = f"""WITH {DLOG}
SELECT DISTINCT "Participant", "Condition", date_trunc('hour', "Timestamp") AS second FROM dlog"""

SQL["pointer_track"] = f"""WITH {FRAMES} SELECT * FROM track"""

SQL["pointer_mean"] = f"""WITH {DLOG}
SELECT "Participant", "Condition", date_trunc('hour', "Timestamp") AS second,
       ROUND(AVG("RightControllerLaserPosWorldX"), 6) AS laser_x,
       ROUND(AVG("RightControllerLaserPosWorldY"), 6) AS laser_y
FROM dlog WHERE "PlayPeriod" = 'Game' GROUP BY 1, 2, 3"""

SQL["dense_frames"] = f"""WITH {FRAMES}
SELECT "Participant", "Condition", id, x, y, size, second FROM dense"""

SQL["overlay_anti"] = f"""WITH {FRAMES}
SELECT d."Participant", d."Condition", d.id, d.second FROM dense d
WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a."Participant" = d."Participant" AND a."Condition" = d."Condition"
                  AND a.second = d.second AND a.id = d.id)"""

SQL["fill_down"] = f"""WITH {DLOG}
SELECT "_ord", "Participant", "Condition",
       LAST_VALUE("MoleId" IGNORE NULLS) OVER ({SESSION_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS last_object
FROM dlog"""

SQL["animation_frames"] = f"""WITH {FRAMES},
f1 AS (
  SELECT d."Participant", d."Condition", d.x, d.y, d.id, d.size, d.name, d.second,
         CAST(NULL AS VARCHAR) AS "Event", CAST(NULL AS BIGINT) AS "_ord", d.time_start, d.total_time
  FROM dense d
  WHERE NOT EXISTS (SELECT 1 FROM act_s a WHERE a."Participant" = d."Participant" AND a."Condition" = d."Condition"
                    AND a.second = d.second AND a.id = d.id)
  UNION ALL
  SELECT "Participant", "Condition", x, y, id, size, name, second, "Event", "_ord", time_start, total_time
  FROM act_s
),
f2 AS (
  SELECT "Participant", "Condition", x, y, id, name, second, "Event", time_start, total_time,
         COALESCE(size,
                  LAST_VALUE(size IGNORE NULLS) OVER (
                    PARTITION BY "Participant", "Condition", id ORDER BY second ASC NULLS LAST, "_ord" ASC NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  CAST(0.0 AS DOUBLE)) AS size
  FROM f1
),
f3 AS (
  SELECT f."Participant", f."Condition", f.x, f.y, f.id, f.size, f.name, f.second, f."Event",
         CAST(NULL AS BOOLEAN) AS has_hit, f.time_start, f.total_time
  FROM f2 f
  WHERE NOT EXISTS (SELECT 1 FROM track_s t WHERE t."Participant" = f."Participant" AND t."Condition" = f."Condition"
                    AND t.second = f.second AND t.id = f.id)
  UNION ALL
  SELECT "Participant", "Condition", x, y, id, size, name, second, CAST(NULL AS VARCHAR), has_hit,
         time_start, total_time
  FROM track_s
)
SELECT "Participant", "Condition", x, y, id, size, size * 32 AS marker_size, name,
       (epoch_us(second) - epoch_us(time_start)) / 1e6 AS second, "Event", has_hit
FROM f3
WHERE (epoch_us(second) - epoch_us(time_start)) / 1e6 <= floor(total_time / 3600) * 3600"""

V2 = r""",
dense0 AS (
  SELECT t."Participant", t."Condition", t.x, t.y, t.id, sp.time_start,
         sp.time_start + to_hours(CAST(g.k AS BIGINT)) AS second
  FROM tmpl t JOIN spans sp ON t."Participant" = sp."Participant" AND t."Condition" = sp."Condition",
       LATERAL generate_series(0, CAST(floor(sp.total_time / 3600) AS BIGINT)) AS g(k)
  WHERE sp.total_time >= 0
),
v2j AS (
  SELECT d."Participant", d."Condition", d.id, d.second, d.time_start, d.x, d.y,
         a."Event", a.x AS _ax, a.y AS _ay, a."_ord"
  FROM dense0 d LEFT JOIN act a
    ON a."Participant" = d."Participant" AND a."Condition" = d."Condition" AND a.second = d.second AND a.id = d.id
),
v2 AS (
  SELECT "Participant", "Condition", id, second, time_start, COALESCE(x, _ax) AS x, COALESCE(y, _ay) AS y,
         COALESCE("Event", LAST_VALUE("Event" IGNORE NULLS) OVER (
           PARTITION BY "Participant", "Condition", id ORDER BY second ASC NULLS LAST, "_ord" ASC NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS "Event"
  FROM v2j
)"""

SQL["animation_frames_v2"] = f"""WITH {FRAMES}{V2}
SELECT "Participant", "Condition", id, (epoch_us(second) - epoch_us(time_start)) / 1e6 AS second, x, y, "Event",
       CASE WHEN "Event" = 'click' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS size,
       CASE WHEN "Event" = 'click' THEN CAST(32.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS marker_size
FROM v2"""

SQL["pointer_frames_v2"] = f"""WITH {FRAMES}{V2},
pmean AS (
  SELECT "Participant", "Condition", date_trunc('hour', "Timestamp") AS second,
         AVG("RightControllerLaserPosWorldX") AS laser_x, AVG("RightControllerLaserPosWorldY") AS laser_y
  FROM dlog WHERE "PlayPeriod" = 'Game' GROUP BY 1, 2, 3
)
SELECT v."Participant", v."Condition", v.id, (epoch_us(v.second) - epoch_us(v.time_start)) / 1e6 AS second,
       v.x, v.y, v."Event",
       CASE WHEN v."Event" = 'click' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS size,
       CASE WHEN v."Event" = 'click' THEN CAST(32.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS marker_size,
       ROUND(p.laser_x, 6) AS laser_x, ROUND(p.laser_y, 6) AS laser_y
FROM v2 v LEFT JOIN pmean p
  ON v."Participant" = p."Participant" AND v."Condition" = p."Condition" AND v.second = p.second"""

SQL["axis_range"] = f"""WITH {DLOG}
SELECT MIN("MolePositionWorldX") - 1 AS x_min, MAX("MolePositionWorldX") + 1 AS x_max,
       MIN("MolePositionWorldY") - 1 AS y_min, MAX("MolePositionWorldY") + 1 AS y_max
FROM dlog"""


def _txt(c: str) -> str:
    return f"COALESCE({c}, 'NA')"


def _num(c: str) -> str:
    """A number with 15 significant digits and no trailing zeros."""
    return f"COALESCE(CASE WHEN {c} IS NOT NULL THEN printf('%.15g', {c}) END, 'NA')"


SQL["spawn_points"] = f"""WITH {DLOG}
SELECT "Participant", "Condition", "MoleId", "MolePositionWorldX", "MolePositionWorldY",
       concat_ws(' ', {_txt('"MoleId"')}, {_num('"MolePositionWorldX"')}, {_num('"MolePositionWorldY"')}) AS label,
       CAST(32.0 AS DOUBLE) AS marker_size
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "Participant", "Condition", "MoleId"
                                   ORDER BY "Timestamp" ASC NULLS LAST, "_ord" ASC NULLS LAST) AS rn
      FROM dlog WHERE "PlayPeriod" = 'Game') WHERE rn = 1"""

SQL["sample_rate_series"] = f"""WITH {DLOG}
SELECT "Participant", "Condition", "_ord", "GameTimeSpent", "Hz",
       concat_ws(' ', {_num('"Participant"')}, {_txt('"Condition"')}) AS series
FROM dlog WHERE "PlayPeriod" = 'Game'"""

SQL["trace_union"] = f"""WITH {FRAMES}
SELECT "Participant", "Condition", 'laser' AS trace, second, x FROM track
UNION ALL
SELECT "Participant", "Condition", 'moles' AS trace, second, x FROM act"""

# ---- sources, scalars, curves ----------------------------------------------
SQL["merge_logs"] = f"""WITH {RAW},
ev AS (SELECT "Timestamp", "Event", "SessionID", "MoleId", "MolePositionWorldX", "MolePositionWorldY", "_ord"
       FROM raw WHERE "Event" IS DISTINCT FROM 'view'),
sa AS (SELECT "Timestamp", "Event", "SessionID", "RightControllerLaserPosWorldX", "RightControllerLaserPosWorldY",
              "WorldGazeHitPositionX", "GazeConfidence", "_ord"
       FROM raw WHERE "Event" = 'view'),
logs AS (SELECT * FROM ev UNION ALL BY NAME SELECT * FROM sa),
meta AS (SELECT CAST(c_custkey AS VARCHAR) AS "SessionID", c_mktsegment AS "MetaTimestamp", c_name AS "MetaEmail",
                CAST(c_nationkey AS VARCHAR) AS "MetaFramecount", CAST(c_custkey AS VARCHAR) AS "ParticipantID"
         FROM customer)
SELECT l.*, m."MetaTimestamp", m."MetaEmail", m."MetaFramecount", m."ParticipantID"
FROM logs l LEFT JOIN meta m ON l."SessionID" IS NOT DISTINCT FROM m."SessionID\""""

_US = ", ".join(f"string_split(url, '_')[{i + 1}] AS i{i + 5}" for i in range(9))
_SL = ", ".join(f"string_split(url, '/')[{i + 1}] AS i{i}" for i in range(5))
SQL["path_fields"] = f"""SELECT page_id, {_US}, {_SL} FROM pages"""

SQL["parse_and_cast"] = r"""
SELECT event_id,
  TRY_CAST(regexp_extract(
    CASE WHEN event_type = 'error' THEN 'not a time'
         WHEN event_type = 'view' THEN CAST(ts AS VARCHAR) || ' +junk'
         ELSE CAST(ts AS VARCHAR) END,
    '^\s*\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?', 0) AS TIMESTAMP) AS "Timestamp",
  TRY_CAST(CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value_num
FROM events"""

SQL["label_text"] = f"""WITH {DLOG}
SELECT "_ord", concat_ws(' ', {_num('"Participant"')}, {_txt('"Condition"')}, {_txt('"MoleId"')},
                         {_num('"MolePositionWorldX"')}) AS label
FROM dlog"""

SQL["clip_values"] = """
SELECT event_id, x,
  CASE WHEN x IS NULL OR isnan(x) THEN CAST(NULL AS DOUBLE)
       WHEN x <= 0 THEN CAST(0.0 AS DOUBLE) WHEN x >= 1 THEN CAST(1.0 AS DOUBLE) ELSE x END AS clipped
FROM (SELECT event_id, value / 100 AS x FROM events)"""

SQL["threshold_label"] = """
SELECT event_id, x,
  CASE WHEN isnan(x) THEN NULL WHEN x <= 0.05 THEN 'rare' WHEN x <= 0.3 THEN 'some' WHEN x <= 0.5 THEN 'half'
       WHEN x <= 0.9 THEN 'most' END AS label
FROM (SELECT event_id, value / 100 AS x FROM events)"""

SQL["linear_curve"] = """
WITH fit AS (
  SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope,
         regr_intercept(l_extendedprice, l_quantity) AS icept, AVG(l_extendedprice) AS ybar,
         MIN(l_quantity) * 100 AS lo, MAX(l_quantity) * 100 AS hi
  FROM lineitem GROUP BY l_returnflag
)
SELECT l_returnflag, ROUND((lo + k) / CAST(100 AS DOUBLE), 6) AS x,
       ROUND(COALESCE(icept, ybar) + COALESCE(slope, 0) * ((lo + k) / CAST(100 AS DOUBLE)), 3) AS y
FROM fit, LATERAL generate_series(0, CAST(floor(hi - lo + 1e-9) AS BIGINT)) AS g(k)
WHERE lo IS NOT NULL"""

_RES = "['AccInput', 'RejInput', 'OverrideInput', 'AugSuccess', 'ExplicitSham', 'AssistSuccess', 'AssistFail', 'MitigateFail']"
_FB = "['FishCaught', 'Reel', 'Stay', 'Unreel', 'FishLost']"


def _rate(num: str, den: str) -> str:
    return f"ROUND(CASE WHEN ({den}) = 0 THEN NULL ELSE ({num}) / ({den}) END, 6)"


SQL["trial_outcome_rates"] = f"""WITH {DLOG},
t AS (
  SELECT *,
    CASE WHEN "Event" = 'click' THEN {_RES}[CAST("MolePositionWorldY" AS INTEGER) % 8 + 1] END AS tr,
    CASE WHEN "Event" = 'error' THEN {_FB}[CAST("MolePositionWorldY" AS INTEGER) % 5 + 1] END AS fb
  FROM dlog
),
l AS (
  SELECT *, LEAD("Event") OVER ({SESSION_W}) AS next_event FROM t
),
agg AS (
  SELECT "Participant", "Condition",
    COUNT(*) FILTER (WHERE tr = 'RejInput') AS "rejInput",
    COUNT(*) FILTER (WHERE tr = 'AccInput') AS "accInput",
    COUNT(*) FILTER (WHERE tr IN ('OverrideInput', 'AccInput', 'AugSuccess', 'ExplicitSham', 'AssistSuccess')) AS "posTrial",
    COUNT(*) FILTER (WHERE tr IN ('AssistSuccess', 'AugSuccess')) AS "assistInput",
    COUNT(*) FILTER (WHERE tr IN ('ExplicitSham', 'OverrideInput')) AS "explicitSham",
    COUNT(*) FILTER (WHERE tr IN ('AssistFail', 'MitigateFail')) AS "mitigateFail",
    COUNT(tr) AS "totalTrials2",
    COUNT(*) FILTER (WHERE fb = 'FishCaught') AS "fishCaught",
    COUNT(*) FILTER (WHERE fb = 'Reel') AS "fishReel",
    COUNT(*) FILTER (WHERE fb = 'Stay') AS "fishStay",
    COUNT(*) FILTER (WHERE fb = 'Unreel') AS "fishUnreel",
    COUNT(*) FILTER (WHERE fb = 'FishLost') AS "fishLost",
    COUNT(*) FILTER (WHERE "Event" = 'click' AND next_event <> 'error') AS "notFishCaught",
    COUNT(*) FILTER (WHERE "Event" = 'click' AND next_event <> 'error'
                     AND NOT COALESCE(tr IN ('RejInput', 'AssistFail', 'MitigateFail'), false)) AS reel,
    COUNT(*) FILTER (WHERE "Event" = 'click' AND next_event <> 'error' AND tr = 'RejInput') AS escape,
    SUM("Time_delta") AS time_total
  FROM l GROUP BY "Participant", "Condition"
),
tot AS (SELECT *, "rejInput" + "accInput" + "assistInput" + "explicitSham" + "mitigateFail" AS "totalTrials" FROM agg),
rates AS (
  SELECT *,
    {_rate('"accInput" + "assistInput"', '"totalTrials"')} AS trial_rate_accept,
    {_rate('"rejInput"', '"totalTrials"')} AS trial_rate_reject,
    {_rate('"assistInput"', '"totalTrials"')} AS trial_rate_assist,
    {_rate('"explicitSham"', '"totalTrials"')} AS trial_rate_sham,
    {_rate('"mitigateFail"', '"totalTrials"')} AS trial_rate_mitigate,
    {_rate('"accInput" + "assistInput" + "explicitSham"', '"totalTrials" - "mitigateFail"')} AS trial_rate_positive
  FROM tot
)
SELECT * EXCLUDE (time_total), ROUND(time_total, 6) AS time_total,
  ROUND(CASE WHEN "Condition" = 'C1' THEN trial_rate_assist WHEN "Condition" = 'C2' THEN trial_rate_sham
       WHEN "Condition" = 'C3' THEN trial_rate_mitigate ELSE CAST(0.0 AS DOUBLE) END, 6) AS pam_rate
FROM rates"""

# the CSV round trip must reproduce the summary computed straight from the table
SQL["csv_session_summary"] = f"""WITH {RAW},
notes AS (
  SELECT "Participant", "Condition", COUNT(note) AS n_notes, MIN(note) AS first_note
  FROM (SELECT *, 'said "' || "Event" || '"; C:' || chr(92) || 'log' || chr(92) || chr(10) || 'seen '
               || CAST("Timestamp" AS VARCHAR) AS note FROM raw)
  GROUP BY "Participant", "Condition"),
s AS ({SQL["session_summary"]})
SELECT s.*, n_notes, first_note FROM s JOIN notes n
  ON s."Participant" IS NOT DISTINCT FROM n."Participant" AND s."Condition" IS NOT DISTINCT FROM n."Condition\""""

SQL["persisted_game_rows"] = f"""WITH {DLOG}
SELECT "_ord", "Participant", "Condition", "Timestamp", "Event", "GameTimeSpent", "Hz"
FROM dlog WHERE "Condition" = 'C1' AND "PlayPeriod" = 'Game'"""

SQL["clustered_derived_log"] = f"""WITH {DLOG}
SELECT "_ord", "Participant", "Condition", "Timestamp", "Event", "PlayPeriod", "Time_delta", "Hz",
  "GameTimeSpent", "GameTimeLeft" FROM dlog"""

SQL["summary_first_marker"] = SQL["session_summary"].replace(
    """ends AS (SELECT "Participant", "Condition", "Timestamp" AS _end FROM game WHERE "Event" = 'purchase')""",
    """ends AS (SELECT "Participant", "Condition", MIN("Timestamp") AS _end FROM game WHERE "Event" = 'purchase'
         GROUP BY "Participant", "Condition")""",
)

SQL["csv_from_paths"] = f"""WITH {RAW}
SELECT "Condition" AS i1, "SessionID" || '-' || "Condition" AS "SessionID", "Event", COUNT(*) AS n,
  MAX('said "' || "Event" || '"; C:' || chr(92) || 'log' || chr(92) || chr(10) || 'seen ' || CAST("Timestamp" AS VARCHAR))
    AS last_note
FROM raw GROUP BY "Condition", "SessionID", "Event\""""

SQL["csv_split_rows"] = f"""WITH {RAW}
SELECT CAST("Timestamp" AS VARCHAR) AS "Timestamp", "Event", "SessionID",
  CASE WHEN "Condition" IN ('C0', 'C1', 'C2') THEN "MoleId" END AS "MoleId", "WorldGazeHitPositionY",
  'said "' || "Event" || '"; C:' || chr(92) || 'log' || chr(92) || chr(10) || 'seen ' || CAST("Timestamp" AS VARCHAR) AS "Note"
FROM raw"""

SQL["csv_explicit_files"] = f"""WITH {RAW}
SELECT "SessionID" || '-' || "Condition" AS "SessionID", "Event", COUNT(*) AS n, MIN("Participant") AS participant
FROM raw GROUP BY "SessionID", "Condition", "Event\""""

SQL["sorted_log"] = f"""WITH {RAW}
SELECT "_ord", "Timestamp", ROW_NUMBER() OVER (ORDER BY "Timestamp" ASC NULLS LAST, "_ord" ASC NULLS LAST) AS row_number
FROM raw"""

SQL["merge_by_path"] = f"""WITH {RAW},
meta AS (SELECT DISTINCT "SessionID" AS s, "Condition" AS i1 FROM raw WHERE "Condition" <> 'C3')
SELECT "Timestamp", "Event", "SessionID", "MoleId", "_ord",
  'data/' || "Condition" || '/u' || "SessionID" || '_Event.csv' AS filename, 'p' || s AS "ParticipantID", i1
FROM raw LEFT JOIN meta ON s = "SessionID" AND i1 = "Condition\""""

SQL["merge_suffix_drop"] = f"""WITH {RAW}
SELECT "Timestamp", "SessionID", "MoleId", "_ord", c_mktsegment AS "Segment"
FROM raw LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = "SessionID\""""

SQL["three_valued_if"] = f"""WITH {RAW}
SELECT "_ord", CASE WHEN y IS NULL THEN NULL WHEN y > 500 THEN 'far' ELSE 'near' END AS side
FROM (SELECT "_ord", TRY_CAST("WorldGazeHitPositionY" AS DOUBLE) AS y FROM raw)"""

SQL["smooth_curve_line"] = """
SELECT l_returnflag, l_quantity AS x, ROUND(icept + slope * l_quantity, 2) AS y
FROM (SELECT DISTINCT l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem)
JOIN (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope,
             regr_intercept(l_extendedprice, l_quantity) AS icept FROM lineitem GROUP BY l_returnflag)
USING (l_returnflag)"""


def _intercept_model(name: str, terms: list[str]) -> str:
    """CTEs that minimise the profile deviance of a random-intercept model over s = ratio / (1 + ratio).

    One recursion step a round: 33 values of s around the best so far, each from
    the sums of all levels; normal equations by Cramer's rule for two or three terms.
    """
    own = ["q_0", *(f"q_{t}" for t in terms), "q_y"]
    k = len(own)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    mom = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    sums = ", ".join(
        f"any_value(t_{own[i][2:]}_{own[j][2:]}) - sum(w * {own[i]} * {own[j]}) AS {mom(i, j)}" for i, j in pairs
    )

    def det(a, size):
        if size == 1:
            return a(0, 0)
        if size == 2:
            return f"({a(0, 0)} * {a(1, 1)} - {a(0, 1)} * {a(1, 0)})"
        minor = lambda c: det(lambda i, j: a(i + 1, j + (j >= c)), size - 1)
        signs = ["", "-", ""]
        return "(" + " + ".join(f"{signs[c]}{a(0, c)} * {minor(c)}" for c in range(size)) + ")"

    p = k - 1
    # residual sum of squares = det of the whole moment matrix / det of the terms' part, by elimination of the first term
    e = lambda i, j: f"({mom(i, j)} - {mom(0, i)} * {mom(0, j)} / m00)"
    if p == 2:
        rss = f"{e(2, 2)} - {e(1, 2)} * {e(1, 2)} / {e(1, 1)}"
    else:
        whole = det(lambda i, j: e(i + 1, j + 1), 3)
        part = det(lambda i, j: e(i + 1, j + 1), 2)
        rss = f"{whole} / {part}"
    rounds = []
    for r in range(9):
        centre, half = (f"(SELECT s FROM {name}_b{r - 1})", f"{0.5 * 8.0 ** -r!r}") if r else ("0.5", "0.5")
        rounds.append(f"""{name}_p{r} AS (
  SELECT DISTINCT greatest(0.0, least(0.999999, {centre} + {half} * (i - 16) / 16.0))::DOUBLE AS s FROM range(33) g(i)),
{name}_e{r} AS (
  SELECT s, sum(ln(1 + s / (1 - s) * q_0)) AS logdet, any_value(t_0_0) AS n, {sums}
  FROM (SELECT *, s / (1 - s) / (1 + s / (1 - s) * q_0) AS w FROM {name}_p{r}, lv, tot) GROUP BY s),
{name}_b{r} AS (
  SELECT s, -0.5 * (n * (ln(2 * pi() * ({rss}) / n) + 1) + logdet) AS ml FROM {name}_e{r} ORDER BY ml DESC, s LIMIT 1)""")
    return ",\n".join(rounds)


_TERMS = {"0": "1.0", "qty": "CAST(l_quantity AS DOUBLE)", "disc": "CAST(l_discount AS DOUBLE)", "y": "CAST(l_extendedprice AS DOUBLE)"}
_TOTALS = ", ".join(
    f"sum({_TERMS[a]} * {_TERMS[b]}) AS t_{a}_{b}" for i, a in enumerate(_TERMS) for b in list(_TERMS)[i:]
)
SQL["random_intercept_test"] = f"""WITH
lv AS (SELECT l_suppkey, {", ".join(f"sum({e}) AS q_{t}" for t, e in _TERMS.items())} FROM lineitem GROUP BY l_suppkey),
tot AS (SELECT {_TOTALS}, count(DISTINCT l_suppkey) AS levels FROM lineitem),
{_intercept_model("a", ["qty"])},
{_intercept_model("b", ["qty", "disc"])}
SELECT 'l_extendedprice ~ 1 + l_quantity + (1 | l_suppkey)' AS model, 4 AS npar, t_0_0::BIGINT AS n, levels,
  round(a_b8.ml, 2) AS "ML", NULL::DOUBLE AS "Chisq", NULL::INTEGER AS "Df" FROM a_b8, tot
UNION ALL
SELECT 'l_extendedprice ~ 1 + l_quantity + l_discount + (1 | l_suppkey)', 5, t_0_0::BIGINT, levels,
  round(b_b8.ml, 2), round(greatest(2 * (b_b8.ml - a_b8.ml), 0.0), 2), 1 FROM a_b8, b_b8, tot"""
