"""DuckDB oracle SQL for the registered queries.

Each string is self-contained over the benchmark tables (``events``,
``nation``, ``region``, ``customer`` as views) and mirrors the view
definitions of ``sources/tables.py`` with the same integer-first arithmetic.
Doubles are rounded half-up to 6 decimals with ``floor(v * 1e6 + 0.5) / 1e6``
exactly as the Spark side does; responses (P6) are printed instead.
"""

from __future__ import annotations

from xgspark.config import (
    GATEWAY_SERVICE_ERROR, GATEWAY_VALIDATION_ERROR, INTERPRETATION_THRESHOLDS, LAX_MESSAGES,
    LOG_LOSS_EPS, STRICT_MESSAGES, YARDS_PER_METER,
)
from xgspark.plans.catalog import ETL_COMPETITION_ID, FOLD_MODELS, SERVICE_MODEL
from xgspark.sources.tables import FIXTURE_MODEL


def r6(e: str) -> str:
    return f"(floor(({e}) * 1000000.0E0 + 0.5E0) / 1000000.0E0)"


def r4(e: str) -> str:
    return f"(floor(({e}) * 10000.0E0 + 0.5E0) / 10000.0E0)"


def shown4(e: str) -> str:
    """Four decimals as the C library prints them: the exact value, half to even."""
    return f"CAST(printf('%.4f', {e}) AS DOUBLE)"


def _lit(v: float) -> str:
    return f"({float(v)!r}E0)" if "e" not in repr(float(v)) else f"({float(v)!r})"


def _dist(x: str, y: str) -> str:
    return f"sqrt((120.0E0 - {x}) * (120.0E0 - {x}) + (40.0E0 - {y}) * (40.0E0 - {y}))"


def _angle(x: str, y: str) -> str:
    r = f"abs(atan2(36.0E0 - {y}, 120.0E0 - {x}) - atan2(44.0E0 - {y}, 120.0E0 - {x}))"
    return f"degrees(CASE WHEN {r} > pi() THEN 2 * pi() - {r} ELSE {r} END)"


def _prob(b0, b1, b2, d: str, a: str) -> str:
    return f"(1.0E0 / (1.0E0 + exp(-({_lit(b0)} + {_lit(b1)} * {d} + {_lit(b2)} * {a}))))"


_FP = _prob(*FIXTURE_MODEL, "distance_to_goal", "shot_angle")

SHOTS = f"""
shots_xy AS (
  SELECT event_id AS shot_id, user_id AS match_id,
         60 + (event_id * 37 % 600) / 10.0E0 AS x,
         (event_id * 53 % 800) / 10.0E0 AS y
  FROM events),
shots_geo AS (
  SELECT *, {_dist('x', 'y')} AS distance_to_goal, {_angle('x', 'y')} AS shot_angle FROM shots_xy),
shots AS (
  SELECT shot_id, match_id, x, y, distance_to_goal, shot_angle,
         CAST(CASE WHEN (shot_id * 7919 % 1000) / 1000.0E0 < {_FP} THEN 1 ELSE 0 END AS INTEGER) AS is_goal
  FROM shots_geo)"""

_XT = "(CAST(60 + (event_id * 37 % 600) // 10 AS VARCHAR) || '.' || CAST((event_id * 37 % 600) % 10 AS VARCHAR))"
_YT = "(CAST((event_id * 53 % 800) // 10 AS VARCHAR) || '.' || CAST((event_id * 53 % 800) % 10 AS VARCHAR))"

RAW = f"""
raw AS (
  SELECT event_id, user_id AS match_id,
    CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 47 = 0 THEN 'Pass' ELSE 'Shot' END AS type_name,
    CAST(CASE WHEN event_id % 37 = 0 THEN NULL ELSE 1 + event_id % 5 END AS INTEGER) AS period,
    CAST(event_id % 95 AS INTEGER) AS minute,
    CASE WHEN event_id % 31 = 0 THEN NULL
         WHEN event_id % 41 = 0 THEN '[100.0]'
         WHEN event_id % 67 = 0 THEN '"oops"'
         WHEN event_id % 73 = 0 THEN '[null, ' || {_YT} || ']'
         WHEN event_id % 71 = 0 THEN '["' || {_XT} || '", ' || {_YT} || ', 0.3]'
         WHEN event_id % 79 = 0 THEN '["nan", ' || {_YT} || ']'
         ELSE '[' || {_XT} || ', ' || {_YT} || ']' END AS location,
    CASE WHEN event_id % 23 = 0 THEN 'Penalty' WHEN event_id % 29 = 0 THEN NULL ELSE 'Open Play' END AS shot_type,
    CASE WHEN event_type = 'purchase' THEN 'Goal' WHEN event_type = 'error' THEN NULL ELSE 'Saved' END AS outcome,
    CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'Right Foot'
         WHEN event_id % 3 = 1 THEN 'Left Foot' ELSE 'Head' END AS body_part,
    CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'Player ' || CAST(user_id AS VARCHAR) END AS player_name,
    CASE WHEN event_id % 13 = 0 THEN 'Club ' || CAST(user_id % 32 AS VARCHAR)
         ELSE 'Team ' || CAST(user_id % 32 AS VARCHAR) END AS team_name,
    value / 100.0E0 AS statsbomb_xg
  FROM events),
raw_xy AS (
  SELECT *, TRY_CAST(json_extract_string(location, '$[0]') AS DOUBLE) AS x,
            TRY_CAST(json_extract_string(location, '$[1]') AS DOUBLE) AS y
  FROM raw)"""


def _clean_from(src: str) -> str:
    """Clean-shots CTE over a ``raw_xy``-shaped relation ``src``."""
    return f"""
kept AS (
  SELECT * FROM {src}
  WHERE type_name = 'Shot' AND x IS NOT NULL AND y IS NOT NULL
    AND shot_type IS DISTINCT FROM 'Penalty' AND period IS DISTINCT FROM 5),
featured AS (
  SELECT match_id, player_name, team_name, minute, period, body_part, shot_type, statsbomb_xg, x, y,
         CAST(CASE WHEN outcome = 'Goal' THEN 1 ELSE 0 END AS INTEGER) AS is_goal,
         {_dist('x', 'y')} AS distance_to_goal, {_angle('x', 'y')} AS shot_angle
  FROM kept),
clean AS (
  SELECT * FROM featured
  WHERE NOT isnan(x) AND NOT isnan(y) AND NOT isnan(distance_to_goal))"""


CLEAN_SELECT = f"""
SELECT match_id, player_name, team_name, minute, period, body_part, shot_type, statsbomb_xg, x, y, is_goal,
       {r6('distance_to_goal')} AS distance_to_goal, {r6('shot_angle')} AS shot_angle
FROM clean"""

CATALOGUE = f"""
competitions AS (
  SELECT CAST(n_regionkey AS BIGINT) AS competition_id, r_name AS competition_name,
         CAST(n_nationkey AS BIGINT) AS season_id, n_name AS season_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
seasons AS (SELECT * FROM competitions WHERE competition_id = {ETL_COMPETITION_ID}),
season_matches AS (
  SELECT CAST(c_custkey AS BIGINT) AS match_id, CAST(c_nationkey AS BIGINT) AS season_id, s.season_name
  FROM customer JOIN seasons s ON CAST(c_nationkey AS BIGINT) = s.season_id),
match_ids AS (SELECT DISTINCT match_id FROM season_matches WHERE match_id IS NOT NULL),
etl_raw AS (
  SELECT * FROM raw_xy WHERE type_name = 'Shot' AND match_id IN (SELECT match_id FROM match_ids))"""

GREEDY_FOLDS = """
gcount AS (
  SELECT match_id, count(*) AS n,
         row_number() OVER (ORDER BY count(*) DESC, match_id DESC) AS rn
  FROM shots GROUP BY match_id),
kk AS (SELECT CAST(least(5, count(*)) AS INTEGER) AS k FROM gcount),
walk(rn, match_id, n, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER),
         list_transform(range((SELECT k FROM kk)), lambda i: CAST(0 AS BIGINT))
  UNION ALL
  SELECT g.rn, g.match_id, g.n,
         CAST(list_position(w.loads, list_min(w.loads)) - 1 AS INTEGER),
         list_transform(range(len(w.loads)), lambda i: w.loads[i + 1] +
             CASE WHEN i = list_position(w.loads, list_min(w.loads)) - 1 THEN g.n ELSE 0 END)
  FROM walk w JOIN gcount g ON g.rn = w.rn + 1),
folds AS (SELECT match_id, n, fold FROM walk WHERE rn > 0),
folded AS (SELECT s.*, f.fold FROM shots s JOIN folds f USING (match_id))"""

SCORED = f"""
scored AS (SELECT *, {_FP} AS p FROM folded)"""

_EPS = repr(LOG_LOSS_EPS)
_PC = f"least(greatest(p, {_EPS}), 1.0E0 - {_EPS})"

FOLD_METRICS = f"""
base AS (
  SELECT fold, count(*) AS n, CAST(sum(is_goal) AS BIGINT) AS goals,
         avg(-(is_goal * ln({_PC}) + (1.0E0 - is_goal) * ln(1.0E0 - {_PC}))) AS log_loss,
         avg((p - is_goal) * (p - is_goal)) AS brier
  FROM scored GROUP BY fold),
dist AS (
  SELECT fold, p, sum(is_goal) AS pos, count(*) - sum(is_goal) AS neg FROM scored GROUP BY fold, p),
below AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY p
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM dist),
auc AS (
  SELECT fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
           sum(pos * (nb + neg / 2.0E0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc
  FROM below GROUP BY fold),
fm AS (SELECT b.fold, n, goals, log_loss, roc_auc, brier FROM base b LEFT JOIN auc a USING (fold))"""

REQUESTS = """
req AS (
  SELECT event_id AS request_id,
         CAST((event_id % 50) - 2 AS DOUBLE) AS distance_meters,
         CAST((event_id * 7 % 200) - 5 AS DOUBLE) AS angle_degrees
  FROM events)"""


def _msg_cases(mode: str, d: str, a: str, d_present: str, d_num: str, a_present: str, a_num: str):
    m = STRICT_MESSAGES if mode == "strict" else LAX_MESSAGES
    md, ma = m["distance_meters"], m["angle_degrees"]
    d_msg = (f"CASE WHEN NOT ({d_present}) THEN '{md['required']}' WHEN NOT ({d_num}) THEN '{md['type']}' "
             f"WHEN isnan({d}) OR NOT ({d} > 0) THEN '{md['gt']}' END")
    a_msg = (f"CASE WHEN NOT ({a_present}) THEN '{ma['required']}' WHEN NOT ({a_num}) THEN '{ma['type']}' "
             f"WHEN isnan({a}) OR {a} < 0 THEN '{ma['ge']}' WHEN {a} > 180 THEN '{ma['le']}' END")
    return d_msg, a_msg


def _errors_json(d_msg: str = "d_msg", a_msg: str = "a_msg") -> str:
    return ("'{' || concat_ws(',', "
            f"CASE WHEN {d_msg} IS NOT NULL THEN '\"distance_meters\":[\"' || {d_msg} || '\"]' END, "
            f"CASE WHEN {a_msg} IS NOT NULL THEN '\"angle_degrees\":[\"' || {a_msg} || '\"]' END) || '}}'")


_D_MSG, _A_MSG = _msg_cases(
    "strict", "distance_meters", "angle_degrees",
    "distance_meters IS NOT NULL", "NOT isnan(distance_meters) AND NOT isinf(distance_meters)",
    "angle_degrees IS NOT NULL", "NOT isnan(angle_degrees) AND NOT isinf(angle_degrees)")

VALIDATED = f"""
vmsg AS (SELECT *, {_D_MSG} AS d_msg, {_A_MSG} AS a_msg FROM req),
validated AS (
  SELECT *, CASE WHEN d_msg IS NULL AND a_msg IS NULL THEN 'ok' ELSE 'rejected' END AS status,
         {_errors_json()} AS errors_json
  FROM vmsg)"""


def _interp(p: str) -> str:
    last = INTERPRETATION_THRESHOLDS[-1][1]
    whens = " ".join(f"WHEN {p} >= {_lit(t)} THEN '{label}'" for t, label in INTERPRETATION_THRESHOLDS)
    return f"CASE WHEN {p} IS NULL THEN NULL WHEN isnan({p}) THEN '{last}' {whens} ELSE '{last}' END"


def _score_sql(model: dict | None, prefix: str | None = None, source: str = "validated") -> str:
    """Scoring over a validated relation (request_id, distance_meters,
    angle_degrees, status, errors_json); ``prefix`` is its WITH clause."""
    prefix = prefix or f"WITH {REQUESTS}, {VALIDATED}"
    yards = f"(distance_meters * {_lit(YARDS_PER_METER)})"
    if model is None:
        p = "CAST(NULL AS DOUBLE)"
        status = "CASE WHEN status = 'ok' THEN 'model_unavailable' ELSE status END"
    else:
        p = (f"CASE WHEN status = 'ok' THEN "
             f"{_prob(model['intercept'], model['coef_distance'], model['coef_angle'], yards, 'angle_degrees')} END")
        status = "status"
    return f"""{prefix},
sc AS (SELECT *, {p} AS p, {status} AS st FROM {source})
SELECT request_id, distance_meters, angle_degrees, st AS status,
       CASE WHEN st = 'ok' THEN 200 WHEN st = 'model_unavailable' THEN 503 ELSE 422 END AS http_status,
       CASE WHEN st = 'ok' THEN 200 WHEN st = 'rejected' THEN 422 ELSE 502 END AS gateway_status,
       CASE WHEN st = 'rejected' THEN '{GATEWAY_VALIDATION_ERROR}' WHEN st <> 'ok' THEN '{GATEWAY_SERVICE_ERROR}' END AS error,
       errors_json,
       CASE WHEN st = 'ok' THEN {shown4('p')} END AS xg_probability,
       CASE WHEN st = 'ok' THEN {shown4(yards)} END AS distance_yards,
       CASE WHEN st = 'ok' THEN {_interp('p')} END AS interpretation
FROM sc"""


_JREQ = """
jreq_src AS (
  SELECT event_id,
         CAST((event_id % 50) - 2 AS VARCHAR) AS d,
         CAST((event_id * 7 % 200) - 5 AS VARCHAR) AS a
  FROM events),
jreq AS (
  SELECT event_id AS request_id,
    CASE WHEN event_id % 97 = 0 THEN '[1, 2]'
         WHEN event_id % 89 = 0 THEN 'not json'
         WHEN event_id % 83 = 0 THEN '{}'
         WHEN event_id % 79 = 0 THEN '{"distance_meters": 1e400, "angle_degrees": ' || a || '}'
         WHEN event_id % 73 = 0 THEN '{"distance_meters": -3, "angle_degrees": ' || a || ', "distance_meters": ' || d || '}'
         WHEN event_id % 71 = 0 THEN '{"angle_degrees": 10, "x": {"a": 1, "a": 2}, "distance_meters": ' || d || ', "angle_degrees": null}'
         WHEN event_id % 13 = 0 THEN '{"angle_degrees": ' || a || '}'
         WHEN event_id % 17 = 0 THEN '{"distance_meters": ' || d || '}'
         WHEN event_id % 19 = 0 THEN '{"distance_meters": null, "angle_degrees": ' || a || '}'
         WHEN event_id % 11 = 0 THEN '{"distance_meters": "' || d || '", "angle_degrees": ' || a || '}'
         WHEN event_id % 7 = 0 THEN '{"distance_meters": true, "angle_degrees": ' || a || '}'
         WHEN event_id % 5 = 0 THEN '{"distance_meters": ' || d || '.5, "angle_degrees": "' || a || '"}'
         ELSE '{"distance_meters": ' || d || ', "angle_degrees": ' || a || '}' END AS body,
    -- What such a body means, in a form without repeated keys and infinite numbers.
    CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 THEN NULL
         WHEN event_id % 79 = 0 THEN '{"distance_meters": "inf", "angle_degrees": ' || a || '}'
         WHEN event_id % 73 = 0 THEN '{"distance_meters": ' || d || ', "angle_degrees": ' || a || '}'
         WHEN event_id % 71 = 0 THEN '{"distance_meters": ' || d || ', "angle_degrees": null}' END AS meant
  FROM jreq_src),
jtyped AS (
  SELECT request_id, body,
    coalesce(CASE WHEN json_valid(said) THEN json_type(said) END = 'OBJECT', false) AS body_ok,
    CASE WHEN json_valid(said) THEN json_type(said, '$.distance_meters') END AS d_t,
    CASE WHEN json_valid(said) THEN json_extract_string(said, '$.distance_meters') END AS dx,
    CASE WHEN json_valid(said) THEN json_type(said, '$.angle_degrees') END AS a_t,
    CASE WHEN json_valid(said) THEN json_extract_string(said, '$.angle_degrees') END AS ax
  FROM (SELECT *, coalesce(meant, body) AS said FROM jreq))"""

_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE')"


def _json_validate_sql(mode: str, valid_only: bool = False) -> str:
    sql = _json_validated_ctes(mode)
    if valid_only:
        return sql + """
SELECT request_id, distance_meters, angle_degrees, CASE WHEN status = 'ok' THEN 'valid' ELSE 'rejected' END AS side,
       CASE WHEN status <> 'ok' THEN errors_json END AS errors_json FROM jo"""
    return sql + "\nSELECT request_id, body, distance_meters, angle_degrees, status, errors_json FROM jo"


def _json_validated_ctes(mode: str) -> str:
    """WITH clause ending in ``jo``: validated JSON requests."""
    if mode == "strict":
        dv = f"CASE WHEN d_t IN {_NUM} THEN CAST(dx AS DOUBLE) END"
        av = f"CASE WHEN a_t IN {_NUM} THEN CAST(ax AS DOUBLE) END"
    else:
        def lax(t, x):
            return (f"CASE WHEN {t} IN {_NUM} THEN CAST({x} AS DOUBLE) "
                    f"WHEN {t} = 'VARCHAR' THEN TRY_CAST({x} AS DOUBLE) "
                    f"WHEN {t} = 'BOOLEAN' THEN CASE WHEN {x} = 'true' THEN 1.0E0 ELSE 0.0E0 END END")
        dv, av = lax("d_t", "dx"), lax("a_t", "ax")
    d_msg, a_msg = _msg_cases(mode, "distance_meters", "angle_degrees",
                              "d_t IS NOT NULL", "distance_meters IS NOT NULL",
                              "a_t IS NOT NULL", "angle_degrees IS NOT NULL")
    sql = f"""WITH {_JREQ},
jv AS (SELECT request_id, body, body_ok, d_t, a_t, {dv} AS distance_meters, {av} AS angle_degrees FROM jtyped),
jm AS (SELECT *, {d_msg} AS d_msg, {a_msg} AS a_msg FROM jv),
jo AS (
  SELECT request_id, body, distance_meters, angle_degrees,
         CASE WHEN body_ok AND d_msg IS NULL AND a_msg IS NULL THEN 'ok' ELSE 'rejected' END AS status,
         CASE WHEN body_ok THEN {_errors_json()} ELSE '{{}}' END AS errors_json
  FROM jm)"""
    return sql


_FOLD_MODEL_VALUES = ", ".join(f"({f}, {_lit(b0)}, {_lit(b1)}, {_lit(b2)})" for f, b0, b1, b2 in FOLD_MODELS)
OOF = f"""WITH {SHOTS}, {GREEDY_FOLDS},
fmodels(fold, b0, b1, b2) AS (VALUES {_FOLD_MODEL_VALUES}),
oof AS (
  SELECT shot_id, match_id, f.fold,
         1.0E0 / (1.0E0 + exp(-(b0 + b1 * distance_to_goal + b2 * shot_angle))) AS p
  FROM folded f JOIN fmodels m ON f.fold = m.fold)
SELECT shot_id, match_id, fold, {r6('p')} AS p FROM oof"""

NEWTON_STEPS = 14


def _newton(rows: str, sides: str, train: str) -> str:
    """CTEs ending in ``fitted(side, b0, b1, b2, n_train)``: logistic fits of
    ``rows`` (distance_to_goal, shot_angle, is_goal, fold) by unrolled Newton
    steps on ``sum(log loss) + (b1^2 + b2^2) / 2``, one for each row of
    ``sides``; ``train`` tells which rows a side trains on.  A step solves the
    3 x 3 system by Cramer's rule."""
    ctes = [f"w0 AS MATERIALIZED (SELECT side, 0.0E0 AS b0, 0.0E0 AS b1, 0.0E0 AS b2 FROM ({sides}))"]
    for t in range(NEWTON_STEPS):
        ctes.append(f"""
g{t} AS MATERIALIZED (
  SELECT side, b0, b1, b2, sum(q) AS a00, sum(q * d) AS a01, sum(q * a) AS a02,
         sum(q * d * d) + 1 AS a11, sum(q * d * a) AS a12, sum(q * a * a) + 1 AS a22,
         sum(p - y) AS r0, sum((p - y) * d) + b1 AS r1, sum((p - y) * a) + b2 AS r2, count(*) AS n_train
  FROM (SELECT *, p * (1 - p) AS q FROM (
    SELECT w.*, r.distance_to_goal AS d, r.shot_angle AS a, CAST(r.is_goal AS DOUBLE) AS y,
           1.0E0 / (1.0E0 + exp(-(b0 + b1 * r.distance_to_goal + b2 * r.shot_angle))) AS p
    FROM w{t} w JOIN {rows} r ON {train}))
  GROUP BY side, b0, b1, b2),
w{t + 1} AS MATERIALIZED (
  SELECT side, n_train,
    b0 - (r0 * (a11 * a22 - a12 * a12) - a01 * (r1 * a22 - a12 * r2) + a02 * (r1 * a12 - a11 * r2)) / det AS b0,
    b1 - (a00 * (r1 * a22 - a12 * r2) - r0 * (a01 * a22 - a12 * a02) + a02 * (a01 * r2 - r1 * a02)) / det AS b1,
    b2 - (a00 * (a11 * r2 - r1 * a12) - a01 * (a01 * r2 - r1 * a02) + r0 * (a01 * a12 - a11 * a02)) / det AS b2
  FROM (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det
        FROM g{t}))""")
    return ",\n".join(ctes) + f",\nfitted AS (SELECT * FROM w{NEWTON_STEPS})"


_ALL = "SELECT CAST(NULL AS INTEGER) AS side"
_FOLD_SIDES = "SELECT DISTINCT fold AS side FROM folded"
# Shots without an angle (NULL or NaN) never reach training.
GAPPY = SHOTS.replace("shots AS (", "all_shots AS (", 1) + """,
shots AS (SELECT * FROM all_shots WHERE shot_id % 101 <> 0 AND shot_id % 103 <> 0)"""
_FIT_R4 = f"{r4('b1')} AS coef_distance, {r4('b2')} AS coef_angle, {r4('b0')} AS intercept"

_CV = ", ".join(f"{r6(f'avg({m})')} AS {m}_mean, {r6(f'stddev_pop({m})')} AS {m}_std"
                for m in ("log_loss", "roc_auc", "brier"))

_SHOTS_OUT = f"""SELECT shot_id, match_id, x, y, {r6('distance_to_goal')} AS distance_to_goal,
       {r6('shot_angle')} AS shot_angle"""

ORACLE: dict[str, str] = {
    "shot_geometry": f"WITH {SHOTS}\n{_SHOTS_OUT} FROM shots",
    "shot_summary": f"""WITH {SHOTS}
SELECT count(*) AS shots, CAST(coalesce(sum(is_goal), 0) AS BIGINT) AS goals,
       {r6('coalesce(sum(is_goal) / CAST(count(*) AS DOUBLE), 0.0E0)')} AS conversion_rate,
       count(DISTINCT match_id) AS matches
FROM shots""",
    "clean_shots": f"WITH {RAW}, {_clean_from('raw_xy')}\n{CLEAN_SELECT}",
    "null_safe_filters": f"""WITH {RAW}
SELECT event_id, shot_type, period FROM raw
WHERE shot_type IS DISTINCT FROM 'Penalty' AND period IS DISTINCT FROM 5""",
    "bad_locations": f"""WITH {RAW}
SELECT event_id, location, x, y, (x IS NOT NULL AND y IS NOT NULL) AS valid FROM raw_xy""",
    "missing_value_counts": f"""WITH {RAW}, {_clean_from('raw_xy')}
SELECT count(*) AS rows_in,
       count(CASE WHEN isnan(x) OR isnan(y) OR isnan(distance_to_goal) THEN 1 END) AS rows_dropped
FROM featured""",
    "assembled_features": f"""WITH {SHOTS}
SELECT {r6('distance_to_goal')} AS f_distance_to_goal, {r6('shot_angle')} AS f_shot_angle,
       CAST(is_goal AS DOUBLE) AS label, match_id
FROM shots""",
    "etl_shots": f"WITH {RAW}, {CATALOGUE}, {_clean_from('etl_raw')}\n{CLEAN_SELECT}",
    "ingest_audit": f"""WITH {RAW}, {CATALOGUE}, {_clean_from('etl_raw')},
per_match AS (SELECT match_id, count(*) AS raw_shots FROM etl_raw GROUP BY match_id),
m AS (
  SELECT count(*) AS matches_total, count(p.raw_shots) AS matches_with_shots,
         count(*) - count(p.raw_shots) AS matches_without_shots,
         CAST(coalesce(sum(p.raw_shots), 0) AS BIGINT) AS raw_shots
  FROM match_ids i LEFT JOIN per_match p USING (match_id)),
c AS (SELECT count(*) AS kept_shots, CAST(coalesce(sum(is_goal), 0) AS BIGINT) AS goals FROM clean),
f AS (SELECT count(*) AS passed FROM featured)
SELECT matches_total, matches_with_shots, matches_without_shots, raw_shots, kept_shots,
       raw_shots - kept_shots AS dropped_shots, passed - kept_shots AS dropped_missing, goals
FROM m, c, f""",
    "season_matches": f"WITH {RAW}, {CATALOGUE}\nSELECT match_id, season_id, season_name FROM season_matches",
    "matches_without_shots": f"""WITH {RAW}, {CATALOGUE}
SELECT match_id, season_id, season_name FROM season_matches
WHERE match_id NOT IN (SELECT match_id FROM raw WHERE type_name = 'Shot' AND match_id IS NOT NULL)""",
    "distinct_match_ids": f"""WITH {RAW}
SELECT DISTINCT match_id FROM raw WHERE type_name = 'Shot' AND match_id IS NOT NULL""",
    "ragged_union": """
SELECT event_id, user_id AS match_id, value, CAST(NULL AS VARCHAR) AS props FROM events
WHERE event_type IN ('purchase', 'click')
UNION ALL
SELECT event_id, user_id AS match_id, CAST(NULL AS DOUBLE) AS value, props FROM events
WHERE event_type NOT IN ('purchase', 'click') OR event_type IS NULL""",
    "validate_requests": f"""WITH {REQUESTS}, {VALIDATED}
SELECT request_id, distance_meters, angle_degrees, status, errors_json FROM validated""",
    "validate_json_requests": _json_validate_sql("strict"),
    "validate_json_requests_lax": _json_validate_sql("lax"),
    "valid_json_requests": _json_validate_sql("strict", valid_only=True),
    "score_requests": _score_sql(SERVICE_MODEL),
    "score_requests_no_model": _score_sql(None),
    "score_json_requests": _score_sql(SERVICE_MODEL, _json_validated_ctes("strict"), "jo"),
    "interpretation_buckets": f"""WITH {SHOTS}
SELECT {_interp(_FP)} AS interpretation, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals
FROM shots GROUP BY 1""",
    "group_kfold_greedy": f"WITH RECURSIVE {SHOTS}, {GREEDY_FOLDS}\nSELECT match_id, n, fold FROM folds",
    "fold_sizes": f"""WITH RECURSIVE {SHOTS}, {GREEDY_FOLDS},
per AS (SELECT fold, count(*) AS test_rows, count(DISTINCT match_id) AS test_matches FROM folded GROUP BY fold)
SELECT fold, CAST(sum(test_rows) OVER () - test_rows AS BIGINT) AS train_rows, test_rows, test_matches FROM per""",
    "leakage_check": f"""WITH RECURSIVE {SHOTS}, {GREEDY_FOLDS},
pg AS (SELECT match_id, count(DISTINCT fold) AS n_folds FROM folded GROUP BY match_id)
SELECT count(*) AS n_groups, count(CASE WHEN n_folds > 1 THEN 1 END) AS n_leaking_groups FROM pg""",
    "fold_metrics": f"""WITH RECURSIVE {SHOTS}, {GREEDY_FOLDS}, {SCORED}, {FOLD_METRICS}
SELECT fold, n, goals, {r6('log_loss')} AS log_loss, {r6('roc_auc')} AS roc_auc, {r6('brier')} AS brier FROM fm""",
    "cv_summary": f"""WITH RECURSIVE {SHOTS}, {GREEDY_FOLDS}, {SCORED}, {FOLD_METRICS}
SELECT count(*) AS folds, {_CV} FROM fm""",
    "oof_scores": OOF.replace("WITH ", "WITH RECURSIVE ", 1),
    "fit_folds": f"""WITH RECURSIVE {SHOTS}, {GREEDY_FOLDS}, {_newton('folded', _FOLD_SIDES, 'r.fold <> w.side')}
SELECT side AS fold, {_FIT_R4}, n_train FROM fitted""",
    "final_model": f"""WITH {SHOTS}, {_newton('shots', _ALL, 'true')}
SELECT t.term, {r4('t.value')} AS value
FROM fitted, unnest([{{'term': 'distance_to_goal', 'value': b1}}, {{'term': 'shot_angle', 'value': b2}},
                     {{'term': 'intercept', 'value': b0}}]) AS u(t)""",
    "train_cv_metrics": f"""WITH RECURSIVE {GAPPY}, {GREEDY_FOLDS}, {_newton('folded', _FOLD_SIDES, 'r.fold <> w.side')},
scored AS (
  SELECT f.*, 1.0E0 / (1.0E0 + exp(-(b0 + b1 * distance_to_goal + b2 * shot_angle))) AS p
  FROM folded f JOIN fitted m ON f.fold = m.side), {FOLD_METRICS}
SELECT fold, n, goals, {r4('log_loss')} AS log_loss, {r4('roc_auc')} AS roc_auc, {r4('brier')} AS brier FROM fm""",
    "train_report": f"""WITH {GAPPY}, {_newton('shots', _ALL, 'true')}
SELECT (SELECT count(*) FROM all_shots) - n_train AS rows_dropped, n_train AS n_rows,
       (SELECT count(DISTINCT match_id) FROM shots) AS n_groups, {_FIT_R4} FROM fitted""",
    "open_data_competitions": f"WITH {RAW}, {CATALOGUE}\nSELECT competition_id, competition_name, season_id, season_name FROM competitions",
    "open_data_matches": f"WITH {RAW}, {CATALOGUE}\nSELECT match_id, season_id, season_name FROM season_matches",
    "open_data_events": f"""WITH {RAW}
SELECT match_id, type_name, period, minute, player_name, shot_type, outcome, body_part,
       {r6('statsbomb_xg')} AS statsbomb_xg FROM raw""",
    "build_shots": f"WITH {RAW}, {CATALOGUE}, {_clean_from('etl_raw')}\n{CLEAN_SELECT}",
    "event_file_ledger": f"""WITH {RAW}, {CATALOGUE},
per_season AS (SELECT CAST(c_nationkey AS BIGINT) AS season_id, count(*) AS n FROM customer GROUP BY 1),
per_match AS (SELECT match_id, count(*) AS n FROM raw GROUP BY match_id),
season_files AS (
  SELECT 'matches' AS kind, s.season_id AS id, coalesce(p.n, 0) AS n,
         CASE WHEN p.n IS NULL OR s.season_id % 5 = 2 THEN 'missing' WHEN s.season_id % 5 = 3 THEN 'corrupt' ELSE 'read' END AS outcome
  FROM seasons s LEFT JOIN per_season p USING (season_id)),
event_files AS (
  SELECT 'events' AS kind, i.match_id AS id, coalesce(p.n, 0) AS n,
         CASE WHEN i.match_id % 19 = 3 THEN 'corrupt' WHEN i.match_id % 19 = 5 THEN 'empty'
              WHEN i.match_id % 19 = 7 OR p.n IS NULL THEN 'missing' ELSE 'read' END AS outcome
  FROM (SELECT DISTINCT match_id FROM season_matches WHERE season_id % 5 NOT IN (2, 3)) i LEFT JOIN per_match p USING (match_id))
SELECT kind, id, outcome, CAST(CASE WHEN outcome = 'read' THEN n ELSE 0 END AS BIGINT) AS records,
       CAST(CASE WHEN outcome = 'corrupt' THEN 1 ELSE 0 END AS BIGINT) AS unreadable
FROM (SELECT * FROM season_files UNION ALL SELECT * FROM event_files)""",
    "incremental_ingest": f"""WITH {RAW},
per AS (SELECT match_id, count(*) AS n, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS even FROM raw GROUP BY match_id)
SELECT match_id, CAST(CASE WHEN match_id % 10 = 1 AND even > 0 OR match_id % 10 <> 1 AND match_id % 3 = 0
                           THEN 2 ELSE 1 END AS INTEGER) AS run,
       CASE WHEN match_id % 10 = 1 AND even > 0 THEN even ELSE n END AS events
FROM per WHERE match_id IS NOT NULL AND NOT (match_id % 10 = 1 AND even = 0 AND match_id % 3 = 0)""",
    "stored_build_shots": f"WITH {RAW}, {CATALOGUE}, {_clean_from('etl_raw')}\n{CLEAN_SELECT}",
    "csv_column_orders": f"""WITH {SHOTS}
{_SHOTS_OUT}, is_goal, CASE WHEN shot_id % 2 = 1 THEN 'n' END AS note FROM shots""",
    "csv_round_trip": f"WITH {SHOTS}\n{_SHOTS_OUT}, is_goal FROM shots",
    "model_round_trip": OOF.replace("WITH ", "WITH RECURSIVE ", 1),
    "stream_scores": _score_sql(SERVICE_MODEL),
}

ORACLE["stored_audit"] = ORACLE["ingest_audit"].replace(
    "FROM m, c, f", """,
       (SELECT count(*) FROM seasons WHERE season_id NOT IN (SELECT season_id FROM season_matches)) AS seasons_without_matches,
       CAST(0 AS BIGINT) AS event_files_skipped
FROM m, c, f""").replace("dropped_missing, goals\n,", "dropped_missing, goals,")
