"""Property tests: Spark operators against row-by-row Python models of the
behaviour being reproduced, on random inputs."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from xgspark.functions.geometry import distance_to_goal, shot_angle
from xgspark.operators.cleaning import clean_shots

NAMED = "struct<id:bigint,name:string>"
SCHEMA = (f"eid long, match_id long, type {NAMED}, period int, location string, "
          f"shot_type string, shot_outcome {NAMED}, player {NAMED}, player_name string")

coord = st.one_of(st.floats(-10, 140, allow_nan=False, width=32).map(float),
                  st.integers(-10, 140))
element = st.one_of(coord, coord.map(lambda v: str(v)), st.none(), st.just("a"), st.just("nan"))
location = st.one_of(st.none(), st.just('"oops"'),
                     st.lists(element, min_size=0, max_size=3).map(json.dumps))
named = lambda names: st.one_of(st.none(), st.tuples(st.just(1), st.one_of(st.none(), st.sampled_from(names))))
row = st.tuples(
    named(["Shot", "Pass"]),
    st.one_of(st.none(), st.integers(1, 5)),
    location,
    st.one_of(st.none(), st.sampled_from(["Penalty", "Open Play", "Free Kick"])),
    named(["Goal", "Saved", "Off T"]),
    named(["A", "B"]),
    st.one_of(st.none(), st.sampled_from(["Flat"])),
)


def _to_float(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _model(rows):
    """Row-by-row model of the cleaning rules (written for these tests)."""
    out = []
    for eid, (typ, period, loc, shot_type, outcome, player, player_name) in enumerate(rows):
        if typ is None or typ[1] != "Shot":
            continue
        arr = json.loads(loc) if loc is not None else None
        if not isinstance(arr, list) or len(arr) < 2:
            continue
        x, y = _to_float(arr[0]), _to_float(arr[1])
        if x is None or y is None:
            continue
        if shot_type == "Penalty" or period == 5:
            continue
        if math.isnan(x) or math.isnan(y):
            continue
        name = player_name if player_name is not None else (player[1] if player is not None else None)
        goal = 1 if outcome is not None and outcome[1] == "Goal" else 0
        out.append((eid, x, y, goal, name))
    return out


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=40))
def test_cleaning_matches_row_model(spark, rows):
    df = spark.createDataFrame([(i, 7, *r) for i, r in enumerate(rows)], SCHEMA)
    got = sorted((r.x, r.y, r.is_goal, r.player_name) for r in clean_shots(df).collect())
    want = sorted((x, y, g, n) for _, x, y, g, n in _model(rows))
    assert got == want


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-50, 200, allow_nan=False), st.floats(-50, 150, allow_nan=False)),
                min_size=1, max_size=50))
def test_geometry_matches_math(spark, pts):
    df = spark.createDataFrame(pts, "x double, y double")
    rows = df.select("x", "y", distance_to_goal("x", "y").alias("d"), shot_angle("x", "y").alias("a")).collect()
    for r in rows:
        d = math.sqrt((120 - r.x) ** 2 + (40 - r.y) ** 2)
        a = abs(math.atan2(36 - r.y, 120 - r.x) - math.atan2(44 - r.y, 120 - r.x))
        if a > math.pi:
            a = 2 * math.pi - a
        assert r.d == pytest.approx(d, rel=1e-12, abs=1e-12)
        assert r.a == pytest.approx(math.degrees(a), rel=1e-9, abs=1e-9)


_ABSENT = object()
field_value = st.one_of(st.just(_ABSENT), st.none(), st.booleans(),
                        st.integers(-5, 200), st.floats(-5, 200, allow_nan=False).map(lambda v: round(v, 3)),
                        st.integers(-5, 200).map(str))


def _body(d, a):
    obj = {}
    if d is not _ABSENT:
        obj["distance_meters"] = d
    if a is not _ABSENT:
        obj["angle_degrees"] = a
    return json.dumps(obj)


def _coerce(v, mode):
    """(present, number or None) under the contract's typing rules."""
    if v is _ABSENT:
        return False, None
    if isinstance(v, bool):
        return True, (float(v) if mode == "lax" else None)
    if isinstance(v, (int, float)):
        return True, float(v)
    if isinstance(v, str) and mode == "lax":
        try:
            return True, float(v)
        except ValueError:
            return True, None
    return True, None


def _expected(d, a, mode):
    from xgspark.config import LAX_MESSAGES, STRICT_MESSAGES

    m = STRICT_MESSAGES if mode == "strict" else LAX_MESSAGES
    errors = {}
    dp, dv = _coerce(d, mode)
    if not dp:
        errors["distance_meters"] = [m["distance_meters"]["required"]]
    elif dv is None:
        errors["distance_meters"] = [m["distance_meters"]["type"]]
    elif not dv > 0:
        errors["distance_meters"] = [m["distance_meters"]["gt"]]
    ap, av = _coerce(a, mode)
    if not ap:
        errors["angle_degrees"] = [m["angle_degrees"]["required"]]
    elif av is None:
        errors["angle_degrees"] = [m["angle_degrees"]["type"]]
    elif av < 0:
        errors["angle_degrees"] = [m["angle_degrees"]["ge"]]
    elif av > 180:
        errors["angle_degrees"] = [m["angle_degrees"]["le"]]
    return errors


@pytest.mark.parametrize("mode", ["strict", "lax"])
@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(field_value, field_value), min_size=1, max_size=60))
def test_json_validation_matches_contract_model(spark, mode, pairs):
    from xgspark.operators.validation import validate_json

    df = spark.createDataFrame([(i, _body(d, a)) for i, (d, a) in enumerate(pairs)], "i int, body string")
    got = {r.i: (r.status, r.errors) for r in validate_json(df, "body", mode).collect()}
    for i, (d, a) in enumerate(pairs):
        errors = _expected(d, a, mode)
        assert got[i] == ("ok" if not errors else "rejected", errors), (_body(d, a), mode)


@settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 30), min_size=2, max_size=40))
def test_greedy_folds_match_python_greedy(spark, sizes):
    from xgspark.operators.folds import fold_map

    rows = [(g,) for g, n in enumerate(sizes) for _ in range(n)]
    got = {r.match_id: r.fold for r in fold_map(spark.createDataFrame(rows, "match_id long")).collect()}
    k = min(5, len(sizes))
    loads, want = [0] * k, {}
    for g, n in sorted(enumerate(sizes), key=lambda t: (-t[1], -t[0])):
        f = loads.index(min(loads))
        loads[f] += n
        want[g] = f
    assert got == want


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=80),
       st.sampled_from([1, 3, 8]))
def test_auc_matches_pair_count(spark, rows, buckets):
    from xgspark.operators.metrics import roc_auc

    df = spark.createDataFrame([(f, p / 10.0, y) for f, p, y in rows], "fold int, p double, is_goal int")
    got = {r.fold: r.roc_auc for r in roc_auc(df, "p", "is_goal", "fold", buckets=buckets).collect()}
    for f in {f for f, _, _ in rows}:
        pos = [p for g, p, y in rows if g == f and y == 1]
        neg = [p for g, p, y in rows if g == f and y == 0]
        if not pos or not neg:
            assert got[f] is None
            continue
        s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
        assert got[f] == pytest.approx(s / (len(pos) * len(neg)), abs=1e-12)
