"""Request validation as a table operator (V1-V5).

Two contracts are reproduced: the gateway's *strict* one (only JSON
numbers are numbers) and the service's *lax* one (numeric text and booleans
are coerced).  Every failing field is reported, not only the first, as a
``map<string, array<string>>`` from field to messages; ``status`` carries
the disposition (``ok`` / ``rejected`` / later ``model_unavailable``).
Everything is a Catalyst expression over the row -- no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xgspark.config import (
    LAX_MESSAGES, STATUS_OK, STATUS_REJECTED, STRICT_MESSAGES,
)

DISTANCE = "distance_meters"
ANGLE = "angle_degrees"
_ERRORS_TYPE = "map<string,array<string>>"
_LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"
_NUMERIC_VARIANT_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _messages(mode: str) -> dict:
    if mode == "strict":
        return STRICT_MESSAGES
    if mode == "lax":
        return LAX_MESSAGES
    raise ValueError(f"mode must be 'strict' or 'lax', not {mode!r}")


def _is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _distance_message(v: Column, present: Column, is_number: Column, mode: str) -> Column:
    m = _messages(mode)[DISTANCE]
    # NOT (v > 0) also catches NaN in lax mode (NaN fails every comparison
    # there); Spark orders NaN above everything, so test it explicitly.
    bad_range = F.isnan(v) | ~(v > F.lit(0.0))
    return (F.when(~present, F.lit(m["required"]))
             .when(~is_number, F.lit(m["type"]))
             .when(bad_range, F.lit(m["gt"])))


def _angle_message(v: Column, present: Column, is_number: Column, mode: str) -> Column:
    m = _messages(mode)[ANGLE]
    return (F.when(~present, F.lit(m["required"]))
             .when(~is_number, F.lit(m["type"]))
             .when(F.isnan(v) | (v < F.lit(0.0)), F.lit(m["ge"]))
             .when(v > F.lit(180.0), F.lit(m["le"])))


def error_map(d_msg: Column, a_msg: Column) -> Column:
    """Field -> messages for the failing fields only (V3).

    A ``CASE`` over ``create_map`` (fully code-generated) rather than a
    filtered array of entries (a higher-order function, interpreted).
    """
    d = (F.lit(DISTANCE), F.array(d_msg))
    a = (F.lit(ANGLE), F.array(a_msg))
    empty = F.create_map().cast(_ERRORS_TYPE)
    return (F.when(d_msg.isNotNull() & a_msg.isNotNull(), F.create_map(*d, *a))
             .when(d_msg.isNotNull(), F.create_map(*d))
             .when(a_msg.isNotNull(), F.create_map(*a))
             .otherwise(empty))


def _finish(df: DataFrame, d_msg: Column, a_msg: Column, body_ok: Column | None = None) -> DataFrame:
    """Add ``errors`` (failing fields only) and ``status``; a body that is not
    an object is rejected with an empty map."""
    errors = error_map(d_msg, a_msg)
    if body_ok is not None:
        errors = F.when(body_ok, errors).otherwise(F.create_map().cast(_ERRORS_TYPE))
    ok = F.size("errors") == 0
    if body_ok is not None:
        ok = body_ok & ok
    return (df.withColumn("errors", errors)
              .withColumn("status", F.when(ok, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_REJECTED))))


def validate_shots(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Range and presence rules on typed columns (V1, V3).

    ``distance_meters > 0`` and ``0 <= angle_degrees <= 180``.  NULL means
    the field was absent.  In strict mode NaN / infinity are not numbers; in
    lax mode they are numbers that then fail (or pass) the range rules.
    """
    d, a = F.col(DISTANCE).cast("double"), F.col(ANGLE).cast("double")
    strict = mode == "strict"
    d_num = _is_finite(d) if strict else F.lit(True)
    a_num = _is_finite(a) if strict else F.lit(True)
    d_msg = _distance_message(d, d.isNotNull(), d_num, mode)
    a_msg = _angle_message(a, a.isNotNull(), a_num, mode)
    return _finish(df, d_msg, a_msg)


def _json_field(body_v: Column, field: str, mode: str) -> tuple[Column, Column, Column]:
    """(present, is_number, value) of one field of a parsed JSON body."""
    fv = F.try_variant_get(body_v, f"$.{field}", "variant")
    present = fv.isNotNull()
    kind = F.schema_of_variant(fv)
    numeric = kind.isin(*_NUMERIC_VARIANT_TYPES) | kind.startswith("DECIMAL")
    num_value = F.try_variant_get(body_v, f"$.{field}", "double")
    if mode == "strict":
        numeric = numeric & F.coalesce(_is_finite(num_value), F.lit(False))
        return present, numeric, F.when(numeric, num_value)
    # lax: numbers, numeric text and booleans are coerced to float
    text_value = F.try_variant_get(body_v, f"$.{field}", "string").try_cast("double")
    bool_value = F.try_variant_get(body_v, f"$.{field}", "boolean").cast("double")
    value = (F.when(numeric, num_value)
              .when(kind == "STRING", text_value)
              .when(kind == "BOOLEAN", bool_value))
    return present, value.isNotNull(), value


def _last_key_wins(spark) -> None:
    """Of equal keys of a JSON object the last one counts, as in the parsers of
    both contracts; without this setting such a body would be no JSON at all."""
    if spark.conf.get(_LAST_KEY_WINS, "false") != "true":
        spark.conf.set(_LAST_KEY_WINS, "true")


def validate_json(df: DataFrame, json_col: str = "body", mode: str = "strict") -> DataFrame:
    """Validate raw JSON request bodies (V2, V3).

    Tells apart an absent field ("is required"), a JSON null or wrong type
    ("must be a number"), and a range failure.  A body that is not a JSON
    object is rejected with an empty field map.  Of equal keys the last one
    counts; a number beyond the range of a double is infinite, which is no
    number in strict mode.  Adds ``distance_meters``
    and ``angle_degrees`` (parsed values, NULL where not numbers),
    ``errors`` and ``status``.
    """
    _last_key_wins(df.sparkSession)
    # Parse once: a one-element explode keeps Catalyst from inlining (and so
    # repeating) the parse into every expression and predicate that uses it.
    parsed = df.select("*", F.explode(F.array(F.try_parse_json(F.col(json_col)))).alias("__body"))
    v = F.col("__body")
    body_ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    dp, dn, dv = _json_field(v, DISTANCE, mode)
    ap, an, av = _json_field(v, ANGLE, mode)
    staged = parsed.select(*df.columns, body_ok.alias("__ok"),
                           dp.alias("__dp"), dn.alias("__dn"), dv.alias("__dv"),
                           ap.alias("__ap"), an.alias("__an"), av.alias("__av"))
    d, a = F.col("__dv"), F.col("__av")
    out = staged.withColumn(DISTANCE, d).withColumn(ANGLE, a)
    res = _finish(out, _distance_message(d, F.col("__dp"), F.col("__dn"), mode),
                  _angle_message(a, F.col("__ap"), F.col("__an"), mode), F.col("__ok"))
    return res.drop("__ok", "__dp", "__dn", "__dv", "__ap", "__an", "__av")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows go on to scoring, the others come back with detail (V4).

    Two filters over one plan; on a stream, write both from ``foreachBatch``.
    """
    ok = F.col("status") == F.lit(STATUS_OK)
    return validated.filter(ok), validated.filter(~ok)
