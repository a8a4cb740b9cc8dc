"""Batch scoring of request tables (E3): validate, score, shape the response.

The same expression chain serves batch tables and streams (E4), so the two
cannot disagree.  The model is applied as literals (loaded once per job, as
the service loads it once per process): the probability stays a native
expression inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.config import (
    GATEWAY_RELAY_STATUS, GATEWAY_SERVICE_ERROR, GATEWAY_VALIDATION_ERROR, HTTP_STATUS,
    STATUS_MODEL_UNAVAILABLE, STATUS_OK, STATUS_REJECTED,
)
from xgspark.functions.geometry import to_yards
from xgspark.functions.scoring import interpret_xg, logistic_probability, round_half_even
from xgspark.operators.validation import ANGLE, DISTANCE, validate_json, validate_shots

def score_requests(validated: DataFrame, model: dict | DataFrame | None) -> DataFrame:
    """Score rows that passed validation.

    ``interpretation`` uses the unrounded probability; the response shows
    probability and yards rounded to 4 decimals (exact value, half to even).  Without a model,
    valid rows get ``status = 'model_unavailable'``.
    """
    if isinstance(model, DataFrame):      # a model table as returned by load_model
        from xgspark.operators.model import model_as_dict
        model = model_as_dict(model)
    ok = F.col("status") == F.lit(STATUS_OK)
    yards = to_yards(F.col(DISTANCE))
    if model is None:
        p = F.lit(None).cast("double")
        status = F.when(ok, F.lit(STATUS_MODEL_UNAVAILABLE)).otherwise(F.col("status"))
    else:
        p = F.when(ok, logistic_probability(model["intercept"],
                                            (model["coef_distance"], model["coef_angle"]),
                                            (yards, F.col(ANGLE))))
        status = F.col("status")
    scored = validated.withColumn("__p", p).withColumn("status", status)
    http = F.when(F.col("status") == STATUS_OK, F.lit(HTTP_STATUS[STATUS_OK])) \
            .when(F.col("status") == STATUS_MODEL_UNAVAILABLE, F.lit(HTTP_STATUS[STATUS_MODEL_UNAVAILABLE])) \
            .otherwise(F.lit(HTTP_STATUS["rejected"]))
    # The gateway answers its own validation failures (422) and relays any
    # non-2xx answer of the service as 502.
    gateway = F.when(F.col("status") == STATUS_OK, F.lit(HTTP_STATUS[STATUS_OK])) \
               .when(F.col("status") == STATUS_REJECTED, F.lit(HTTP_STATUS[STATUS_REJECTED])) \
               .otherwise(F.lit(GATEWAY_RELAY_STATUS))
    served = F.col("status") == F.lit(STATUS_OK)
    return (scored
            .withColumn("http_status", http)
            .withColumn("gateway_status", gateway)
            .withColumn("error", F.when(F.col("status") == STATUS_REJECTED, F.lit(GATEWAY_VALIDATION_ERROR))
                                  .when(F.col("status") != STATUS_OK, F.lit(GATEWAY_SERVICE_ERROR)))
            .withColumn("xg_probability", F.when(served, round_half_even(F.col("__p"), 4)))
            .withColumn("distance_yards", F.when(served, round_half_even(yards, 4)))
            .withColumn("interpretation", F.when(served, interpret_xg(F.col("__p"))))
            .drop("__p"))


def score_batch(requests: DataFrame, model: dict | DataFrame | None, validate: bool = True,
                mode: str = "strict") -> DataFrame:
    """Validate (optional, as the command-line path skips it) and score."""
    if validate:
        v = validate_shots(requests, mode)
    else:
        # No range checks, but a missing (NULL or NaN) input cannot be scored.
        absent = [F.col(c).isNull() | F.isnan(c) for c in (DISTANCE, ANGLE)]
        v = requests.withColumn("errors", F.create_map().cast("map<string,array<string>>")) \
                    .withColumn("status", F.when(absent[0] | absent[1], F.lit(STATUS_REJECTED))
                                           .otherwise(F.lit(STATUS_OK)))
    return score_requests(v, model)


def score_json(requests: DataFrame, model: dict | DataFrame | None, json_col: str = "body",
               mode: str = "strict") -> DataFrame:
    """Raw JSON request bodies end to end: the gateway's validation of the
    body (strict by default, V2), then scoring of the valid rows (E3)."""
    return score_requests(validate_json(requests, json_col, mode), model)
