"""Column expressions.  Everything here is a native Catalyst expression, so it
stays inside whole-stage code generation; there is no Python UDF."""

from xgspark.functions.geometry import distance_to_goal, shot_angle, to_yards
from xgspark.functions.fields import goal_label, location_xy_variant, name_field, named_of_variant
from xgspark.functions.scoring import (
    logistic_probability, interpret_xg, round_half_up,
)

__all__ = [
    "distance_to_goal", "shot_angle", "to_yards", "name_field", "location_xy_variant",
    "named_of_variant", "goal_label", "logistic_probability", "interpret_xg",
    "round_half_up",
]
