"""Shot geometry (X1-X3) as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from xgspark.config import GOAL_CENTER, GOAL_POST_FAR, GOAL_POST_NEAR, YARDS_PER_METER


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance_to_goal(x, y) -> Column:
    """Euclidean distance from (x, y) to the centre of the goal."""
    gx, gy = GOAL_CENTER
    dx = F.lit(gx) - _col(x)
    dy = F.lit(gy) - _col(y)
    return F.sqrt(dx * dx + dy * dy)


def shot_angle(x, y) -> Column:
    """Angle (degrees) subtended by the two posts as seen from (x, y).

    Absolute difference of the two ``atan2`` bearings, folded into [0, pi].
    A shot exactly on a post has ``atan2(0, 0) = 0`` for that post.
    """
    (p1x, p1y), (p2x, p2y) = GOAL_POST_NEAR, GOAL_POST_FAR
    a1 = F.atan2(F.lit(p1y) - _col(y), F.lit(p1x) - _col(x))
    a2 = F.atan2(F.lit(p2y) - _col(y), F.lit(p2x) - _col(x))
    r = F.abs(a1 - a2)
    folded = F.when(r > F.lit(math.pi), F.lit(2 * math.pi) - r).otherwise(r)
    return F.degrees(folded)


def to_yards(meters) -> Column:
    """Metres to yards."""
    return _col(meters) * F.lit(YARDS_PER_METER)
