"""Fixed values that results depend on.

FIXED VALUES: these must equal the behaviour being reproduced, so they are
stated here plainly and in one place.
"""

# --- FIXED VALUES: pitch and goal geometry (yards, attacking towards x = 120) ---
GOAL_CENTER = (120.0, 40.0)
GOAL_POST_NEAR = (120.0, 36.0)
GOAL_POST_FAR = (120.0, 44.0)

# --- FIXED VALUES: unit conversion ---
YARDS_PER_METER = 1.09361

# --- FIXED VALUES: interpretation buckets, descending, ">=" and first match wins ---
INTERPRETATION_THRESHOLDS = (
    (0.50, "High quality chance"),
    (0.20, "Good chance"),
    (0.08, "Moderate probability effort"),
    (0.00, "Low probability effort"),
)

# --- FIXED VALUES: event filters ---
SHOT_TYPE_NAME = "Shot"
PENALTY_SHOT_TYPE = "Penalty"
SHOOTOUT_PERIOD = 5
GOAL_OUTCOME = "Goal"
DEFAULT_COMPETITION_ID = 43

# --- FIXED VALUES: candidate columns for display names, in lookup order ---
SHOT_TYPE_CANDIDATES = ("shot_type_name", "shot_type")
SHOT_OUTCOME_CANDIDATES = ("shot_outcome_name", "shot_outcome")
BODY_PART_CANDIDATES = ("shot_body_part_name", "shot_body_part")
PLAYER_CANDIDATES = ("player_name", "player")
TEAM_CANDIDATES = ("team_name", "team")

# --- FIXED VALUES: model / training contract ---
FEATURE_COLUMNS = ("distance_to_goal", "shot_angle")
TARGET_COLUMN = "is_goal"
GROUP_COLUMN = "match_id"
N_SPLITS = 5
# Columns whose absence drops a clean shot after feature engineering.
CRITICAL_COLUMNS = ("x", "y", "is_goal", "distance_to_goal")
# Probability clip for log loss: float64 machine epsilon.
LOG_LOSS_EPS = 2.220446049250313e-16

# --- FIXED VALUES: request validation messages (gateway, strict mode) ---
STRICT_MESSAGES = {
    "distance_meters": {
        "required": "distance_meters is required",
        "type": "distance_meters must be a number",
        "gt": "distance_meters must be greater than 0",
    },
    "angle_degrees": {
        "required": "angle_degrees is required",
        "type": "angle_degrees must be a number",
        "ge": "angle_degrees must be >= 0",
        "le": "angle_degrees must be <= 180",
    },
}

# --- FIXED VALUES: request validation messages (service, lax mode) ---
LAX_MESSAGES = {
    "distance_meters": {
        "required": "Field required",
        "type": "Input should be a valid number",
        "gt": "Input should be greater than 0",
    },
    "angle_degrees": {
        "required": "Field required",
        "type": "Input should be a valid number",
        "ge": "Input should be greater than or equal to 0",
        "le": "Input should be less than or equal to 180",
    },
}

# --- FIXED VALUES: request disposition ---
STATUS_OK = "ok"
STATUS_REJECTED = "rejected"
STATUS_MODEL_UNAVAILABLE = "model_unavailable"
HTTP_STATUS = {STATUS_OK: 200, STATUS_REJECTED: 422, STATUS_MODEL_UNAVAILABLE: 503}
# The gateway relays any non-2xx answer of the service as 502.
GATEWAY_RELAY_STATUS = 502

# --- FIXED VALUES: the gateway's error titles ---
GATEWAY_VALIDATION_ERROR = "Validation failed"
GATEWAY_SERVICE_ERROR = "ML service error"
