"""Column names, value sets and code tables that callers rely on."""

from __future__ import annotations

IDENTITY = ["fixture_id", "kickoff", "competition_id", "season_id", "home_team_id", "away_team_id"]
TARGETS = ["home_win", "draw", "away_win", "home_goals", "away_goals"]
SIDES = ("home", "away")
LEAGUE = ["competition_id", "season_id"]
TEAM = [*LEAGUE, "team_id"]

FORM = [f"{s}_{what}_last_{n}" for s in SIDES for n in (3, 5, 10) for what in ("wins", "draws", "losses")] + [
    f"{s}_points_last_{n}" for s in SIDES for n in (5, 10)
]
GOALS = [f"{s}_goals_{d}_last_{n}" for s in SIDES for n in (5, 10) for d in ("for", "against")] + [
    f"{s}_goals_{d}_mean_last_{n}" for s in SIDES for n in (5, 10) for d in ("for", "against")
]
SPLIT = [f"{s}_{s}_{what}_last_5" for s in SIDES for what in ("points", "goals_for", "goals_against")]
H2H = ["h2h_home_wins", "h2h_away_wins", "h2h_draws", "h2h_total_goals_mean", "h2h_sample_size"]
TABLE = [f"{s}_{what}" for what in ("table_position", "points_table", "goal_difference_table") for s in SIDES] + [
    "table_points_difference",
    "table_goal_difference_difference",
]
REST = [f"{s}_rest_days" for s in SIDES]
ELO = ["home_elo_pre_match", "away_elo_pre_match", "elo_difference"]
XG = [f"{s}_{x}_season_asof" for s in SIDES for x in ("xg", "xga")]

FEATURES = FORM + GOALS + SPLIT + H2H + TABLE + REST + ELO + XG
DATASET_COLUMNS = IDENTITY + FEATURES + TARGETS
DOUBLE_FEATURES = {n for n in FEATURES if "_mean_" in n or n.endswith("_mean") or n in ELO or n in XG}

# Columns that both goal heads read; each head adds its own side's columns.
SHARED = H2H + ["elo_difference", "table_points_difference", "table_goal_difference_difference"]
HEAD = {
    side: [n for n in FEATURES if n.startswith(f"{side}_")] + SHARED
    for side in SIDES
}

# Code tables of the landed payload formats.
STATUS_FORMAT_A = {
    "TBD": "scheduled",
    "NS": "scheduled",
    "1H": "in_play",
    "2H": "in_play",
    "ET": "in_play",
    "BT": "in_play",
    "P": "in_play",
    "SUSP": "suspended",
    "INT": "suspended",
    "PST": "postponed",
    "CANC": "cancelled",
    "ABD": "cancelled",
    "AWD": "finished",
    "WO": "finished",
    "FT": "finished",
    "AET": "finished",
    "PEN": "finished",
}
STATUS_FORMAT_B = {
    "scheduled": "scheduled",
    "upcoming": "scheduled",
    "ns": "scheduled",
    "tbd": "scheduled",
    "notstarted": "scheduled",
    "not_started": "scheduled",
    "live": "in_play",
    "in_play": "in_play",
    "inplay": "in_play",
    "1h": "in_play",
    "2h": "in_play",
    "ht": "in_play",
    "et": "in_play",
    "p": "in_play",
    "finished": "finished",
    "ft": "finished",
    "aet": "finished",
    "pen": "finished",
    "postponed": "postponed",
    "pst": "postponed",
    "cancelled": "cancelled",
    "canc": "cancelled",
    "abd": "cancelled",
    "suspended": "suspended",
    "susp": "suspended",
    "int": "suspended",
}
POSITIONS = {
    "GK": "GK",
    "DF": "DF",
    "MF": "MF",
    "FW": "FW",
    "Goalkeeper": "GK",
    "Defender": "DF",
    "Midfielder": "MF",
    "Attacker": "FW",
}
MATCH_STATUSES = ["scheduled", "in_play", "finished", "postponed", "cancelled", "suspended"]
COMPETITION_TYPES = ["league", "cup", "playoff", "super_cup"]
INJURY_STATUSES = ["active", "doubtful", "recovered", "suspended"]
MODEL_NAMES = ["elo_baseline", "poisson", "gradient_boosting", "lightgbm"]

FEATURE_VERSION = "fd_v1"
SCHEMA_VERSION = "schema_v1"
