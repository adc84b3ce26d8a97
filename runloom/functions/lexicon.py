"""Words, names and tables that decide results.

Everything here is data. Order matters wherever a list is searched from the
front, so keep it.
"""

from __future__ import annotations

# --- fixed values: texts that mean "nothing here" ---------------------------
BLANK_EXACT = ["", "nan", "None", "<NA>"]
BLANK_LOWER = ["", "nan", "none", "<na>"]
BLANK_CELL = ["", "nan", "none"]

# --- fixed values: yes / no words, one pair per kind of source ---------------
FINISH_YES = ["да", "yes", "true", "истина", "y"]
CELL_YES = ["да", "yes", "true", "истина", "1"]
INDICATOR_YES = ["да", "yes", "true", "1"]

# --- fixed values: subtotal words, default sequence id -----------------------
TOTAL_WORDS = ["итог", "сумма", "всего", "total", "summary"]
DEFAULT_SEQUENCE = "sequence_0"
_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
_INFINITY = r"[+-]?(?i:inf(inity)?)"
NUMBER_PATTERN = rf"^\s*({_NUMBER}|{_INFINITY})\s*$"
EPISODE_ID_PATTERN = rf"(?U)^\s*({_NUMBER}|{_INFINITY}|[a-zA-Zа-яА-Я]*\d+[a-zA-Zа-яА-Я]*)\s*$"
CELL_ID_PATTERN = rf"(?U)^\s*({_NUMBER}|{_INFINITY}|[a-zA-Z]*\d+[a-zA-Z]*)\s*$"
# the characters that count as blank at the ends of a text
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# --- fixed values: observed classes and labels -------------------------------
OBSERVED_CLASSES = [
    "zap_r", "zap_n", "zap_t", "hold", "arm_submission", "leg_submission", "no_score", "unknown",
]
CONFIDENCE_LABELS = ["high", "medium", "low"]

# --- fixed values: observation mapping ---------------------------------------
MAPPING_VERSION = "observation_mapping_v2"
SCORE_COLUMNS = ["outcomes__score", "observed_result", "баллы", "score"]
SCORE_CLASSES = {1: "zap_r", 2: "zap_n", 4: "zap_t"}
POSITION_CLASSES = {
    1: "zap_r", 2: "zap_n", 3: "zap_t", 4: "hold", 5: "arm_submission", 6: "leg_submission",
}
FINISH_ANY = {
    "zap_r": ["зап-р", "zap_r", "zap-r", "zap r"],
    "zap_n": ["зап-н", "zap_n", "zap-n", "zap n"],
    "zap_t": ["зап-т", "zap_t", "zap-t", "zap t"],
    "hold": ["удерж", "hold"],
    "arm_submission": ["arm_submission", "arm submission", "submission_arm"],
    "leg_submission": ["leg_submission", "leg submission", "submission_leg"],
}
FINISH_ALL = {"arm_submission": ["болев", "рук"], "leg_submission": ["болев", "ног"]}
POSITION_PATTERNS = [
    r"finish_action_(\d+)", r"outcome_action_indicator_(\d+)", r"finish_action(\d+)", r"outcome_action(\d+)",
]
FINISH_LIKE = [
    "finish", "outcome_action", "action_indicator", "заверша", "удерж", "болев", "submission", "throw", "брос",
]

# --- fixed values: header dictionary (header, field stem, block, how many) ---
# A header repeated n times arrives as header, header_2 … header_n and maps to
# stem_01 … stem_n.
REPEATED_HEADERS = [
    ("технико-тактический эпизод", "metadata__episode_attr", "metadata", 3),
    ("стойка и маневрирование самбиста (основные в эпизоде)", "maneuvering__indicator", "maneuvering", 24),
    ("контакты физического взаимодействия (захваты, обхваты, прихваты, хваты, упоры)", "kfv__indicator", "kfv", 29),
    ("выведение соперника из устойчивого положения (при выполнении n или n1)", "vup__indicator", "vup", 5),
    ("завершающие атаку приемы (n)", "outcomes__finish_action", "outcomes", 6),
]
SINGLE_HEADERS = [
    ("фио борца", "metadata__athlete_name", "metadata"),
    ("баллы", "outcomes__score", "outcomes"),
    ("_sheet", "metadata__sheet", "metadata"),
]
METADATA_ALIASES = {
    "_sheet": "metadata__sheet",
    "source_sheet": "metadata__sheet",
    "фио борца": "metadata__athlete_name",
    "athlete_name": "metadata__athlete_name",
    "episode_id": "metadata__episode_id",
    "episode_order": "metadata__episode_order",
    "episode_duration": "metadata__episode_duration",
    "pause_duration": "metadata__pause_duration",
    "баллы": "outcomes__score",
    "observed_result": "outcomes__score",
}
BLOCK_PREFIXES = ["metadata", "maneuvering", "kfv", "vup", "outcomes", "other"]
BLOCK_WORDS = [
    ("maneuvering", ["стойка", "маневр", "maneuver"]),
    ("kfv", ["кфв", "контакты физического взаимодействия", "захват", "обхват", "прихват", "хват", "упор"]),
    ("vup", ["вуп", "выведение", "vup"]),
    ("outcomes", ["балл", "результ", "score", "outcome", "заверша", "брос", "удерж", "болев"]),
    ("metadata", ["фио", "борца", "athlete", "fighter", "технико-тактический эпизод", "эпизод", "episode",
                  "время", "duration", "пауз", "pause", "sheet"]),
]
REQUIRED_BLOCKS = ["metadata", "maneuvering", "kfv", "vup", "outcomes"]
NUMERIC_BLOCKS = ["maneuvering", "kfv", "vup", "outcomes"]
EPISODE_NUMBER_WORDS = ["№ эпизода", "номер эпизода", "episode id", "episode number"]

# --- fixed values: cleaning --------------------------------------------------
ACTIVITY_WORDS = ["maneuver", "манев", "kfv", "контак", "vup", "выведение", "outcome", "заверша"]
CLEAN_ATHLETE = ["metadata__athlete_name", "фио борца", "athlete_name"]
CLEAN_SHEET = ["metadata__sheet", "_sheet", "sheet"]
CLEAN_EPISODE = ["metadata__episode_id", "номер эпизода", "episode_id", "metadata__episode_attr_01", "эпизод"]
CLEAN_RESULT = ["outcomes__score", "баллы", "observed_result", "результат"]
HEADER_LIKE_EPISODE = "эпизод|episode"

# --- fixed values: logical field -> candidate columns, best first ------------
FIELD_CANDIDATES = {
    "athlete_name": ["metadata__athlete_name", "athlete_name", "фио борца"],
    "athlete_id": ["metadata__athlete_id", "athlete_id", "metadata__athlete", "id_athlete"],
    "opponent_name": [
        "metadata__opponent_name", "metadata__opponent", "metadata__opponent_id", "metadata__opponent_full_name",
        "metadata__enemy", "metadata__rival_name", "metadata__rival", "opponent_name", "opponent",
        "opponent_full_name", "opponent_id", "rival_name", "enemy", "opp", "rival", "соперник", "оппонент",
        "противник",
    ],
    "sheet_name": ["metadata__sheet", "source_sheet", "_sheet", "sheet"],
    "weight_class": [
        "metadata__weight_class", "metadata__weight", "metadata__weight_category", "metadata__weight_division",
        "metadata__weight_kg", "weight_category", "weight_class", "weight_division", "division", "category_weight",
        "weight", "weight_kg", "весовая", "весовая категория", "вес", "вес_кг",
    ],
    "tournament_name": [
        "metadata__tournament", "metadata__tournament_name", "metadata__tournament_title", "metadata__event",
        "metadata__event_name", "metadata__competition", "metadata__competition_name", "metadata__cup",
        "metadata__league", "tournament", "tournament_name", "event", "event_name", "competition",
        "competition_name", "competition_title", "championship", "league", "cup", "турнир", "соревнован",
    ],
    "event_date": [
        "metadata__event_date", "metadata__date", "metadata__match_date", "metadata__competition_date",
        "metadata__bout_date", "metadata__fight_date", "event_date", "date", "match_date", "competition_date",
        "bout_date", "fight_date", "event_dt", "competition_dt", "дата", "дата проведения",
    ],
    "explicit_sequence_id": [
        "metadata__sequence_id", "metadata__sequence", "sequence_id", "sequence", "metadata__bout_id",
        "metadata__bout_number", "metadata__bout_num", "metadata__bout", "metadata__bout_no",
        "metadata__bout_sequence", "metadata__fight_number", "metadata__fight_no", "metadata__match_id",
        "metadata__match_number", "metadata__match_no", "metadata__fight_id", "bout_id", "bout", "bout_number",
        "bout_num", "bout_no", "bout_sequence", "bout_seq", "match_id", "match_no", "match_num", "match_number",
        "match", "fight_id", "fight_number", "fight_no", "fight", "номер_схватки", "номер поединка",
        "номер схватки", "схватка", "поединок",
    ],
    "episode_id": [
        "metadata__episode_id", "episode_id", "metadata__episode_order", "episode_order",
        "metadata__episode_attr_01_02", "metadata__episode_attr_01", "номер эпизода",
    ],
    "episode_time_sec": [
        "metadata__episode_duration", "metadata__episode_time_sec", "metadata__episode_sec",
        "metadata__episode_time_seconds", "metadata__time_episode", "episode_duration", "metadata__episode_time",
        "episode_time", "episode_time_sec", "episode_seconds", "time_episode_sec", "metadata__episode_attr_02_03",
        "metadata__time_attr_01_02", "round_time", "elapsed_time", "elapsed_sec", "fight_time_sec",
        "bout_time_sec", "time_sec", "time", "duration", "время эпизода", "время",
    ],
    "pause_time_sec": [
        "metadata__pause_duration", "metadata__pause_time_sec", "metadata__pause_sec",
        "metadata__pause_time_seconds", "pause_duration", "metadata__pause_time", "pause_time", "pause_time_sec",
        "pause_seconds", "metadata__episode_attr_03_04", "metadata__time_attr_02_03", "rest_time", "rest_sec",
        "break_time", "break_sec", "pause_sec", "pause", "время паузы",
    ],
    "score": ["outcomes__score", "observed_result", "баллы", "score"],
}
WEIGHT_WORDS = ["weight", "вес", "kg", "кг", "wt"]

# --- fixed values: feature engineering ---------------------------------------
MANEUVER_RIGHT_WORDS = ["стойка прав", "maneuver_right", "mr_"]
MANEUVER_LEFT_WORDS = ["стойка лев", "maneuver_left", "ml_"]
GROUP_WORDS = {
    "maneuvering": ["стойка и маневрирование", "maneuver"],
    "kfv": ["кфв", "захват", "хват", "обхват", "прихват", "упор", "kfv"],
    "vup": ["вуп", "выведение", "vup"],
    "outcomes": [],
}
GRIP_RANGES = {
    "grips": (1, 6), "holds": (7, 12), "bodylocks": (13, 18), "underhooks": (19, 24), "posts": (25, 29),
}
FEATURE_EPISODE = ["metadata__episode_id", "номер эпизода", "episode", "episode_id"]
FEATURE_DURATION = ["metadata__episode_duration", "время эпизода", "episode_duration", "duration"]
FEATURE_PAUSE = ["metadata__pause_duration", "pause_duration", "время паузы", "pause"]
FEATURE_RESULT = ["outcomes__score", "observed_result", "баллы", "результат", "оценка", "result"]
FEATURE_GROUPS = ["maneuvering", "kfv", "vup", "outcomes"]
MODEL_FEATURES = [
    "maneuver_right_code", "maneuver_left_code", "grips_code", "holds_code", "bodylocks_code",
    "underhooks_code", "posts_code", "kfv_code", "vup_code", "duration", "pause",
]
ENGINEERED_FEATURES = [
    "maneuver_right_code", "maneuver_left_code", "grips_code", "holds_code", "bodylocks_code",
    "underhooks_code", "posts_code", "kfv_code", "vup_code", "outcome_actions_code",
    "duration", "pause", "observed_result",
]
# canonical name <- engineered name
CODE_NAMES = {
    "maneuver_right_code": "maneuver_right_code",
    "maneuver_left_code": "maneuver_left_code",
    "kfv_capture_code": "grips_code",
    "kfv_grip_code": "holds_code",
    "kfv_wrap_code": "bodylocks_code",
    "kfv_hook_code": "underhooks_code",
    "kfv_post_code": "posts_code",
    "vup_code": "vup_code",
}
HIDDEN_LAYER = list(CODE_NAMES) + ["episode_time_sec", "pause_time_sec"]
BLOCK_FEATURES = {
    "maneuvering": ["maneuver_right_code", "maneuver_left_code"],
    "kfv": ["kfv_code", "grips_code", "holds_code", "bodylocks_code", "underhooks_code", "posts_code"],
    "vup": ["vup_code"],
}
BLOCK_WEIGHTS = {"maneuvering": 1.0, "kfv": 0.85, "vup": 1.35, "temporal": 0.90, "other": 1.0}

# --- fixed values: canonical episode columns, in order ------------------------
EPISODE_COLUMNS = [
    "athlete_name", "athlete_id", "sheet_name", "weight_class", "opponent_name", "tournament_name", "event_date",
    "episode_id", "sequence_id", "sequence_quality_flag", "sequence_resolution_type", "sequence_quality_reason",
    "episode_time_sec", "pause_time_sec", "score", "score_value", "score_rounded", "score_supported_class",
    "maneuver_right_code", "maneuver_left_code", "kfv_capture_code", "kfv_grip_code", "kfv_wrap_code",
    "kfv_hook_code", "kfv_post_code", "vup_code", "observed_zap_class", "observed_zap_source_columns",
    "finish_match_classes", "finish_match_columns", "observation_quality_flag", "observation_resolution_type",
    "observation_confidence_label", "mapping_version", "is_total_row", "is_train_eligible", "source_row_index",
    "source_record_id",
]

# --- fixed values: hidden states ----------------------------------------------
# (block, state name); a state takes the name when its block dominates
SEMANTIC_STATES = [("maneuvering", "S1"), ("kfv", "S2"), ("vup", "S3")]
EMISSION_BUMPS = [
    (0, {"no_score": 6.0, "zap_r": 3.0, "unknown": 2.0}),
    (1, {"hold": 4.0, "zap_n": 3.0, "zap_r": 2.0}),
    (2, {"zap_t": 4.0, "arm_submission": 4.0, "leg_submission": 4.0, "zap_n": 2.0}),
]

# --- fixed values: matrix sheets -----------------------------------------------
AXIS_HINTS = ["№ эпизода", "номер эпизода", "эпизод №", "episode id", "episode number"]
NAME_WORDS = ["фио", "athlete", "fighter", "борца"]
# kind of a row label: first line of which one list of words occurs, with all its words
LABEL_KINDS = [
    ("pause_duration", [["время", "пауз"]]),
    ("episode_duration", [["время", "эпизод"], ["длительность"]]),
    ("observed_result", [["балл"], ["очк"], ["результ"], ["score"], ["points"]]),
    ("maneuver_right_indicator", [["правосторон"], ["правой стойк"], ["стойка прав"], ["right"]]),
    ("maneuver_left_indicator", [["левосторон"], ["левой стойк"], ["стойка лев"], ["left"]]),
    ("kfv_bodylocks_indicator", [["обхват"]]),
    ("kfv_underhooks_indicator", [["прихват"]]),
    ("kfv_grips_indicator", [["захват"]]),
    ("kfv_posts_indicator", [["упор"]]),
    ("kfv_holds_indicator", [["хват"]]),
    ("vup_indicator", [["вуп"], ["выведен"], ["vup"]]),
    ("outcome_action_indicator", [["заверша"], ["атак"], ["прием"], ["finish"], ["outcome"]]),
]
NUMERIC_KINDS = ["episode_duration", "pause_duration", "observed_result"]

# --- fixed values: audits --------------------------------------------------------
AUDIT_FIELDS = [
    "athlete_name", "athlete_id", "sheet_name", "weight_class", "episode_id", "episode_time_sec",
    "pause_time_sec", "score", "opponent_name", "tournament_name", "event_date", "sequence_id",
]
AUDIT_NUMERIC_FIELDS = ["episode_time_sec", "pause_time_sec", "score"]
CONTEXT_FIELDS = ["weight_class", "opponent_name", "tournament_name", "event_date"]
