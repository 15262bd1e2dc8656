"""Table schemas, fixed vocabularies and argument checks."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# Unit levels from fine to coarse, and their child level.
LEVELS = ("day", "week", "month", "year")
CHILD_LEVEL = {"week": "day", "month": "week", "year": "month"}
# How many child units stand in for one missing earlier unit.
CHILDREN_PER_UNIT = {"week": 7, "month": 4, "year": 12}
# Profile projections.
PROFILE_MODES = ("full", "arc", "mentions")
# Which source types a search scope covers.
SEARCH_SCOPES = {
    "raw": ("raw",),
    "summaries": ("summary_day", "summary_week", "summary_month", "summary_year"),
    "day": ("summary_day",),
    "week": ("summary_week",),
    "month": ("summary_month",),
    "year": ("summary_year",),
    "all": ("raw", "summary_day", "summary_week", "summary_month", "summary_year"),
}
# Classification labels used when the caller gives none.
DEFAULT_CATEGORIES = (
    "self_reflection_psychology_therapy_dating",
    "other_personal",
    "coding_related",
    "other",
)
# Defaults of an entry's optional columns.
ENTRY_DEFAULTS = {"time": "00:00:00", "source": "unknown", "source_file": "",
                  "role": "user", "text": ""}

ENTRY_COLUMNS = ("id", "date", "time", "source", "source_file", "role", "text")

# Fixed values from here on: field names of the stored and imported JSON documents.
ENTRY_BODY = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("time", "source", "source_file", "role", "text")
])
DAY_FILE = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("entries", T.ArrayType(ENTRY_BODY)),
])
MERGED_FILE = T.StructType([T.StructField("entries", T.ArrayType(DAY_FILE))])

CHAT_FILE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("chat", T.StructType([
        T.StructField("messages", T.ArrayType(T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("timestamp", T.StringType()),
        ]))),
    ])),
])

TURN_FILE = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("datetime_parsed", "datetime_raw_parsed", "datetime_raw", "user", "text", "response")
])

_STRINGS = ("summary", "emotional_tone", "overall_vibe", "time_of_day_texture", "peak_moment",
            "scalar_metrics", "narrative_threads", "significant_delta", "physiological_flags",
            "relational_map", "entity_mentions", "avoidance_signals", "growth_markers",
            "coping_mechanisms", "self_perception_snapshot", "values_in_tension",
            "context_bridge", "thinking_trace", "model_used", "mode", "timestamp_processed")
_SCORES = ("energy_level", "social_connectedness", "forward_momentum")

SUMMARY_BODY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("unit", "period_start", "period_end")]
    + [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField(c, T.IntegerType()) for c in _SCORES]
    + [T.StructField(c, T.ArrayType(T.StringType()))
       for c in ("key_events", "questions_raised", "source_units")]
    + [T.StructField("entities", T.MapType(T.StringType(), T.StringType())),
       T.StructField("source_entry_count", T.LongType()),
       T.StructField("token_count_input", T.LongType()),
       T.StructField("token_count_output", T.LongType()),
       T.StructField("processing_time_seconds", T.DoubleType())]
)

KNOWLEDGE = T.StructType([
    T.StructField("valid_from", T.StringType()),
    T.StructField("valid_until", T.StringType()),
    T.StructField("source_entries", T.ArrayType(T.StringType())),
    T.StructField("content", T.StringType()),
    T.StructField("emotional_valence", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
PROFILE_BODY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("role_in_authors_life", T.StringType()),
    T.StructField("first_mentioned_in_diary", T.StringType()),
    T.StructField("stable_facts", T.MapType(T.StringType(), T.StringType())),
    T.StructField("timestamped_knowledge", T.ArrayType(KNOWLEDGE)),
    T.StructField("relationship_arc_summary", T.StringType()),
    T.StructField("arc_last_updated", T.StringType()),
])

USAGE_COLUMNS = ("timestamp", "model", "estimated_input_tokens", "actual_input_tokens",
                 "actual_output_tokens", "char_count", "empirical_ratio")


def check_level(level: str) -> str:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}, not {level!r}")
    return level


def check_mode(mode: str) -> str:
    if mode not in PROFILE_MODES:
        raise ValueError(f"mode must be one of {', '.join(PROFILE_MODES)}, not {mode!r}")
    return mode


def check_scope(scope: str) -> tuple[str, ...]:
    if scope not in SEARCH_SCOPES:
        raise ValueError(f"scope must be one of {', '.join(sorted(SEARCH_SCOPES))}, not {scope!r}")
    return SEARCH_SCOPES[scope]


def check_version(found: int) -> int:
    """A store written by a newer release is refused; an older one is accepted."""
    if found > SCHEMA_VERSION:
        raise ValueError(f"store has schema version {found}, this release reads {SCHEMA_VERSION}")
    return found
