"""Queries of the reply parsers: replies are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from stratalog.functions import replies as R
from stratalog.registry import base as B
from stratalog.registry.base import query


def _replies(s, d):
    u = B.day_unit(s, d)
    text = F.concat(
        F.lit("=== MACHINE-READABLE INDEX ===\n\nOVERALL_VIBE: mixed (mostly)\n\nKey Events:\n- "),
        F.array_join("key_events", "\n• "), F.lit("\n\nSUMMARY: first draft\nSUMMARY: "),
        F.col("summary"), F.lit("\n=== HUMAN-READABLE NARRATIVE ===\nEMOTIONAL TONE - "),
        F.col("emotional_tone"), F.lit("\nQUESTIONS_RAISED: why, what for\nENERGY LEVEL: about "),
        F.col("energy_level").cast("string"), F.lit("/5\nSCALAR_METRICS:\n  ENERGY_LEVEL: 9\n"
                                                    "  SOCIAL_CONNECTEDNESS: "),
        F.col("social_connectedness").cast("string"),
        F.lit("\nENTITIES:\n- [Anna K.]: "), F.col("summary"), F.lit("\n  and left\n* Bob: none\n"),
        F.lit("PEAK_MOMENT:\n"), F.col("period_start"))
    return u.withColumn("reply", text)


query("parse_sections", """SELECT period_start, 'MIXED' AS overall_vibe, summary, emotional_tone,
  array_to_string(key_events, ',') AS key_events, 'why,what for' AS questions_raised, energy_level,
  social_connectedness, CAST(NULL AS INTEGER) AS forward_momentum, period_start AS peak_moment,
  'Anna K.=' || summary || ' and left;Bob=none' AS entities FROM day_unit""")(
    lambda s, d: R.parse_replies(_replies(s, d), "reply", "_s").select(
        "period_start", "_s.overall_vibe", "_s.summary", "_s.emotional_tone",
        F.array_join("_s.key_events", ",").alias("key_events"),
        F.array_join("_s.questions_raised", ",").alias("questions_raised"), "_s.energy_level",
        "_s.social_connectedness", "_s.forward_momentum", "_s.peak_moment",
        F.array_join(F.transform(F.map_entries("_s.entities"), lambda e: F.concat_ws(
            "=", e["key"], e["value"])), ";").alias("entities")))

query("parse_scores", r"""SELECT doc_id, TRY_CAST(regexp_extract(text, '(\d)', 1) AS INTEGER) AS score,
  TRY_CAST(regexp_extract('energy level - ' || n_chars, '(?i)ENERGY[_ ]LEVEL\s*[:\-]\s*(\d)', 1) AS INTEGER)
    AS energy FROM documents""")(
    lambda s, d: B.table(s, d, "documents").select(
        "doc_id", R.first_digit(F.col("text")).alias("score"),
        R.sub_score(F.concat(F.lit("energy level - "), F.col("n_chars").cast("string")),
                    "energy_level").alias("energy")))

# The engine behind the check upper-cases a sharp s to one letter, Spark and Python to two.
query("parse_keyword", r"""SELECT doc_id,
  nullif(upper(replace(regexp_extract(text, '^\s*(\S+)', 1), 'ß', 'ss')), '') AS word FROM documents""")(
    lambda s, d: B.table(s, d, "documents").select("doc_id", R.keyword("text").alias("word")))

query("parse_list", r"""SELECT doc_id, array_to_string(CASE WHEN len(items) = 1 AND contains(items[1], ',')
  THEN list_filter(list_transform(string_split(items[1], ','), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '')
  ELSE list_filter(items, lambda x: x <> '') END, '|') AS items
FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)),
        lambda l: trim(l, E' \t\n\r') <> ''),
        lambda l: trim(regexp_replace(l, '^[-•*]\s*', ''), E' \t\n\r')) AS items FROM documents)""")(
    lambda s, d: B.table(s, d, "documents").select(
        "doc_id", F.array_join(R.bullet_list("text"), "|").alias("items")))

query("strip_banners", """SELECT doc_id, rtrim(text, E' \\n\\t\\r') AS text FROM documents""")(
    lambda s, d: B.table(s, d, "documents").select("doc_id", R.strip_banners(F.concat(
        F.col("text"), F.lit("\n=== HUMAN-READABLE NARRATIVE ===\n"))).alias("text")))

_BODY = T.StructType([T.StructField("summary", T.StringType()), T.StructField("n", T.LongType())])

query("parse_json_reply", """SELECT period_start, CASE WHEN emotional_tone LIKE '5%' THEN NULL ELSE summary END
  AS summary, CASE WHEN emotional_tone LIKE '5%' THEN NULL ELSE source_entry_count END AS n FROM day_unit""")(
    lambda s, d: _json(s, d))


def _json(s, d):
    body = F.to_json(F.struct("summary", F.col("source_entry_count").alias("n")))
    text = (F.when(F.col("emotional_tone").startswith("5"), F.lit("no object {here"))
            .when(F.col("emotional_tone").startswith("1"), body)
            .otherwise(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n"))))
    return B.day_unit(s, d).withColumn("_r", R.parse_json_reply(text, _BODY)).select(
        "period_start", "_r.summary", "_r.n")


@query("parse_mentions", """SELECT seq, name_as_written, normalized_name, valence, interaction_summary, source_date
FROM mention UNION ALL SELECT seq, 'Bob', NULL, NULL, 'waved', NULL FROM mention""")
def _(s, d):
    m = B.mention(s, d)
    norm = F.coalesce(F.concat(F.lit("\n  normalized_name: "), F.col("normalized_name")), F.lit(""))
    block = F.concat(
        F.lit("- name_as_written: \""), F.col("name_as_written"), F.lit("\""), norm,
        F.lit("\n  valence: "), F.col("valence"), F.lit("\n  interaction_summary: "),
        F.col("interaction_summary"), F.lit("\n  source_date: "), F.col("source_date"),
        F.lit("\n- (name_as_written: Bob; interaction_summary: waved)"))
    return m.select("seq", F.explode(R.parse_mentions(block)).alias("_m")).select("seq", "_m.*")


@query("parse_key_events", """SELECT period_start, period_start AS date, summary || ' — high' AS sentence,
  'high' AS significance FROM day_unit""")
def _(s, d):
    event = F.concat(F.lit("- ["), F.col("period_start"), F.lit("]: "), F.col("summary"),
                     F.lit(" — high"))
    return B.day_unit(s, d).withColumn("_e", R.parse_key_event(event)).select(
        "period_start", "_e.*")
