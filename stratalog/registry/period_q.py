"""Queries of the period operators and the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import periods as P, text as X
from stratalog.operators import ingest, periods as O
from stratalog.plans import hierarchy as H, prompts
from stratalog.registry import base as B
from stratalog.registry.base import query
from stratalog.sources import readers

# Structural units of entries, for a source of (date, n) rows named by {days}.
UNITS_OF = """
d AS (SELECT 'day' AS level, date AS period_start, date AS period_end, [date] AS source_units,
             n AS source_entry_count FROM ({days})),
w AS (SELECT 'week' AS level, min(period_start) AS period_start, max(period_end) AS period_end,
             list(period_start ORDER BY period_start) AS source_units,
             CAST(sum(source_entry_count) AS BIGINT) AS source_entry_count
      FROM d GROUP BY strftime(CAST(period_start AS DATE), '%G-W%V')),
m AS (SELECT 'month' AS level, substr(w.period_start, 1, 7) AS period_start,
             max_by(w.period_end, w.period_start) AS period_end,
             list(w.period_start ORDER BY w.period_start) AS source_units,
             CAST(sum(source_entry_count) AS BIGINT) AS source_entry_count
      FROM w GROUP BY substr(w.period_start, 1, 7)),
y AS (SELECT 'year' AS level, substr(m.period_start, 1, 4) AS period_start,
             max_by(m.period_end, m.period_start) AS period_end,
             list(m.period_start ORDER BY m.period_start) AS source_units,
             CAST(sum(source_entry_count) AS BIGINT) AS source_entry_count
      FROM m GROUP BY substr(m.period_start, 1, 4)),
u AS (SELECT * FROM d UNION ALL SELECT * FROM w UNION ALL SELECT * FROM m UNION ALL SELECT * FROM y)"""
ALL_DAYS = "SELECT date, count(*) AS n FROM raw_entry GROUP BY date"
UNIT_ROW = """SELECT level, period_start, period_end, array_to_string(source_units, ',') AS source_units,
  source_entry_count FROM u"""


def _flat(units):
    return units.withColumn("source_units", F.array_join("source_units", ","))


query("hierarchy", f"WITH {UNITS_OF.format(days=ALL_DAYS)} {UNIT_ROW}")(
    lambda s, d: _flat(H.structural_units(B.raw_entry(s, d))))

query("run_hierarchy", f"WITH {UNITS_OF.format(days=ALL_DAYS)} {UNIT_ROW}")(
    lambda s, d: _flat(_incremental(s, d)))


def _incremental(s, d):
    """The store covers the days a system message opened; the run completes the rest."""
    rows = B.raw_entry(s, d)
    early = rows.join(rows.filter("role = 'system'").select("date").distinct(), "date", "left_semi")
    return H.run_hierarchy(rows, H.structural_units(early)).select(*H.UNIT)


query("filter_level", "SELECT level, period_start, summary FROM unit WHERE level = 'month'")(
    lambda s, d: O.filter_level(B.unit(s, d), "month").select("level", "period_start", "summary"))

query("list_periods", "SELECT DISTINCT period_start FROM unit WHERE level = 'week'")(
    lambda s, d: O.list_periods(B.unit(s, d), "week"))

query("list_raw_dates", "SELECT DISTINCT date FROM raw_entry")(
    lambda s, d: O.list_raw_dates(B.raw_entry(s, d)))

query("period_bounds", """SELECT level, min(period_start) AS first_period, max(period_start) AS last_period,
  count(DISTINCT period_start) AS periods FROM unit GROUP BY level""")(
    lambda s, d: O.period_bounds(B.unit(s, d)))

query("status_summary", "SELECT level, count(*) AS units FROM unit GROUP BY level")(
    lambda s, d: O.status_summary(B.unit(s, d)))

ROLLUP = """SELECT level, period_start, period_end, array_to_string(source_units, ',') AS source_units,
  source_entry_count FROM {}_unit"""
for _level, _below in (("week", "day"), ("month", "week"), ("year", "month")):
    query(f"{_level}_groups", ROLLUP.format(_level))(
        lambda s, d, level=_level, below=_below: _flat(O.rollup_level(
            O.filter_level(B.unit(s, d), below), level)))

query("period_tree", """SELECT level, period_start, CASE WHEN level IN ('day') THEN 'month'
  WHEN level = 'month' THEN 'year' WHEN level = 'week' THEN 'month' END AS parent_level,
  CASE WHEN level = 'day' THEN substr(period_start, 1, 7) WHEN level = 'week' THEN substr(period_start, 1, 7)
  WHEN level = 'month' THEN substr(period_start, 1, 4) END AS parent_period FROM unit""")(
    lambda s, d: O.period_tree(B.unit(s, d)))

query("period_keys", """SELECT date, strftime(CAST(date AS DATE), '%G-W%V') AS iso_week,
  strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS monday, substr(date, 1, 7) AS month,
  substr(date, 1, 4) AS year FROM (SELECT DISTINCT date FROM raw_entry
  UNION SELECT period_start FROM day_unit)""")(
    lambda s, d: B.raw_entry(s, d).select("date").unionByName(
        B.day_unit(s, d).select(F.col("period_start").alias("date"))).distinct().select(
        "date", P.iso_week_key("date").alias("iso_week"), P.week_monday("date").alias("monday"),
        P.month_key("date").alias("month"), P.year_key("date").alias("year")))


@query("load_summaries", """SELECT level, period_start, period_end, summary, emotional_tone,
  array_to_string(key_events, ',') AS key_events, 0 AS n_questions, energy_level, source_entry_count
FROM day_unit""")
def _(s, d):
    units = B.day_unit(s, d)
    stored = units.select("level", "period_start", "period_end", F.to_json(F.struct(
        "summary", "emotional_tone", "key_events", "energy_level", "source_entry_count",
        F.lit("kept by an older release").alias("central_themes"))).alias("data_json"))
    return readers.load_summaries(stored, "day").select(
        "level", "period_start", "period_end", "summary", "emotional_tone",
        F.array_join("key_events", ",").alias("key_events"),
        F.size("questions_raised").alias("n_questions"), "energy_level", "source_entry_count")


# --- lookup: mention dates ask, entry dates with their gaps answer -----------------------

NEAREST = """SELECT period, (SELECT max(date) FROM raw_entry r WHERE r.date < q.period) AS previous,
  (SELECT min(date) FROM raw_entry r WHERE r.date > q.period) AS next
FROM (SELECT DISTINCT source_date AS period FROM mention UNION SELECT '1999' UNION SELECT '2099-01-01') q"""


def _requests(s, d):
    asked = B.mention(s, d).select(F.col("source_date").alias("period")).distinct()
    return asked.unionByName(s.createDataFrame([("1999",), ("2099-01-01",)], "period STRING"))


query("nearest_periods", NEAREST)(
    lambda s, d: O.nearest_periods(_requests(s, d), B.raw_entry(s, d).select(
        F.col("date").alias("period"))))


@query("lookup_periods", f"""SELECT n.period AS request,
  CASE WHEN r.n IS NULL THEN 'not_found' ELSE 'success' END AS status, r.n AS source_entry_count,
  CASE WHEN r.n IS NULL THEN 'There is no day ' || n.period || '. Nearest periods: before '
    || coalesce(previous, 'none') || ', after ' || coalesce(next, 'none') END AS hint
FROM ({NEAREST}) n LEFT JOIN ({ALL_DAYS}) r ON r.date = n.period""")
def _(s, d):
    return O.lookup_periods(_requests(s, d), O.day_units(B.raw_entry(s, d)), "day").select(
        "request", "status", "source_entry_count", "hint")


@query("lookup_raw", f"""SELECT n.period AS request,
  CASE WHEN r.n IS NULL THEN 'not_found' ELSE 'success' END AS status, r.n AS n, r.texts AS texts,
  CASE WHEN r.n IS NULL THEN 'There are no entries of ' || n.period || '. Nearest dates: before '
    || coalesce(previous, 'none') || ', after ' || coalesce(next, 'none') END AS hint
FROM ({NEAREST}) n LEFT JOIN (SELECT date, count(*) AS n, string_agg(role || ': ' || text, ' / '
  ORDER BY time, id) AS texts FROM raw_entry GROUP BY date) r ON r.date = n.period""")
def _(s, d):
    return O.lookup_raw(_requests(s, d), B.raw_entry(s, d)).select(
        "request", "status", "n", F.array_join(F.transform("entries", lambda e: F.concat_ws(
            ": ", e["role"], e["text"])), " / ").alias("texts"), "hint")


# --- sequences -----------------------------------------------------------------

query("prior_units", """SELECT level, period_start, coalesce(array_to_string(list(period_start) OVER (
  PARTITION BY level ORDER BY period_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS prior
FROM unit""")(
    lambda s, d: O.prior_units(B.unit(s, d), 3).select(
        "level", "period_start", F.array_join("prior", ",").alias("prior")))

query("lookback_stats", f"""SELECT a.date, count(b.date) AS days_before,
  CAST(coalesce(sum(b.n), 0) AS BIGINT) AS entries_before
FROM ({ALL_DAYS}) a LEFT JOIN ({ALL_DAYS}) b ON CAST(b.date AS DATE) < CAST(a.date AS DATE)
  AND CAST(b.date AS DATE) >= CAST(a.date AS DATE) - 7 GROUP BY a.date""")(
    lambda s, d: O.lookback_stats(ingest.day_rollup(B.raw_entry(s, d)), 7))

query("trend", """SELECT *, energy - lag(energy) OVER w AS energy_delta,
  social - lag(social) OVER w AS social_delta, momentum - lag(momentum) OVER w AS momentum_delta
FROM (SELECT period_start AS period, energy_level AS energy, social_connectedness AS social,
             forward_momentum AS momentum FROM day_unit)
WHERE energy <> 0 OR social <> 0 OR momentum <> 0 WINDOW w AS (ORDER BY period)""")(
    lambda s, d: O.trend(B.day_unit(s, d), "day"))

query("project_metrics", """SELECT period_start, energy_level, social_connectedness, forward_momentum
FROM day_unit""")(lambda s, d: O.project_metrics(B.day_unit(s, d), "day"))

query("notable_periods", """SELECT period_start, energy_level, social_connectedness, forward_momentum
FROM day_unit WHERE least(energy_level, social_connectedness, forward_momentum) <= 1
  OR greatest(energy_level, social_connectedness, forward_momentum) >= 5""")(
    lambda s, d: O.notable_periods(B.day_unit(s, d), "day", 1, 5))

query("first_events", """SELECT period_start, array_to_string(key_events[1:2], ',') AS events
FROM day_unit""")(
    lambda s, d: B.day_unit(s, d).select("period_start", F.array_join(
        O.first_events("key_events", 2), ",").alias("events")))

# --- runs ----------------------------------------------------------------------

query("target_days", """WITH r AS (SELECT date, row_number() OVER (ORDER BY date) AS rn
  FROM (SELECT DISTINCT date FROM raw_entry))
SELECT date, date >= '2024-06-01' AS in_range FROM r
WHERE rn >= coalesce((SELECT min(rn) FROM r WHERE date >= '2024-06-01'), 1) - 3 AND date <= '2025-06-30'""")(
    lambda s, d: prompts.target_days(B.raw_entry(s, d), "2024-06-01", "2025-06-30", 3))


@query("cascade_keys", f"""WITH changed AS (SELECT date,
    strftime(CAST(date AS DATE), '%G-W%V') AS w FROM raw_entry WHERE role = 'system' GROUP BY date),
  per_week AS (SELECT w, min(date) AS new, strftime(date_trunc('week', min(CAST(date AS DATE))),
    '%Y-%m-%d') AS monday FROM changed GROUP BY w),
  stored AS (SELECT strftime(CAST(date AS DATE), '%G-W%V') AS w, min(date) AS old
    FROM raw_entry WHERE role = 'assistant' GROUP BY 1),
  hit AS (SELECT coalesce(old, monday) AS week, coalesce(old, new) AS a,
    least(new, coalesce(old, new)) AS b FROM per_week LEFT JOIN stored USING (w))
SELECT DISTINCT level, period_start FROM (
  SELECT 'week' AS level, week AS period_start FROM hit
  UNION ALL SELECT 'month', substr(a, 1, 7) FROM hit UNION ALL SELECT 'month', substr(b, 1, 7) FROM hit
  UNION ALL SELECT 'year', substr(a, 1, 4) FROM hit UNION ALL SELECT 'year', substr(b, 1, 4) FROM hit)""")
def _(s, d):
    rows = B.raw_entry(s, d)
    new = rows.filter("role = 'system'").select("date").distinct()
    return H.cascade_keys(new, H.structural_units(rows.filter("role = 'assistant'")))


FINGERPRINTS = """
f_d{v} AS (SELECT 'day' AS level, date AS period_start, sha256(count(*) || ':'
    || sum(CAST(('0x' || id) AS UBIGINT))) AS fp FROM raw_entry {where} GROUP BY date),
f_w{v} AS (SELECT 'week' AS level, min(period_start) AS period_start,
    sha256(string_agg(fp, '|' ORDER BY period_start)) AS fp
    FROM f_d{v} GROUP BY strftime(CAST(period_start AS DATE), '%G-W%V')),
f_m{v} AS (SELECT 'month' AS level, substr(x.period_start, 1, 7) AS period_start,
    sha256(string_agg(fp, '|' ORDER BY x.period_start)) AS fp FROM f_w{v} x
    GROUP BY substr(x.period_start, 1, 7)),
f_y{v} AS (SELECT 'year' AS level, substr(x.period_start, 1, 4) AS period_start,
    sha256(string_agg(fp, '|' ORDER BY x.period_start)) AS fp FROM f_m{v} x
    GROUP BY substr(x.period_start, 1, 4)),
f{v} AS (SELECT * FROM f_d{v} UNION ALL SELECT * FROM f_w{v} UNION ALL SELECT * FROM f_m{v}
    UNION ALL SELECT * FROM f_y{v})"""
_NOW = FINGERPRINTS.format(v="_now", where="")
_THEN = FINGERPRINTS.format(v="_then", where="WHERE role <> 'system'")

query("fingerprints", f"WITH {_NOW} SELECT level, period_start, fp AS fingerprint FROM f_now")(
    lambda s, d: H.fingerprints(B.raw_entry(s, d)))

query("stale_units", f"""WITH {_NOW}, {_THEN}
SELECT level, period_start, CASE WHEN b.fp IS NULL THEN 'new' WHEN a.fp IS NULL THEN 'gone'
  ELSE 'changed' END AS change
FROM f_now a FULL JOIN f_then b USING (level, period_start) WHERE a.fp IS DISTINCT FROM b.fp""")(
    lambda s, d: H.stale_units(H.fingerprints(B.raw_entry(s, d)),
                               H.fingerprints(B.raw_entry(s, d).filter("role <> 'system'"))))

MD = """'# ' || upper(level) || ': ' || period_start || ' – ' || period_end || E'\\n\\n'
  || '## Summary' || E'\\n' || summary || E'\\n\\n' || '**Emotional Tone:** ' || emotional_tone || E'\\n\\n'
  || '## Key Events' || E'\\n- ' || array_to_string(key_events, E'\\n- ') || E'\\n\\n'"""
query("render_summary", f"SELECT period_start, {MD} AS document FROM day_unit")(
    lambda s, d: _documents(s, d))


def _documents(s, d):
    units = B.day_unit(s, d).withColumnRenamed("level", "unit")
    return units.select("period_start", X.summary_document(units.columns).alias("document"))


query("summary_context", """SELECT period_start, '[' || period_start || ' — ' || period_end || ']' || E'\\nSummary: '
  || summary || E'\\nTone: ' || emotional_tone || E'\\nEvents: ' || array_to_string(key_events, '; ')
  AS context FROM day_unit""")(
    lambda s, d: B.day_unit(s, d).select("period_start", X.summary_context(
        B.day_unit(s, d).columns).alias("context")))


B.ORACLES["stale_after_merge"] = B.ORACLES["stale_units"]


@query("stale_after_merge")
def _(s, d):
    """Stored hashes of some entries, merged with those of a batch: no entry is read twice."""
    from stratalog.session import stored
    rows = B.raw_entry(s, d)
    then = stored(H.day_hashes(rows.filter("role <> 'system'")), "day_hashes")
    now = H.merge_day_hashes(then, H.day_hashes(rows.filter("role = 'system'")))
    return H.stale_units(H.fingerprints_of(now), H.fingerprints_of(then))


B.ORACLES["update_stale"] = B.ORACLES["hierarchy"]


@query("update_stale")
def _(s, d):
    """Units of a store that grows in two batches, of which only stale ones are done again."""
    from stratalog.plans import pipeline
    from stratalog.registry.source_q import _folder
    from stratalog.sources import writers
    rows, store, units, hashes = B.raw_entry(s, d), _folder(s), None, None
    for part in ("role <> 'system'", "role = 'system'"):
        batch = rows.filter(part)
        writers.write_raw(batch, store)
        units, hashes = pipeline.update_stale(s, store, units, H.day_hashes(batch), hashes)
    return _flat(units.select(*H.UNIT))
