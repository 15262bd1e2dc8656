"""Queries of the entity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.functions import periods as P, text as X
from stratalog.operators import entities as O, ingest, paging
from stratalog.plans import synthesis
from stratalog.registry import base as B
from stratalog.registry.base import query

query("normalize_id", "SELECT seq, id FROM named")(
    lambda s, d: B.mention(s, d).select("seq", X.normalize_id(
        F.coalesce("normalized_name", "name_as_written")).alias("id")))

query("discover_entities", "SELECT id, display_name, first_mentioned, appearances FROM entity")(
    lambda s, d: O.discover_entities(B.mention(s, d)).drop("first_seen"))

query("entity_aliases", "SELECT id, alias FROM alias_row")(
    lambda s, d: O.entity_aliases(B.mention(s, d)))

query("alias_map", "SELECT alias, id FROM alias")(lambda s, d: O.alias_map(B.mention(s, d)))

query("alias_groups", """SELECT id, string_agg(alias, ',' ORDER BY alias) AS aliases, count(*) AS n_aliases
FROM alias GROUP BY id""")(
    lambda s, d: O.alias_groups(O.alias_map(B.mention(s, d))).withColumn(
        "aliases", F.array_join("aliases", ",")))

query("top_entities", """SELECT id, display_name, appearances FROM entity
ORDER BY appearances DESC, id LIMIT 20""")(
    lambda s, d: O.top_entities(O.discover_entities(B.mention(s, d))).select(
        "id", "display_name", "appearances"))


def _wanted(s, d):
    """Ids that were mentioned warmly."""
    return B.mention(s, d).filter("valence = 'warm'").select(X.normalize_id(
        F.coalesce("normalized_name", "name_as_written")).alias("id"))


WANTED = "SELECT DISTINCT id FROM alias WHERE id IN (SELECT id FROM named WHERE valence = 'warm')"
query("target_entities", WANTED)(
    lambda s, d: O.target_entities(O.alias_map(B.mention(s, d)), _wanted(s, d)))
query("intersect_targets", WANTED)(
    lambda s, d: O.intersect_targets(O.alias_map(B.mention(s, d)), _wanted(s, d)))

query("resolve_alias", "SELECT seq, id AS entity FROM fact")(
    lambda s, d: O.resolve_alias(B.mention(s, d), O.alias_map(B.mention(s, d))).select(
        "seq", "entity"))


def facts(s, d):
    m = B.mention(s, d)
    return O.knowledge(m, O.alias_map(m))


query("knowledge", "SELECT id, valid_from, content, emotional_valence, seq FROM fact")(
    lambda s, d: facts(s, d).select("id", "valid_from", "content", "emotional_valence", "seq"))

query("as_of", "SELECT id, valid_from, content FROM fact WHERE valid_from <= '2024-01-09'")(
    lambda s, d: O.as_of(facts(s, d), "2024-01-09").select("id", "valid_from", "content"))

PROFILES = """SELECT a.id, a.aliases, coalesce(f.first, '') AS first_mentioned, coalesce(f.n, 0) AS mention_count
FROM (SELECT id, string_agg(alias, ',' ORDER BY alias) AS aliases FROM alias GROUP BY id) a
LEFT JOIN (SELECT id, min(valid_from) AS first, count(*) AS n FROM fact GROUP BY id) f USING (id)"""


def profiles(s, d):
    return O.build_profiles(facts(s, d), O.alias_map(B.mention(s, d)))


query("build_profiles", f"SELECT id, id AS display_name, aliases, first_mentioned, mention_count FROM ({PROFILES})")(
    lambda s, d: profiles(s, d).withColumn("aliases", F.array_join("aliases", ",")))

query("entity_by_id", f"SELECT id, aliases, mention_count FROM ({PROFILES}) WHERE id = 'user_7'")(
    lambda s, d: O.entity_by_id(profiles(s, d), "user_7").select(
        "id", F.array_join("aliases", ",").alias("aliases"), "mention_count"))


@query("project_profile", f"""SELECT p.id, 'seen ' || mention_count AS arc_summary, f.valid_from, f.content,
  f.emotional_valence, f.seq FROM ({PROFILES}) p
LEFT JOIN (SELECT * FROM fact WHERE valid_from <= '2024-01-03') f USING (id)""")
def _(s, d):
    told = profiles(s, d).withColumn("arc_summary", F.concat(
        F.lit("seen "), F.col("mention_count").cast("string")))
    return O.project_profile(told, facts(s, d), "full", "2024-01-03")


@query("entity_directory", f"""SELECT id, '' AS role, coalesce(n, 0) AS mentions FROM ({PROFILES})
LEFT JOIN (SELECT id, count(*) AS n FROM fact GROUP BY id) USING (id)""")
def _(s, d):
    known = profiles(s, d)
    stored = F.when(F.col("id").startswith("user"), F.create_map(
        F.lit("mention_count"), F.col("mention_count").cast("string")))
    return O.entity_directory(known.withColumn("role", F.lit("")).withColumn(
        "stable_facts", stored), facts(s, d))


@query("lookup_entity", """WITH r AS (SELECT DISTINCT name_as_written AS request FROM mention
  UNION SELECT id FROM named UNION SELECT 'Nobody'),
  a AS (SELECT lower(alias) AS low, min(id) AS id FROM alias GROUP BY 1),
  p AS (SELECT DISTINCT id FROM alias)
SELECT request, coalesce(p.id, a.id) AS id, CASE WHEN p.id IS NOT NULL THEN 'id'
  WHEN a.id IS NOT NULL THEN 'alias' ELSE 'not_found' END AS matched_by
FROM r LEFT JOIN p ON p.id = request LEFT JOIN a ON a.low = lower(request)""")
def _(s, d):
    m = B.mention(s, d)
    asked = (m.select(F.col("name_as_written").alias("request"))
             .unionByName(O.discover_entities(m).select(F.col("id").alias("request")))
             .unionByName(s.createDataFrame([("Nobody",)], "request STRING")).distinct())
    return O.lookup_entity(asked, profiles(s, d))


NOTES = """SELECT strftime(ts, '%Y-%m-%d') AS period_start, event_type AS key,
  CASE WHEN count(*) % 7 = 0 THEN 'Not mentioned today' ELSE count(*) || ' times' END AS note
FROM events GROUP BY 1, 2"""


def _noted_days(s, d):
    day = F.date_format("ts", "yyyy-MM-dd").alias("period_start")
    n = F.count(F.lit(1))
    per_kind = B.table(s, d, "events").groupBy(day, F.col("event_type").alias("key")).agg(
        F.when(n % 7 == 0, "Not mentioned today").otherwise(
            F.concat(n.cast("string"), F.lit(" times"))).alias("note"))
    return per_kind.groupBy("period_start").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("key", "note")))).alias("entities")).select(
        F.lit("day").alias("level"), "period_start", F.col("period_start").alias("period_end"),
        "entities")


query("dossier", f"""SELECT period_start, period_start AS period_end, 'day' AS unit, key, note FROM (
  SELECT *, row_number() OVER (PARTITION BY period_start ORDER BY key) AS rn FROM ({NOTES})
  WHERE contains(key, 'purchase') OR contains('purchase', key) OR contains(key, 'clicking')
    OR contains('clicking', key))
WHERE rn = 1 AND NOT contains(lower(note), 'not mentioned')""")(
    lambda s, d: O.dossier(_noted_days(s, d), "Purchase", ["Clicking"], "day"))

query("timeline_text", """SELECT id, string_agg('[' || period_start || '] ' || content, E'\\n'
  ORDER BY period_start, seq) AS text FROM fact GROUP BY id
UNION ALL SELECT 'nobody', '(No mentions found)'""")(lambda s, d: _timeline(s, d))


def _timeline(s, d):
    known = facts(s, d)
    labels = known.select("id").unionByName(s.createDataFrame([("nobody",)], "id STRING"))
    return O.timeline_text(known.withColumnRenamed("content", "note"), ["id"],
                           paging.by_date_and_seq("period_start", "seq"), labels).select(
        "id", "text")


NOTES_FIXED = len("sys") + 1 + len("About :\n\nEnd.")


@query("timeline_prompts", f"""WITH n AS (SELECT id, '[' || period_start || ']: ' || content AS line,
    period_start, seq, sum(length(content) + 16) OVER (PARTITION BY id
      ORDER BY period_start DESC, seq DESC) - 2 AS total FROM fact),
  k AS (SELECT id, count(*) AS n, string_agg(line, E'\\n\\n' ORDER BY period_start, seq) AS t FROM n
    WHERE trunc((total + length(id) + {NOTES_FIXED}) / CAST(3.2 AS DOUBLE)) <= 300 GROUP BY id)
SELECT id, coalesce(n, 0) AS n_notes, every - coalesce(n, 0) AS n_dropped, 'About ' || id || E':\\n' || coalesce(t, '(none)') || E'\\nEnd.' AS prompt
FROM (SELECT id, count(*) AS every FROM fact GROUP BY id) LEFT JOIN k USING (id)""")
def _(s, d):
    notes = facts(s, d).withColumnRenamed("content", "note")
    return synthesis.timeline_prompts(
        notes, ["id"], paging.by_date_and_seq("period_start", "seq"),
        "About {entity}:\n{entity_timeline}\nEnd.", "sys", 300 + 1024 + 5000, 1024)


@query("upsert_profile", f"""SELECT id, CASE WHEN mention_count > 60 THEN 'frequent' ELSE id END
  AS display_name FROM ({PROFILES})""")
def _(s, d):
    old = profiles(s, d).select("id", "display_name", "mention_count")
    new = old.filter("mention_count > 60").withColumn("display_name", F.lit("frequent"))
    return ingest.upsert_profile(old, new).select("id", "display_name")


@query("entity_evidence", None)
def _(s, d):
    return evidence(s, d)


def evidence(s, d):
    from stratalog.registry.context_q import contexts
    return synthesis.entity_evidence(facts(s, d), B.mention_day(s, d), contexts(s, d))


from stratalog.registry.context_q import CONTEXT  # noqa: E402

HEAD = """'── TYPE A  [' || valid_from || ']  valence=' || emotional_valence || E' ──\\n' || content
  || E'\\n\\n[Day framing]\\nDay emotional tone: ' || emotional_tone || E'\\nKey events that day:\\n  • '
  || array_to_string(key_events, E'\\n  • ')"""
B.ORACLES["entity_evidence"] = B.with_views(f"""SELECT id, period_start, seq, head, valid_from AS context_date,
  context_chars, chars AS block_chars, CAST(trunc(chars / CAST(3.2 AS DOUBLE)) AS BIGINT) AS tokens
FROM (SELECT *, length(head) + CASE WHEN context_chars > 0 THEN context_chars
        + length(E'\\n\\n── TYPE B  raw entries (±1/1 days) ──\\n') ELSE 0 END AS chars
      FROM (SELECT f.*, {HEAD} AS head, coalesce(length(c.text), 0) AS context_chars
            FROM fact f JOIN mention_day USING (period_start)
            LEFT JOIN ({CONTEXT}) c ON c.center_date = f.valid_from))""")


def _arcs(system: str, user: str) -> str:
    """Stand-in synthesis: how many evidence blocks a prompt shows, how many partial arcs a merge joins."""
    if user.startswith("Merge"):
        return f"{user.count('## part ')} arcs, the last of {user.rstrip().rsplit(chr(10), 1)[-1]}"
    return f"{user.count('TYPE A')} mentions"


BUDGET, OVERLAP = 20_000, 3
# The packing walk over the evidence: which blocks each chunk holds.
B.ORACLES["synthesize_entities"] = f"""WITH RECURSIVE b AS (SELECT id, row_number() OVER o - 1 AS i, tokens AS t,
    coalesce(sum(tokens) OVER (o ROWS BETWEEN {OVERLAP} PRECEDING AND 1 PRECEDING), 0) AS last
  FROM ({B.ORACLES["entity_evidence"]}) WINDOW o AS (PARTITION BY id ORDER BY period_start, seq)),
walk AS (SELECT id, i, 0 AS chunk, CAST(t AS BIGINT) AS cur, CAST(0 AS BIGINT) AS s FROM b WHERE i = 0
  UNION ALL SELECT b.id, b.i, CASE WHEN cur + t > {BUDGET} THEN chunk + 1 ELSE chunk END,
    CAST(CASE WHEN cur + t > {BUDGET} THEN last + t ELSE cur + t END AS BIGINT),
    CASE WHEN cur + t > {BUDGET} THEN greatest(b.i - {OVERLAP}, 0) ELSE s END
  FROM walk JOIN b ON b.id = walk.id AND b.i = walk.i + 1),
sized AS (SELECT id, chunk, max(i) - min(s) + 1 AS n FROM walk GROUP BY id, chunk),
arcs AS (SELECT id, max(chunk) + 1 AS k, arg_max(n, chunk) AS n FROM sized GROUP BY id)
SELECT id, CAST(k AS BIGINT) AS arc_chunks_used,
  CASE WHEN k = 1 THEN n || ' mentions' ELSE k || ' arcs, the last of ' || n || ' mentions' END AS arc_summary
FROM arcs"""


@query("synthesize_entities")
def _(s, d):
    """Frequent entities need several chunks: partial arcs, and a call that merges them."""
    return synthesis.synthesize_entities(
        evidence(s, d), _contexts(s, d), _arcs, "About {entity}:\n{entity_timeline}",
        "Merge {n_chunks} arcs of {entity}:\n{partial_arcs}", budget=BUDGET, overlap=OVERLAP)


def _contexts(s, d):
    from stratalog.registry.context_q import contexts
    return contexts(s, d)


NAMED_DAY = """SELECT d, CASE k % 3 WHEN 0 THEN c_name || ' jr' WHEN 1 THEN upper(c_name) ELSE c_name[5:] END AS key,
    CASE WHEN k % 5 = 0 THEN 'Not mentioned' ELSE n || ' orders' END AS note
  FROM (SELECT o_orderdate AS d, c_custkey AS k, c_name, count(*) AS n
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


@query("label_notes", f"""WITH e AS ({NAMED_DAY}),
  h AS (SELECT strftime(d, '%Y-%m-%d') AS period_start, c_name AS label, key, note,
      row_number() OVER (PARTITION BY d, c_name ORDER BY key) AS k
    FROM e JOIN customer ON contains(lower(key), lower(c_name)) OR contains(lower(c_name), lower(key)))
SELECT period_start, label, key, note FROM h WHERE k = 1 AND note <> 'Not mentioned'""")
def _(s, d):
    """Every customer as a label, found in the names of each day's orders by containment."""
    from stratalog.operators import entities
    name, n = F.col("c_name"), F.col("c_custkey")
    people = B.table(s, d, "customer")
    named = B.table(s, d, "orders").join(people.hint("merge"), F.col("o_custkey") == n).groupBy(
        "o_orderdate", n, name).agg(F.count(F.lit(1)).alias("n"))
    key = F.when(n % 3 == 0, F.concat(name, F.lit(" jr"))).when(n % 3 == 1, F.upper(name)).otherwise(
        F.substr(name, F.lit(5)))
    note = F.when(n % 5 == 0, "Not mentioned").otherwise(F.concat(F.col("n").cast("string"), F.lit(" orders")))
    units = named.select("o_orderdate", key.alias("key"), note.alias("note")).groupBy("o_orderdate").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "note")))).alias("entities"))
    day = P.date_text(F.col("o_orderdate"))
    units = units.select(F.lit("day").alias("level"), day.alias("period_start"), day.alias("period_end"), "entities")
    return entities.label_notes(units, people.select(name.alias("label"), name.alias("term")), "day").select(
        "period_start", "label", "key", "note")
