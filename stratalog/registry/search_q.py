"""Queries of search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalog.operators import search as S
from stratalog.registry import base as B
from stratalog.registry.base import query
from stratalog.session import shared_folder, stored
from stratalog.sources import writers

query("index_corpus", "SELECT source_type, source_id, date, length(content) AS chars FROM corpus")(
    lambda s, d: B.corpus(s, d).select("source_type", "source_id", "date",
                                       F.length("content").cast("long").alias("chars")))

query("build_index", "SELECT source_type, source_id, date, doc_len, token, tf FROM posting")(
    lambda s, d: S.build_index(B.corpus(s, d)))

RANKED = """WITH p AS (SELECT word, source_type, source_id, date, doc_len, CAST(sum(tf) AS DOUBLE) AS f
    FROM posting, (SELECT unnest([{words}]) AS word) WHERE starts_with(token, word)
    GROUP BY word, source_type, source_id, date, doc_len),
  docs AS (SELECT count(*) AS n, avg(len(regexp_extract_all(strip_accents(lower(content)),
    '[\\p{{L}}\\p{{N}}]+'))) AS al FROM corpus),
  w AS (SELECT word, count(*) AS df FROM p GROUP BY word),
  idf AS (SELECT word, al, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0
    THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS i FROM w, docs),
  r AS (SELECT source_type, source_id, date,
    -sum(i * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / al))) AS rank
    FROM p JOIN idf USING (word) GROUP BY source_type, source_id, date)"""
WORDS = "'ther', 'quean'"
QUERY = "ther Queán"

query("search_ranked", RANKED.format(words=WORDS) + """
SELECT source_type, source_id, date, round(rank, 6) AS rank FROM r""")(
    lambda s, d: S.search(QUERY, *_stored(s, d)).withColumn("rank", F.round("rank", 6)))

query("search_summaries", RANKED.format(words="'week', 'custom'") + """
SELECT source_type, source_id, date, round(rank, 6) AS rank FROM r
WHERE source_type <> 'raw' AND date >= '1996-01-01' AND date <= '1999-12-31'""")(
    lambda s, d: _search(s, d, "week custom", scope="summaries", date_from="1996-01-01",
                         date_to="1999-12-31", limit=None).withColumn("rank", F.round("rank", 6)))

query("search_limit", RANKED.format(words=WORDS) + """
SELECT source_id, round(rank, 6) AS rank FROM r ORDER BY rank, source_id LIMIT 50""")(
    lambda s, d: _search(s, d, QUERY, limit=50).select("source_id",
                                                      F.round("rank", 6).alias("rank")))

query("search_totals", RANKED.format(words=WORDS) + """
SELECT count(*) AS total_hits, least(count(*), 50) AS results_shown, count(*) > 50 AS truncated FROM r""")(
    lambda s, d: S.search_totals(_search(s, d, QUERY, limit=None), 50))

query("snippets", r"""SELECT source_id, '...' || trim(regexp_replace(content[greatest(p - 30, 1):p - 1],
    '\s+', ' ', 'g')) || ' >>' || content[p:p + l - 1] || '<< '
    || trim(regexp_replace(content[p + l:p + l + 29], '\s+', ' ', 'g')) || '...' AS context
FROM (SELECT *, length(m[1]) + 1 AS p, length(m[2]) AS l FROM (SELECT source_id, content,
        regexp_extract_all(strip_accents(lower(content)),
          '(?s)^((?:.*?[^\p{L}\p{N}])??)(?:ther|quean)', 1)[1] AS head,
        [head, regexp_extract(substr(strip_accents(lower(content)), length(head) + 1),
          '^((?:ther|quean)[\p{L}\p{N}]*)', 1)] AS m
      FROM corpus WHERE source_type = 'raw') WHERE m[2] <> '')""")(
    lambda s, d: S.snippets(_search(s, d, QUERY, scope="raw", limit=None), B.corpus(s, d),
                            QUERY, 30).select("source_id", "context"))


def _search(s, d, text, **kw):
    counted = stored(S.count_tokens(B.corpus(s, d)), "counted")
    return S.search(text, S.postings(counted), counted, **kw)


@query("search_after_merge", RANKED.format(words=WORDS).replace("FROM posting", "FROM grown_posting")
       .replace("FROM corpus", "FROM grown") + """
SELECT source_type, source_id, date, round(rank, 6) AS rank FROM r""")
def _(s, d):
    """Half of the corpus, then the rest, then longer texts in the place of some, then merged segments."""
    path = f"{shared_folder(s)}/index-{uuid.uuid4().hex}"
    rows, last = B.corpus(s, d), F.right("source_id", F.lit(1))
    half = last.isin("0", "2", "4", "6", "8")
    writers.append_index(rows.filter(half), path)
    writers.append_index(rows.filter(~half), path)
    writers.append_index(B.grown(s, d).filter(last.isin("3", "4")), path)
    writers.merge_index(s, path, factor=2)
    return S.search(QUERY, *writers.read_index(s, path)).withColumn("rank", F.round("rank", 6))


def _stored(s, d, keys=()):
    """The index as a table on disk, written by this query and read again."""
    path = f"{shared_folder(s)}/index-{uuid.uuid4().hex}"
    writers.write_index(_by_source(s, d) if keys else B.corpus(s, d), path, keys)
    return writers.read_index(s, path, keys)


def _by_source(s, d):
    """Documents as two streams that share their ids: each text is in both, shorter in one."""
    docs = B.corpus(s, d).filter("source_type = 'raw'")
    return docs.withColumn("tenant", F.lit("a")).unionByName(docs.select(
        *[c for c in docs.columns if c != "content"], F.lit("b").alias("tenant"),
        F.concat_ws(" ", "content", F.lit("ther extra words")).alias("content")))


query("search_by_key", """WITH docs AS (SELECT 'a' AS tenant, source_id, content FROM corpus WHERE source_type = 'raw'
    UNION ALL SELECT 'b', source_id, content || ' ther extra words' FROM corpus WHERE source_type = 'raw'),
  tok AS (SELECT tenant, source_id, regexp_extract_all(strip_accents(lower(content)),
    '[\\p{L}\\p{N}]+') AS l FROM docs),
  p AS (SELECT tenant, source_id, word, len(l) AS n, len(list_filter(l, lambda t: starts_with(t, word))) AS f
    FROM tok, (SELECT unnest(['ther', 'quean']) AS word)),
  st AS (SELECT tenant, count(*) AS n, avg(len(l)) AS al FROM tok GROUP BY tenant),
  idf AS (SELECT tenant, word, al, CASE WHEN ln((st.n - df + 0.5) / (df + 0.5)) > 0
    THEN ln((st.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS i
    FROM (SELECT tenant, word, count(*) AS df FROM p WHERE f > 0 GROUP BY ALL) JOIN st USING (tenant))
SELECT tenant, source_id, round(-sum(i * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE
  + 0.75::DOUBLE * n / al))), 6) + 0.0 AS rank
FROM p JOIN idf USING (tenant, word) WHERE f > 0 GROUP BY tenant, source_id""".replace("\\\\", "\\"))(
    lambda s, d: S.search(QUERY, *_stored(s, d, ["tenant"]), keys=["tenant"]).select(
        "tenant", "source_id", (F.round("rank", 6) + 0.0).alias("rank")))


SNIPPET = r"""'...' || trim(regexp_replace(text[greatest(p - 40, 1):p - 1], '\s+', ' ', 'g')) || ' >>'
  || text[p:p + 1] || '<< ' || trim(regexp_replace(text[p + 2:p + 41], '\s+', ' ', 'g')) || '...'"""

query("search_user", f"""SELECT id, date, text[p:p + 1] AS matched_word, {SNIPPET} AS context FROM (
  SELECT *, instr(lower(text), 'en') AS p FROM raw_entry WHERE role = 'user')
WHERE p > 0 AND date <= '2025-06-30'""")(
    lambda s, d: S.search_user("En", B.raw_entry(s, d), 40, date_to="2025-06-30"))

query("kwic", f"""SELECT id, CASE WHEN p > 0 THEN {SNIPPET} END AS context FROM (
  SELECT *, instr(lower(text), 'ch') AS p FROM raw_entry)""")(
    lambda s, d: _kwic(s, d))


def _kwic(s, d):
    from stratalog.functions import text as X
    return B.raw_entry(s, d).select("id", X.kwic("text", "ch", 40).alias("context"))


# The engine behind the check has no look-behind: sentence ends are marked, then split.
query("search_sentences", r"""WITH s AS (SELECT id, date, string_split(regexp_replace(text,
    '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM raw_entry WHERE role = 'user'),
  e AS (SELECT id, date, l, unnest(range(len(l))) AS no, unnest(l) AS one FROM s)
SELECT id, date, CAST(no AS INTEGER) AS sentence_no,
  array_to_string(l[greatest(no, 1):least(no + 2, len(l))], ' ') AS context
FROM e WHERE contains(lower(one), 'que')""")(
    lambda s, d: S.search_sentences("que", B.raw_entry(s, d)))

query("search_events", """SELECT period_start, array_to_string(key_events, ',') AS key_events FROM day_unit
WHERE contains(lower(array_to_string(key_events, ' ')), 'f p')""")(
    lambda s, d: S.search_events("F P", B.day_unit(s, d), "day").withColumn(
        "key_events", F.array_join("key_events", ",")))


@query("scan_threads", """SELECT period_start, 'thread_' || lower(emotional_tone[3:5]) AS thread,
  'ongoing' AS status, summary AS description, period_start AS first_seen, period_end AS last_active
FROM day_unit
UNION ALL SELECT period_start, 'thread_all', 'dormant', NULL, NULL, period_end FROM day_unit""")
def _(s, d):
    block = F.concat(
        F.lit("- thread_"), F.lower(F.substring("emotional_tone", 3, 3)),
        F.lit(": status: Ongoing\n  description: "), F.col("summary"), F.lit("\n  first_seen: "),
        F.col("period_start"), F.lit("\n  last_active: "), F.col("period_end"),
        F.lit("\n- thread_all: dormant\n  last_active: "), F.col("period_end"))
    return S.scan_threads(B.day_unit(s, d).withColumn("narrative_threads", block), "day")
