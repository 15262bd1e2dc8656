"""The registered queries of the operators, each with the DuckDB SQL that checks it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalog.llm import (bpe, decontaminate, exact, neardup, packing, periodic, pii, reputation, spelling,
                           substrings, tokenfiles, toxicity, warc)
from stratalog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


URL_RULES = reputation.rules("allow com/", "block example.com/en/", "allow www.example.com/en/",
                             "block net/es/", "block net/fr/")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return reputation.judge_urls(pages, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def _shrunk(level: str, parent: str, rate: str) -> str:
    """One level of shrinkage in SQL: rho from all rows of the level, then posterior means."""
    return f"""
    {level}_m AS (SELECT l.*, {rate} AS m FROM {level} l {parent}),
    {level}_s AS (SELECT 1 / least(greatest(coalesce(
        (sum(CASE WHEN n > 0 THEN n * (bad / n - m) * (bad / n - m) END)
         - sum(CASE WHEN n > 0 THEN m * (1 - m) END))
        / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * m * (1 - m) END), 0), 0.999), 0.001), 0.999)
        - 1 AS held FROM {level}_m),
    {level}_p AS (SELECT x.*, (m * held + bad) / (held + n) AS mean, held + n AS weight
                  FROM {level}_m x, {level}_s)"""


ORACLES["op8_url_filters"] = rf"""
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com'))
             AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com'))
             AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
        END AS rule
    FROM parts),
marked AS (
    SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 0 WHEN rule IS NOT NULL THEN 1
        END AS bad, string_split(host, '.') AS labels FROM ruled),
tailed AS (
    SELECT *, array_to_string(labels[-2:], '.') AS two FROM marked),
host AS (
    SELECT host,
        CASE WHEN any_value(two) IN ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au',
            'org.au', 'co.jp', 'ne.jp', 'or.jp', 'co.nz', 'com.br', 'co.in', 'com.cn')
            THEN any_value(two) ELSE any_value(labels)[-1] END AS suffix,
        CASE WHEN any_value(two) IN ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au',
            'org.au', 'co.jp', 'ne.jp', 'or.jp', 'co.nz', 'com.br', 'co.in', 'com.cn')
            THEN array_to_string(any_value(labels)[-3:], '.') ELSE any_value(two) END AS domain,
        count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
    FROM tailed GROUP BY host),
domain AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM host GROUP BY ALL),
suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain GROUP BY ALL),
{_shrunk("suffix", "", "(SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM host)")},
{_shrunk("domain", "JOIN suffix_p p USING (suffix)", "p.mean")},
{_shrunk("host", "JOIN domain_p p USING (domain)", "p.mean")}
SELECT page_id, r.host, path, rule,
    CASE WHEN r.bad = 1 THEN 'block' WHEN r.bad = 0 THEN 'allow'
         WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) >= 0.5 THEN 'block'
         ELSE 'allow' END AS verdict
FROM marked r JOIN host_p USING (host)
"""


@query
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.count_tokens(docs, tokenizer_path()).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_overlap(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact.find_copies(table(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op9_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

ORACLES["op5_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS g,
        least(len(w), 10) AS size FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes),
hits AS (SELECT doc_id, i, p.size, item_id FROM places p
        JOIN windows x ON x.size = p.size AND x.g = array_to_string(w[i:i + p.size - 1], ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM
        (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
        string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return neardup.find_groups(docs, neardup.Plan(words=2))


# Pairs by shared shingles, links by the sizes of sets, components by following links.
ORACLES["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
shingle AS (SELECT doc_id, unnest(s) AS g FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
        WHERE 100 * common >= 80 * (len(x.s) + len(y.s) - common)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets
        UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


@query
def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    # Pages have no time of capture; the id in seconds gives every page one of its own.
    index = warc.capture_index(table(spark, sf, "pages"), F.timestamp_seconds("page_id"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                        "url_key", "captured", "intact")


@query
def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.written_out("base"), 256).alias("base_sha256"),
                        pii.written_out("spans").alias("spans"))


@query
def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.find_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed",
                        F.lower(F.hex("kept_digest")).alias("kept_sha256"))


ORACLES["op6_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
        lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM places),
least AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
        FROM windows JOIN least USING (g) WHERE doc_id > first),
lists AS (SELECT doc_id, list(k) AS gone FROM covered GROUP BY doc_id),
kept AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN lists USING (doc_id))
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM kept
"""


def planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a run planted into one document in ten, as op 11's contract says."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _planted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for ids, texts in batches:
        yield pa.array([b" ".join(planted_run(i, periodic.words(t))).decode()
                        for i, t in zip(ids.to_pylist(), texts.to_pylist())], pa.string())


@query
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    text = F.arrow_udf(_planted, "string")("doc_id", "text")
    found = periodic.find_runs(docs.select("doc_id", text.alias("text")))
    # The first of the greatest exponents in order of start and period; fractions by cross products.
    best = F.aggregate("runs", F.col("runs")[0], lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n"))))
    return (found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


def misspelt(doc_id: int | None, word: str) -> str:
    """The word, or one letter less for one word in 199, as op 12's contract says."""
    h = 1 if doc_id is None else zlib.crc32(word.encode(), zlib.crc32(f"{doc_id}:".encode()))
    k = h % len(word)
    return word if h % 199 else word[:k] + word[k + 1:]


@query
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    found = spelling.find_variants(table(spark, sf, "documents").select("doc_id", "text"),
                                   change=misspelt)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS raw
    FROM documents),
low AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
    count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM low),
summed AS (SELECT w, n, xor(list_reduce(
    list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
        lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(c, b)),
    4294967295::BIGINT), 4294967295) AS h FROM bytes),
words AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
    ELSE w END AS word, sum(n)::BIGINT AS n FROM summed GROUP BY 1),
v AS (SELECT * FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
gaps AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM cut),
pairs AS (
    SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y USING (i, a, b)
        WHERE x.word <> y.word
    UNION SELECT g.word, g.n, v.word, v.n FROM gaps g JOIN v ON v.word = g.a || g.b
    UNION SELECT v.word, v.n, g.word, g.n FROM gaps g JOIN v ON v.word = g.a || g.b),
best AS (SELECT word, count(*) AS n_near,
    first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * v.n THEN near END AS form,
    CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS tail FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.tail WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.tail FROM chain c JOIN forms f ON f.word = c.tail WHERE f.form IS NULL)
SELECT word, form, coalesce(tail, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""


@query
def op13_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)
